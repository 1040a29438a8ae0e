"""Models on streams: scoring, and cross products that take in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.partials import cross, gather
from ..plans import solve as S
from ..plans import spec
from ..plans.gamm import GAMM
from ..plans.model import Model


def score_stream(stream: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str, ci: bool = False, once: bool = True) -> StreamingQuery:
    """Predictions of each micro-batch go to ``sink(batch, number)``."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: sink(model.predict(batch, ci=ci), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Running:
    """Gaussian model whose cross products decay by ``keep`` with each batch and are solved on demand."""

    def __init__(self, model: GAMM, keep: float = 1.0) -> None:
        self.model, self.keep = model, keep
        d = model.designs[0]
        self.xx, self.xy, self.one = np.zeros((d.raw_width, d.raw_width)), np.zeros(d.raw_width), np.zeros(2)

    def update(self, batch: DataFrame, number: int = 0) -> None:
        design = self.model.designs[0]
        rows = spec.rows_of(batch, design, [self.model._response()])
        raw = design.raw_width

        def work(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            index, value = design.rows(block)
            y = block["y0"]
            return {"xx": cross(index, value, np.ones(len(y)), raw), "xy": np.bincount(index.ravel(), (value * y[:, None]).ravel(), raw), "one": np.array([y @ y, len(y)])}

        got = gather(rows, work, {"xx": (raw, raw), "xy": (raw,), "one": (2,)})
        self.xx, self.xy, self.one = (self.keep * a + got[k] for a, k in ((self.xx, "xx"), (self.xy, "xy"), (self.one, "one")))

    def solve(self) -> S.Fit:
        d = self.model.designs[0]
        return S.solve(d.map.T @ self.xx @ d.map, d.map.T @ self.xy, float(self.one[0]), float(self.one[1]), d.penalties())
