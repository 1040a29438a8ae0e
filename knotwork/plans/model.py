"""What all fitted models share: prediction, posterior draws, intervals, differences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import draw_normal
from ..functions.special import normal_ppf
from ..operators.partials import columns
from ..session import ensure_importable
from .solve import Fit
from .spec import Design, rows_of


class Model:
    """``designs``: one for each linear predictor; ``splits``: where its coefficients begin."""

    designs: list[Design]
    fitted: Fit

    @property
    def splits(self) -> list[int]:
        at = [0]
        for d in self.designs:
            at.append(at[-1] + d.n_coef)
        return at

    def _part(self, par: int) -> slice:
        return slice(self.splits[par], self.splits[par + 1])

    def get_pars(self) -> tuple[np.ndarray, float]:
        return self.fitted.coef, self.fitted.scale

    def coef_table(self) -> pd.DataFrame:
        """One row for each coefficient."""
        se = np.sqrt(np.maximum((self.fitted.lvi**2).sum(axis=0) * self.fitted.scale, 0))
        return pd.DataFrame([(par, n, float(self.fitted.coef[k]), float(se[k])) for par, d in enumerate(self.designs) for k, n in enumerate(d.names, self.splits[par])], columns=["par", "name", "estimate", "se"])

    def get_mmat(self, df: DataFrame, par: int = 0, use_terms: Sequence[int] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Sparse model matrix: ``idx`` and ``val`` arrays of each row, in coefficients."""
        design = self.designs[par]
        rows = rows_of(df, design, keep=keep, drop_null=True)
        ensure_importable(df.sparkSession)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = design.matrix(columns(batch), use_terms)
                full = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f.astype(np.int32) for f in full], pa.list_(pa.int32())), pa.array([r[f] for r, f in zip(x, full, strict=True)], pa.list_(pa.float64()))], [*keep, "idx", "val"])

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
        return rows.mapInArrow(work, f"{kinds}idx array<int>, val array<double>")

    def predict(self, df: DataFrame, use_terms: Sequence[int] | None = None, alpha: float = 0.05, ci: bool = False, whole_interval: bool = False, n_ps: int = 10_000, seed: int | None = None, par: int = 0) -> DataFrame:
        """``df`` with ``fit`` and, if ``ci``, ``se``, ``lower`` and ``upper``.

        ``whole_interval``: the band covers the whole function. A row with a null or an unseen level of
        a variable gets what its other columns give; a null numeric value gives a null fit.
        """
        design, part = self.designs[par], self._part(par)
        coef, factor = self.fitted.coef[part], self.fitted.lvi[:, part] * np.sqrt(self.fitted.scale)
        z = float(normal_ppf(1 - alpha / 2)[0])
        if ci and whole_interval:
            z = self.band(df, use_terms, alpha, n_ps, seed, par)
        names = [c for c in df.columns]
        taken = {"fit", "se", "lower", "upper"} & set(names)
        if taken:
            raise ValueError(f"the table has columns named {sorted(taken)}")
        row = df.withColumns({f"_k{k}": F.col(c) for k, c in enumerate(names)})
        rows = rows_of(row, design, keep=[f"_k{k}" for k in range(len(names))], drop_null=False)
        need = [c for c in rows.columns if not c.startswith("_k")]
        ensure_importable(df.sparkSession)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = columns(batch.select(need)) if need else {"_": np.zeros(batch.num_rows)}
                gone = np.zeros(batch.num_rows, bool)
                for c in need:
                    if c.startswith("n_"):
                        gone |= np.isnan(block[c])
                out = [batch.column(f"_k{k}") for k in range(len(names))]
                if ci:
                    x = design.matrix(block, use_terms)
                    fit, se = x @ coef, np.sqrt(np.maximum(((x @ factor.T) ** 2).sum(axis=1), 0))
                    made = [fit, se, fit - z * se, fit + z * se]
                else:
                    made = [design.predictor(block, coef, use_terms)]
                out += [pa.array(v, mask=gone) for v in made]
                yield pa.RecordBatch.from_arrays(out, [*names, *(["fit", "se", "lower", "upper"] if ci else ["fit"])])

        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
        return rows.mapInArrow(work, f"{kinds}, fit double" + ", se double, lower double, upper double" * ci)

    def sample_post(self, n_ps: int, deviations: bool = False, seed: int | None = None, par: int | None = None) -> np.ndarray:
        """Draws of the coefficients, one a column."""
        part = slice(None) if par is None else self._part(par)
        mean = np.zeros_like(self.fitted.coef) if deviations else self.fitted.coef
        return draw_normal(n_ps, mean, self.fitted.lvi, self.fitted.scale, seed).T[part]

    def band(self, df: DataFrame, use_terms: Sequence[int] | None = None, alpha: float = 0.05, n_ps: int = 10_000, seed: int | None = None, par: int = 0) -> float:
        """Factor of the standard error for a band that holds the whole function.

        For each draw the largest standardised deviation over all rows is taken inside the tasks and
        then over tasks; the quantile over draws is exact.
        """
        design, part = self.designs[par], self._part(par)
        draws = self.sample_post(n_ps, True, seed, par)
        factor = self.fitted.lvi[:, part] * np.sqrt(self.fitted.scale)
        rows = rows_of(df, design)
        ensure_importable(df.sparkSession)

        return self._widest(rows, lambda batch: design.matrix(columns(batch), use_terms), factor, draws, alpha)

    @staticmethod
    def _widest(rows: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray], factor: np.ndarray, draws: np.ndarray, alpha: float) -> float:
        n_ps = draws.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(n_ps)
            for batch in batches:
                x = matrix(batch)
                for lo in range(0, len(x), 512):
                    part = x[lo : lo + 512]
                    se = np.sqrt(((part @ factor.T) ** 2).sum(axis=1))
                    ok = se > 0
                    if ok.any():
                        most = np.maximum(most, np.abs(part[ok] @ draws / se[ok, None]).max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_ps)), pa.array(most)], ["draw", "most"])

        top = rows.mapInArrow(work, "draw long, most double").groupBy("draw").agg(F.max("most").alias("most")).toPandas()  # n_ps rows
        return float(np.quantile(top["most"], 1 - alpha))

    def predict_diff(self, df1: DataFrame, df2: DataFrame, on: Sequence[str], use_terms: Sequence[int] | None = None, alpha: float = 0.05, par: int = 0, whole_interval: bool = False, n_ps: int = 10_000, seed: int | None = None) -> DataFrame:
        """Difference of two tables' predictions, rows matched by the key ``on``, with its interval.

        ``whole_interval``: the band covers the whole difference.
        """
        design, part = self.designs[par], self._part(par)
        coef, factor = self.fitted.coef[part], self.fitted.lvi[:, part] * np.sqrt(self.fitted.scale)
        keys = [f"_k{k}" for k in range(len(on))]
        one, two = (rows_of(d.withColumns({k: F.col(c) for k, c in zip(keys, on, strict=True)}), design, keep=keys, drop_null=True) for d in (df1, df2))
        need = [c for c in one.columns if c not in keys]
        both = one.join(two.withColumnsRenamed({c: f"{c}_2" for c in need}), keys)
        ensure_importable(df1.sparkSession)

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            def side(tail: str) -> np.ndarray:
                block = {c: batch.column(f"{c}{tail}").to_numpy(zero_copy_only=False) for c in need} or {"_": np.zeros(batch.num_rows)}
                return design.matrix(block, use_terms)

            return side("") - side("_2")

        z = float(normal_ppf(1 - alpha / 2)[0])
        if whole_interval:
            z = self._widest(both, matrix, factor, self.sample_post(n_ps, True, seed, par), alpha)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch)
                diff, se = x @ coef, np.sqrt(np.maximum(((x @ factor.T) ** 2).sum(axis=1), 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(v) for v in (diff, se, diff - z * se, diff + z * se))], [*on, "diff", "se", "lower", "upper"])

        kinds = "".join(f"`{c}` {df1.schema[c].dataType.simpleString()}, " for c in on)
        return both.mapInArrow(work, f"{kinds}diff double, se double, lower double, upper double")

    def write_mmat(self, df: DataFrame, path: str, par: int = 0, keep: Sequence[str] = ()) -> None:
        """Write the sparse model matrix as Parquet, with the columns ``keep``, for later reads."""
        self.get_mmat(df, par, keep=keep).write.parquet(path)

    def info(self) -> dict[str, Any]:
        f = self.fitted
        return {"converged": f.converged, "iterations": f.iterations, "n": f.n, "edf": f.edf, "scale": f.scale, "llk": f.llk, "reml": f.reml, "dropped": [d.dropped for d in self.designs]}


def read_mmat(spark: SparkSession, path: str) -> DataFrame:
    """A model matrix that ``write_mmat`` wrote: ``idx`` and ``val`` arrays of each row, and what it kept."""
    return spark.read.parquet(path)
