"""Gaussian additive models with one grouping factor of very many levels.

The normal equations are an arrow: a small block of shared coefficients and one small block for
each level. The levels' cross products stay in Spark as a table of one row a level; each update of
the smoothing parameters is one pass that eliminates the levels where they are and sends sums of
the shared size to the driver. Nothing grows with the number of levels but that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.linalg import inverse_factor
from ..operators import encode as enc
from ..operators.partials import columns, cross, expand, gather
from ..session import ensure_importable
from . import solve as S
from . import spec
from .model import Model
from .terms import Formula, f, ri


class ArrowGAMM(Model):
    """``formula`` holds the shared terms; ``big`` is a random intercept or a factor smooth."""

    def __init__(self, formula: Formula, big: ri | f) -> None:
        self.formula, self.big = formula, big
        self.level = big.variable if isinstance(big, ri) else big.by

    def fit(self, df: DataFrame, lam: float = 1.1, most: int = 100, tol: float = 1e-6, fixed_lam: bool = False) -> ArrowGAMM:
        shared, level = self.formula, self.level
        inner = Formula(shared.lhs, [] if isinstance(self.big, ri) else [f(**{**self.big.__dict__, "by": None, "id": None})], as_factor=shared.as_factor)
        both = list(dict.fromkeys([*shared.variables(), *inner.variables()]))
        encoding = enc.learn(df, both, shared.as_factor, shared.codebook)
        self.designs = [spec.build(df, shared, encoding)]
        own = spec.build(df, inner, encoding)
        wide = spec.Design(shared, encoding, [*self.designs[0].blocks, *own.blocks])
        y = F.col(shared.lhs.variable)
        df = df.withColumn("_level", F.col(level).cast("string")).where(F.col("_level").isNotNull())
        rows = spec.rows_of(df, wide, [shared.lhs.f(y.cast("double")) if shared.lhs.f else y], ["_level"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spec.settle(self.designs[0], rows)
            spec.settle(own, rows)
            self.own = own
            table = self._blocks(rows).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                self._solve(rows, table, lam, most, tol, fixed_lam)
                self.levels = self._levels(table)
            finally:
                table.unpersist()
        finally:
            rows.unpersist()
        return self

    def _size(self) -> int:
        return 1 if isinstance(self.big, ri) else self.own.n_coef

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """(level, n, own cross product, cross product with the shared columns, own right-hand side).

        Partial products of each task are made first and added by level afterwards, so a level with a
        third of all rows is no single task's work.
        """
        design, own, k, raw = self.designs[0], self.own, self._size(), self.designs[0].raw_width
        single = isinstance(self.big, ri)
        size = k * k + k * design.n_coef + k + 1
        ensure_importable(rows.sparkSession)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = columns(batch)
                names, back = np.unique(block["_level"].astype(str), return_inverse=True)
                index, value = design.rows(block)
                x = expand(index, value, raw) @ design.map
                z = np.ones((len(x), 1)) if single else own.matrix(block)
                y = block["y0"]
                order = np.argsort(back, kind="stable")
                cuts = np.append(np.searchsorted(back[order], np.arange(len(names))), len(order))
                stats = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    r = order[a:b]
                    stats.append(np.concatenate(((z[r].T @ z[r]).ravel(), (z[r].T @ x[r]).ravel(), z[r].T @ y[r], [len(r)])))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([s.tolist() for s in stats], pa.list_(pa.float64()))], ["level", "stats"])

        parts = rows.mapInArrow(work, "level string, stats array<double>")
        sums = F.array(*[F.sum(F.col("stats")[j]) for j in range(size)])
        return parts.groupBy("level").agg(sums.alias("stats"))

    def _unpack(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, p = self._size(), self.designs[0].n_coef
        a, c, b = stats[:, : k * k], stats[:, k * k : k * k + k * p], stats[:, k * k + k * p : -1]
        return a.reshape(-1, k, k), c.reshape(-1, k, p), b, stats[:, -1]

    def _penalties(self) -> list[np.ndarray]:
        return [np.eye(1)] if isinstance(self.big, ri) else self.own.blocks[0].penalties

    def _solve(self, rows: DataFrame, table: DataFrame, lam: float, most: int, tol: float, fixed: bool) -> None:
        design, raw = self.designs[0], self.designs[0].raw_width

        def work(block: dict[str, np.ndarray]) -> dict[str, np.ndarray | float]:
            index, value = design.rows(block)
            y = block["y0"]
            return {"xx": cross(index, value, np.ones(len(y)), raw), "xy": np.bincount(index.ravel(), (value * y[:, None]).ravel(), raw), "one": [float(y @ y), len(y)]}

        got = gather(rows, work, {"xx": (raw, raw), "xy": (raw,), "one": (2,)})
        a0, b0 = design.map.T @ got["xx"] @ design.map, design.map.T @ got["xy"]
        yy, n = got["one"]
        penalties, mats = design.penalties(lam=lam), self._penalties()
        own = np.full(len(mats), lam)
        p, k, count = design.n_coef, self._size(), table.count()
        previous = np.inf
        for it in range(most):
            sums = self._eliminate(table, own, p, k, len(mats))
            schur = a0 - sums["ce"]
            lvi, _ = inverse_factor(schur + S.total(penalties, p))
            v = lvi.T @ lvi
            coef = v @ (b0 - sums["cu"])
            up = np.array([np.trace(m @ np.linalg.pinv(sum(w * q for w, q in zip(own, mats, strict=True)), rcond=1e-12)) * count for m in mats])
            down = np.array([sums["tr"][j] + float((v * sums["ese"][j].T).sum()) for j in range(len(mats))])
            quad = np.array([sums["usu"][j] - 2 * float(coef @ sums["esu"][j]) + float(coef @ sums["ese"][j] @ coef) for j in range(len(mats))])
            lgdet, ldet, bsb, _, _ = S.traces(penalties, v, coef)
            edf = p + k * count - float(own @ down) - sum(t.lam * x for t, x in zip(penalties, ldet, strict=True))
            fit_by = float(coef @ b0) + sums["ub"][0] - float(coef @ sums["eb"])
            rss = max(yy - fit_by - float(own @ quad) - sum(t.lam * x for t, x in zip(penalties, bsb, strict=True)), 1e-300)
            scale = rss / max(n - edf, 1.0)
            if fixed or abs(previous - edf) < tol * max(edf, 1.0) or it + 1 == most:
                break
            previous = edf
            S.step_lambda(penalties, v, coef, scale)
            ratio = scale * np.maximum(up - down, 0) / np.maximum(quad, 1e-300)
            own = np.clip(own * ratio, S.LOW, S.HIGH)
        self.own_lam = own
        _, each = S.edf_of(penalties, v, schur)
        self.fitted = S.Fit(coef, lvi, scale, edf, [*S.term_edf(each, penalties), edf - float(each.sum())], penalties, schur, n=int(n), converged=it + 1 < most, iterations=it + 1)
        self.fitted.deviance, self.fitted.llk = rss, -0.5 * (n * np.log(2 * np.pi * scale) + rss / scale)

    def _eliminate(self, table: DataFrame, own: np.ndarray, p: int, k: int, q: int) -> dict[str, np.ndarray]:
        mats, unpack = self._penalties(), self._unpack
        s = sum(w * m for w, m in zip(own, mats, strict=True))

        def work(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            a, c, b, _ = unpack(np.stack(block["stats"]))
            inv = np.linalg.inv(a + s)
            e, u = inv @ c, np.einsum("gij,gj->gi", inv, b)
            return {
                "ce": np.einsum("gkp,gkr->pr", c, e),
                "cu": np.einsum("gkp,gk->p", c, u),
                "ub": np.array([np.einsum("gk,gk->", u, b)]),
                "eb": np.einsum("gkp,gk->p", e, b),
                "tr": np.array([np.einsum("gij,ji->", inv, m) for m in mats]),
                "usu": np.array([np.einsum("gi,ij,gj->", u, m, u) for m in mats]),
                "esu": np.stack([np.einsum("gip,ij,gj->p", e, m, u) for m in mats]),
                "ese": np.stack([np.einsum("gip,ij,gjr->pr", e, m, e) for m in mats]),
            }

        return gather(table, work, {"ce": (p, p), "cu": (p,), "ub": (1,), "eb": (p,), "tr": (q,), "usu": (q,), "esu": (q, p), "ese": (q, p, p)})

    def _levels(self, table: DataFrame) -> DataFrame:
        """(level, n, coef): the levels' own coefficients."""
        mats, unpack, coef = self._penalties(), self._unpack, self.fitted.coef
        s = sum(w * m for w, m in zip(self.own_lam, mats, strict=True))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, c, b, n = unpack(np.stack([np.array(v) for v in batch.column("stats").to_pylist()]))
                    own = np.linalg.solve(a + s, (b - c @ coef)[:, :, None])[:, :, 0]
                    yield pa.RecordBatch.from_arrays([batch.column("level"), pa.array(n.astype(np.int64)), pa.array(own.tolist(), pa.list_(pa.float64()))], ["level", "n", "coef"])

        out = table.mapInArrow(work, "level string, n long, coef array<double>").persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
