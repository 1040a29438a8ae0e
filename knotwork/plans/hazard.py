"""Proportional hazards with Breslow ties, baseline hazard and survival.

Risk sets are sums over rows of later times. Rows are range-partitioned by descending time, so ties
stay together; one pass sums each partition, the driver adds up those of later times (as many rows
as partitions), and a second pass does the rest inside the partitions. No table of all times is
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import encode as enc
from ..operators.partials import columns, gather
from ..session import ensure_importable
from . import solve as S
from . import spec
from .model import Model
from .terms import Formula


class PropHaz(Model):
    """``PropHaz(formula, event)``: the formula's response is the time, ``event`` a 0/1 column."""

    def __init__(self, formula: Formula, event: str) -> None:
        self.formula, self.event = formula, event

    def _rows(self, df: DataFrame) -> DataFrame:
        f = self.formula
        rows = spec.rows_of(df, self.designs[0], [F.col(f.lhs.variable), F.col(self.event)])
        return rows.repartitionByRange(F.desc("y0")).sortWithinPartitions(F.desc("y0"))

    def fit(self, df: DataFrame, max_outer: int = 50, max_inner: int = 20, tol: float = 1e-8, lam: float = 10.0) -> PropHaz:
        f = self.formula
        encoding = enc.learn(df, f.variables(), f.as_factor, f.codebook)
        self.designs = [spec.build(df, f, encoding)]
        rows = self._rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spec.settle(self.designs[0], rows)
            self._fit(rows, max_outer, max_inner, tol, lam)
        finally:
            rows.unpersist()
        return self

    def at(self, df: DataFrame, coef: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Partial log-likelihood, gradient and Hessian at given coefficients, which become the model's."""
        f, coef = self.formula, np.asarray(coef, float)
        self.designs = [spec.build(df, f, enc.learn(df, f.variables(), f.as_factor, f.codebook))]
        rows = self._rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spec.settle(self.designs[0], rows)
            llk, grad, hess = self.evaluate(rows, coef)
            lvi = np.linalg.pinv(np.linalg.cholesky(-hess + 1e-12 * np.eye(len(coef))))
            self.fitted = S.Fit(coef, lvi, 1.0, float(len(coef)), [], [], -hess, llk=llk, n=rows.count())
        finally:
            rows.unpersist()
        return llk, grad, hess

    def _before(self, rows: DataFrame, coef: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
        """(smallest time, risk sum, weighted covariates) of each partition, latest times first."""
        design, p = self.designs[0], len(coef)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, g, gx = np.inf, 0.0, np.zeros(p)
            for batch in batches:
                block = columns(batch)
                x = design.matrix(block)
                e = np.exp(x @ coef)
                low, g, gx = min(low, float(block["y0"].min())), g + float(e.sum()), gx + e @ x
            if np.isfinite(low):
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([g]), pa.array([gx.tolist()], pa.list_(pa.float64()))], ["low", "g", "gx"])

        found = rows.mapInArrow(work, "low double, g double, gx array<double>").collect()  # a row a partition
        return sorted(((r["low"], r["g"], np.array(r["gx"])) for r in found), reverse=True, key=lambda r: r[0])

    def evaluate(self, rows: DataFrame, coef: np.ndarray, second: bool = True) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Partial log-likelihood, gradient and Hessian."""
        design, p = self.designs[0], len(coef)
        totals = self._before(rows, coef)

        def work(block: dict[str, np.ndarray]) -> dict[str, np.ndarray | float]:
            t, d = block["y0"], block["y1"]
            x = design.matrix(block)
            eta = x @ coef
            e = np.exp(eta)
            later = [r for r in totals if r[0] > t.max()]
            g0, gx0 = sum(r[1] for r in later), sum((r[2] for r in later), np.zeros(p))
            ends = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)  # last row of each time
            g = np.cumsum(e)[ends] + g0
            gx = np.cumsum(e[:, None] * x, axis=0)[ends] + gx0
            deaths = np.diff(np.append(0, np.cumsum(d)[ends]))
            mean = gx / g[:, None]
            out = {"llk": float((d * eta).sum() - (deaths * np.log(g)).sum()), "grad": x.T @ d - deaths @ mean}
            if second:
                # sum over events of the risk set's second moment: cumulated like the first
                starts = np.append(0, ends[:-1] + 1)
                weight = np.zeros(len(ends))
                weight[:] = np.cumsum((deaths / g)[::-1])[::-1]
                each = np.repeat(weight, ends - starts + 1)
                out["inner"] = (x * (e * each)[:, None]).T @ x
                out["outer"] = (mean * deaths[:, None]).T @ mean
                # rows of later partitions are in this partition's risk sets as well
                out[f"carry{totals_index(totals, t.max())}"] = float((deaths / g).sum())
            return out

        def totals_index(rows_: list, high: float) -> int:
            return sum(r[0] > high for r in rows_)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ..operators.partials import _entries

            table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
            got = work(columns(table)) if table is not None else {}
            yield _entries({k: np.atleast_1d(np.asarray(v, float)).ravel() for k, v in got.items()})

        ensure_importable(rows.sparkSession)
        parts = rows.mapInArrow(whole, "name string, place long, value double").groupBy("name", "place").agg(F.sum("value").alias("value")).toArrow()
        names, place, value = np.array(parts.column("name").to_pylist(), object), parts.column("place").to_numpy(), parts.column("value").to_numpy()

        def read(name: str, size: int) -> np.ndarray:
            out = np.zeros(size)
            out[place[names == name]] = value[names == name]
            return out

        llk, grad = float(read("llk", 1)[0]), read("grad", p)
        if not second:
            return llk, grad, None
        hess = read("inner", p * p).reshape(p, p) - read("outer", p * p).reshape(p, p)
        carry = np.array([read(f"carry{k}", 1)[0] for k in range(len(totals))])
        after = np.append(np.cumsum(carry[::-1])[::-1][1:], 0.0)  # what earlier times add to each partition's rows
        if np.any(after):
            lows = np.array([r[0] for r in totals])

            def extra(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
                x = design.matrix(block)
                k = np.sum(lows[None] > block["y0"][:, None], axis=1)
                return {"h": (x * (np.exp(x @ coef) * after[k])[:, None]).T @ x}

            hess = hess + gather(rows, extra, {"h": (p, p)})["h"]
        return llk, grad, -(hess + hess.T) / 2

    def _fit(self, rows: DataFrame, outer: int, inner: int, tol: float, lam: float) -> None:
        from ..functions.linalg import inverse_factor

        design = self.designs[0]
        penalties, coef = design.penalties(lam=lam), np.zeros(design.n_coef)
        last, control = None, S.StepControl(penalties)
        for k in range(outer):
            s = S.total(penalties, len(coef))
            old, before = None, -np.inf
            for _ in range(inner):
                llk, grad, hess = self.evaluate(rows, coef)
                value = llk - 0.5 * float(coef @ s @ coef)
                if old is not None and value < before - 1e-10 * abs(before):  # too far: half the step
                    coef = (old + coef) / 2
                    continue
                gain, old, before = value - before, coef, value
                if gain < tol * abs(value):
                    break
                lvi, _ = inverse_factor(-hess + s)
                coef = coef + lvi.T @ (lvi @ (grad - s @ coef))
            else:
                coef = old
                llk, _, hess = self.evaluate(rows, coef)
            lvi, _ = inverse_factor(-hess + s)
            edf, each = S.edf_of(penalties, lvi.T @ lvi, -hess)
            if penalties and k and not control.judge(lvi.T @ lvi, coef, 1.0):
                last = edf
                continue
            moved = control.step(lvi.T @ lvi, coef, 1.0) if penalties else 0.0
            if moved < 1e-6 or (last is not None and abs(edf - last) < 1e-3):
                break
            last = edf
        self.fitted = S.Fit(coef, lvi, 1.0, edf, S.term_edf(each, penalties), penalties, -hess, llk=llk, n=rows.count(), converged=k + 1 < outer, iterations=k + 1)
        self.fitted.reml = S.reml(llk, -hess, coef, 1.0, penalties)

    # hazard and survival --------------------------------------------------------------------------
    def baseline(self, df: DataFrame) -> DataFrame:
        """``time``, ``deaths``, ``risk`` and cumulative baseline ``hazard`` of each distinct time."""
        return cumulative_hazard(self.risk(df))

    def risk(self, df: DataFrame) -> DataFrame:
        """``time``, ``deaths`` and ``own``, the summed relative risks of the rows of that time."""
        scored = self.predict(df).where(F.col("fit").isNotNull())
        return scored.groupBy(F.col(self.formula.lhs.variable).cast("double").alias("time")).agg(F.sum(F.col(self.event).cast("double")).alias("deaths"), F.sum(F.exp("fit")).alias("own"))

    def survival(self, df: DataFrame, new: DataFrame, time: str) -> DataFrame:
        """``new`` with ``survival`` at its column ``time``: the next event time not before it counts."""
        scored = self.predict(new).withColumnRenamed("fit", "_fit")
        met = next_time(scored, self.baseline(df).select("time", "hazard"), time)
        return met.withColumn("survival", F.exp(-F.col("hazard") * F.exp("_fit"))).drop("_fit", "hazard")

    def get_resid(self, df: DataFrame, kind: str = "Martingale") -> DataFrame:
        """``df`` with ``resid``: Martingale or Deviance."""
        if kind not in ("Martingale", "Deviance"):
            raise ValueError(f"unknown residual type {kind!r}")
        delta = F.col(self.event).cast("double")
        scored = self.survival(df, df, self.formula.lhs.variable)
        m = delta + F.log("survival")
        if kind == "Deviance":
            inner = m + F.when(delta > 0, delta * F.log(delta - m)).otherwise(0.0)
            m = F.signum(m) * F.sqrt(F.greatest(-2 * inner, F.lit(0.0)))
        return scored.withColumn("resid", m).drop("survival")


def running(rows: DataFrame, key: str, value: str, to: str, descending: bool, chunks: int = 64) -> DataFrame:
    """Running sum of ``value`` along ``key``, in two levels: inside ranges of the key, and over the ranges."""
    edges = rows.approxQuantile(key, [k / chunks for k in range(1, chunks)], 0.01) if chunks > 1 else []
    bucket = F.lit(0)
    for e in sorted(set(edges)):
        bucket = bucket + (F.col(key) > e).cast("int")
    parts = rows.withColumn("_bucket", bucket)
    sums = parts.groupBy("_bucket").agg(F.sum(value).alias("_sum"))  # at most ``chunks`` rows
    side = F.desc if descending else F.asc
    over = Window.orderBy(side("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(over), F.lit(0.0)).alias("_before"))
    own = Window.partitionBy("_bucket").orderBy(side(key)).rangeBetween(Window.unboundedPreceding, 0)
    met = parts.withColumn("_own", F.sum(value).over(own)).join(F.broadcast(before), F.col("_bucket") == F.col("_b"))
    return met.withColumn(to, F.col("_own") + F.col("_before")).drop("_bucket", "_b", "_own", "_before")


def cumulative_hazard(per_time: DataFrame) -> DataFrame:
    """``risk`` (sum over later times and itself) and ``hazard`` from (time, deaths, own)."""
    risk = running(per_time, "time", "own", "risk", descending=True)
    return running(risk.withColumn("_step", F.col("deaths") / F.col("risk")), "time", "_step", "hazard", descending=False).drop("_step", "own")


def next_time(rows: DataFrame, table: DataFrame, time: str) -> DataFrame:
    """As-of join: each row gets the table's row of the smallest time that is not before its own.

    Both sides are put in one order by time and the next table value is carried back, so no row meets
    more than one other; beyond the last time the last row counts.
    """
    extra = [c for c in table.columns if c != "time"]
    left = rows.select(F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in extra])
    right = table.select(F.col("time").alias("_t"), F.lit(2).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *extra)
    both = left.unionByName(right)
    edges = sorted(set(table.approxQuantile("time", [k / 64 for k in range(1, 64)], 0.01)))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("_t") > e).cast("int")
    both = both.withColumn("_bucket", bucket)
    ahead = Window.partitionBy("_bucket").orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    firsts = table.withColumnRenamed("time", "_t").withColumn("_bucket", bucket).groupBy("_bucket").agg(F.min_by(F.struct(*extra), "_t").alias("_first"))
    low = Window.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    grid = rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("_b"))
    carry = grid.join(firsts, F.col("_b") == F.col("_bucket"), "left").drop("_bucket").withColumnRenamed("_b", "_bucket")
    carry = carry.withColumn("_next", F.first("_first", ignorenulls=True).over(low)).select(F.col("_bucket").alias("_b"), "_next")
    last = table.agg(F.max_by(F.struct(*extra), "time")).first()[0]  # one row
    met = both.withColumn("_own", F.first(F.when(F.col("_side") == 2, F.struct(*extra)), ignorenulls=True).over(ahead)).where("_side = 1")
    met = met.join(F.broadcast(carry), F.col("_bucket") == F.col("_b"))  # 64 rows
    return met.select("_row.*", *[F.coalesce(F.col(f"_own.{c}"), F.col(f"_next.{c}"), F.lit(None if last is None else last[c])).alias(c) for c in extra])
