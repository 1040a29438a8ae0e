"""Additive models of one linear predictor: penalised iteratively weighted least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.families import ExtendedFamily, Family, Gaussian
from ..functions.linalg import penalised_qr
from ..functions.links import Identity
from ..operators import encode as enc
from ..operators.partials import Block, columns, cross, expand, gather, gather_qr
from ..session import ensure_importable
from . import solve as S
from . import spec
from .model import Model
from .terms import Formula


class GAMM(Model):
    """``GAMM(formula, family).fit(df)``; statistics are aggregated in Spark, the rest is on the driver."""

    def __init__(self, formula: Formula, family: Family | None = None) -> None:
        self.formula, self.family = formula, family or Gaussian()

    # rows -----------------------------------------------------------------------------------------
    def _response(self) -> Column:
        y = F.col(self.formula.lhs.variable)
        return self.formula.lhs.f(y.cast("double")) if self.formula.lhs.f else y

    def _rows(self, df: DataFrame, design: spec.Design, offset: str | None, rho: float | None) -> DataFrame:
        f = self.formula
        if offset is not None:
            df = df.withColumn("o_offset", F.col(offset).cast("double"))
        keep = ["o_offset"] if offset is not None else []
        if rho is None:
            return spec.rows_of(df, design, [self._response()], keep)
        if f.series is None or not f.order:
            raise ValueError("an AR(1) model needs the formula's series and order")
        keys = [f.series, *f.order]
        df = df.withColumns({f"_o{k}": F.col(c) for k, c in enumerate(keys)})
        rows = spec.rows_of(df, design, [self._response()], [*keep, *(f"_o{k}" for k in range(len(keys)))])
        own = Window.partitionBy("_o0").orderBy(*(f"_o{k}" for k in range(1, len(keys))))
        lag = [c for c in rows.columns if not c.startswith("_o")]
        rows = rows.withColumns({f"p_{c}": F.lag(c).over(own) for c in lag} | {"_first": F.row_number().over(own) == 1})
        return rows.drop(*(f"_o{k}" for k in range(len(keys))))

    def fit(self, df: DataFrame, max_outer: int = 200, conv_tol: float = 1e-7, offset: str | None = None, rho: float | None = None, lam: float | Sequence[float] = 1.1, fixed_lam: bool = False, find_nested: bool = True, encoding: enc.Encoding | None = None, method: str = "Chol", extension: str = "ratio", init_coef: np.ndarray | None = None) -> GAMM:
        """Estimate coefficients, smoothing parameters and scale.

        ``offset`` names a column; ``rho`` whitens the rows of each series by an AR(1) process;
        ``fixed_lam`` keeps all smoothing parameters at ``lam``, one number or one for each; ``init_coef``
        are coefficients of an earlier fit to start weighted steps from. ``method`` "QR" takes the coefficients
        of a Gaussian model from a QR decomposition of the rows, which costs one more pass and keeps the digits
        that cross products lose. ``extension``: how steps of the lambdas are lengthened, see ``StepControl``.
        """
        if method not in ("Chol", "QR"):
            raise ValueError(f"unknown method {method!r}")
        f, self._extension = self.formula, extension
        encoding = encoding or enc.learn(df, f.variables(), f.as_factor, f.codebook)
        design = spec.build(df, f, encoding)
        rows = self._rows(df, design, offset, rho).persist(StorageLevel.MEMORY_AND_DISK)
        self.designs, self.rho, self.offset = [design], rho, offset
        try:
            spec.settle(design, rows)
            linear = isinstance(self.family, Gaussian) and isinstance(self.family.link, Identity)
            if method == "QR" and not linear:
                raise ValueError("QR is for Gaussian models with the identity link")
            self.fitted = self._linear(rows, design, lam, fixed_lam, find_nested, method) if linear else self._weighted(rows, design, lam, fixed_lam, max_outer, conv_tol, init_coef)
        finally:
            rows.unpersist()
        return self

    @staticmethod
    def _white(design: spec.Design, block: Block, rho: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows and response, less their AR(1) prediction; the offset is taken off."""
        y = block["y0"] - block.get("o_offset", 0.0)
        index, value = design.rows(block)
        if rho is None:
            return index, value, y
        first = block["_first"].astype(bool)
        before = {k[2:]: np.where(first, block[k[2:]], v) for k, v in block.items() if k.startswith("p_")}
        old_index, old_value = design.rows(before)
        scale = 1 / np.sqrt(1 - rho**2)
        a, b = np.where(first, 1.0, scale), np.where(first, 0.0, -rho * scale)
        past = before["y0"] - before.get("o_offset", 0.0)
        return np.concatenate((index, old_index), axis=1), np.concatenate((value * a[:, None], old_value * b[:, None]), axis=1), a * y + b * past

    @staticmethod
    def _penalties(design: spec.Design, lam: float | Sequence[float]) -> list[S.Penalty]:
        found = design.penalties(lam=1.1 if np.ndim(lam) else lam)
        if np.ndim(lam):
            S.set_logs(found, np.log(np.asarray(lam, float)))
        return found

    def _linear(self, rows: DataFrame, design: spec.Design, lam: float | Sequence[float], fixed: bool, find_nested: bool, method: str) -> S.Fit:
        """Gaussian with identity link: one pass, then all is on the driver.

        The response is shifted by its mean, if there is an intercept, so that sums of squares keep
        their digits; the intercept gets the mean back.
        """
        rho = self.rho
        intercept = next((b.start for b in design.blocks if type(b.term).__name__ == "i"), None)
        shift = 0.0
        if intercept is not None and rho is None:
            shift = float(rows.agg(F.avg("y0")).first()[0] or 0.0)
        raw = design.raw_width

        def work(block: Block) -> dict[str, np.ndarray | float]:
            index, value, y = self._white(design, block, rho)
            y = y - shift
            jac = 0.0 if rho is None else float((~block["_first"].astype(bool)).sum()) * -0.5 * np.log(1 - rho**2)
            return {"xx": cross(index, value, np.ones(len(y)), raw), "xy": np.bincount(index.ravel(), (value * y[:, None]).ravel(), raw), "one": [float(y @ y), len(y), jac]}

        got = gather(rows, work, {"xx": (raw, raw), "xy": (raw,), "one": (3,)})
        a, b = design.map.T @ got["xx"] @ design.map, design.map.T @ got["xy"]
        if find_nested:
            spec.prune(design, a)
            a, b = design.map.T @ got["xx"] @ design.map, design.map.T @ got["xy"]
        yy, n, jac = got["one"]
        fit = S.solve(a, b, yy, n, self._penalties(design, lam), self.family.scale, fixed=fixed, extension=self._extension)
        if method == "QR":
            p = len(b)

            def tall(block: Block) -> np.ndarray:
                index, value, y = self._white(design, block, rho)
                return np.column_stack((expand(index, value, raw) @ design.map, y - shift))

            factor = gather_qr(rows, tall, p + 1)
            fit.coef = penalised_qr(factor[:, :p], factor[:, p], S.total(fit.penalties, p))
        rss = yy - 2 * float(fit.coef @ b) + float(fit.coef @ a @ fit.coef)
        if intercept is not None:
            fit.coef[intercept] += shift
        fit.deviance = rss
        fit.llk = -0.5 * (n * np.log(2 * np.pi * fit.scale) + rss / fit.scale) + jac
        centred = fit.coef.copy()
        if intercept is not None:
            centred[intercept] -= shift
        fit.reml = S.reml(fit.llk, a, centred, fit.scale, fit.penalties)
        return fit

    def _weighted(self, rows: DataFrame, design: spec.Design, lam: float | Sequence[float], fixed: bool, most: int, tol: float, start: np.ndarray | None = None) -> S.Fit:
        """A pass for each weighted step: working response and weights at the current coefficients.

        Rows with a useless weight or response leave that step. If the penalised deviance rises, one
        more pass finds the longest of several shortened steps that lowers it.
        """
        family, raw = self.family, design.raw_width
        penalties = self._penalties(design, lam)
        extended = isinstance(family, ExtendedFamily)

        def statistics(coef: np.ndarray | None, newton: bool = False) -> Callable[[Block], dict[str, np.ndarray | float]]:
            def work(block: Block) -> dict[str, np.ndarray | float]:
                y, off = block["y0"], block.get("o_offset", 0.0)
                index, value = design.rows(block)
                with np.errstate(all="ignore"):
                    eta = family.link.f(family.init_mu(y)) if coef is None else (value * (design.map @ coef)[index]).sum(axis=1) + off
                    mu = family.link.fi(eta)
                    z, w = family.newton(y, eta) if newton else family.working(y, eta)
                    dev, llk = family.D(y, mu), family.lp(y, mu, self._phi)
                good = np.isfinite(z) & np.isfinite(w) & ((w != 0) if newton else (w > 0))
                z, w = np.where(good, z - off, 0.0), np.where(good, w, 0.0)
                out = {"xx": cross(index, value, w, raw), "xz": np.bincount(index.ravel(), (value * (w * z)[:, None]).ravel(), raw), "one": [float((w * z * z).sum()), int(good.sum()), float(dev.sum()), float(llk.sum()), float((w * (z + off - eta) ** 2)[good].sum())]}
                if extended:
                    l0, g, h = family.theta_derivatives(y, mu)
                    out["theta"] = [l0, *g, *h.ravel()]
                return out

            return work

        sizes = {"xx": (raw, raw), "xz": (raw,), "one": (5,)}
        if extended:
            q = len(family.theta)
            sizes["theta"] = (1 + q + q * q,)
        self._phi = family.scale or 1.0
        coef, fit, before, old = None, None, np.inf, None
        for k in range(most):
            first = start if coef is None and start is not None and len(start) == design.n_coef else coef
            got = gather(rows, statistics(first), sizes)
            zz, n, dev, llk, chi = got["one"]
            if coef is not None:
                s = S.total(fit.penalties, len(coef))
                now = dev + float(coef @ s @ coef)
                if old is not None and now > before + 1e-7 * abs(before):
                    steps = 0.5 ** np.arange(1, 9)
                    tried = self._deviances(rows, design, [old + t * (coef - old) for t in steps])
                    pen = [d + float(c @ s @ c) for d, c in zip(tried, (old + t * (coef - old) for t in steps), strict=True)]
                    best = int(np.nanargmin(pen))
                    coef = old + steps[best] * (coef - old)
                    got = gather(rows, statistics(coef), sizes)
                    zz, n, dev, llk, chi = got["one"]
                    now = dev + float(coef @ s @ coef)
                if abs(before - now) < tol * abs(now) and lam_moved < 1e-3:
                    break
                before = now
                if extended:
                    self._update_theta(got["theta"])
            a, b = design.map.T @ got["xx"] @ design.map, design.map.T @ got["xz"]
            if coef is None:
                spec.prune(design, a)
                a, b = design.map.T @ got["xx"] @ design.map, design.map.T @ got["xz"]
                penalties = self._penalties(design, lam)
            logs = np.log([p.lam for p in penalties]) if penalties else np.zeros(1)
            fit = S.solve(a, b, zz, n, penalties, 1.0 if extended else family.scale, fixed=fixed, most=200 if coef is not None else 1, extension=self._extension)
            lam_moved = float(np.max(np.abs(np.log([p.lam for p in penalties]) - logs))) if penalties else 0.0
            old, coef = coef, fit.coef
            self._phi = fit.scale
        fit.coef, fit.iterations, fit.converged = coef, k + 1, k + 1 < most
        if family.scale is None:
            fit.scale = self._phi = chi / max(n - fit.edf, 1.0)
        last = gather(rows, statistics(coef), sizes)
        fit.deviance, fit.llk, fit.n = float(last["one"][2]), float(last["one"][3]), int(last["one"][1])
        observed = gather(rows, statistics(coef, newton=True), sizes)
        fit.info["observed_hessian"] = design.map.T @ observed["xx"] @ design.map
        fit.reml = S.reml(fit.llk, fit.hessian, coef, fit.scale, fit.penalties)
        return fit

    def _deviances(self, rows: DataFrame, design: spec.Design, coefs: list[np.ndarray]) -> np.ndarray:
        family, stack = self.family, np.stack([design.map @ c for c in coefs], axis=1)

        def work(block: Block) -> dict[str, np.ndarray]:
            index, value = design.rows(block)
            eta = np.einsum("nk,nkc->cn", value, stack[index]) + block.get("o_offset", 0.0)
            with np.errstate(all="ignore"):
                return {"dev": np.array([family.D(block["y0"], family.link.fi(e)).sum() for e in eta])}

        return gather(rows, work, {"dev": (len(coefs),)})["dev"]

    def _update_theta(self, stats: np.ndarray) -> None:
        """A Newton step with eigenvalue floor and bounded length."""
        q = len(self.family.theta)
        g, h = stats[1 : 1 + q], stats[1 + q :].reshape(q, q)
        value, vector = np.linalg.eigh(-h)
        value = np.maximum(np.abs(value), 1e-5 * max(np.abs(value).max(), 1e-300))
        step = vector @ ((vector.T @ g) / value)
        self.family.theta = self.family.theta + step / max(1.0, np.abs(step).max() / 0.5)

    # results ----------------------------------------------------------------------------------------
    def get_resid(self, df: DataFrame, kind: str = "Pearson", keep: Sequence[str] = ()) -> DataFrame:
        """``fit`` on the response scale and ``resid`` (Pearson, Deviance or ar1) of each usable row."""
        design, family, rho, coef = self.designs[0], self.family, self.rho, self.fitted.coef
        if kind == "ar1" and rho is None:
            raise ValueError("the model has no AR(1) process")
        if kind not in ("Pearson", "Deviance", "ar1"):
            raise ValueError(f"unknown residual type {kind!r}")
        df = df.withColumns({f"_k{k}": F.col(c) for k, c in enumerate(keep)})
        if kind == "ar1":
            rows = self._rows(df, design, self.offset, rho)
        else:
            df = df.withColumn("o_offset", F.col(self.offset).cast("double")) if self.offset else df
            rows = spec.rows_of(df, design, [self._response()], [*(["o_offset"] if self.offset else []), *(f"_k{k}" for k in range(len(keep)))])
        ensure_importable(df.sparkSession)
        kept = [] if kind == "ar1" else list(keep)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = columns(batch.select([c for c in batch.schema.names if not c.startswith("_k")]))
                if kind == "ar1":
                    index, value, y = GAMM._white(design, block, rho)
                    mu = (value * (design.map @ coef)[index]).sum(axis=1)
                    res = y - mu
                else:
                    mu = family.link.fi(design.predictor(block, coef) + block.get("o_offset", 0.0))
                    res = family.residual(block["y0"], mu, kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(f"_k{k}") for k in range(len(kept))), pa.array(mu), pa.array(res)], [*kept, "fit", "resid"])

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
        return rows.mapInArrow(work, f"{kinds}fit double, resid double")

    def get_llk(self) -> float:
        return self.fitted.llk

    def get_reml(self) -> float:
        return self.fitted.reml
