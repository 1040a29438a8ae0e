"""Models of several linear predictors: location-scale-shape and general likelihoods.

A likelihood is a sum over blocks of rows, over whole series, or over rows ordered by time; each
Newton step takes one pass for gradient and Hessian and one that tries several step lengths at once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.families import ExtendedFamily, Family, GAMLSSFamily
from ..functions.linalg import dependent_columns, inverse_factor
from ..functions.quasi import LimitedMemory, lbfgs, sampled_pairs
from ..operators import encode as enc
from ..operators.partials import Block, columns, gather, in_series
from ..session import ensure_importable
from . import solve as S
from . import spec
from .model import Model
from .spec import Penalty
from .terms import Formula

STEPS = 0.5 ** np.arange(0, 12)


def finite(v: np.ndarray | float) -> np.ndarray:
    return np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0)


def each_series(ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    for a, b in zip(starts, [*starts[1:], len(ys[0])], strict=True):
        yield [y[a:b] for y in ys], [x[a:b] for x in xs]


class GSMMFamily(ABC):
    """A likelihood of several linear predictors and ``extra`` further coefficients.

    ``llk(coef, splits, ys, xs)`` is the part of one block: rows (``shape`` "rowwise") or a whole
    series ("grouped"). Without ``gradient`` or ``hessian`` differences are used, all of them in one pass.
    A grouped family can do many series at once: see ``series_llks`` and ``series_gradient``.
    """

    shape = "rowwise"
    extra = 0

    def __init__(self, pars: int, links: list) -> None:
        self.n_par, self.links = pars, links

    @abstractmethod
    def llk(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> float: ...

    def llks(self, coefs: Sequence[np.ndarray], splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        """``llk`` at several coefficients; a family whose recursion is costly can do them together."""
        return np.array([self.llk(c, splits, ys, xs) for c in coefs])

    def series_llks(self, coefs: Sequence[np.ndarray], splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """``llks`` of several whole series, one after the other from the rows ``starts``: (series, coefs)."""
        return np.stack([self.llks(coefs, splits, *part) for part in each_series(ys, xs, starts)])

    def series_gradient(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Sum of their gradients, if the family has one."""
        return np.sum([finite(self.gradient(coef, splits, *part)) for part in each_series(ys, xs, starts)], axis=0)

    gradient: Callable | None = None
    hessian: Callable | None = None
    #: Whether ``llks`` costs little more than ``llk``, so that second differences come from it.
    batched = False

    def init_coef(self, splits: list[int]) -> np.ndarray | None:
        return None

    @staticmethod
    def etas(coef: np.ndarray, splits: list[int], xs: list[np.ndarray]) -> list[np.ndarray]:
        return [x @ coef[a:b] for x, a, b in zip(xs, splits[:-1], splits[1:], strict=True)]


class Adapter(GSMMFamily):
    """A location-scale-shape family as a general one."""

    def __init__(self, family: GAMLSSFamily) -> None:
        super().__init__(family.n_par, family.links)
        self.family = family

    def llk(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> float:
        with np.errstate(all="ignore"):
            v = self.family.lp(ys[0], *self.family.means(self.etas(coef, splits, xs)))
        return float(v.sum()) if np.isfinite(v).all() else float("-inf")

    def gradient(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            first, _ = self.family.derivatives(ys[0], self.etas(coef, splits, xs))
        return np.concatenate([x.T @ d for x, d in zip(xs, first, strict=True)])

    def hessian(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        with np.errstate(all="ignore"):
            _, second = self.family.derivatives(ys[0], self.etas(coef, splits, xs))
        out = np.zeros((len(coef), len(coef)))
        for i, x in enumerate(xs):
            for j in range(i, len(xs)):
                h = x.T @ (xs[j] * second[i][j][:, None])
                out[splits[i] : splits[i + 1], splits[j] : splits[j + 1]] = h
                out[splits[j] : splits[j + 1], splits[i] : splits[i + 1]] = h.T
        return out


class FamilyAdapter(GSMMFamily):
    """A one-parameter family as a general one; log scale or theta are extra coefficients."""

    def __init__(self, family: Family) -> None:
        super().__init__(1, [family.link])
        self.family = family
        self.own = np.array(family.theta) if isinstance(family, ExtendedFamily) else np.zeros(int(family.twopar))
        self.extra = len(self.own)

    def llk(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> float:
        tail = coef[splits[-1] :]
        with np.errstate(all="ignore"):
            mu = self.family.link.fi(self.etas(coef, splits, xs)[0])
            if isinstance(self.family, ExtendedFamily):
                v = self.family.lp(ys[0], mu, theta=tail)
            else:
                v = self.family.lp(ys[0], mu, float(np.exp(tail[0])) if self.extra else 1.0)
        return float(v.sum()) if np.isfinite(v).all() else float("-inf")

    def init_coef(self, splits: list[int]) -> np.ndarray:
        return np.append(np.zeros(splits[-1]), self.own)


class Joint(Model):
    """Common part of ``GAMMLSS`` and ``GSMM``."""

    def __init__(self, formulas: Sequence[Formula], family: GSMMFamily) -> None:
        if len(formulas) != family.n_par:
            raise ValueError(f"the family has {family.n_par} linear predictors, not {len(formulas)}")
        self.formulas, self.family = list(formulas), family

    # rows -----------------------------------------------------------------------------------------
    def _prepare(self, df: DataFrame) -> DataFrame:
        variables = list(dict.fromkeys(v for f in self.formulas for v in f.variables()))
        factors = [v for f in self.formulas for v in f.as_factor]
        books = {k: v for f in self.formulas for k, v in f.codebook.items()}
        encoding = enc.learn(df, variables, factors, books)
        self.designs = [spec.build(df, f, encoding) for f in self.formulas]
        return self.rows(df)

    def rows(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encoded rows for all predictors; whatever any of them reads must not be null."""
        shown = [f.lhs for f in self.formulas if f.lhs is not None]
        ys = [f.f(F.col(f.variable).cast("double")) if f.f else F.col(f.variable) for f in shown]
        extra = [*keep, *self._keys()]
        df = df.withColumns({f"_q{k}": F.col(c) for k, c in enumerate(extra)})
        whole = spec.Design(self.formulas[0], self.designs[0].encoding, [b for d in self.designs for b in d.blocks])
        whole.formula = next((f for f in self.formulas if f.series), self.formulas[0])
        rows = spec.rows_of(df, whole, ys, [f"_q{k}" for k in range(len(extra))])
        if self.family.shape != "grouped":
            return rows
        own = [f"_q{k}" for k in range(len(keep), len(extra))]
        return in_series(rows, own[0], tuple(own[1:])).drop(*own[1:])

    def _keys(self) -> list[str]:
        """Columns of series and order, which a grouped likelihood needs."""
        f = next((f for f in self.formulas if f.series), None)
        return [f.series, *f.order] if f else []

    def _parts(self, block: Block) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ys = [block[f"y{k}"] for k in range(sum(f.lhs is not None for f in self.formulas))]
        return ys, [d.matrix(block) for d in self.designs]

    def _gather(self, rows: DataFrame, work: Callable[[Block], dict], sizes: dict) -> dict[str, np.ndarray]:
        if self.family.shape == "grouped":
            return gather(rows.drop("_q0"), work, sizes, series=True)
        return gather(rows, work, sizes)

    # likelihood -----------------------------------------------------------------------------------
    def llks(self, rows: DataFrame, coefs: Sequence[np.ndarray]) -> np.ndarray:
        """Log-likelihoods at several coefficients in one pass; not finite: minus infinity."""
        family, splits, parts = self.family, self.splits, self._parts

        def work(block: Block) -> dict[str, np.ndarray]:
            ys, xs = parts(block)
            with np.errstate(all="ignore"):
                if family.shape == "grouped":
                    v = family.series_llks(coefs, splits, ys, xs, np.flatnonzero(block["_first"]))
                    return {"llk": np.where(np.isfinite(v), v, -1e300).sum(axis=0)}
                v = family.llks(coefs, splits, ys, xs)
            return {"llk": np.where(np.isfinite(v), v, -1e300)}

        v = self._gather(rows, work, {"llk": (len(coefs),)})["llk"]
        return np.where(v > -1e299, v, -np.inf)

    def local(self, rows: DataFrame, coef: np.ndarray, second: bool = True) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Log-likelihood, gradient and Hessian, from one pass."""
        family, splits, parts, p = self.family, self.splits, self._parts, len(coef)
        step = 1e-5 * np.maximum(np.abs(coef), 1.0)

        def ends(k: int, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
            up, down = coef.copy(), coef.copy()
            up[k] += scale * step[k]
            down[k] -= scale * step[k]
            return up, down

        def gradient(c: np.ndarray, ys: list, xs: list) -> np.ndarray:
            if family.gradient is not None:
                return family.gradient(c, splits, ys, xs)
            both = family.llks([c + sign * step[k] * np.eye(p)[k] for sign in (1, -1) for k in range(p)], splits, ys, xs)
            return (both[:p] - both[p:]) / (2 * step)

        low = [(i, j) for i in range(p) for j in range(i)]
        unit, wide = np.eye(p), 30 * step

        def moves() -> list[np.ndarray]:
            found = [sign * wide[k] * unit[k] for sign in (1, -1) for k in range(p)]
            return found + [sign * (wide[i] * unit[i] + wide[j] * unit[j]) for sign in (1, -1) for i, j in low]

        def differences(at: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Second derivatives from ``v`` (..., moves), finite ones."""
            h = np.zeros((*v.shape[:-1], p, p))
            one = v[..., :p] + v[..., p : 2 * p]
            h[..., np.arange(p), np.arange(p)] = (one - 2 * at[..., None]) / wide**2
            pair = v[..., 2 * p : 2 * p + len(low)] + v[..., 2 * p + len(low) :]
            for n, (i, j) in enumerate(low):
                h[..., i, j] = h[..., j, i] = (pair[..., n] - one[..., i] - one[..., j] + 2 * at) / (2 * wide[i] * wide[j])
            return finite(h)

        def one(ys: list, xs: list) -> dict[str, np.ndarray]:
            out = {"llk": family.llk(coef, splits, ys, xs), "grad": gradient(coef, ys, xs)}
            if second and family.hessian is not None:
                out["hess"] = family.hessian(coef, splits, ys, xs)
            elif second and family.gradient is not None and not family.batched:
                cols = []
                for k in range(p):
                    up, down = ends(k)
                    cols.append((gradient(up, ys, xs) - gradient(down, ys, xs)) / (2 * step[k]))
                out["hess"] = np.stack(cols)
            elif second:
                out["hess"] = differences(np.asarray(out["llk"]), family.llks([coef + m for m in moves()], splits, ys, xs))
            return {k: finite(v) for k, v in out.items()}

        def work(block: Block) -> dict[str, np.ndarray | float]:
            ys, xs = parts(block)
            with np.errstate(all="ignore"):
                if family.shape != "grouped":
                    return one(ys, xs)
                starts = np.flatnonzero(block["_first"])
                if family.gradient is not None and family.batched and family.hessian is None:
                    v = family.series_llks([coef, *(coef + m for m in moves() if second)], splits, ys, xs, starts)
                    out = {"llk": finite(v[:, 0]).sum(), "grad": family.series_gradient(coef, splits, ys, xs, starts)}
                    return out | ({"hess": differences(v[:, 0], v[:, 1:]).sum(axis=0)} if second else {})
                found = [one(*part) for part in each_series(ys, xs, starts)]
                return {k: np.sum([f[k] for f in found], axis=0) for k in found[0]}

        sizes = {"llk": (1,), "grad": (p,)} | ({"hess": (p, p)} if second else {})
        got = self._gather(rows, work, sizes)
        return float(got["llk"][0]), got["grad"], (got["hess"] + got["hess"].T) / 2 if second else None

    # fitting ----------------------------------------------------------------------------------------
    def fit(self, df: DataFrame, max_outer: int = 100, max_inner: int = 20, conv_tol: float = 1e-7, lam: float = 10.0, init_coef: np.ndarray | None = None, method: str = "Newton", fixed_lam: bool = False, extra_penalties: Sequence[Penalty] = (), callback: Callable[[int, float, np.ndarray], None] | None = None, memory: int = 30, sample: bool = False, prefit: int = 0) -> Joint:
        """Newton steps on all coefficients inside, Fellner-Schall steps on all lambdas outside.

        ``method`` "qEFS" replaces the Hessian by a limited-memory approximation from the last ``memory``
        gradient differences: damped BFGS updates, or with "SR1" symmetric rank-one updates where they
        are well defined; "L-BFGS" maximises by two-loop steps first, "Grad" takes gradient steps. ``sample`` adds pairs
        along random directions before each update of the lambdas. ``prefit`` gradient steps come first. Start
        values without a finite likelihood are drawn anew; coefficients that the data and the penalties
        can't tell apart from others stay 0 (``dropped``).
        """
        rows = self._prepare(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for d in self.designs:
                spec.settle(d, rows)
            if prefit:
                self._fit(rows, 1, prefit, conv_tol, lam, init_coef, "Grad", True, list(extra_penalties), None, memory, False)
                init_coef = self.fitted.coef
            self._fit(rows, max_outer, max_inner, conv_tol, lam, init_coef, method, fixed_lam, list(extra_penalties), callback, memory, sample)
        finally:
            rows.unpersist()
        return self

    def at(self, df: DataFrame, coef: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Log-likelihood, gradient and Hessian at given coefficients."""
        rows = self._prepare(df)
        for d in self.designs:
            spec.settle(d, rows)
        return self.local(rows, np.asarray(coef, float))

    def _start(self, rows: DataFrame) -> np.ndarray:
        return np.zeros(self.splits[-1] + self.family.extra)

    def _fit(self, rows: DataFrame, outer: int, inner: int, tol: float, lam: float, coef: np.ndarray | None, method: str, fixed: bool, extra: list[Penalty], callback: Callable | None, memory: int = 30, sampled: bool = False) -> None:
        splits = self.splits
        penalties = [p for d, at in zip(self.designs, splits, strict=False) for p in d.penalties(at, lam)] + extra
        if coef is None:
            coef = self.family.init_coef(splits)
        coef = self._start(rows) if coef is None else np.array(coef, float)
        p, approx, last, edfs = len(coef), None, [], []
        if method not in ("Newton", "qEFS", "SR1", "Grad", "L-BFGS"):
            raise ValueError(f"unknown method {method!r}")
        quasi = method != "Newton"
        for attempt in range(8):
            if np.isfinite(self.llks(rows, [coef])[0]):
                break
            coef = np.random.default_rng(attempt).normal(0, 0.3, p)
        alive, checked, control = np.ones(p, bool), quasi, S.StepControl(penalties)
        for k in range(outer):
            s = S.total(penalties, p)
            value, settled, stuck = None, quasi, False
            if method == "L-BFGS":  # its pairs serve the approximation as well
                coef = self._lbfgs(rows, coef, s, inner, tol)
            for step in range(inner):
                llk, grad, hess = self.local(rows, coef, second=not quasi)
                if quasi and (approx is None or method == "Grad"):
                    approx = LimitedMemory(p, "SR1" if method == "SR1" else "BFGS", memory, max(1.0, float(np.abs(grad).max())))
                slope = grad - s @ coef
                value = llk - 0.5 * float(coef @ s @ coef)
                if not checked:
                    checked, alive = True, self._identified(rows, s, grad, hess)
                    coef = np.where(alive, coef, 0.0)
                direction = np.zeros(p)
                if quasi:
                    direction = approx.solver(_blocks(penalties))(slope)
                else:
                    lvi, _ = inverse_factor((-hess + s)[np.ix_(alive, alive)])
                    direction[alive] = lvi.T @ (lvi @ slope[alive])
                trials = [coef + t * direction for t in STEPS]
                ahead = np.array([0.5 * float(c @ s @ c) for c in trials])
                alone = not quasi and self.family.shape == "grouped"
                # a Newton step takes the first length that gains, most often the whole one
                found = self.llks(rows, trials[:1] if alone else trials)
                found = np.append(found, np.full(len(trials) - len(found), -np.inf)) - ahead
                good = np.flatnonzero(found > value - 1e-12 * abs(value))
                if not len(good) and alone:
                    found[1:] = self.llks(rows, trials[1:]) - ahead[1:]
                    good = np.flatnonzero(found > value - 1e-12 * abs(value))
                if not len(good):
                    if quasi and step == 0:
                        approx = None
                    if not quasi:  # no step gains: an end, and an optimum if none was to be expected
                        stuck, settled = True, abs(float(slope @ direction)) < 2 * tol * max(1.0, abs(value))
                    break
                best = int(good[0]) if not quasi else int(np.nanargmax(found))
                new = trials[best]
                if quasi:
                    after = self.local(rows, new, second=False)[1]
                    approx.add(new - coef, grad - after)
                gain, coef = found[best] - value, new
                value = found[best]
                if gain < tol * max(1.0, abs(value)):
                    settled = True
                    break
            llk, grad, hess = self.local(rows, coef, second=not quasi)
            if quasi:
                approx = approx or LimitedMemory(p, "BFGS", memory, max(1.0, float(np.abs(grad).max())))
                if sampled:
                    for pair in sampled_pairs(lambda cs: self.gradients(rows, cs), coef, approx.solver(_blocks(penalties)), min(memory, 2 * p)):
                        approx.add(*pair)
                hess = -approx.dense()
            h = np.where(np.outer(alive, alive), -hess, 0.0)
            guard = np.diag(np.where(alive, 0.0, 1e12))
            lvi, _ = inverse_factor(h + s + guard)
            cov = lvi.T @ lvi
            if callback is not None:
                callback(k, llk, coef)
            last.append(llk - 0.5 * float(coef @ s @ coef))
            moved, stands = 0.0, True
            edfs.append(S.edf_of(penalties, cov, h)[0])
            if penalties and not fixed:  # a move of the lambdas that went too far is halved and tried again
                stands = k == 0 or control.judge(cov, coef, 1.0)
                moved = control.step(cov, coef, 1.0) if stands else np.inf
            # lambdas that grow without end move nothing but themselves
            still = len(last) > 2 and abs(edfs[-1] - edfs[-2]) < 1e-3 and abs(last[-1] - last[-2]) < 10 * tol * abs(last[-1])
            ended = not penalties or fixed or moved < 1e-6 or (stands and still)
            if ended and (settled or stuck):
                break
        s = S.total(penalties, p)
        lvi, _ = inverse_factor(h + s + guard)
        edf, each = S.edf_of(penalties, lvi.T @ lvi, h)
        for d, at in zip(self.designs, splits, strict=False):
            d.dropped = [int(j) for j in np.flatnonzero(~alive[at : at + d.n_coef])]
        self.fitted = S.Fit(coef, lvi, 1.0, edf, S.term_edf(each, penalties), penalties, h, llk=llk, n=rows.count(), converged=bool(ended and settled), iterations=k + 1)
        self.fitted.reml = S.reml(llk, h, coef, 1.0, penalties)

    def gradients(self, rows: DataFrame, coefs: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Gradients at several coefficients; one pass where the family has a gradient."""
        family, splits, parts, p = self.family, self.splits, self._parts, len(coefs[0])
        if family.gradient is None:
            return [self.local(rows, c, second=False)[1] for c in coefs]

        def work(block: Block) -> dict[str, np.ndarray]:
            ys, xs = parts(block)
            if family.shape == "grouped":
                return {"g": np.stack([family.series_gradient(c, splits, ys, xs, np.flatnonzero(block["_first"])) for c in coefs])}
            return {"g": finite(np.stack([family.gradient(c, splits, ys, xs) for c in coefs]))}

        return list(self._gather(rows, work, {"g": (len(coefs), p)})["g"])

    def _lbfgs(self, rows: DataFrame, coef: np.ndarray, s: np.ndarray, most: int, tol: float) -> np.ndarray:
        def value(c: np.ndarray) -> tuple[float, np.ndarray]:
            llk, grad, _ = self.local(rows, c, second=False)
            return (llk if np.isfinite(llk) else -np.inf) - 0.5 * float(c @ s @ c), grad - s @ c

        return lbfgs(value, coef, most, tol=tol)[0]

    def _identified(self, rows: DataFrame, s: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """Coefficients that the columns and the penalty (at unit size) tell apart and that have an effect."""
        designs = self.designs

        def work(block: Block) -> dict[str, np.ndarray]:
            return {f"x{k}": x.T @ x for k, x in enumerate(d.matrix(block) for d in designs)}

        grams = gather(rows, work, {f"x{k}": (d.n_coef, d.n_coef) for k, d in enumerate(designs)})
        alive = np.ones(len(grad), bool)
        for k, (a, b) in enumerate(zip(self.splits[:-1], self.splits[1:], strict=True)):
            g, own = grams[f"x{k}"], s[a:b, a:b]
            unit = own / max(np.abs(own).max(), 1e-300) * max(np.abs(g).max(), 1e-300) if own.size and own.any() else 0.0
            alive[[a + j for j in dependent_columns(g + unit, 0, 1e-10)]] = False
        idle = (grad == 0) & (np.abs(hess).sum(axis=0) == 0) & (np.abs(s).sum(axis=0) == 0)
        return alive & ~idle

    def get_llk(self) -> float:
        return self.fitted.llk

    def get_reml(self) -> float:
        return self.fitted.reml


def _blocks(penalties: list[Penalty]) -> list[tuple[int, np.ndarray]]:
    """The penalties' sum as diagonal blocks."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for t in penalties:
        found[t.start, t.size] = found.get((t.start, t.size), 0.0) + t.lam * t.full()
    return [(start, m) for (start, _), m in sorted(found.items())]


class GAMMLSS(Joint):
    """Location-scale-shape model: a formula for each parameter of the response's distribution."""

    def __init__(self, formulas: Sequence[Formula], family: GAMLSSFamily) -> None:
        super().__init__(formulas, Adapter(family))
        self.dist = family

    def _start(self, rows: DataFrame) -> np.ndarray:
        mean, var = rows.agg(F.avg("y0"), F.var_pop("y0")).first()
        coef = np.zeros(self.splits[-1])
        for d, at, value in zip(self.designs, self.splits, self.dist.start(mean, var), strict=False):
            for b in d.blocks:
                if type(b.term).__name__ == "i":
                    coef[at + b.start] = value
        return coef

    def score(self, df: DataFrame, keep: Sequence[str] = (), seed: int = 0) -> DataFrame:
        """Distribution parameters ``par0``..., residual and a random draw for each usable row."""
        designs, splits, dist, coef = self.designs, self.splits, self.dist, self.fitted.coef
        ensure_importable(df.sparkSession)
        # what is random about a residual comes from the row, so batches and partitions don't matter
        own = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 52))
        df = df.withColumn("o_own", own)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = columns(batch.select([c for c in batch.schema.names if not c.startswith("_q")]))
                mus = dist.means([d.predictor(block, coef[a:b]) for d, a, b in zip(designs, splits[:-1], splits[1:], strict=True)])
                number = batch.column(f"_q{len(keep)}").to_numpy()
                u = (number + 0.5) / (1 << 52)
                resid = dist.quantile_resid(block["y0"], u, *mus) if hasattr(dist, "quantile_resid") else dist.get_resid(block["y0"], *mus)
                draws = dist.rvs(np.random.default_rng((seed, *number[:1])), *mus).astype(float)
                made = [*mus, resid, draws]
                yield pa.RecordBatch.from_arrays([*(batch.column(f"_q{j}") for j in range(len(keep))), *(pa.array(v) for v in made)], [*keep, *(f"par{j}" for j in range(len(mus))), "resid", "draw"])

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
        pars = "".join(f"par{j} double, " for j in range(len(designs)))
        return self.rows(df, [*keep, "o_own"]).mapInArrow(work, f"{kinds}{pars}resid double, draw double")


class GSMM(Joint):
    """General smooth model: any ``GSMMFamily``."""


class MultiGauss(GSMMFamily):
    """Multivariate normal; the precision's upper root has log diagonal, row by row, as extra coefficients."""

    def __init__(self, pars: int, links: list) -> None:
        super().__init__(pars, links)
        self.extra = pars * (pars + 1) // 2

    def root(self, theta: np.ndarray) -> np.ndarray:
        m, r = self.n_par, np.zeros((self.n_par, self.n_par))
        r[np.triu_indices(m)] = theta
        r[np.diag_indices(m)] = np.exp(np.diag(r))
        return r

    def _split(self, coef: np.ndarray, splits: list[int], ys: list, xs: list) -> tuple[np.ndarray, np.ndarray]:
        e = np.stack(ys) - np.stack(self.etas(coef, splits, xs))
        return self.root(coef[splits[-1] :]), e

    def llk(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> float:
        r, e = self._split(coef, splits, ys, xs)
        return float(e.shape[1] * np.log(np.diag(r)).sum() - 0.5 * ((r @ e) ** 2).sum())

    def gradient(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        r, e = self._split(coef, splits, ys, xs)
        u = r @ e
        back = r.T @ u
        d = -(u @ e.T)
        d[np.diag_indices(len(d))] = np.diag(d) * np.diag(r) + e.shape[1]
        return np.concatenate([*(x.T @ b for x, b in zip(xs, back, strict=True)), d[np.triu_indices(len(d))]])

    def init_coef(self, splits: list[int]) -> np.ndarray:
        return np.zeros(splits[-1] + self.extra)
