"""Summaries, tests and comparisons of fitted models, on the driver."""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.linalg import chol_derivative, inverse_factor, pseudo_inverse_logdet
from ..functions.linalg import penalty_logdet as logdet_of
from ..functions.special import chi2_sf, f_sf, normal_cdf, t_sf_two_sided, weighted_chi2_sf
from . import solve as S
from .model import Model
from .terms import f, irf


def _estimated_scale(model: Model) -> bool:
    return getattr(model, "family", None) is not None and getattr(model.family, "scale", 1.0) is None


def _stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""


def summary_parametric(model: Model, par: int = 0) -> pd.DataFrame:
    """Wald tests of the unpenalised coefficients: t if the scale is estimated, else z."""
    table = model.coef_table()
    table = table[table["par"] == par].reset_index(drop=True)
    wanted = [k for b in model.designs[par].blocks if type(b.term).__name__ in ("i", "l") for k in range(b.start, b.start + b.width)]
    table = table.iloc[wanted].copy()
    stat = table["estimate"].to_numpy() / np.maximum(table["se"].to_numpy(), 1e-300)
    p = t_sf_two_sided(stat, max(model.fitted.n - len(model.fitted.coef), 1)) if _estimated_scale(model) else 2 * normal_cdf(-np.abs(stat))
    return table.assign(statistic=stat, p=p, stars=[_stars(v) for v in p])


def edf1(model: Model) -> np.ndarray:
    """Bias-corrected effective degrees of freedom of each coefficient: diagonal of 2F - FF."""
    ff = model.fitted.cov @ model.fitted.hessian
    return 2 * np.diag(ff) - np.einsum("ij,ji->i", ff, ff)


def _smooth_spans(model: Model, par: int) -> list[tuple[str, int, int]]:
    found, base = [], model.splits[par]
    design = model.designs[par]
    for b in design.blocks:
        if isinstance(b.term, f | irf):
            one = b.width // b.levels
            shared = getattr(b.term, "id", None) == 99
            for v in range(1 if shared else b.levels):
                tail = "" if b.levels == 1 or shared else f":{design.encoding.levels[b.term.by][v]}"
                found.append((design.label(b) + tail, base + b.start + v * one, b.width if shared else one))
    return found


def smooth_p_values(model: Model, par: int = 0) -> pd.DataFrame:
    """Rank-r Wald tests of the smooths (Wood, 2013), r the bias-corrected edf, not rounded."""
    each, ff = edf1(model), np.diag(model.fitted.cov @ model.fitted.hessian)
    rows = []
    for label, start, size in _smooth_spans(model, par):
        part = slice(start, start + size)
        h = model.fitted.hessian[part, part]
        value, vector = np.linalg.eigh((h + h.T) / 2)
        root = (np.sqrt(np.maximum(value, 0))[:, None] * vector.T)
        v = root @ model.fitted.cov[part, part] @ root.T * model.fitted.scale
        value, vector = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-value)
        value, vector = value[order], vector[:, order]
        alive = int((value > 1e-9 * max(value[0], 1e-300)).sum())
        r = float(np.clip(each[part].sum(), 0.1, alive))
        k, nu = int(np.floor(r)), r - np.floor(r)
        z = (vector.T @ (root @ model.fitted.coef[part]))[: k + 1] / np.sqrt(np.maximum(value[: k + 1], 1e-300))
        if k >= alive or nu < 1e-6:
            stat, weights = float((z[:k] ** 2).sum()), np.ones(k)
        elif k == 0:
            stat, weights = float(z[0] ** 2) * nu, np.array([nu])
        else:
            rho = np.sqrt(nu * (1 - nu) / 2)
            block = np.array([[1.0, rho], [rho, nu]])
            tail = z[k - 1 : k + 1]
            both = [float(tail @ (np.outer([1, s], [1, s]) * block) @ tail) for s in (1, -1)]
            stat = float((z[: k - 1] ** 2).sum()) + sum(both) / 2
            weights = np.append(np.ones(k - 1), np.linalg.eigvalsh(block))
        if _estimated_scale(model):
            df = max(model.fitted.n - model.fitted.edf, 1.0)
            p = weighted_chi2_sf(0.0, np.append(weights, -stat / df), np.append(np.ones(len(weights)), df))
        else:
            p = weighted_chi2_sf(stat, weights)
        rows.append((label, float(ff[part].sum()), r, stat, p, _stars(p)))
    return pd.DataFrame(rows, columns=["term", "edf", "edf1", "statistic", "p", "stars"])


def summary_smooth(model: Model, par: int = 0, pen_cutoff: float = 0.2, p_values: bool = False) -> pd.DataFrame:
    """Effective degrees of freedom of the smooths; ``penalized`` marks those below the cutoff."""
    ff = np.diag(model.fitted.cov @ model.fitted.hessian)
    table = pd.DataFrame([(label, float(ff[a : a + n].sum())) for label, a, n in _smooth_spans(model, par)], columns=["term", "edf"])
    table["penalized"] = table["edf"] < pen_cutoff
    return table.merge(smooth_p_values(model, par).drop(columns="edf"), on="term") if p_values else table


# uncertainty of the smoothing parameters ------------------------------------------------------------


def print_parametric_terms(model: Model, par: int = 0) -> None:
    """The Wald tests as a table, with the usual marks of significance."""
    print(summary_parametric(model, par).to_string(index=False, float_format=lambda v: f"{v:.4g}"))


def print_smooth_terms(model: Model, par: int = 0, pen_cutoff: float = 0.2, p_values: bool = False) -> None:
    """The smooths with their effective degrees of freedom, those below ``pen_cutoff`` marked as removed."""
    print(summary_smooth(model, par, pen_cutoff, p_values).to_string(index=False, float_format=lambda v: f"{v:.4g}"))


def _logs(model: Model) -> tuple[list[list[int]], np.ndarray]:
    groups = S.merged(model.fitted.penalties)
    return groups, np.log([model.fitted.penalties[g[0]].lam for g in groups])


def refits(model: Model, df: DataFrame) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """REML, coefficients and covariance of an additive model fitted anew at other log lambdas, the data's
    own for every family; each costs the passes of a fit from the present coefficients.
    """
    known: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}

    def at(rho: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        key = np.round(np.asarray(rho, float), 12).tobytes()
        if key not in known:
            new = type(model)(model.formula, copy.deepcopy(model.family))
            new.fit(df, lam=np.exp(rho), fixed_lam=True, offset=model.offset, rho=model.rho, encoding=model.designs[0].encoding, init_coef=model.fitted.coef, conv_tol=1e-10)
            known[key] = new.fitted.reml, new.fitted.coef, new.fitted.lvi
        return known[key]

    return at


def candidate(model: Model, rho: np.ndarray, refit: Callable | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """REML, coefficients and covariance at other log lambdas, with the Hessian as it is.

    The likelihood is its quadratic expansion at the estimate, which is exact for a Gaussian response;
    ``refit`` (see ``refits``) fits anew instead.
    """
    if refit is not None:
        return refit(rho)
    fit = model.fitted
    groups, _ = _logs(model)
    old = [p.lam for p in fit.penalties]
    try:
        for g, r in zip(groups, rho, strict=True):
            for k in g:
                fit.penalties[k].lam = float(np.clip(np.exp(r), 1e-300, 1e300))
        s = S.total(fit.penalties, len(fit.coef))
        for p, lam in zip(fit.penalties, old, strict=True):
            p.lam, lam = lam, p.lam
        before = S.total(fit.penalties, len(fit.coef))
        target = (fit.hessian + before) @ fit.coef  # X'Wz of the working model
        lvi, _ = inverse_factor(fit.hessian + s)
        coef = lvi.T @ (lvi @ target)
        d = coef - fit.coef
        llk = fit.llk + (float((before @ fit.coef) @ d) - 0.5 * float(d @ fit.hessian @ d)) / fit.scale
        for g, r in zip(groups, rho, strict=True):
            for k in g:
                fit.penalties[k].lam = float(np.clip(np.exp(r), 1e-300, 1e300))
        return S.reml(llk, fit.hessian, coef, fit.scale, fit.penalties), coef, lvi
    finally:
        for p, lam in zip(fit.penalties, old, strict=True):
            p.lam = lam


def estimate_vp(model: Model, step: float = 1e-2, regularise: float = 0.0, refit: Callable | None = None) -> np.ndarray:
    """Covariance of the log lambdas: inverse Hessian of the negative REML by differences."""
    _, rho = _logs(model)
    q, at = len(rho), candidate(model, rho, refit)[0]
    h = np.zeros((q, q))
    for a in range(q):
        for b in range(a + 1):
            e, g = step * np.eye(q)[a], step * np.eye(q)[b]
            if a == b:
                h[a, a] = (candidate(model, rho + e, refit)[0] - 2 * at + candidate(model, rho - e, refit)[0]) / step**2
            else:
                h[a, b] = h[b, a] = (candidate(model, rho + e + g, refit)[0] - candidate(model, rho + e - g, refit)[0] - candidate(model, rho - e + g, refit)[0] + candidate(model, rho - e - g, refit)[0]) / (4 * step**2)
    value, vector = np.linalg.eigh(-h)
    keep = value > 1e-7
    return (vector[:, keep] / (value[keep] + regularise)) @ vector[:, keep].T


class RhoPrior:
    """Prior of the log lambdas; here flat. ``logpdf`` takes one draw a row."""

    def logpdf(self, rho: np.ndarray) -> np.ndarray:
        return np.zeros(len(rho))


class UniformRhoPrior(RhoPrior):
    def __init__(self, low: float = np.log(1e-7), high: float = np.log(1e7)) -> None:
        self.low, self.high = low, high

    def logpdf(self, rho: np.ndarray) -> np.ndarray:
        inside = ((rho >= self.low) & (rho <= self.high)).all(axis=1)
        return np.where(inside, -rho.shape[1] * np.log(self.high - self.low), -np.inf)


def correct_covariance(model: Model, grid: str = "JJJ1", draws: int = 250, df: float = 40, prior: RhoPrior | None = None, seed: int = 0, refit: Callable | None = None) -> tuple[np.ndarray, float]:
    """Covariance (unscaled) and edf that take in the uncertainty of the smoothing parameters.

    JJJ1 adds the first-order terms of coefficients and Cholesky factor; JJJ2 averages V over draws of
    log lambda from a multivariate t and adds the coefficients' term; JJJ3 averages both. ``refit``
    judges other lambdas by new fits, which matters for families other than the Gaussian.
    """
    fit = model.fitted
    groups, rho = _logs(model)
    v, p = fit.cov, len(fit.coef)
    if not groups:
        return v, fit.edf
    jac = np.stack([-v @ sum((_embed(fit.penalties[k], p) for k in g), np.zeros((p, p))) @ fit.coef for g in groups], axis=1)
    if grid == "JJJ1":
        vp = estimate_vp(model, step=0.1 if refit else 1e-2, refit=refit)
        low = np.linalg.cholesky(v + 1e-12 * np.trace(v) / p * np.eye(p))
        slopes = [chol_derivative(low, -v @ sum((_embed(fit.penalties[k], p) for k in g), np.zeros((p, p))) @ v) for g in groups]
        vcc = sum(vp[a, b] * slopes[a] @ slopes[b].T for a in range(len(groups)) for b in range(len(groups)))
        out = v + jac @ vp @ jac.T / fit.scale + vcc
    elif grid in ("JJJ2", "JJJ3"):
        vp = estimate_vp(model, step=0.1 if refit else 1e-2, regularise=0.1, refit=refit)
        rng = np.random.default_rng(seed)
        root = np.linalg.cholesky(vp + 1e-10 * np.eye(len(vp)))
        t = rng.normal(size=(draws, len(rho))) / np.sqrt(rng.chisquare(df, size=(draws, 1)) / df)
        sample = np.vstack((rho, np.clip(rho + t @ root.T, np.log(1e-7), np.log(1e7))))
        found = [candidate(model, r, refit) for r in sample]
        d = np.sum(np.linalg.solve(root, (sample - rho).T) ** 2, axis=0)
        log = np.array([f[0] for f in found]) + (prior or RhoPrior()).logpdf(sample) + 0.5 * (df + len(rho)) * np.log1p(d / df)
        w = np.exp(log - log.max())
        w /= w.sum()
        out = sum(x * f[2].T @ f[2] for x, f in zip(w, found, strict=True))
        if grid == "JJJ2":
            out = out + jac @ vp @ jac.T / fit.scale
        else:
            mean = sum(x * f[1] for x, f in zip(w, found, strict=True))
            out = out + sum(x * np.outer(f[1] - mean, f[1] - mean) for x, f in zip(w, found, strict=True)) / fit.scale
    else:
        raise ValueError(f"unknown grid {grid!r}")
    edf = float(np.einsum("ij,ji->", out, fit.hessian))
    return (v, fit.edf) if edf < fit.edf else (out, edf)


def _embed(p: S.Penalty, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[p.start : p.start + p.size, p.start : p.start + p.size] = p.lam * p.full()
    return out


def aic(model: Model, edf: float | None = None) -> float:
    extra = int(_estimated_scale(model)) + len(getattr(getattr(model, "family", None), "theta", ()))
    return -2 * model.fitted.llk + 2 * ((model.fitted.edf if edf is None else edf) + extra)


def compare_CDL(model1: Model, model2: Model, correct_V: bool = True, grid: str = "JJJ1", perform_GLRT: bool = False, seed: int = 0, alpha: float = 0.05) -> dict:  # noqa: N802, N803
    """Difference of the (corrected) AIC and, on demand, a generalised likelihood-ratio test."""
    e1, e2 = ((correct_covariance(m, grid, seed=seed)[1] if correct_V else m.fitted.edf) for m in (model1, model2))
    out = {"aic_1": aic(model1, e1), "aic_2": aic(model2, e2), "DOF1": e1, "DOF2": e2, "Res. DOF": model1.fitted.n - e1, "llk1": model1.fitted.llk, "llk2": model2.fitted.llk}
    out["aic_diff"] = out["aic_1"] - out["aic_2"]
    if perform_GLRT:
        df = abs(e1 - e2)
        stat = 2 * abs(model1.fitted.llk - model2.fitted.llk)
        if _estimated_scale(model1):
            big = model1 if e1 > e2 else model2
            small = model2 if big is model1 else model1
            stat = (small.fitted.deviance - big.fitted.deviance) / max(df, 1e-12) / big.fitted.scale
            p = float(f_sf(stat, df, big.fitted.n - max(e1, e2))[0]) if df > 0 else 1.0
        else:
            p = float(chi2_sf(stat, df)[0]) if df > 0 else 1.0
        out |= {"test_stat": stat, "DOF_diff": df, "p": p, "H1": p <= alpha}
    return out


# posterior sampling ---------------------------------------------------------------------------------


def nuts(logp: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, factor: np.ndarray, draws: int, adapt: int, seed: int, delta: float = 0.8, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """No-U-turn sampler with dual averaging of the step size; ``factor @ factor.T`` is the metric."""
    rng, p = np.random.default_rng(seed), len(start)

    def density(z: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = logp(start + factor @ z)
        return (v, factor.T @ g) if np.isfinite(v) else (-np.inf, np.zeros(p))

    def leap(z: np.ndarray, r: np.ndarray, g: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        r = r + 0.5 * e * g
        z = z + e * r
        v, g = density(z)
        return z, r + 0.5 * e * g, g, v

    z = np.zeros(p)
    value, grad = density(z)
    step, bar, h, centre = 0.5, 1.0, 0.0, np.log(5.0)
    out, lps = np.empty((draws, p)), np.empty(draws)
    for m in range(adapt + draws):
        r = rng.normal(size=p)
        joint = value - 0.5 * r @ r
        level = np.log(rng.uniform()) + joint
        left = right = (z, r, grad)
        pick, n, alive, j, accept, count = (z, value, grad), 1, True, 0, 0.0, 0

        def tree(state: tuple, sign: int, j: int, e: float):  # noqa: ANN202
            if j == 0:
                zz, rr, gg, vv = leap(*state, sign * e)
                now = vv - 0.5 * rr @ rr
                ok = float(min(1.0, np.exp(min(0.0, now - joint)))) if np.isfinite(now) else 0.0
                s = (zz, rr, gg)
                return s, s, (zz, vv, gg), int(level <= now), bool(level < now + 1000), ok, 1
            a, b, c, n1, go, ok, k = tree(state, sign, j - 1, e)
            if go:
                a2, b2, c2, n2, go2, ok2, k2 = tree(a if sign < 0 else b, sign, j - 1, e)
                a, b = (a2, b) if sign < 0 else (a, b2)
                if n2 and rng.uniform() < n2 / max(n1 + n2, 1):
                    c = c2
                d = b[0] - a[0]
                go = go2 and d @ a[1] >= 0 and d @ b[1] >= 0
                n1, ok, k = n1 + n2, ok + ok2, k + k2
            return a, b, c, n1, go, ok, k

        while alive and j < depth:
            sign = 1 if rng.uniform() < 0.5 else -1
            a, b, c, n2, go, ok, k = tree(left if sign < 0 else right, sign, j, step)
            left, right = (a, right) if sign < 0 else (left, b)
            if go and n2 and rng.uniform() < min(1.0, n2 / n):
                pick = c
            n, accept, count = n + n2, accept + ok, count + k
            d = right[0] - left[0]
            alive = go and d @ left[1] >= 0 and d @ right[1] >= 0
            j += 1
        z, value, grad = pick
        if m < adapt:
            t = m + 1
            h += (delta - accept / max(count, 1) - h) / (t + 10)
            step = float(np.exp(centre - np.sqrt(t) / 0.05 * h))
            w = t**-0.75
            bar = float(np.exp(w * np.log(step) + (1 - w) * np.log(bar)))
            if t == adapt:
                step = bar
        else:
            out[m - adapt], lps[m - adapt] = start + factor @ z, value
    return out, lps


def sample_posterior(model: Model, spark, chains: int = 4, draws: int = 500, adapt: int = 300, seed: int = 0, sample_rho: bool = True):  # noqa: ANN001, ANN201
    """Chains over coefficients, log scale and log lambdas of a model, one Spark task each.

    The likelihood enters by its sufficient statistics (exact for a Gaussian response, the expansion
    at the estimate otherwise), so no data travel. Returns a DataFrame (chain, draw, name, value).
    """
    fit, p = model.fitted, len(model.fitted.coef)
    groups, rho0 = _logs(model)
    free_scale = _estimated_scale(model)
    q = len(groups) if sample_rho else 0
    names = [n for d in model.designs for n in d.names] + [f"extra_{k}" for k in range(p - model.splits[-1])] + ["log_scale"] * free_scale + [f"log_lambda_{k}" for k in range(q)]
    before = S.total(fit.penalties, p)
    blocks = [sum((_embed(fit.penalties[k], p) / fit.penalties[k].lam for k in g), np.zeros((p, p))) for g in groups]
    target, h, coef0, dev, n = (fit.hessian + before) @ fit.coef, fit.hessian, fit.coef, fit.deviance, fit.n
    scale0, prior = fit.scale, UniformRhoPrior()

    spans: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for k, group in enumerate(groups):
        for one in group:
            t = fit.penalties[one]
            spans.setdefault((t.start, t.size), []).append((k, t.full()))
    alone = {span: pseudo_inverse_logdet(found[0][1]) for span, found in spans.items() if len(found) == 1}

    def penalty_logdet(rho: np.ndarray) -> tuple[float, int, np.ndarray]:
        """log|S|+ span by span, so that lambdas far apart don't hide each other's eigenvalues."""
        log, rank, slope = 0.0, 0, np.zeros(len(rho))
        for span, found in spans.items():
            if span in alone:
                _, one, r = alone[span]
                log, rank = log + one + r * rho[found[0][0]], rank + r
                slope[found[0][0]] += r
                continue
            inverse, one, r = logdet_of([m for _, m in found], [float(np.exp(rho[k])) for k, _ in found])
            log, rank = log + one, rank + r
            for k, m in found:
                slope[k] += np.exp(rho[k]) * float((inverse * m).sum())
        return log, rank, slope

    def logp(x: np.ndarray) -> tuple[float, np.ndarray]:
        b = x[:p]
        phi = np.exp(x[p]) if free_scale else scale0
        rho = x[p + free_scale :] if q else rho0
        if not (-60 < np.log(phi) < 60) or np.any(rho < prior.low) or np.any(rho > prior.high):
            return -np.inf, np.zeros_like(x)
        d = b - coef0
        s = sum(np.exp(r) * m for r, m in zip(rho, blocks, strict=True)) if blocks else np.zeros((p, p))
        quad = float(-2 * (target - h @ coef0) @ d + d @ h @ d)
        pen = float(b @ s @ b)
        g = np.zeros_like(x)
        g[:p] = (target - h @ b - s @ b) / phi
        value = -(quad + pen) / (2 * phi)
        logdet, rank, slope = penalty_logdet(rho)
        if free_scale:
            value += -(n + rank) / 2 * np.log(phi) - dev / (2 * phi)
            g[p] = -(n + rank) / 2 + (quad + pen + dev) / (2 * phi)
        if q:
            value += 0.5 * logdet
            for k, m in enumerate(blocks):
                g[p + free_scale + k] = 0.5 * (slope[k] - np.exp(rho[k]) * float(b @ m @ b) / phi)
        return value, g

    size = p + free_scale + q
    factor = np.zeros((size, size))
    factor[:p, :p] = fit.lvi.T * np.sqrt(scale0)
    for k in range(p, size):
        factor[k, k] = np.sqrt(2 / max(n, 1)) if free_scale and k == p else 0.7
    start = np.concatenate((fit.coef, [np.log(scale0)] if free_scale else [], np.clip(rho0, -12, 12) if q else []))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["id"].iloc[0])
        x, lps = nuts(logp, start, factor, draws, adapt, seed + chain)
        table = pd.DataFrame(x, columns=names).assign(lp=lps, chain=chain, draw=np.arange(draws))
        return table.melt(["chain", "draw"], var_name="name", value_name="value")[["chain", "draw", "name", "value"]]

    from ..session import ensure_importable

    ensure_importable(spark)
    return spark.range(chains).repartition(chains).groupBy("id").applyInPandas(run, "chain long, draw long, name string, value double")


def convergence(samples) -> pd.DataFrame:  # noqa: ANN001
    """Split-chain Rhat, bulk effective size and Monte-Carlo error by parameter, from (chain, draw, name, value)."""
    table = samples.toPandas() if not isinstance(samples, pd.DataFrame) else samples
    rows = []
    for name, part in table.groupby("name"):
        x = part.pivot(index="chain", columns="draw", values="value").to_numpy()
        half = x.shape[1] // 2
        x = np.vstack((x[:, :half], x[:, -half:]))
        m, n = x.shape
        within = x.var(axis=1, ddof=1).mean()
        var = (n - 1) / n * within + x.mean(axis=1).var(ddof=1)
        rho, total = np.ones(1), 0.0
        centred = x - x.mean(axis=1, keepdims=True)
        for lag in range(1, n - 1, 2):
            pair = sum(1 - (within - (centred[:, : n - k] * centred[:, k:]).sum(axis=1).mean() / (n - 1)) / max(var, 1e-300) for k in (lag, lag + 1))
            if pair < 0:
                break
            total += pair
        ess = m * n / (1 + 2 * total)
        rows.append((name, x.mean(), np.sqrt(var), np.sqrt(var / max(within, 1e-300)), ess, np.sqrt(var / ess)))
    return pd.DataFrame(rows, columns=["name", "mean", "sd", "rhat", "ess", "mcse"])
