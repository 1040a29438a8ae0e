"""Estimation on aggregated statistics: penalised least squares, smoothing parameters, REML."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.linalg import inverse_factor, penalty_logdet
from .spec import Penalty

LOW, HIGH = 1e-7, 1e7


@dataclass
class Fit:
    """What an estimation knows: ``lvi.T @ lvi`` is the unscaled covariance."""

    coef: np.ndarray
    lvi: np.ndarray
    scale: float
    edf: float
    term_edf: list[float]
    penalties: list[Penalty]
    hessian: np.ndarray
    reml: float = float("nan")
    llk: float = float("nan")
    deviance: float = float("nan")
    n: int = 0
    converged: bool = False
    iterations: int = 0
    info: dict = field(default_factory=dict)

    @property
    def cov(self) -> np.ndarray:
        return self.lvi.T @ self.lvi


def total(penalties: list[Penalty], p: int) -> np.ndarray:
    s = np.zeros((p, p))
    for t in penalties:
        s[t.start : t.start + t.size, t.start : t.start + t.size] += t.lam * t.full()
    return s


def merged(penalties: list[Penalty]) -> list[list[int]]:
    """Numbers of the penalties that share one lambda."""
    groups: dict = {}
    for k, t in enumerate(penalties):
        groups.setdefault(("own", k) if t.group is None else ("shared", t.group), []).append(k)
    return list(groups.values())


def traces(penalties: list[Penalty], cov: np.ndarray, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """For each penalty tr(S^- S_j), tr(V S_j), b' S_j b; and log|S|+ with the rank of S."""
    lgdet, ldet, bsb = (np.zeros(len(penalties)) for _ in range(3))
    logdet, rank, seen = 0.0, 0, {}
    for k, t in enumerate(penalties):
        seen.setdefault((t.start, t.size), []).append(k)
    for (start, size), members in seen.items():
        rows = slice(start, start + size)
        repeat = penalties[members[0]].repeat if all(penalties[k].repeat == penalties[members[0]].repeat for k in members) else 1
        one = [penalties[k].s if repeat > 1 else penalties[k].full() for k in members]
        inverse, log, r = penalty_logdet(one, [penalties[k].lam for k in members])
        logdet, rank = logdet + repeat * log, rank + repeat * r
        width = len(one[0])
        v, b = cov[rows, rows], coef[rows].reshape(repeat, width)
        for k, s in zip(members, one, strict=True):
            lgdet[k] = repeat * float((inverse * s.T).sum())
            ldet[k] = sum(float((v[a * width : (a + 1) * width, a * width : (a + 1) * width] * s.T).sum()) for a in range(repeat))
            bsb[k] = float((b @ s * b).sum())
    return lgdet, ldet, bsb, logdet, rank


def reml_gradient(penalties: list[Penalty], cov: np.ndarray, coef: np.ndarray, scale: float) -> np.ndarray:
    """Slope of the restricted likelihood in the log of each lambda, one for each that is shared."""
    lgdet, ldet, bsb, _, _ = traces(penalties, cov, coef)
    each = np.array([t.lam for t in penalties]) * 0.5 * (lgdet - ldet - bsb / scale)
    return np.array([each[members].sum() for members in merged(penalties)])


def get_logs(penalties: list[Penalty]) -> np.ndarray:
    """Logs of the lambdas, one for each that is shared."""
    return np.log([penalties[members[0]].lam for members in merged(penalties)])


def set_logs(penalties: list[Penalty], rho: np.ndarray) -> None:
    for members, r in zip(merged(penalties), rho, strict=True):
        for k in members:
            penalties[k].lam = float(np.clip(np.exp(r), LOW, HIGH))


def step_lambda(penalties: list[Penalty], cov: np.ndarray, coef: np.ndarray, scale: float, boost: float = 1.0) -> float:
    """One Fellner-Schall update of all lambdas; returns the largest change of a log lambda."""
    lgdet, ldet, bsb, _, _ = traces(penalties, cov, coef)
    old, new = get_logs(penalties), []
    for members, before in zip(merged(penalties), old, strict=True):
        up, down = sum(max(0.0, lgdet[k] - ldet[k]) for k in members), sum(max(0.0, bsb[k]) for k in members)
        ratio = scale * up / down if down > 0 else HIGH / np.exp(before)
        new.append(before + boost * np.log(max(ratio, 1e-300)))
    set_logs(penalties, np.array(new))
    return float(np.abs(get_logs(penalties) - old).max(initial=0.0))


class StepControl:
    """Judges each move of the log lambdas by the restricted likelihood's slope at its end.

    A move against that slope went beyond the best point along it and is halved, at most ``most`` times;
    after one that the slope confirms the next is lengthened: by ``extension`` "ratio" a growing factor
    up to 2, by "nesterov" a growing part of the last move is added, by "none" nothing.
    """

    def __init__(self, penalties: list[Penalty], most: int = 6, extension: str = "ratio") -> None:
        if extension not in ("ratio", "nesterov", "none"):
            raise ValueError(f"unknown extension {extension!r}")
        self.penalties, self.most, self.extension = penalties, most, extension
        self.before, self.boost, self.halved = get_logs(penalties), 1.0, 0
        self.last, self.age = np.zeros(len(self.before)), 0

    def judge(self, cov: np.ndarray, coef: np.ndarray, scale: float) -> bool:
        """Whether the last move stands; if not, it has been halved and is to be tried again."""
        move = get_logs(self.penalties) - self.before
        slope = reml_gradient(self.penalties, cov, coef, scale)
        gain = float(slope @ move)
        if gain < -1e-9 and self.halved < self.most:
            self.halved += 1
            self.boost, self.age = 1.0, 0
            set_logs(self.penalties, self.before + move / 2)
            return False
        self.last, self.age = move, self.age + 1
        self.boost = min(self.boost * 1.25, 2.0) if gain > 0 and not self.halved and np.abs(move).max(initial=0) > 0 else 1.0
        self.halved = 0
        return True

    def step(self, cov: np.ndarray, coef: np.ndarray, scale: float) -> float:
        self.before = get_logs(self.penalties)
        moved = step_lambda(self.penalties, cov, coef, scale, self.boost if self.extension == "ratio" else 1.0)
        if self.extension == "nesterov" and self.age > 1:
            set_logs(self.penalties, get_logs(self.penalties) + (self.age - 1) / (self.age + 2) * self.last)
        return moved


def reml(llk: float, hessian: np.ndarray, coef: np.ndarray, scale: float, penalties: list[Penalty]) -> float:
    """Laplace-approximate restricted likelihood; ``hessian`` is the unpenalised one times the scale."""
    p = len(coef)
    s = total(penalties, p)
    _, _, _, logdet, rank = traces(penalties, np.zeros((p, p)), coef)
    low, _ = inverse_factor((hessian + s) / scale)
    half = -float(np.log(np.abs(np.diag(low))).sum())
    keep = np.diag(hessian) > 0
    null = int(keep.sum()) - rank
    return llk - float(coef @ s @ coef) / (2 * scale) + 0.5 * (logdet - rank * np.log(scale)) - half + null * np.log(2 * np.pi) / 2


def edf_of(penalties: list[Penalty], cov: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """Total effective degrees of freedom and those of each coefficient."""
    each = np.einsum("ij,ji->i", cov, hessian)
    return float(each.sum()), each


def term_edf(each: np.ndarray, penalties: list[Penalty]) -> list[float]:
    spans = list(dict.fromkeys((t.start, t.size) for t in penalties))
    return [float(each[a : a + b].sum()) for a, b in spans]


def solve(a: np.ndarray, b: np.ndarray, yy: float, n: float, penalties: list[Penalty], scale: float | None = None, most: int = 200, tol: float = 1e-7, fixed: bool = False, extension: str = "ratio") -> Fit:
    """Coefficients and lambdas of a penalised least-squares problem from its cross products.

    ``scale`` None: it is estimated. ``fixed``: lambdas stay. Columns without data get coefficient 0.
    Every step of the lambdas is judged by ``StepControl``.
    """
    p = len(b)
    dead = np.diag(a) <= 0
    guard = np.diag(np.where(dead, 1.0, 0.0)) * max(np.trace(a) / max(p, 1), 1.0)
    phi, control = scale or 1.0, StepControl(penalties, extension=extension)

    def at() -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray, float]:
        lvi, _ = inverse_factor(a + total(penalties, p) + guard)
        cov = lvi.T @ lvi
        coef = cov @ b
        coef[dead] = 0.0
        edf, each = edf_of(penalties, cov, a)
        rss = max(yy - 2 * float(coef @ b) + float(coef @ a @ coef), 1e-300)
        return lvi, cov, coef, edf, each, scale or rss / max(n - edf, 1.0)

    lvi, cov, coef, edf, each, phi = at()
    done, k = fixed or not penalties, 0
    while not done and k < most:
        k += 1
        moved = control.step(cov, coef, phi)
        lvi, cov, coef, edf, each, phi = at()
        while not control.judge(cov, coef, phi):
            lvi, cov, coef, edf, each, phi = at()
        done = moved < tol or (k > 3 and moved < 1e-5)
    return Fit(coef, lvi, phi, edf, term_edf(each, penalties), penalties, a, n=int(n), converged=bool(done), iterations=max(k, 1))
