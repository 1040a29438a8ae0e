"""Small dense linear algebra on the driver."""

from __future__ import annotations

import numpy as np


def pivoted_cholesky(a: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray, int]:
    """Lower factor, pivots and numerical rank: ``a[p][:, p] = l @ l.T`` on the leading rank block."""
    a = np.array(a, float)
    n = len(a)
    order, low = np.arange(n), np.zeros((n, n))
    rest = np.diag(a).copy()
    limit = tol * max(rest.max(initial=0), 1e-300)
    for k in range(n):
        best = k + int(np.argmax(rest[k:]))
        if rest[best] <= limit:
            return low[:, :k], order, k
        for v in (order, rest):
            v[[k, best]] = v[[best, k]]
        low[[k, best]] = low[[best, k]]
        low[k, k] = np.sqrt(rest[k])
        if k + 1 < n:
            low[k + 1 :, k] = (a[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
            rest[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order, n


def dependent_columns(gram: np.ndarray, first: int, tol: float = 1e-9) -> list[int]:
    """Columns from ``first`` on that depend on earlier ones, from the cross product ``gram``."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g = gram * scale[:, None] * scale
    base, gone = list(range(first)), []
    inverse = np.linalg.pinv(g[np.ix_(base, base)], rcond=1e-10, hermitian=True) if base else np.zeros((0, 0))
    for j in range(first, len(g)):
        c = g[base, j]
        if g[j, j] - c @ inverse @ c < tol * max(g[j, j], 1e-300):
            gone.append(j)
        else:
            base.append(j)
            inverse = np.linalg.pinv(g[np.ix_(base, base)], rcond=1e-10, hermitian=True)
    return gone


def solve_tr(low: np.ndarray, b: np.ndarray, transpose: bool = False) -> np.ndarray:
    """Solve with a lower factor or its transpose."""
    return np.linalg.solve(low.T if transpose else low, b)


def inverse_factor(h: np.ndarray, most: int = 60) -> tuple[np.ndarray, float]:
    """``l`` with ``l.T @ l = inv(h + ridge * I)`` after diagonal scaling, and the ridge that was needed."""
    d = np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-300))
    scaled = h / d[:, None] / d
    ridge = 0.0
    for k in range(most):
        try:
            low = np.linalg.cholesky(scaled + ridge * np.eye(len(h)))
            return np.linalg.solve(low, np.diag(1 / d)), ridge
        except np.linalg.LinAlgError:
            ridge = 1e-14 * 2**k * max(1.0, np.trace(scaled) / max(len(h), 1))
    raise np.linalg.LinAlgError("the matrix can't be made positive definite")


def condition(h: np.ndarray) -> tuple[float, int]:
    """Condition number and code: 0 fine, 1 above 1/sqrt(eps), 2 above 1/eps."""
    k, eps = float(np.linalg.cond(h)), np.finfo(float).eps
    return k, int(k > eps**-0.5) + int(k > 1 / eps)


def pseudo_inverse_logdet(s: np.ndarray, tol: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """Generalised inverse, log of the product of the non-zero eigenvalues, and rank."""
    value, vector = np.linalg.eigh((s + s.T) / 2)
    keep = value > tol * max(value.max(initial=0), 1e-300)
    inv = (vector[:, keep] / value[keep]) @ vector[:, keep].T
    return inv, float(np.log(value[keep]).sum()), int(keep.sum())


def penalty_logdet(mats: list[np.ndarray], lams: list[float], tol: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """``pseudo_inverse_logdet`` of ``sum(lam * mat)`` for lambdas of any size.

    The range is that of the equally scaled sum, so rank and null space don't depend on the
    lambdas; inside it the matrix is definite and is scaled by its diagonal before it is factored.
    """
    scaled = sum(m / max(np.linalg.norm(m), 1e-300) for m in mats)
    value, vector = np.linalg.eigh((scaled + scaled.T) / 2)
    basis = vector[:, value > tol * max(value.max(initial=0), 1e-300)]
    inner = basis.T @ sum(w * m for w, m in zip(lams, mats, strict=True)) @ basis
    if not len(inner):
        return np.zeros_like(scaled), 0.0, 0
    d = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    small = inner / d[:, None] / d
    low = np.linalg.cholesky(small + 1e-15 * np.eye(len(small)))
    half = np.linalg.solve(low, np.diag(1 / d))
    return basis @ half.T @ half @ basis.T, float(2 * np.log(np.diag(low)).sum() + 2 * np.log(d).sum()), len(inner)


def similarity_transform(mats: list[np.ndarray], lams: list[float], close: float = 1e-5) -> np.ndarray:
    """Orthogonal matrix that separates penalties of very different size (Wood, 2011, appendix B).

    The largest penalties are taken first; the directions they leave free are handed to the rest.
    """
    n = len(mats[0])
    whole, done = np.eye(n), 0
    inner, left = [np.array(m, float) for m in mats], list(range(len(mats)))
    while left and done < n:
        size = {k: lams[k] * np.linalg.norm(inner[k]) for k in left}
        top = [k for k in left if size[k] >= close * max(size.values())]
        left = [k for k in left if k not in top]
        unit = sum(inner[k] / max(np.linalg.norm(inner[k]), 1e-300) for k in top)
        value = np.linalg.eigvalsh((unit + unit.T) / 2)
        rank = int((value > 1e-7 * max(value.max(initial=0), 1e-300)).sum())
        total = sum(lams[k] * inner[k] for k in top)
        value, vector = np.linalg.eigh((total + total.T) / 2)
        vector = vector[:, ::-1]
        turn = np.eye(n)
        turn[done:, done:] = vector
        whole = whole @ turn
        free = vector[:, rank:]
        inner = [free.T @ m @ free for m in inner]
        done += rank
    return whole


def chol_derivative(low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Derivative of the lower Cholesky factor for the derivative ``d`` of the matrix."""
    inv = np.linalg.inv(low)
    m = inv @ d @ inv.T
    return low @ (np.tril(m, -1) + np.diag(np.diag(m) / 2))


def draw_normal(n: int, mean: np.ndarray, factor: np.ndarray, scale: float, seed: int | None) -> np.ndarray:
    """``n`` draws with covariance ``scale * factor.T @ factor``, one a row."""
    z = np.random.default_rng(seed).normal(size=(n, len(factor)))
    return mean + np.sqrt(scale) * z @ factor


def chol_update(low: np.ndarray, v: np.ndarray, sign: float = 1.0) -> np.ndarray:
    """Lower factor of ``low @ low.T + sign * v v.T`` by plane rotations, without factoring anew."""
    out, v = np.array(low, float), np.array(v, float)
    for k in range(len(v)):
        square = out[k, k] ** 2 + sign * v[k] ** 2
        if square <= 0:
            raise np.linalg.LinAlgError("the matrix is no longer positive definite")
        r = np.sqrt(square)
        c, s = r / out[k, k], v[k] / out[k, k]
        out[k, k] = r
        out[k + 1 :, k] = (out[k + 1 :, k] + sign * s * v[k + 1 :]) / c
        v[k + 1 :] = c * v[k + 1 :] - s * out[k + 1 :, k]
    return out


def root_of(s: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """``r`` with ``r.T @ r = s`` for a positive semidefinite matrix."""
    value, vector = np.linalg.eigh((s + s.T) / 2)
    keep = value > tol * max(value.max(initial=0), 1e-300)
    return np.sqrt(value[keep])[:, None] * vector[:, keep].T


def penalised_qr(r: np.ndarray, z: np.ndarray, s: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Coefficients from the triangular factor ``r`` of the model matrix and ``z = Q'y``, by a QR decomposition
    of ``r`` on top of the penalty's root: the cross products are never formed. Dependent columns get 0.
    """
    root = root_of(s)
    q, t = np.linalg.qr(np.vstack((r, root)))
    right = q.T @ np.append(z, np.zeros(len(root)))
    fine = np.abs(np.diag(t)) > tol * max(np.abs(np.diag(t)).max(initial=0), 1e-300)
    coef = np.zeros(r.shape[1])
    if fine.all():
        coef = np.linalg.solve(t, right)
    else:
        coef[fine] = np.linalg.lstsq(t[:, fine], right, rcond=None)[0]
    return coef
