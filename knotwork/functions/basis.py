"""Uniform B-spline bases and what is built from them, on arrays and as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import pseudo_inverse_logdet


def local_values(w: np.ndarray | Column, deg: int) -> list:
    """The ``deg + 1`` values of the cardinal B-splines that are not zero, ``w`` in [0, 1)."""
    b: list = [w * 0 + 1.0]
    for d in range(1, deg + 1):
        saved = w * 0.0
        for r in range(d):
            part = b[r] / d
            b[r], saved = saved + (r + 1 - w) * part, (w + (d - 1 - r)) * part
        b.append(saved)
    return b


def bspline(x: np.ndarray, low: float, high: float, nk: int, deg: int = 3, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First column and the ``deg + 1`` values of ``nk`` equally spaced B-splines on [low, high].

    Outside, the same knots go on: columns beyond 0..nk-1 get the value 0. ``inside``: all knots lie
    in [low, high], and splines reach no further.
    """
    cells = nk - deg
    first = low
    if inside:
        cells = nk + deg
    dx = (high - low) / cells if high > low else 1.0
    u = (x - first) / dx
    c = np.floor(u)
    c = np.where((u >= cells) & (x <= high + 1e-12 * abs(dx)), cells - 1, c)
    values = np.stack(local_values(u - c, deg), axis=1)
    start = c.astype(np.int64) - (deg if inside else 0)
    column = start[:, None] + np.arange(deg + 1)
    values[(column < 0) | (column >= nk)] = 0.0
    return start, values


def bspline_columns(x: Column, low: float, high: float, nk: int, deg: int = 3) -> tuple[Column, Column]:
    """The same as expressions: first column (int) and array of ``deg + 1`` values, for x in [low, high]."""
    cells = nk - deg
    u = (x - F.lit(low)) / F.lit((high - low) / cells)
    c = F.least(F.floor(u), F.lit(cells - 1))
    return c.cast("int"), F.array(*local_values(u - c, deg))


def dense(start: np.ndarray, values: np.ndarray, nk: int) -> np.ndarray:
    out = np.zeros((len(start), nk))
    column = start[:, None] + np.arange(values.shape[1])
    ok = (column >= 0) & (column < nk)
    np.add.at(out, (np.nonzero(ok)[0], column[ok]), values[ok])
    return out


def tensor(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise Kronecker product of sparse rows (columns, values); ``width`` columns on the right."""
    column = a[0][:, :, None] * width + b[0][:, None, :]
    value = a[1][:, :, None] * b[1][:, None, :]
    return column.reshape(len(column), -1), value.reshape(len(value), -1)


def tensor_columns(a: Column, b: Column, sizes: tuple[int, int] | None = None) -> Column:
    """Row-wise products of two arrays; with their ``sizes`` as plain expressions, which are compiled."""
    if sizes is not None:
        return F.array(*[a[u] * b[v] for u in range(sizes[0]) for v in range(sizes[1])])
    return F.flatten(F.transform(a, lambda u: F.transform(b, lambda v: u * v)))


def truncated_power(x: Column | np.ndarray, t: float, p: int) -> Column | np.ndarray:
    if isinstance(x, Column):
        return F.when(x > t, F.pow(x - t, F.lit(p))).otherwise(F.lit(0.0))
    return np.where(x > t, (x - t) ** p, 0.0)


def difference_penalty(n: int, m: int = 2) -> np.ndarray:
    d = np.diff(np.eye(n), m, axis=0)
    return d.T @ d


def identity_penalty(n: int, f=None) -> np.ndarray:  # noqa: ANN001  optional weight of the distance
    return np.eye(n) if f is None else np.diag([float(f(i + 1)) for i in range(n)])


def null_penalty(s: np.ndarray, tol: float = 1e-7) -> np.ndarray | None:
    """Penalty of the null space of ``s``."""
    value, vector = np.linalg.eigh((s + s.T) / 2)
    low = value <= tol * max(value.max(initial=0), 1e-300)
    return vector[:, low] @ vector[:, low].T if low.any() else None


def sum_to_zero(sums: np.ndarray, kind: str = "QR") -> np.ndarray:
    """Map from the constrained to the raw coefficients of one smooth.

    QR: orthogonal to the column sums. DROP: without the middle column. DIFF: neighbours' differences,
    which leaves out the constant function.
    """
    k = len(sums)
    if kind == "QR":
        return np.linalg.qr(sums[:, None], mode="complete")[0][:, 1:]
    mid = k // 2
    if kind == "DROP":
        return np.delete(np.eye(k), mid, axis=1)
    if kind == "DIFF":
        z = np.delete(np.eye(k), mid, axis=1)
        z[mid] = -1.0
        return z
    raise ValueError(f"unknown constraint {kind!r}")


def natural(gram: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Demmler-Reinsch form: map to a basis orthonormal under ``gram`` in which ``s`` is diagonal."""
    low = np.linalg.cholesky(gram + 1e-12 * np.trace(gram) / len(gram) * np.eye(len(gram)))
    back = np.linalg.inv(low).T
    value, vector = np.linalg.eigh(back.T @ s @ back)
    order = np.argsort(-value)
    value = np.where(value[order] < 1e-9 * max(value.max(), 1e-300), 0.0, value[order])
    return back @ vector[:, order], np.diag(value)


def value_map(low: float, high: float, nk: int, deg: int, z: np.ndarray | None) -> np.ndarray:
    """Map under which a marginal's coefficients are its values at equally spaced points."""
    x = np.linspace(low, high, nk if z is None else z.shape[1])
    a = dense(*bspline(x, low, high, nk, deg), nk)
    a = a if z is None else a @ z
    inverse = np.linalg.pinv(a, rcond=1e-10)
    return inverse if z is None else z @ inverse


__all__ = [n for n in dir() if not n.startswith("_")] + ["pseudo_inverse_logdet"]
