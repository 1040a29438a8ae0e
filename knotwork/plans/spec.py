"""From a formula and a table to a model-matrix design.

A design's blocks produce RAW sparse rows (basis values, one-hot entries); constraints and
reparametrisations are linear maps that are applied on the driver to aggregated cross products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product as outer
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from ..functions.linalg import dependent_columns
from ..operators import encode as enc
from ..operators.partials import Block, cross, expand, gather
from . import terms as T


@dataclass
class Penalty:
    """``lam * s`` on the coefficients from ``start`` on; ``repeat`` blocks of ``s`` share one lambda."""

    term: int
    start: int
    s: np.ndarray
    lam: float = 1.1
    repeat: int = 1
    label: str = ""
    group: Any = None

    @property
    def size(self) -> int:
        return len(self.s) * self.repeat

    def full(self) -> np.ndarray:
        return np.kron(np.eye(self.repeat), self.s) if self.repeat > 1 else self.s


@dataclass
class Columns:
    """The columns of one term: raw width, map to coefficients, names and penalties."""

    term: Any
    index: int
    raw: int
    names: list[str]
    map: np.ndarray | None = None
    levels: int = 1
    raw_start: int = 0
    start: int = 0
    marginals: list[dict[str, Any]] = field(default_factory=list)
    penalties: list[np.ndarray] = field(default_factory=list)

    @property
    def width(self) -> int:
        return (self.raw if self.map is None else self.map.shape[1]) * self.levels

    @property
    def raw_width(self) -> int:
        return self.raw * self.levels


@dataclass
class Design:
    """One formula's design on one table."""

    formula: T.Formula
    encoding: enc.Encoding
    blocks: list[Columns] = field(default_factory=list)
    dropped: list[int] = field(default_factory=list)

    # layout ---------------------------------------------------------------------------------------
    def arrange(self) -> None:
        raw = start = 0
        for b in self.blocks:
            b.raw_start, b.start = raw, start
            raw, start = raw + b.raw_width, start + b.width
        self.raw_width, self.n_coef = raw, start
        to = np.zeros((raw, start))
        for b in self.blocks:
            one = np.eye(b.raw) if b.map is None else b.map
            for k in range(b.levels):
                r, c = b.raw_start + k * b.raw, b.start + k * one.shape[1]
                to[r : r + b.raw, c : c + one.shape[1]] = one
        self.map = to
        if self.dropped:
            self.map[:, self.dropped] = 0.0

    @property
    def names(self) -> list[str]:
        return [n for b in self.blocks for n in b.names]

    def penalties(self, offset: int = 0, lam: float = 1.1) -> list[Penalty]:
        """One lambda a penalty and level, or one for all that share an ``id``."""
        found = []
        for b in self.blocks:
            one = b.width // b.levels
            for k, s in enumerate(b.penalties):
                shared = getattr(b.term, "id", None)
                if shared is not None or b.levels == 1:
                    found.append(Penalty(b.index, offset + b.start, s, lam, b.levels, f"{self.label(b)}", (shared, k) if shared is not None else None))
                else:
                    found += [Penalty(b.index, offset + b.start + v * one, s, lam, 1, f"{self.label(b)}:{self.encoding.levels[b.term.by][v]}") for v in range(b.levels)]
        return found

    def label(self, b: Columns) -> str:
        t = b.term
        if isinstance(t, T.ri):
            return f"ri({t.variable})"
        kind = type(t).__name__
        return "i" if kind == "i" else f"{kind}({','.join(t.variables)})"

    # rows -----------------------------------------------------------------------------------------
    def rows(self, block: Block, use: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Raw columns and values of a block of encoded rows, as many entries for each row.

        ``use``: only these terms have values; the width stays the same.
        """
        n = len(next(iter(block.values())))
        index, value = [], []
        for b in self.blocks:
            k, v = self._term(b, block, n)
            if use is not None and b.index not in use:
                v = np.zeros_like(v)
            index.append(k + b.raw_start)
            value.append(v)
        return np.concatenate(index, axis=1), np.concatenate(value, axis=1)

    def _product(self, variables: Sequence[str], skip: Sequence[int], block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Interaction: place in the grid of the factors' levels, and the numeric product."""
        place, value = np.zeros(n, np.int64), np.ones(n)
        for v, s in zip(variables, skip, strict=True):
            if v in self.encoding.factors:
                code = block[f"c_{v}"].astype(np.int64) - s
                size = len(self.encoding.levels[v]) - s
                value = value * ((code >= 0) & (code < size))
                place = place * size + np.clip(code, 0, max(size - 1, 0))
            else:
                value = value * block[f"n_{v}"]
        return place[:, None], value[:, None]

    def _term(self, b: Columns, block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
        t = b.term
        if isinstance(t, T.i):
            return np.zeros((n, 1), np.int64), np.ones((n, 1))
        if isinstance(t, T.l):
            return self._product(t.variables, b.marginals[0]["skip"], block, n)
        if isinstance(t, T.ri):
            return self._product([t.variable], [0], block, n)
        if isinstance(t, T.rs):
            place, value = self._product(t.variables, [0] * len(t.variables), block, n)
            return self._spread(b, t.by, place, value, block)
        column = value = None
        for m in b.marginals:
            x = block[m["column"]]
            missing = np.isnan(x)
            start, vals = basis.bspline(np.where(missing, m["low"], x), m["low"], m["high"], m["nk"], m["deg"], m.get("inside", False))
            col = np.clip(start[:, None] + np.arange(vals.shape[1]), 0, m["nk"] - 1)
            vals = np.where(missing[:, None], 0.0, vals)
            column, value = (col, vals) if column is None else basis.tensor((column, value), (col, vals), m["nk"])
        if getattr(t, "by_cont", None):
            value = value * block[f"n_{t.by_cont}"][:, None]
        for name in ("binary", "subgroup"):
            if getattr(t, name, None):
                factor, level = getattr(t, name)
                value = value * (block[f"c_{factor}"] == self.encoding.code(factor, level))[:, None]
        return self._spread(b, t.by, column, value, block)

    def _spread(self, b: Columns, by: str | None, column: np.ndarray, value: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
        if by is None:
            return column, value
        code = block[f"c_{by}"].astype(np.int64)[:, None]
        return column + np.maximum(code, 0) * b.raw, value * (code >= 0)

    def matrix(self, block: Block, use: Sequence[int] | None = None) -> np.ndarray:
        """Dense model matrix of a block, in coefficients."""
        index, value = self.rows(block, use)
        return expand(index, value, self.raw_width) @ self.map

    def predictor(self, block: Block, coef: np.ndarray, use: Sequence[int] | None = None) -> np.ndarray:
        index, value = self.rows(block, use)
        return (value * (self.map @ coef)[index]).sum(axis=1)

    def columns(self) -> list[str]:
        """Encoded columns that ``rows`` reads."""
        marg = [m["column"] for b in self.blocks for m in b.marginals if "column" in m]
        return list(dict.fromkeys([*(f"n_{v}" for v in self.encoding.numeric), *(f"c_{v}" for v in self.encoding.factors), *marg]))


def _grid(design: Design, variables: Sequence[str], skip: Sequence[int]) -> list[str]:
    """Names of the columns of an interaction."""
    parts = [[f"{v}_{x}" for x in design.encoding.levels[v][s:]] if v in design.encoding.factors else [v] for v, s in zip(variables, skip, strict=True)]
    return ["_".join(p) for p in outer(*parts)]


def _marginals(design: Design, t: Any) -> list[dict[str, Any]]:
    several = len(t.variables) > 1
    extra = int(t.identifiable and not (several and t.te)) if isinstance(t, T.f) else 1
    default = (5 if t.te else 4) if several else 9
    nk = t.nk if t.nk is not None else default
    nk = list(nk) if isinstance(nk, list | tuple) else [nk] * len(t.variables)
    found = []
    for v, k in zip(t.variables, nk, strict=True):
        if v not in design.encoding.numeric:
            raise TypeError(f"a smooth needs a numeric variable, {v!r} is a factor")
        low, high = design.encoding.ranges[v]
        found.append({"column": f"n_{v}", "low": low, "high": high, "nk": k + extra, "deg": t.deg})
    return found


def build(df: DataFrame, formula: T.Formula, encoding: enc.Encoding) -> Design:
    """Blocks without constraints; ``settle`` adds what depends on the rows."""
    design = Design(formula, encoding)
    constant = False
    for number, t in enumerate(formula.flat()):
        b = Columns(t, number, 1, [])
        if isinstance(t, T.i):
            b.names, constant = ["Intercept"], True
        elif isinstance(t, T.l):
            skip = [int(constant and v in encoding.factors) for v in t.variables]
            b.marginals, b.names = [{"skip": skip}], _grid(design, t.variables, skip)
            b.raw = len(b.names)
            constant = constant or (len(t.variables) == 1 and t.variables[0] in encoding.factors)
        elif isinstance(t, T.ri):
            if t.variable not in encoding.factors:
                raise TypeError(f"a random intercept needs a factor, {t.variable!r} is numeric")
            b.names, b.raw = _grid(design, [t.variable], [0]), len(encoding.levels[t.variable])
        elif isinstance(t, T.rs):
            base = _grid(design, t.variables, [0] * len(t.variables))
            b.raw, b.levels = len(base), len(encoding.levels[t.by]) if t.by else 1
            b.names = [f"{n}_{x}" for x in encoding.levels[t.by] for n in base] if t.by else base
        else:
            if t.by is not None and t.by not in encoding.factors:
                raise TypeError(f"by needs a factor, {t.by!r} is numeric")
            if isinstance(t, T.irf):
                low, high = encoding.ranges[t.variables[0]]
                b.marginals = [{"column": f"r_{t.variables[0]}_{t.onset}", "low": low, "high": high, "nk": t.nk, "deg": t.deg, "inside": True}]
            else:
                b.marginals = _marginals(design, t)
            b.raw = int(np.prod([m["nk"] for m in b.marginals]))
            b.levels = len(encoding.levels[t.by]) if t.by else 1
        design.blocks.append(b)
    design.arrange()
    return design


def rows_of(df: DataFrame, design: Design, responses: Sequence[Column] = (), keep: Sequence[str] = (), drop_null: bool = True) -> DataFrame:
    """Encoded rows of a table, shifted covariates of impulse responses included."""
    shifts, formula = [], design.formula
    for b in design.blocks:
        if isinstance(b.term, T.irf):
            if formula.series is None or not formula.order:
                raise ValueError("an impulse response needs the formula's series and order")
            name = b.marginals[0]["column"]
            df = enc.lagged(df, formula.series, list(formula.order), b.term.variables[0], b.term.onset, name)
            df = df.withColumn(name, F.col(name).cast("double"))
            shifts.append(name)
    return enc.encode(df, design.encoding, responses, [*keep, *shifts], drop_null)


def settle(design: Design, rows: DataFrame) -> Design:
    """Constraints, reparametrisations, penalties and names, from one pass over the encoded rows.

    The pass sums the columns of every constrained smooth, before ``by`` spreads them, and makes
    the cross products that a Demmler-Reinsch form needs.
    """
    smooth = [b for b in design.blocks if isinstance(b.term, T.f)]
    sizes: dict[str, tuple[int, ...]] = {}
    for b in smooth:
        sizes[f"sum{b.index}"] = (b.raw,)
        if b.term.rp == 1:
            sizes[f"gram{b.index}"] = (b.raw, b.raw)
        for k, m in enumerate(b.marginals):
            sizes[f"sum{b.index}_{k}"] = (m["nk"],)

    def work(block: Block) -> dict[str, np.ndarray]:
        out = {}
        for b in smooth:
            column = value = None
            for k, m in enumerate(b.marginals):
                start, vals = basis.bspline(block[m["column"]], m["low"], m["high"], m["nk"], m["deg"])
                col = np.clip(start[:, None] + np.arange(vals.shape[1]), 0, m["nk"] - 1)
                out[f"sum{b.index}_{k}"] = np.bincount(col.ravel(), vals.ravel(), m["nk"])
                column, value = (col, vals) if column is None else basis.tensor((column, value), (col, vals), m["nk"])
            out[f"sum{b.index}"] = np.bincount(column.ravel(), value.ravel(), b.raw)
            if b.term.rp == 1:
                out[f"gram{b.index}"] = cross(column, value, np.ones(len(column)), b.raw)
        return out

    found = gather(rows, work, sizes) if smooth else {}
    for b in design.blocks:
        t = b.term
        if isinstance(t, T.ri | T.rs):
            b.penalties = [np.eye(b.raw)]
        elif isinstance(t, T.irf):
            b.penalties = [_penalty(p, b.raw) for p in t.penalty] if t.is_penalized else []
            b.names = _smooth_names(design, b)
        elif isinstance(t, T.f):
            _smooth(design, b, found)
            b.names = _smooth_names(design, b)
    design.arrange()
    return design


def _penalty(p: Any, n: int) -> np.ndarray:
    if isinstance(p, int):
        return basis.difference_penalty(n, p)
    return np.asarray(p(n) if callable(p) else p, float)


def _smooth_names(design: Design, b: Columns) -> list[str]:
    one, t = b.width // b.levels, b.term
    stem = f"{'irf' if isinstance(t, T.irf) else 'f'}_{'_'.join(t.variables)}"
    if t.by:
        return [f"{stem}_{k}_{x}" for x in design.encoding.levels[t.by] for k in range(one)]
    tail = f"_{t.binary[1]}" if getattr(t, "binary", None) else ""
    return [f"{stem}_{k}{tail}" for k in range(one)]


def _smooth(design: Design, b: Columns, found: dict[str, np.ndarray]) -> None:
    t, several = b.term, len(b.marginals) > 1
    sizes = [m["nk"] for m in b.marginals]
    full_te = several and t.te
    maps = [basis.sum_to_zero(found[f"sum{b.index}_{k}"], t.constraint) if t.identifiable and not full_te else np.eye(n) for k, n in enumerate(sizes)]
    rp = t.rp if t.rp is not None else (2 if several else 0)
    if rp == 2:
        maps = [basis.value_map(m["low"], m["high"], m["nk"], m["deg"], None if z.shape[0] == z.shape[1] else z) for m, z in zip(b.marginals, maps, strict=True)]
    whole = maps[0]
    for z in maps[1:]:
        whole = np.kron(whole, z)
    parts = []
    for k, p_of in enumerate(b.marginals):
        for p in t.penalty:
            s = maps[k].T @ _penalty(p, p_of["nk"]) @ maps[k]
            if several and t.scale_te:
                s = s / np.linalg.eigvalsh(s).max()
            for j, z in enumerate(maps):
                if j < k:
                    s = np.kron(np.eye(z.shape[1]), s)
                elif j > k:
                    s = np.kron(s, np.eye(z.shape[1]))
            parts.append(s)
    if full_te and t.identifiable:
        z = basis.sum_to_zero(whole.T @ found[f"sum{b.index}"], t.constraint)
        whole, parts = whole @ z, [z.T @ s @ z for s in parts]
    if rp == 1:
        gram = whole.T @ found[f"gram{b.index}"] @ whole
        back, first = basis.natural(gram, parts[0])
        scale = np.sqrt(np.trace(gram) / len(gram))
        back = back * scale
        whole, parts = whole @ back, [first * scale**2, *(back.T @ s @ back for s in parts[1:])]
    b.map = whole
    if not t.is_penalized:
        parts = []
    if t.penalize_null and parts:
        total = sum(parts)
        value = np.linalg.eigvalsh(total)
        if rp == 1:  # the null space is spanned by single columns
            null = [k for k in range(len(total)) if total[k, k] <= 1e-7 * max(value.max(), 1e-300)]
            parts += [np.diag((np.arange(len(total)) == k).astype(float)) for k in null]
        elif (extra := basis.null_penalty(total)) is not None:
            parts.append(extra)
    b.penalties = parts


def prune(design: Design, gram: np.ndarray) -> Design:
    """Drop columns of smooths that depend on columns of terms before them (nested smooths)."""
    first = next((b.start for b in design.blocks if isinstance(b.term, T.f)), None)
    if first is None:
        return design
    last = max(b.start + b.width for b in design.blocks if isinstance(b.term, T.f))
    gone = [j for j in dependent_columns(gram[:last, :last], first) if not any(b.start <= j < b.start + b.width and (b.penalties and getattr(b.term, "by", None)) for b in design.blocks)]
    if gone:
        design.dropped = gone
        design.arrange()
    return design
