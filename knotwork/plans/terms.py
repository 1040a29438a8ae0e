"""Terms of a formula. They hold no data; ``spec`` turns them into blocks of model-matrix columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any


@dataclass(frozen=True)
class lhs:  # noqa: N801  names follow the usual formula notation
    """Response variable with an optional transformation of its column."""

    variable: str
    f: Callable[[Any], Any] | None = None


@dataclass(frozen=True)
class i:  # noqa: N801
    """Intercept."""


@dataclass(frozen=True)
class l:  # noqa: N801, E742
    """Parametric effect of one variable or interaction of several."""

    variables: Sequence[str]


def li(variables: Sequence[str]) -> list[l]:
    """All main effects and interactions of ``variables``."""
    return [l(list(c)) for k in range(1, len(variables) + 1) for c in combinations(variables, k)]


@dataclass(frozen=True)
class f:  # noqa: N801
    """Smooth of one variable, or tensor smooth of several: full (``te``) or interaction only.

    ``by``: one smooth for each level of a factor; ``binary`` (factor, level): a smooth for that level
    alone; ``by_cont``: multiplied by a numeric variable; ``id``: smooths that share their penalties.
    ``rp`` 1: Demmler-Reinsch form; 2: coefficients are function values (tensor smooths). ``penalty``:
    orders of difference penalties, functions n -> matrix, or matrices.
    """

    variables: Sequence[str]
    by: str | None = None
    by_cont: str | None = None
    binary: tuple[str, str] | None = None
    id: int | None = None
    nk: int | Sequence[int] | None = None
    te: bool = False
    rp: int | None = None
    constraint: str = "QR"
    identifiable: bool = True
    scale_te: bool = True
    deg: int = 3
    is_penalized: bool = True
    penalize_null: bool = False
    penalty: Sequence[Any] = (2,)
    subgroup: tuple[str, str] | None = None


def fs(variables: Sequence[str], rf: str, nk: int = 9, m: int = 1, rp: int = 1, by_cont: str | None = None, by_subgroup: tuple[str, str] | None = None, deg: int = 3) -> f:
    """One smooth with shared penalties for each level of ``rf``, its null space penalised as well."""
    return f(variables, by=rf, by_cont=by_cont, id=99, nk=nk + 1, rp=rp, identifiable=False, penalize_null=True, penalty=(m,), deg=deg, subgroup=by_subgroup)


@dataclass(frozen=True)
class irf:  # noqa: N801
    """Impulse response: a smooth of ``variables[0]`` that starts at a series' event.

    ``onset`` names the column with the event's row number in its series; the series' rows are
    ordered by the formula's ``order``.
    """

    variables: Sequence[str]
    onset: str
    by: str | None = None
    id: int | None = None
    nk: int = 10
    deg: int = 3
    is_penalized: bool = True
    penalty: Sequence[Any] = (2,)


@dataclass(frozen=True)
class ri:  # noqa: N801
    """Random intercept of a factor."""

    variable: str
    id: int | None = None


@dataclass(frozen=True)
class rs:  # noqa: N801
    """Random slope of a variable or interaction, by level of ``by``."""

    variables: Sequence[str]
    by: str | None = None
    id: int | None = None


@dataclass
class Formula:
    """Response and terms. ``series`` and ``order`` are needed by impulse responses and AR(1).

    ``as_factor``: numeric columns to be taken as factors; ``codebook``: {factor: {level: code}}.
    """

    lhs: lhs | None
    terms: Sequence[Any]
    series: str | None = None
    order: Sequence[str] = ()
    as_factor: Sequence[str] = ()
    codebook: dict[str, dict[str, int]] = field(default_factory=dict)

    def flat(self) -> list[Any]:
        """Terms in the order of the coefficients: parametric, impulse, smooth (unpenalised first), random."""
        terms = [t for part in self.terms for t in (part if isinstance(part, list) else [part])]
        out = [t for t in terms if isinstance(t, i | l)]
        out += [t for t in terms if isinstance(t, irf)]
        smooth = [t for t in terms if isinstance(t, f)]
        out += [t for t in smooth if not t.is_penalized] + [t for t in smooth if t.is_penalized]
        return out + [t for t in terms if isinstance(t, ri | rs)]

    def variables(self) -> list[str]:
        found: list[str] = []
        for t in self.flat():
            found += list(getattr(t, "variables", [])) + ([t.variable] if isinstance(t, ri) else [])
            for name in ("by", "by_cont", "onset"):
                if getattr(t, name, None):
                    found.append(getattr(t, name))
            for name in ("binary", "subgroup"):
                if getattr(t, name, None):
                    found.append(getattr(t, name)[0])
        return list(dict.fromkeys(found))
