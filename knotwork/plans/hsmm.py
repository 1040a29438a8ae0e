"""Hidden semi-Markov models: explicit-duration states over series of observations.

State of the recursion at a sample: (samples the current state still lasts, state). Durations are
1..D-1 with probabilities from a discretised Gamma distribution, renormalised. A series is a group
of rows, ordered by the formula's order; likelihood, decoding, sampling and residuals run on whole
series in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.families import GAMLSSFamily
from ..functions.special import gamma_cdf, normal_ppf
from ..operators.partials import columns, whole_series
from ..session import ensure_importable
from . import chains
from .joint import GSMM, GSMMFamily, each_series


@dataclass
class Chain:
    """Probabilities of one series: ``emit`` (n, S), ``last`` (D-1, S), ``move`` (S, S), ``first`` (S).

    ``emit`` may also depend on the samples that a state still lasts: (n, D-1, S).
    """

    emit: np.ndarray
    last: np.ndarray
    move: np.ndarray
    first: np.ndarray
    ends_with_last: bool = False


def _enter(c: Chain, out: np.ndarray) -> np.ndarray:
    """Weights of entering each state after those that end now."""
    return out @ c.move


def forward(c: Chain) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, scaled forward probabilities (n, D-1, S) and scales."""
    n, (k, s) = len(c.emit), c.last.shape
    a, scale = np.empty((n, k, s)), np.empty(n)
    for t in range(n):
        if t == 0:
            now = c.last * c.first
        else:
            now = c.last * _enter(c, a[t - 1, 0])
            now[:-1] += a[t - 1, 1:]
        now = now * c.emit[t]
        if t == n - 1 and c.ends_with_last:
            now[1:] = 0.0
        scale[t] = now.sum()
        a[t] = now / scale[t] if scale[t] > 0 else now
    with np.errstate(divide="ignore"):
        return float(np.log(scale).sum()), a, scale


def viterbi(c: Chain) -> tuple[np.ndarray, int, float]:
    """Most probable states, samples that the last one still lasts, and the path's log-probability."""
    n, (k, s) = len(c.emit), c.last.shape
    with np.errstate(divide="ignore"):
        emit, last, move, first = (np.log(v) for v in (c.emit, c.last, c.move, c.first))
    best, new, origin = np.empty((n, k, s)), np.zeros((n, k, s), bool), np.zeros((n, s), int)
    best[0] = last + first + emit[0]
    new[0] = True
    for t in range(1, n):
        entry = best[t - 1, 0][:, None] + move
        origin[t] = entry.argmax(axis=0)
        fresh = last + entry.max(axis=0)
        stay = np.full((k, s), -np.inf)
        stay[:-1] = best[t - 1, 1:]
        new[t] = fresh > stay
        best[t] = np.maximum(fresh, stay) + emit[t]
    end = best[-1].copy()
    if c.ends_with_last:
        end[1:] = -np.inf
    r, j = np.unravel_index(end.argmax(), end.shape)
    rest, value, states = int(r), float(end.max()), np.empty(n, int)
    for t in range(n - 1, -1, -1):
        states[t] = j
        if t and new[t, r, j]:
            j, r = origin[t, j], 0
        else:
            r += 1
    return states, rest, value


def backward_sample(c: Chain, rng: np.random.Generator) -> np.ndarray:
    """A state path from its posterior distribution."""
    _, a, _ = forward(c)
    n, (k, s) = len(c.emit), c.last.shape
    p = a[-1].ravel() / a[-1].sum()
    r, j = divmod(int(rng.choice(k * s, p=p)), s)
    states = np.empty(n, int)
    for t in range(n - 1, -1, -1):
        states[t] = j
        if t == 0:
            break
        stay = a[t - 1, r + 1, j] if r + 1 < k else 0.0
        entry = a[t - 1, 0] * c.move[:, j] * c.last[r, j]
        w = np.append(entry, stay)
        pick = int(rng.choice(s + 1, p=w / w.sum()))
        if pick < s:
            r, j = 0, pick
        else:
            r += 1
    return states


def simulate(c: Chain, rng: np.random.Generator) -> np.ndarray:
    """A state path from the model, as long as the series."""
    n, (k, s) = len(c.emit), c.last.shape
    states, t, j = np.empty(n, int), 0, int(rng.choice(s, p=c.first))
    while t < n:
        length = 1 + int(rng.choice(k, p=c.last[:, j] / c.last[:, j].sum()))
        states[t : t + length] = j
        t += length
        if t < n:
            j = int(rng.choice(s, p=c.move[j]))
    return states


def _ahead(c: Chain, a: np.ndarray, t: int) -> np.ndarray:
    """Probabilities of sample ``t``'s state before it is seen, (D-1, S)."""
    if t == 0:
        return c.last * c.first
    now = c.last * _enter(c, a[t - 1, 0])
    now[:-1] += a[t - 1, 1:]
    return now


def _mixture(w: np.ndarray, cdf: np.ndarray) -> float:
    w = w / w.sum()
    return float((w * cdf).sum() if cdf.ndim == 2 else w.sum(axis=0) @ cdf)


def forward_residuals(c: Chain, cdf: np.ndarray) -> np.ndarray:
    """Normal scores of each observation's distribution given the past; ``cdf`` like ``emit``."""
    _, a, _ = forward(c)
    out = np.array([_mixture(_ahead(c, a, t), cdf[t]) for t in range(len(c.emit))])
    return normal_ppf(np.clip(out, 1e-12, 1 - 1e-12))


def backward(c: Chain, scale: np.ndarray) -> np.ndarray:
    """Scaled backward probabilities (n, D-1, S)."""
    n, (k, s) = len(c.emit), c.last.shape
    b = np.ones((n, k, s))
    if c.ends_with_last:
        b[-1, 1:] = 0.0
    for t in range(n - 2, -1, -1):
        seen = b[t + 1] * c.emit[t + 1]
        b[t, 1:] = seen[:-1] / scale[t + 1]
        b[t, 0] = c.move @ (c.last * seen).sum(axis=0) / scale[t + 1]
    return b


def predictive_residuals(c: Chain, cdf: np.ndarray) -> np.ndarray:
    """Normal scores of each observation's distribution given all others of its series."""
    _, a, scale = forward(c)
    b = backward(c, scale)
    out = np.array([_mixture(_ahead(c, a, t) * b[t], cdf[t]) for t in range(len(c.emit))])
    return normal_ppf(np.clip(out, 1e-12, 1 - 1e-12))


class HSMMFamily(GSMMFamily):
    """Semi-Markov family for ``GSMM``.

    Formulas, in order: for each state and each response the parameters of its family; for each state
    mean and scale of its duration; if ``move`` is None, for each state its states - 2 transition
    logits; if ``first`` is None, states - 1 initial logits. Duration, transition and initial
    predictors take the covariates of a series' first row. Only the first formula of each response
    names it; all others have no response.

    ``events`` are states that last exactly as long as ``template``, and whose first emission
    parameter follows it: its value times the template's at the samples since the event began. Their
    duration formulas have no effect.
    """

    shape = "grouped"

    def __init__(self, states: int, families: Sequence[GAMLSSFamily], longest: int, move: np.ndarray | None = None, first: np.ndarray | None = None, ends_with_last: bool = False, events: Sequence[int] = (), template: np.ndarray | None = None) -> None:
        self.events, self.template = list(events), template
        if self.events and (template is None or len(template) >= longest):
            raise ValueError("events need a template shorter than the longest duration")
        self.states, self.families, self.longest = states, list(families), longest
        self.move, self.first, self.ends_with_last = move, first, ends_with_last
        emission = sum(f.n_par for f in families) * states
        logits = (states * (states - 2) if move is None else 0) + (states - 1 if first is None else 0)
        super().__init__(emission + 2 * states + logits, [])

    def durations(self, coefs: Sequence[np.ndarray], splits: list[int], xs: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the durations 1..D-1 by coefficients and state, shape (coefs, D-1, states)."""
        at = sum(f.n_par for f in self.families) * self.states
        eta = np.array([[[float(xs[at + 2 * j + k][0] @ c[splits[at + 2 * j + k] : splits[at + 2 * j + k + 1]]) for k in (0, 1)] for j in range(self.states)] for c in coefs])
        mean, scale = np.moveaxis(np.exp(np.clip(eta, -20, 20)), 2, 0)
        edges = np.arange(0, self.longest) + 0.5
        edges[0] = 0.0
        p = np.diff(gamma_cdf(edges[None, :, None], (1 / scale)[:, None], (scale * mean)[:, None]), axis=1)
        for j in self.events:
            p[:, :, j] = np.arange(1, self.longest) == len(self.template)
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def changes(self, etas: list[np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of moves and of the first state, from the predictors ``at`` and after at the first row."""
        move, first, s = self.move, self.first, self.states
        if move is None:
            move = np.zeros((s, s))
            for j in range(s):
                z = np.array([0.0, *(float(etas[at + k][0]) for k in range(s - 2))])
                at += s - 2
                e = np.exp(z - z.max())
                move[j, [k for k in range(s) if k != j]] = e / e.sum()
        if first is None:
            z = np.array([0.0, *(float(etas[at + k][0]) for k in range(s - 1))])
            e = np.exp(z - z.max())
            first = e / e.sum()
        return move, first

    def chain(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], last: np.ndarray | None = None) -> tuple[Chain, list[list[list[np.ndarray]]]]:
        """Probabilities of a series, and the emission parameters by state and response."""
        etas, at, s = self.etas(coef, splits, xs), 0, self.states
        n = len(ys[0])
        log, pars = np.zeros((n, s)), []
        for j in range(s):
            own = []
            for y, f in zip(ys, self.families, strict=True):
                mus = f.means(etas[at : at + f.n_par])
                own.append(mus)
                log[:, j] += f.lp(y, *mus)
                at += f.n_par
            pars.append(own)
        last = self.durations([coef], splits, xs)[0] if last is None else last
        at += 2 * s
        if self.events:
            log = np.repeat(log[:, None], self.longest - 1, axis=1)
            for j in self.events:
                for rest in range(len(self.template)):
                    scale = self.template[len(self.template) - 1 - rest]
                    log[:, rest, j] = sum(f.lp(y, m[0] * scale, *m[1:]) for y, f, m in zip(ys, self.families, pars[j], strict=True))
        move, first = self.changes(etas, at)
        return Chain(np.exp(np.clip(log, -700, 300)), last, move, first, self.ends_with_last), pars

    def llk(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> float:
        return float(self.llks([coef], splits, ys, xs)[0])

    def llks(self, coefs: Sequence[np.ndarray], splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        """One recursion over the samples for all coefficients at once."""
        durations = self.durations(coefs, splits, xs)
        chains = [self.chain(c, splits, ys, xs, d)[0] for c, d in zip(coefs, durations, strict=True)]
        emit, last, move, first = (np.stack([getattr(c, n) for c in chains]) for n in ("emit", "last", "move", "first"))
        n, total, now = emit.shape[1], np.zeros(len(coefs)), None
        for t in range(n):
            if t == 0:
                now = last * first[:, None]
            else:
                entry = np.einsum("bi,bij->bj", now[:, 0], move)
                stay = now[:, 1:]
                now = last * entry[:, None]
                now[:, :-1] += stay
            now = now * (emit[:, t, None] if emit.ndim == 3 else emit[:, t])
            if t == n - 1 and self.ends_with_last:
                now[:, 1:] = 0.0
            scale = now.sum(axis=(1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.log(scale)
                now = now / scale[:, None, None]
        return total


    #: The likelihood does many coefficients in one recursion, so second derivatives come from it.
    batched = True

    def gradient(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
        """Gradient of a series' log-likelihood: the complete-data score, expected under the posterior of the states.

        One forward and one backward recursion give the probabilities of states, of entries with each
        duration, of moves and of the first state. With events differences of the likelihood are taken.
        """
        out, s = np.zeros(len(coef)), self.states
        if self.events:
            step = 1e-5 * np.maximum(np.abs(coef), 1.0)
            moves = np.diag(step)
            both = self.llks([*(coef + m for m in moves), *(coef - m for m in moves)], splits, ys, xs)
            return (both[: len(coef)] - both[len(coef) :]) / (2 * step)
        c, _ = self.chain(coef, splits, ys, xs)
        llk, a, scale = forward(c)
        if not np.isfinite(llk):
            return out
        b = backward(c, scale)
        state = (a * b).sum(axis=1)  # (n, S)
        seen = b * c.emit[:, None] / scale[:, None, None]
        enter = np.vstack((c.first[None], a[:-1, 0] @ c.move))  # weight of entering at each sample
        stays = c.last * np.einsum("tj,trj->rj", enter, seen)  # expected stays by duration and state
        reached = np.einsum("rj,trj->tj", c.last, seen)
        moved = c.move * (a[:-1, 0].T @ reached[1:])
        begun = c.first * reached[0]
        return self._score(coef, splits, ys, xs, state, stays, moved, begun, c.move, c.first)

    def _score(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], state: np.ndarray, stays: np.ndarray, moved: np.ndarray, begun: np.ndarray, move: np.ndarray, first_p: np.ndarray) -> np.ndarray:
        """Complete-data score of expected states (n, S), stays (D-1, S), moves (S, S) and first states (S).

        Predictors but those of emissions are read at the first row, so all series must agree in them.
        """
        out, s = np.zeros(len(coef)), self.states

        def add(k: int, value: np.ndarray) -> None:
            out[splits[k] : splits[k + 1]] += value

        etas, at = self.etas(coef, splits, xs), 0
        for j in range(s):
            for y, f in zip(ys, self.families, strict=True):
                with np.errstate(all="ignore"):
                    first, _ = f.derivatives(y, etas[at : at + f.n_par])
                for k in range(f.n_par):
                    add(at + k, xs[at + k].T @ (state[:, j] * first[k]))
                at += f.n_par
        # the duration's probabilities are differences of a distribution function without closed slopes in its shape
        step, shifted = 1e-5, []
        for k in range(2 * s):
            for sign in (1, -1):
                moved_coef, x = coef.copy(), xs[at + k][0]
                moved_coef[splits[at + k] : splits[at + k + 1]] += sign * step * x / max(float(x @ x), 1e-300)
                shifted.append(moved_coef)
        logs = np.log(np.maximum(self.durations(shifted, splits, xs), 1e-300))
        for k in range(2 * s):
            slope = (logs[2 * k, :, k // 2] - logs[2 * k + 1, :, k // 2]) / (2 * step)
            add(at + k, xs[at + k][0] * float(stays[:, k // 2] @ slope))
        at += 2 * s
        if self.move is None:
            for j in range(s):
                others = [k for k in range(s) if k != j]
                slope = moved[j, others] - move[j, others] * moved[j].sum()
                for k in range(s - 2):
                    add(at + k, xs[at + k][0] * slope[k + 1])
                at += s - 2
        if self.first is None:
            for k in range(s - 1):
                add(at + k, xs[at + k][0] * (begun[k + 1] - begun.sum() * first_p[k + 1]))
        return out

    # many series at once -----------------------------------------------------------------------------
    def lanes(self, xs: list[np.ndarray], starts: np.ndarray) -> list[chains.Lanes]:
        """Batches of series that agree in what their durations, moves and first state depend on."""
        at = sum(f.n_par for f in self.families) * self.states
        own = [x[starts] for x in xs[at:]]
        alike = np.unique(np.column_stack(own), axis=0, return_inverse=True)[1].ravel() if own else np.zeros(len(starts), int)
        return chains.lanes(starts, len(xs[0]), alike)

    def emissions(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], made: dict) -> list[np.ndarray]:
        """Emission probabilities by state; those in ``made`` of equal coefficients are taken from there."""
        at, out = 0, []
        for j in range(self.states):
            width = sum(f.n_par for f in self.families)
            key = (j, coef[splits[at] : splits[at + width]].tobytes())
            if key not in made:
                if len(made) * len(ys[0]) > chains.CELLS:
                    made.clear()
                log = np.zeros(len(ys[0]))
                for y, f in zip(ys, self.families, strict=True):
                    log += f.lp(y, *f.means([xs[at + k] @ coef[splits[at + k] : splits[at + k + 1]] for k in range(f.n_par)]))
                    at += f.n_par
                made[key] = np.exp(np.clip(log, -700, 300, out=log), out=log)
            else:
                at += width
            out.append(made[key])
        return out

    def tables(self, coefs: Sequence[np.ndarray], splits: list[int], xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of durations, moves and first states at the first row, by coefficients."""
        at = sum(f.n_par for f in self.families) * self.states + 2 * self.states
        found = [self.changes(self.etas(c, splits, [x[:1] for x in xs]), at) for c in coefs]
        return self.durations(coefs, splits, xs), np.stack([m for m, _ in found]), np.stack([f for _, f in found])

    def series_llks(self, coefs: Sequence[np.ndarray], splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        if self.events:
            return super().series_llks(coefs, splits, ys, xs, starts)
        out = np.empty((len(starts), len(coefs)))
        for lane in self.lanes(xs, starts):
            y, x, made = [v[lane.perm] for v in ys], [v[lane.perm] for v in xs], {}
            tables = self.tables(coefs, splits, x)
            few = max(1, min(chains.SERIES // len(lane.series), chains.CELLS // (self.states * len(lane.perm))))
            for k in range(0, len(coefs), few):
                part = slice(k, k + few)
                emit = np.array([self.emissions(c, splits, y, x, made) for c in coefs[part]])
                out[lane.series, part] = chains.forward(lane, emit, *(v[part] for v in tables), self.ends_with_last).llk.T
        return out

    def series_gradient(self, coef: np.ndarray, splits: list[int], ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        if self.events:
            return super().series_gradient(coef, splits, ys, xs, starts)
        out = np.zeros(len(coef))
        for lane in self.lanes(xs, starts):
            y, x = [v[lane.perm] for v in ys], [v[lane.perm] for v in xs]
            last, move, first = (v[0] for v in self.tables([coef], splits, x))
            state, *sums = chains.expected(lane, np.array(self.emissions(coef, splits, y, x, {})), last, move, first, self.ends_with_last)
            out += self._score(coef, splits, y, x, state.T, *sums, move, first)
        return out


class HSMM(GSMM):
    """``GSMM`` with a semi-Markov family: adds what works on single series."""

    family: HSMMFamily

    def each(self, df: DataFrame, kind: str, seed: int = 0, draws: int = 1) -> DataFrame:
        """One row for each sample of each series: (series, place, draw, state, value).

        ``kind``: "viterbi" (value: samples that the last state still lasts), "posterior" (sampled
        paths; value 0), "predict" (simulated paths; value: a draw of the first response),
        "forward" or "predictive" (state -1; value: the first response's normal score given the past, or given
        all other samples), "durations" (one row for
        each stay of the Viterbi path; value: its normal score), or "probabilities" (one row for each
        sample and state; value: log emission probability).
        """
        if kind not in ("viterbi", "posterior", "predict", "forward", "predictive", "durations", "probabilities"):
            raise ValueError(f"unknown kind {kind!r}")
        family, splits, parts, coef = self.family, self.splits, self._parts, self.fitted.coef
        ensure_importable(df.sparkSession)

        def single(ys: list[np.ndarray], xs: list[np.ndarray], series: str) -> tuple[np.ndarray, ...]:
            c, pars = family.chain(coef, splits, ys, xs)
            n = len(ys[0])
            rng = np.random.default_rng((seed, abs(hash(series)) % 2**31))
            place, which, state, value = [], [], [], []

            def add(d: int, s: np.ndarray, v: np.ndarray | float) -> None:
                place.append(np.arange(len(s)))
                which.append(np.full(len(s), d))
                state.append(s)
                value.append(np.broadcast_to(np.asarray(v, float), len(s)))

            if kind == "viterbi":
                s, rest, _ = viterbi(c)
                add(0, s, rest)
            elif kind == "posterior":
                for d in range(draws):
                    add(d, backward_sample(c, rng), 0.0)
            elif kind == "predict":
                for d in range(draws):
                    s = simulate(c, rng)
                    v = np.array([family.families[0].rvs(rng, *(m[[t]] for m in pars[j][0]))[0] for t, j in enumerate(s)])
                    add(d, s, v)
            elif kind in ("forward", "predictive"):
                cdf = np.stack([np.exp(family.families[0].lcp(ys[0], *pars[j][0])) for j in range(family.states)], axis=1)
                if family.events:
                    cdf = np.repeat(cdf[:, None], family.longest - 1, axis=1)
                    for j in family.events:
                        for left in range(len(family.template)):
                            m = pars[j][0]
                            cdf[:, left, j] = np.exp(family.families[0].lcp(ys[0], m[0] * family.template[-1 - left], *m[1:]))
                add(0, np.full(n, -1), (forward_residuals if kind == "forward" else predictive_residuals)(c, cdf))
            elif kind == "durations":
                s, _, _ = viterbi(c)
                cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                length = np.diff(np.append(cuts, n))
                high = np.cumsum(c.last, axis=0)
                top = high[np.minimum(length, len(high)) - 1, s[cuts]]
                u = top - rng.uniform(size=len(cuts)) * c.last[np.minimum(length, len(high)) - 1, s[cuts]]
                add(0, s[cuts], normal_ppf(np.clip(u, 1e-12, 1 - 1e-12)))
            else:
                for j in range(family.states):
                    with np.errstate(divide="ignore"):
                        add(j, np.full(n, j), np.log(c.emit[..., j].max(axis=1) if c.emit.ndim == 3 else c.emit[:, j]))
            return tuple(np.concatenate(x) for x in (place, which, state, value))

        def together(ys: list[np.ndarray], xs: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, ...]:
            """The kinds that many series can do at once: state and value of each row."""
            state, value = np.full(len(ys[0]), -1), np.empty(len(ys[0]))
            for lane in family.lanes(xs, starts):
                y, x = [v[lane.perm] for v in ys], [v[lane.perm] for v in xs]
                last, move, first = (v[0] for v in family.tables([coef], splits, x))
                emit = np.array(family.emissions(coef, splits, y, x, {}))
                if kind == "viterbi":
                    state[lane.perm], rest = chains.viterbi(lane, emit, last, move, first, family.ends_with_last)
                    value[lane.perm] = rest[lane.rank()]
                else:
                    cdf, width, f = [], sum(g.n_par for g in family.families), family.families[0]
                    for j in range(family.states):
                        mus = f.means([x[j * width + k] @ coef[splits[j * width + k] : splits[j * width + k + 1]] for k in range(f.n_par)])
                        cdf.append(np.exp(f.lcp(y[0], *mus)))
                    u = chains.mixtures(lane, emit, last, move, first, family.ends_with_last, np.stack(cdf))
                    value[lane.perm] = normal_ppf(np.clip(u, 1e-12, 1 - 1e-12))
            return state, value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_series(batches):
                block = columns(table.drop_columns(["_q0"]))
                starts = np.flatnonzero(block["_first"])
                names = [str(v) for v in table.column("_q0").take(pa.array(starts)).to_pylist()]
                ys, xs = parts(block)
                if kind in ("viterbi", "forward") and not family.events:
                    size = np.diff(np.append(starts, table.num_rows))
                    place = np.arange(table.num_rows) - np.repeat(starts, size)
                    found = [(place, np.zeros(len(place), int), *together(ys, xs, starts))]
                    sizes = size
                else:
                    found = [single(*part, name) for part, name in zip(each_series(ys, xs, starts), names, strict=True)]
                    sizes = [len(f[0]) for f in found]
                out = [np.concatenate(v) for v in zip(*found, strict=True)]
                which = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
                whole = pa.RecordBatch.from_arrays([which, *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.float64())], ["series", "place", "draw", "state", "value"])
                for k in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(k, 1 << 16)

        return self.rows(df).mapInArrow(run, "series string, place long, draw long, state long, value double")
