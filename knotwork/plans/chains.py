"""Semi-Markov recursions over many series of one duration, move and start distribution at once.

Rows are time-major: series are ordered by falling length, so those that reach a sample are the first
ones, and their rows stand together. Weights are kept by the samples since (forward) or until
(backward) a state's change, in rings along the third axis that need no shift from sample to sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Series in a batch, and doubles of emission probabilities at once.
SERIES, CELLS = 1024, 1 << 23


@dataclass
class Lanes:
    """Series side by side: ``perm`` the rows in time-major order, ``alive`` series and ``at`` first row by sample."""

    series: np.ndarray
    perm: np.ndarray
    alive: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, series: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Lanes:
        series = series[np.argsort(-lengths[series], kind="stable")]
        size = lengths[series]
        rank = np.repeat(np.arange(len(series)), size)
        time = np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((rank, time))
        alive = np.bincount(time)
        return cls(series, (np.repeat(starts[series], size) + time)[order], alive, np.append(0, np.cumsum(alive)[:-1]))

    def ended(self, t: int) -> int:
        """Series that go on after sample ``t``; the others alive end with it."""
        return int(self.alive[t + 1]) if t + 1 < len(self.alive) else 0

    def rank(self) -> np.ndarray:
        """Place in ``series`` of each time-major row."""
        return np.arange(len(self.perm)) - np.repeat(self.at, self.alive)

    def cut(self, t: int) -> slice:
        return slice(int(self.at[t]), int(self.at[t] + self.alive[t]))


def lanes(starts: np.ndarray, rows: int, alike: np.ndarray) -> list[Lanes]:
    """Batches of series that are equal in ``alike``, of bounded numbers of series and rows."""
    lengths = np.diff(np.append(starts, rows))
    order = np.lexsort((-lengths, alike))
    out, first = [], 0
    total = np.append(0, np.cumsum(lengths[order]))
    for k in range(1, len(order) + 1):
        if k == len(order) or alike[order[k]] != alike[order[first]] or k - first >= SERIES or total[k + 1] - total[first] > CELLS // 8:
            out.append(Lanes.of(order[first:k], starts, lengths))
            first = k
    return out


def _rolled(p: np.ndarray, back: bool) -> list[np.ndarray]:
    """``p`` along its last axis as the ring holds it, by sample modulo its size."""
    k = p.shape[-1]
    slot = np.arange(k)
    return [np.ascontiguousarray(p[..., (slot - m) % k if back else (m - slot) % k]) for m in range(k)]


@dataclass
class Passed:
    """Forward pass: log-likelihoods (C, B); if kept, by row: entering and ending weights (S, rows), scales."""

    llk: np.ndarray
    enter: np.ndarray | None = None
    leave: np.ndarray | None = None
    scale: np.ndarray | None = None


def forward(lane: Lanes, emit: np.ndarray, last: np.ndarray, move: np.ndarray, first: np.ndarray, ends_with_last: bool, keep: bool = False) -> Passed:
    """``emit`` (C, S, rows), ``last`` (C, D-1, S), ``move`` (C, S, S), ``first`` (C, S), for C sets of coefficients."""
    c, s, rows = emit.shape
    k, b = last.shape[1], len(lane.series)
    p = np.swapaxes(last, 1, 2)
    lasts = np.cumsum(p[..., ::-1], axis=-1)[..., ::-1]
    tables, onward = _rolled(np.stack((p, lasts), axis=2), False), np.ascontiguousarray(np.swapaxes(move, 1, 2))
    ring, total = np.zeros((c, s, k, b)), np.zeros((c, b))
    out = Passed(total)
    if keep:
        out.enter, out.leave, out.scale = np.empty((s, rows)), np.empty((s, rows)), np.empty(rows)
    entry, inverse = np.repeat(first[:, :, None], b, axis=2), np.ones((c, b))
    with np.errstate(all="ignore"):
        for t in range(len(lane.alive)):
            n, cut, on = int(lane.alive[t]), lane.cut(t), lane.ended(t)
            w = ring[..., :n]
            # the ring waits for the last scale, which entering weights have already
            now = emit[:, :, cut]
            w *= (now * inverse[:, None, :n])[:, :, None]
            np.multiply(entry[..., :n], now, out=w[:, :, t % k])
            both = np.matmul(tables[t % k], w)
            ending, mass = both[:, :, 0], both[:, :, 1].sum(axis=1)
            if ends_with_last and on < n:
                mass[:, on:] = ending[..., on:].sum(axis=1)
            total[:, :n] += np.log(mass)
            inverse = 1.0 / mass
            ending = ending * inverse[:, None]
            if keep:
                out.enter[:, cut], out.leave[:, cut], out.scale[cut] = entry[0, :, :n], ending[0], mass[0]
            entry = np.matmul(onward, ending[..., :on])
    return out


def expected(lane: Lanes, emit: np.ndarray, last: np.ndarray, move: np.ndarray, first: np.ndarray, ends_with_last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior states (S, rows); expected stays (D-1, S), moves (S, S) and first states (S), summed over the series.

    ``emit`` is (S, rows). Series without a finite likelihood count nothing.
    """
    s, rows = emit.shape
    k, b = last.shape[0], len(lane.series)
    got = forward(lane, emit[None], last[None], move[None], first[None], ends_with_last, keep=True)
    fine = np.isfinite(got.llk[0])
    if not fine.all():
        emit = emit.copy()
        for t in range(len(lane.alive)):
            cut = lane.cut(t)
            bad = np.flatnonzero(~fine[: lane.alive[t]]) + cut.start
            emit[:, bad], got.scale[bad], got.enter[:, bad], got.leave[:, bad] = 1.0, 1.0, 0.0, 0.0
    tables = _rolled(last.T[:, None], True)
    ring, stays, moved = np.zeros((s, k, b)), np.zeros((s, k)), np.zeros((s, s))
    came, went = np.empty((s, rows)), np.zeros((s, rows))
    slots = np.arange(k)
    for t in range(len(lane.alive) - 1, -1, -1):
        n, cut, on = int(lane.alive[t]), lane.cut(t), lane.ended(t)
        w = ring[..., :n]
        w[..., on:] = 0.0 if ends_with_last else 1.0
        w[:, t % k, on:] = 1.0
        w *= (emit[:, cut] / got.scale[cut])[:, None]
        seen = np.matmul(tables[t % k], w)[:, 0]
        entering = got.enter[:, cut]
        stays[:, (slots - t) % k] += np.matmul(w, entering[:, :, None])[..., 0]
        came[:, cut] = entering * seen
        if t:
            before = slice(int(lane.at[t - 1]), int(lane.at[t - 1]) + n)
            leaving, ahead = got.leave[:, before], move @ seen
            moved += leaving @ seen.T
            went[:, before] = leaving * ahead
            w[:, (t - 1) % k] = ahead
    state = came
    for t in range(1, len(lane.alive)):
        before = slice(int(lane.at[t - 1]), int(lane.at[t - 1] + lane.alive[t]))
        state[:, lane.cut(t)] += state[:, before] - went[:, before]
    return state, stays.T * last, moved * move, state[:, : lane.alive[0]].sum(axis=1)


def viterbi(lane: Lanes, emit: np.ndarray, last: np.ndarray, move: np.ndarray, first: np.ndarray, ends_with_last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Most probable states by row, and by series the samples that the last one still lasts."""
    s, rows = emit.shape
    k, b = last.shape[0], len(lane.series)
    with np.errstate(divide="ignore"):
        emit, last, move, first = np.log(emit), np.log(last)[..., None], np.log(move)[..., None], np.log(first)
    best, origin, new = None, np.zeros((s, rows), np.int16), np.ones((k, s, rows), bool)
    end_state, end_rest = np.empty(b, int), np.empty(b, int)
    for t in range(len(lane.alive)):
        n, cut, on = int(lane.alive[t]), lane.cut(t), lane.ended(t)
        if t == 0:
            best = last + first[:, None] + emit[:, cut]
        else:
            entry = best[0, :, None, :n] + move
            origin[:, cut] = entry.argmax(axis=0)
            fresh = last + entry.max(axis=0)
            stay = np.full((k, s, n), -np.inf)
            stay[:-1] = best[1:, :, :n]
            new[..., cut] = fresh > stay
            best = np.maximum(fresh, stay) + emit[:, cut]
        if on < n:
            end = best[..., on:].copy()
            if ends_with_last:
                end[1:] = -np.inf
            end_rest[on:n], end_state[on:n] = np.divmod(end.reshape(k * s, n - on).argmax(axis=0), s)
    states, r, j = np.empty(rows, int), end_rest.copy(), end_state.copy()
    for t in range(len(lane.alive) - 1, -1, -1):
        n, cut = int(lane.alive[t]), lane.cut(t)
        at = np.arange(cut.start, cut.stop)
        states[cut] = j[:n]
        if t:
            moved = new[r[:n], j[:n], at]
            j[:n], r[:n] = np.where(moved, origin[j[:n], at], j[:n]), np.where(moved, 0, np.minimum(r[:n] + 1, k - 1))
    return states, end_rest


def mixtures(lane: Lanes, emit: np.ndarray, last: np.ndarray, move: np.ndarray, first: np.ndarray, ends_with_last: bool, cdf: np.ndarray) -> np.ndarray:
    """Distribution function of each observation given the past of its series, ``cdf`` (S, rows) by state."""
    s, rows = emit.shape
    k, b = last.shape[0], len(lane.series)
    out, now, wide = np.empty(rows), None, last[..., None]
    with np.errstate(all="ignore"):
        for t in range(len(lane.alive)):
            n, cut = int(lane.alive[t]), lane.cut(t)
            if t == 0:
                now = wide * np.repeat(first[:, None], b, axis=1)
            else:
                entry = move.T @ now[0, :, :n]
                stay = now[1:, :, :n]
                now = wide * entry
                now[:-1] += stay
            w = now.sum(axis=0)
            out[cut] = ((w / w.sum(axis=0)) * cdf[:, cut]).sum(axis=0)
            now *= emit[:, cut]
            scale = now.sum(axis=(0, 1))
            now /= np.where(scale > 0, scale, 1.0)
    return out
