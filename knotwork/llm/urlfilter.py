"""URL verdicts by rules and, where none fits, by the ratio of two character language models.

The models are variable-order Markov models over bytes, one of accepted and one of rejected URLs.
What the longest-matching rules decide are their training labels. Counts of (context, byte) are
taken over all labelled URLs, for contexts of order 0 to ``ORDER``, added up by slice before they
are shuffled. Every counted context is kept, so the models are tables that grow with the URLs.
Probabilities are Witten-Bell mixtures with the next shorter context, down to a uniform byte.

Scoring is joins. What a byte adds to a score depends on its longest context alone, so rows are cut
into slices, a slice asks for each of its (context, byte) once, each asked pair is worked out once,
order by order, and the answers go back to the slices. A frequent pair has one row for a slice, and
a context at most 257 followers and 257 longer ones, so no key grows with the number of URLs.

A URL's score is the difference of its log-likelihoods divided by its bytes (and the end mark). The
threshold is calibrated on labelled URLs whose hash keeps them out of the counts: the one that gets
the largest share of both classes right, the middle of the best scores' range.

Rules: (verdict, host, path). A rule fits its host and all subdomains if the URL's path starts with
its path; the longest fitting rule wins.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. A null is
scored as an empty text, a URL without ``://`` by all its characters. If labels of one class are missing, all scores are 0 and the verdict is ``allow``.
Repeated rows get equal verdicts. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, slices, stash

Rule = tuple[str, str, str]
ORDER = 5
#: Rows that ask for their pairs together.
TOGETHER = 256
#: One labelled URL in so many is kept for calibration.
CALIBRATE = 5
BINS, RANGE = 4000, 4.0
_END = 256  # byte values are 0-255; contexts hold value + 1, 0 before the start
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, how).otherwise(verdict)
    return name, verdict


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, next symbol and context number by order, for every byte of a slice and each text's end.

    A context number holds the last bytes in base 257 and, on top, its order.
    """
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = offsets[1:] + np.arange(1, len(offsets)) - 1
    symbol = np.empty(len(row), np.int64)
    is_end = np.zeros(len(row), bool)
    is_end[ends] = True
    symbol[is_end], symbol[~is_end] = _END, data
    begin = np.repeat(offsets[:-1] + np.arange(len(lengths)), lengths + 1)
    depth = np.arange(len(row)) - begin
    contexts, context = [np.zeros(len(row), np.int64)], np.zeros(len(row), np.int64)
    for k in range(1, ORDER + 1):
        before = np.zeros(len(row), np.int64)
        ok = depth >= k
        before[ok] = symbol[np.flatnonzero(ok) - k] + 1
        context = context + before * 257 ** (k - 1)
        contexts.append(context + k * 257**ORDER)
    return row, symbol, contexts


class Model:
    """One class in memory, which ``ratios`` must agree with: contexts with their totals and kinds, and (context, byte) pairs."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> None:
        pair = context * 257 + symbol
        order = np.argsort(pair)
        self.pairs, self.counts = pair[order], count[order].astype(float)
        self.contexts, first = np.unique(context[order], return_index=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.kinds = np.diff(np.append(first, len(context))).astype(float)

    def log_likelihood(self, symbol: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(symbol), 1 / 257)
        for c in contexts:
            at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
            known = self.contexts[at] == c
            pair = c * 257 + symbol
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            n = np.where(self.pairs[where] == pair, self.counts[where], 0)
            p = np.where(known, (n + self.kinds[at] * p) / (self.totals[at] + self.kinds[at]), p)
        return np.log(p)


def counts(labelled: DataFrame) -> DataFrame:
    """(allow, context, symbol, n) over all rows (verdict, rest)."""

    def work(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, symbol, contexts = _codes(data, offsets)
        allow = np.array([v == "allow" for v in batch.column("verdict").to_pylist()])[row]
        parts = []
        for yes in (True, False):
            mine = allow == yes
            for c in contexts:
                pair, n = np.unique(c[mine] * 257 + symbol[mine], return_counts=True)
                parts.append((np.full(len(pair), yes), pair // 257, pair % 257, n))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["allow", "context", "symbol", "n"])

    each = arrow_map(labelled, "rest", "allow boolean, context long, symbol long, n long", work)
    return stash(each.groupBy("allow", "context", "symbol").agg(F.sum("n").alias("n")), "counts")


def _shorter(context: Column, order: int) -> Column:
    """The context's last ``order`` bytes."""
    return F.pmod(context, F.lit(257**order)) + F.lit(order * 257**ORDER)


def ratios(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(context, symbol, ratio) of distinct (context, symbol) of the longest order: logs of allow less block."""
    low = F.pmod("context", F.lit(257**ORDER))
    orders = F.explode(F.array(*[_shorter(low, k) for k in range(ORDER + 1)])).alias("context")
    asked = pairs.select(orders, "symbol").distinct()
    own = [F.sum(F.when(F.col("allow") == yes, F.col("n")).otherwise(0)).alias(n) for yes, n in ((True, "n1"), (False, "n0"))]
    none = F.lit(None).cast("boolean").alias("allow")
    both = counted.withColumn("asked", F.lit(False)).unionByName(asked.select(none, "context", "symbol", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    both = both.groupBy("context", "symbol").agg(*own, F.max("asked").alias("asked"))
    here = Window.partitionBy("context")  # 257 rows at most
    for c in ("1", "0"):
        both = both.withColumns({f"t{c}": F.sum(f"n{c}").over(here), f"k{c}": F.count(F.when(F.col(f"n{c}") > 0, 1)).over(here)})
    held = stash(both.where("asked").drop("asked"), "asked")
    found = None
    for k in range(ORDER + 1):
        level = held.where(F.col("context").between(k * 257**ORDER, (k + 1) * 257**ORDER - 1))
        if found is None:
            level = level.withColumns({"q1": F.lit(1 / 257), "q0": F.lit(1 / 257)})
        else:
            before = found.select(F.col("context").alias("_c"), F.col("symbol").alias("_s"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
            level = level.join(before, (_shorter(F.pmod("context", F.lit(257**ORDER)), k - 1) == F.col("_c")) & (F.col("symbol") == F.col("_s")))
        mixed = {f"p{c}": F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") + F.col(f"k{c}") * F.col(f"q{c}")) / (F.col(f"t{c}") + F.col(f"k{c}"))).otherwise(F.col(f"q{c}")) for c in "10"}
        found = level.select("context", "symbol", *[e.alias(n) for n, e in mixed.items()])
    return found.select("context", "symbol", (F.log("p1") - F.log("p0")).alias("ratio"))


def scores(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` with ``score`` in place of ``rest``."""
    kept = [n for n in rows.columns if n != "rest"]
    cut = stash(rows.withColumn("_slice", F.shiftright(F.monotonically_increasing_id(), TOGETHER.bit_length() - 1)), "slices")

    def ask(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, symbol, contexts = _codes(data, offsets)
        own, number = np.unique(batch.column("_slice").to_numpy(), return_inverse=True)
        parts = []
        for j, one in enumerate(own):
            mine = number[row] == j
            pair = np.unique(contexts[ORDER][mine] * 257 + symbol[mine])
            parts.append((np.full(len(pair), one), pair // 257, pair % 257))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["_slice", "context", "symbol"])

    # a slice in several batches may ask twice; equal answers do no harm
    asked = stash(arrow_map(cut.select("_slice", "rest"), "rest", "_slice long, context long, symbol long", ask), "pairs")
    answers = asked.join(ratios(counted, asked.select("context", "symbol").distinct()), ["context", "symbol"]).select("_slice", "context", "symbol", "ratio")

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        pair = answers.column("context").to_numpy() * 257 + answers.column("symbol").to_numpy()
        order = np.argsort(pair)
        pair, ratio = pair[order], answers.column("ratio").to_numpy()[order]
        found = [np.zeros(0)]
        for batch in mine.combine_chunks().to_batches():
            for part, data, offsets in slices(batch, "rest"):
                row, symbol, contexts = _codes(data, offsets)
                at = np.searchsorted(pair, contexts[ORDER] * 257 + symbol)
                found.append(np.bincount(row, ratio[at], part.num_rows) / (np.diff(offsets) + 1))
        return mine.select(kept).append_column("score", pa.array(np.concatenate(found)))

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept)
    return cut.groupBy("_slice").cogroup(answers.groupBy("_slice")).applyInArrow(score, f"{kinds}, score double")


def threshold(table: Iterator[tuple[int, bool, int]]) -> float:
    """From counts by (bin, allow): the score from which most of both classes is right."""
    hist = np.zeros((2, BINS))
    for b, allow, n in table:
        hist[int(allow), b] += n
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    right = (1 - np.append(0, np.cumsum(share[1]))) + np.append(0, np.cumsum(share[0]))  # cut before bin b
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every URL, with its score."""
    host, path = host_and_path(F.col(url_col))
    start = F.instr(F.col(url_col), "://")
    rest = F.coalesce(F.when(start > 0, F.col(url_col).substr(start + 3, F.length(url_col))).otherwise(F.col(url_col)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    rows = rows.withColumn("apart", F.col("verdict").isNotNull() & (F.pmod(F.xxhash64("rest", F.lit("calibrate")), F.lit(CALIBRATE)) == 0))
    counted = counts(rows.where("verdict is not null and not apart").select("verdict", "rest"))
    if counted.where("context = 0").select("allow").distinct().count() < 2:
        return rows.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = stash(scores(rows, counted), "scores")
    bins = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1)).alias("bin")
    cut = threshold((r["bin"], r["verdict"] == "allow", r["count"]) for r in scored.where("apart").groupBy(bins, "verdict").count().collect())  # 2 * BINS rows
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")
