"""Quality rules by weak supervision.

Every rule votes good, bad or abstains on a document. Expectation-maximisation over the table of
vote patterns (at most 3**rules rows, counted over ALL documents) estimates the accuracy of each
rule and the share of good documents; a document is kept if its posterior probability of being good
is at least ``KEEP_AT``. Only the pattern counts reach the driver, whose number does not grow with
the input.

Cases: a null or empty text has no words, so all counts are 0, ``base_failed`` is true and ``kept``
false. Repeated rows are judged alike, each for itself. An empty table gives an empty result.
Columns of the input whose names clash with result columns are not carried by ``quality`` and are
kept untouched by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Segments, arrow_map, covered, gram_hashes, repeats_in_row, run_hashes, stash

#: Posterior probability of good from which a document is kept.
KEEP_AT = 0.5
#: Words below which the rule ``length`` votes bad.
SHORT = 20
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
RULES = ("symbols", "capitals", "punctuation", "lines", "repeats", "word_length", "length", "digits")
GOOD, BAD = 1, 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BYTE = np.arange(256)
_UPPER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122))
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~_DIGIT


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text of a slice."""
    seg, n = Segments(data, offsets), len(offsets) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(sums[offsets])

    rows, words = seg.rows(), seg.word_hashes()
    first = seg.windows(REPEAT_WINDOW)
    often, _ = repeats_in_row(gram_hashes(words, first, REPEAT_WINDOW), rows[first])
    again = covered(first[often], REPEAT_WINDOW, len(words))
    # a line starts at a row's start or after a line feed; a row of no bytes has no line with a word
    starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    starts = starts[starts < len(data)]
    feeds = np.append(np.flatnonzero(data == 10), len(data))
    of_line = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(feeds[np.searchsorted(feeds, starts)], offsets[of_line + 1])
    full = np.concatenate(([0], np.cumsum(seg.inside)))
    has = full[ends] > full[starts]
    starts, ends, of_line = starts[has], ends[has], of_line[has]
    _, later = repeats_in_row(run_hashes(data, starts, ends), of_line)
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": seg.counts.astype(np.int64),
        "word_chars": per_row(seg.inside & lead),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of_line[later], minlength=n),
        "n_repeat_words": np.bincount(rows[again], minlength=n),
        "n_lines": np.bincount(of_line, minlength=n),
        "n_upper": per_row(_UPPER[data]),
        "n_letters": per_row(_LETTER[data]),
        "n_digits": per_row(_DIGIT[data]),
        "n_marks": per_row(_MARK[data]),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Pattern number of each row: digit k, to the base 3, is the vote of rule k (0 abstains)."""

    def share(a: str, b: str) -> np.ndarray:
        return m[a] / np.maximum(m[b], 1)

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, 0))

    mean, words = share("word_chars", "n_words"), m["n_words"]
    cast = (
        vote(share("n_symbols", "n_words") <= 0.05, share("n_symbols", "n_words") > 0.3),
        vote((share("n_upper", "n_letters") < 0.2) & (m["n_letters"] > 0), share("n_upper", "n_letters") > 0.4),
        vote(share("n_marks", "word_chars") < 0.08, share("n_marks", "word_chars") > 0.16),
        vote((m["n_dup_lines"] == 0) & (m["n_lines"] > 1), share("n_dup_lines", "n_lines") > 0.3),
        vote(100 * m["n_repeat_words"] <= 5 * words, 100 * m["n_repeat_words"] > 15 * words),
        vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        vote(words >= 50, words < SHORT),
        vote(share("n_digits", "word_chars") < 0.05, share("n_digits", "word_chars") > 0.2),
    )
    code = np.zeros(len(words), np.int64)
    for k, v in enumerate(cast):
        code += v * 3**k
    return code


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def estimate(counts: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], np.ndarray, float]:
    """EM on pattern counts: posterior of good by pattern, vote probabilities, share of good.

    The model has, for each class and rule, the probabilities of its three answers; they tell how
    far a rule is right when it votes good, when it votes bad, and how often it abstains. A rule
    that says good of everything then counts for little, one that says bad of junk alone for much.
    Start: a document is the less likely good the more rules vote bad. Counts are smoothed by half
    an observation; the start fixes which class is the good one.
    """
    if not counts:
        return {}, np.full((2, len(RULES), 3), 1 / 3), 0.5
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    cast = codes[:, None] // 3 ** np.arange(len(RULES)) % 3
    answers = np.stack([cast == v for v in range(3)], axis=2).astype(float)
    post = 1 / (1 + np.exp(3 * (cast == BAD).sum(1) - 2.0))
    odds, share = np.zeros((2, len(RULES), 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([n * post, n * (1 - post)])
        odds = np.einsum("cp,prv->crv", weight, answers) + 0.5
        odds /= odds.sum(2, keepdims=True)
        share = float((weight[0].sum() + 1) / (n.sum() + 2))
        score = np.einsum("prv,rv->p", answers, np.log(odds[0]) - np.log(odds[1])) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    return {int(c): float(p) for c, p in zip(codes, post, strict=True)}, odds, share


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern long, base_failed boolean"


def _stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        m = measure(data, offsets)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(m[k], pa.int64()) for k in names), pa.array(votes(m)), pa.array(base_failed(m))], [id_col, *names, "pattern", "base_failed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, {_STATS}", work)


def fit(stats: DataFrame) -> dict[int, float]:
    """Posterior of good by vote pattern, from the pattern counts of all rows."""
    counts = {r[0]: r[1] for r in stats.groupBy("pattern").count().collect()}  # at most 3**8 rows
    return estimate(counts)[0]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, posterior and verdict of every document."""
    stats = stash(_stats(docs, id_col, text_col), "quality")
    post = stats.sparkSession.createDataFrame(sorted(fit(stats).items()) or [(-1, 0.0)], "pattern long, posterior double")
    judged = stats.join(F.broadcast(post), "pattern", "left")  # at most 3**8 rows
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    post = fit(_stats(docs, id_col, text_col))
    keep = np.zeros(3 ** len(RULES), bool)
    keep[[k for k, p in post.items() if p >= KEEP_AT]] = True

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        m = measure(data, offsets)
        return rows.filter(pa.array(keep[votes(m)] & ~base_failed(m)))

    return arrow_map(docs, text_col, docs.schema, work)
