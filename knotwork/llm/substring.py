"""Removal of word windows that another document has already.

A window is a run of ``width`` words of one document. A word is removed if a window covers it whose
words also begin somewhere in a document with a smaller id; this is judged on the input.

* First pass, count-min prefilter: windows are counted by their anchor, the smallest hash among
  the ``width // 2``-word runs inside the window (the first of equals). Equal windows have equal
  anchors, so an anchor's count is never below a window's. Sketches of all partitions are merged.
  A sketch that is too large to be broadcast stays a table, and the marks of repeated bundles are
  joined with their documents (see ``sketch``).
* Second pass: consecutive windows with equal anchors form a bundle, also where the text repeats. Only bundles whose anchor
  is estimated to occur twice are grouped, and grouped exactly: first whole bundles by 128-bit hash
  of their words, which takes together copied passages at about 13 windows a row, then the single
  windows of the distinct bundles that share an anchor.

Grouping aggregates before it shuffles, so a passage that a third of all documents hold is no single
task's work, and the joins read tables whose skewed keys Spark splits.

Cases: a null text has no words, a text of fewer than ``width`` words loses none. Equal windows
within one document, or in rows of the same id, remove nothing. A row with a null id neither loses
words nor takes any. Repeated rows (same id and text) get equal answers. An empty table gives
an empty result. Clashing column names are not carried by ``removed`` and are kept by ``strip``, which
cuts words out with the white space behind them and leaves every other byte as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .shared import Segments, arrow_map, covered, gram_hashes, mix, release, stash, unused

WIDTH = 50


def _bundles(seg: Segments, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of every bundle of a slice."""
    wide = width // 2
    reach = width - wide + 1  # anchors inside a window
    starts = seg.windows(width)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    value = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    inner = seg.windows(wide)
    value[inner] = gram_hashes(words, inner, wide)
    least, at, span = value, np.arange(len(words)), 1

    def join(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[shift:] < least[: len(least) - shift]
        return np.where(right, least[shift:], least[: len(least) - shift]), np.where(right, at[shift:], at[: len(at) - shift])

    while 2 * span <= reach:
        least, at = join(span)
        span *= 2
    if span < reach:
        least, at = join(reach - span)
    anchor = value[at[starts]]
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return starts[head], np.diff(np.append(head, len(starts))), anchor[head]


def _schema(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))


def _found(rows: DataFrame, width: int, repeat: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Bundles that ``repeat(rows, anchors, numbers of bundles by row)`` marks, with the hashes of their windows."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        seg = Segments(data, offsets)
        words = seg.word_hashes()
        first, many, anchor = _bundles(seg, words, width)
        row = np.searchsorted(seg.bounds, first, "right") - 1
        keep = repeat(rows, anchor, np.bincount(row, minlength=rows.num_rows))
        if not keep.any():
            return None
        first, many, anchor, row = first[keep], many[keep], anchor[keep], row[keep]
        each = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        window = gram_hashes(seg.word_hashes(1), each, width)
        windows, ends = window.astype("<u8").tobytes(), 8 * np.cumsum(many)
        # a bundle's windows in their order, by two hashes made of two hashes of its words
        order = (each - np.repeat(first, many)).astype(np.uint64)
        begin = np.cumsum(many) - many
        ones, twos = (np.add.reduceat(mix(w + mix(order + np.uint64(k))), begin).view(np.int64) for k, w in ((1, window), (2, gram_hashes(words, each, width))))
        hashes = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(windows)]).cast(pa.binary())
        picked = pa.array(row)
        return pa.RecordBatch.from_arrays([rows.column(0).take(picked), rows.column(1).take(picked), pa.array(first - seg.bounds[row], pa.int32()), pa.array(many, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(ones), pa.array(twos), hashes], ["_id", "_key", "first", "many", "anchor", "one", "two", "windows"])

    return arrow_map(rows, "_text", f"_id {_schema(rows, '_id')}, _key long, first int, many int, anchor long, one long, two long, windows binary", work)


def _repeats(docs: DataFrame, width: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """Bundles whose anchor may occur twice."""
    rows = _rows(docs, id_col, text_col)
    expected = 2 * (sketch.text_bytes(docs, text_col) // (3 * width))  # words of six bytes, a bundle for width / 2 or so

    def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seg = Segments(data, offsets)
        first, _, anchor = _bundles(seg, seg.word_hashes(), width)
        return anchor, np.searchsorted(seg.bounds, first, "right") - 1

    if sketch.fits(expected, most=most):
        seen = docs.sparkSession.sparkContext.broadcast(sketch.build(rows, "_text", expected, lambda d, o: anchors(d, o)[0], most=most))  # at most 2**most bits a row
        return stash(_found(rows, width, lambda _, anchor, __: seen.value.may_repeat(anchor)), "bundles")

    def ask(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        anchor, row = anchors(data, offsets)
        lists = [pa.array([x.to_pylist()], pa.list_(x.type)) for x in (rows.column(0), rows.column(1))]
        counts = pa.array([np.bincount(row, minlength=rows.num_rows).tolist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*lists, counts, pa.array([anchor.astype("<u8").tobytes()], pa.binary())], ["ids", "texts", "counts", "keys"])

    kind = _schema(rows, "_id")
    asked = arrow_map(rows, "_text", f"ids array<{kind}>, texts array<long>, counts array<int>, keys binary", ask)
    asked = stash(asked.withColumn("slice", F.monotonically_increasing_id()), "anchors")
    hits = sketch.repeated(asked.select("slice", "keys"), expected)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, counts, raw in zip(*(batch.column(c) for c in ("ids", "texts", "counts", "hits")), strict=True):
                ends, at = np.cumsum(counts.values.to_numpy()), np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
                row = np.searchsorted(ends, at, "right")
                own, begin = np.unique(row, return_index=True)
                inside = (at - np.append(0, ends)[row]).astype("<u4")
                marks = [inside[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(at)), strict=True)]
                picked = pa.array(own)
                yield pa.RecordBatch.from_arrays([ids.values.take(picked), texts.values.take(picked), pa.array(marks, pa.binary())], ["_id", "_key", "marks"])

    marks = asked.drop("keys").join(hits, "slice").mapInArrow(share, f"_id {kind}, _key long, marks binary").dropDuplicates(["_id", "_key"])

    def marked(rows: pa.RecordBatch, anchor: np.ndarray, counts: np.ndarray) -> np.ndarray:
        keep, begin = np.zeros(len(anchor), bool), np.cumsum(counts) - counts
        for k, raw in enumerate(rows.column(3).to_pylist()):
            keep[begin[k] + np.frombuffer(raw, "<u4")] = True
        return keep

    found = stash(_found(rows.join(marks, ["_id", "_key"]).select("_id", "_key", "_text", "marks"), width, marked), "bundles")
    release(asked, hits)
    return found


def spans(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most: int = sketch.MAX_LOG2) -> DataFrame:
    """(``_id``, ``_key``, ``spans``): word ranges to remove, for each id and hash of text."""
    found = _repeats(docs, width, id_col, text_col, most)
    firsts = stash(found.groupBy("one", "two").agg(F.min("_id").alias("_least"), F.min("anchor").alias("_anchor")), "firsts")
    shared = firsts.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_anchor").alias("anchor"))
    known = found.join(firsts.select("one", "two", "_least"), ["one", "two"])
    whole = known.where(F.col("_id") > F.col("_least")).select("_id", "_key", F.col("first").alias("a"), (F.col("first") + F.col("many") + width - 1).alias("b"))
    # windows of distinct bundles that share their anchor with other bundles
    first_rows = stash(known.where(F.col("_id") == F.col("_least")).select("_id", "_key", "first", "many", "anchor", "windows"), "own")
    own = first_rows.join(shared, "anchor", "left_semi")

    def unpack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            many = batch.column("many").to_numpy()
            row = pa.array(np.repeat(np.arange(len(many)), many))
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            raw = np.frombuffer(b"".join(batch.column("windows").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_key").take(row), pa.array(batch.column("first").to_numpy()[row.to_numpy()] + step, pa.int32()), batch.column("anchor").take(row), pa.array(raw)], ["_id", "_key", "place", "anchor", "window"])

    single = stash(own.mapInArrow(unpack, f"_id {_schema(docs, id_col)}, _key long, place int, anchor long, window long"), "windows")
    least = stash(single.groupBy("anchor", "window").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").drop("_most"), "least")
    part = single.join(least, ["anchor", "window"]).where(F.col("_id") > F.col("_least")).select("_id", "_key", F.col("place").alias("a"), (F.col("place") + width).alias("b"))
    cut = whole.union(part).groupBy("_id", "_key").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))  # one document's spans
    cut = stash(cut, "spans")
    release(found, firsts, first_rows, single, least)
    return cut


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """``docs`` and, as the last column, the spans to remove."""
    key, own, gone = (unused(c, docs.columns) for c in ("_key", "_id", "_spans"))
    cut = spans(docs, width, id_col, text_col, most).select(F.col("_id").alias(own), F.col("_key").alias(f"{key}_"), F.col("_spans").alias(gone))
    met = docs.withColumn(key, F.xxhash64(text_col)).join(cut, (F.col(id_col) == F.col(own)) & (F.col(key) == F.col(f"{key}_")), "left")
    return met.select(*docs.columns, gone)


def _keep(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """Words that stay and the number of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans:
        return words, len(words)
    gone = covered(np.array([s["a"] for s in spans]), np.array([s["b"] - s["a"] for s in spans]), len(words))
    return [w for w, g in zip(words, gone, strict=True) if not g], len(words)


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space behind each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    seg = Segments(raw, np.array([0, len(raw)]))
    gone = covered(np.array([s["a"] for s in spans]), np.array([s["b"] - s["a"] for s in spans]), len(seg.starts))
    ends = np.append(seg.starts[1:], len(raw))
    return raw[~covered(seg.starts[gone], (ends - seg.starts)[gone], len(raw))].tobytes().decode()


def removed(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most: int = sketch.MAX_LOG2) -> DataFrame:
    """Words, removed words, and SHA-256 of the kept words joined by single spaces."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        kept = [_keep(t, s) for t, s in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(w) for w, n in kept], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in kept])], [id_col, "n_words", "n_removed", "kept_sha256"])

    return arrow_map(_marked(docs.select(id_col, text_col), width, id_col, text_col, most), text_col, f"`{id_col}` {_schema(docs, id_col)}, n_words long, n_removed long, kept_sha256 string", work)


def strip(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most: int = sketch.MAX_LOG2) -> DataFrame:
    """The documents with what is left of their texts; a text that loses nothing is unchanged."""
    at = docs.columns.index(text_col)

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        texts = [t if not s else _cut(t, s) for t, s in zip(rows.column(at).to_pylist(), rows.column(rows.num_columns - 1).to_pylist(), strict=True)]
        columns = list(rows.columns[:-1])
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, rows.schema.names[:-1])

    return arrow_map(_marked(docs, width, id_col, text_col, most), text_col, docs.schema, work)
