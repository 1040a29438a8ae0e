"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared
piece lengths). Pieces go, longest first, to the open sequence in which every capacity still
suffices and whose remaining capacities after the placement have the smallest norm (``residual``)
or the largest weighted dot product with the piece's needs (``dot``). The default cost is that of
one full piece, which must fit, so it can't bind by itself and only shades the choice. Where no
capacity is given, the number of documents is the smallest of some that costs no sequence
(``tightest``), so it binds where many short ones meet.

Equal lengths are the same item, so the whole choice is made on the histogram of lengths, which has
at most ``capacity`` entries however many documents there are: sequences in the same state form
one group of consecutive numbers, and a placement moves a part of a group to its next state. The
plan is a table of (length, rank from, rank to) -> place, of bounded size; each piece finds its
place by its rank among the pieces of its length. Ranks come from counts by length and hash chunk,
so a hot length is no single task's work.

Cases: a null text counts as empty and is the piece of the end id alone. Only documents longer
than the capacity are cut; the first piece takes the remainder. Repeated rows are packed each for
itself. An empty table gives no pieces. Other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .shared import arrow_map, stash

END_ID = 2


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: Weights of the three dimensions in the norm and in the dot product.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "residual"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its place in its document, length and CRC-32 of its ids."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        coder = byte_bpe(tokenizer)
        of, number, begin, size, crc, kept = [], [], [], [], [], []
        for r, text in enumerate(rows.column(1).to_pylist()):
            ids = np.append(coder.encode(text or ""), end_id).astype("<u4")
            count = -(-len(ids) // capacity)
            lead = len(ids) - (count - 1) * capacity
            for k in range(count):
                a = lead + (k - 1) * capacity if k else 0
                part = ids[a : lead + k * capacity]
                of.append(r)
                number.append(k)
                begin.append(a)
                size.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                if with_ids:
                    kept.append(part.astype(np.int32))
        out = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, size, crc))]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            out.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(id_col, text_col), text_col, schema, work)


def plan(histogram: Mapping[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, pieces a sequence, offset)."""
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    scale = np.array(cap.weights) / full
    # groups of sequences in one state: first number, how many, what is left of each capacity
    first, many, left = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3))
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, float(length) ** 2])
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        waiting, rank = histogram[length], 0
        while waiting:
            fits = np.flatnonzero((left >= need).all(axis=1) & (many > 0))
            if len(fits):
                if cap.rule == "dot":
                    best = fits[np.argmax((left[fits] * scale) @ (need * scale))]
                else:
                    best = fits[np.argmin((((left[fits] - need) * scale) ** 2).sum(axis=1))]
                state, begin, room = left[best], int(first[best]), int(many[best])
            else:
                best, state, begin, room = -1, full, opened, None
            each = 1 if best >= 0 and cap.rule == "dot" else int(np.min(state // need))
            bins = waiting // each
            if not bins:
                bins, each = 1, waiting
            if room is None:
                opened += bins
            else:
                bins = min(bins, room)
            rows.append((length, rank, rank + bins * each, begin, each, int(full[0] - state[0])))
            rank, waiting = rank + bins * each, waiting - bins * each
            if best >= 0:
                first[best] += bins
                many[best] -= bins
            after = state - each * need
            if after[0] > 0 and after[1] > 0:
                first, many, left = np.append(first, begin), np.append(many, bins), np.vstack((left, after))
        alive = many > 0
        first, many, left = first[alive], many[alive], left[alive]
    return rows


def n_sequences(rows: list[tuple[int, int, int, int, int, int]]) -> int:
    return max((first - (lo - hi) // each for _, lo, hi, first, each, _ in rows), default=0)


def tightest(histogram: Mapping[int, int], cap: Capacity = Capacity()) -> Capacity:
    """``cap`` with the number of documents lowered as long as no more sequences are needed."""
    least, documents = n_sequences(plan(histogram, cap)), cap.documents
    for parts in (2, 4, 8, 16, 21, 32, 43, 64, 85, 128):  # halves, and a third less between them
        fewer = replace(cap, documents=max(cap.documents // parts, 1))
        if n_sequences(plan(histogram, fewer)) > least:
            break
        documents = fewer.documents
    return replace(cap, documents=documents)


def place(parts: DataFrame, cap: Capacity | None = None, chunks: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece; ``parts`` is read twice and should be a table."""
    spark = parts.sparkSession
    counted = parts.withColumn("_chunk", F.pmod(F.xxhash64(id_col, "piece"), F.lit(chunks)))
    counts = counted.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most cap.tokens rows
    rows = plan(histogram, tightest(histogram) if cap is None else cap) or [(-1, 0, 0, 0, 1, 0)]
    where = spark.createDataFrame(rows, "length long, _from long, _to long, _first long, _each long, _base long")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("length", "_chunk").orderBy(id_col, "piece")
    ranked = counted.withColumn("_own", F.row_number().over(own) - 1).join(before.select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before")).alias("p")
    step = F.col("_rank") - F.col("_from")
    found = ranked.join(F.broadcast(where.alias("w")), (F.col("p.length") == F.col("w.length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.select(
        *[F.col(f"p.{c}") for c in parts.columns],
        (F.col("_first") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_base") + F.pmod(step, F.col("_each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, cap: Capacity | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places."""
    return place(stash(pieces(docs, tokenizer, (cap or Capacity()).tokens, END_ID, with_ids, id_col, text_col), "pieces"), cap, id_col=id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``ids`` of every sequence, from pieces packed ``with_ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
