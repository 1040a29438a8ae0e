"""Nearest vectors by inner product with randomly rotated one-bit codes.

A vector minus the centre is scaled to unit length and rotated; the signs of its coordinates are its
code, packed 64 to a word. With x the unit vector that the code stands for and o the rotated unit
vector, <x, o> is kept as a correction: <x, q> / <x, o> estimates <o, q> for a rotated query part q
without bias, with the standard error ``sqrt((1 - <x,o>^2) / <x,o>^2 / (dim - 1)) * |q|``; the bound is
``sure`` standard errors. The query is rounded to 4-bit integers, so <x, q> comes from the packed
bits by popcounts, and the rounding's standard error is added to the bound.

Each task codes its vectors and finds for each query of a block those whose upper bound reaches the
k-th best exact product known so far, at first that among a bounded sample; these alone are
multiplied in double precision on the original vectors, and those below it are not sent on.
Queries come in blocks of bounded size, broadcast one after the other. Where the table is larger
than ``STEP`` such samples, a query's floor rises over nested samples of the table, each ``STEP`` times
the one before: so about ``STEP * k`` rows a query and sample are shuffled, whatever the number of vectors.
Every vector is coded and compared; nothing is left out but by its bound.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as
queries nor as candidates. Each length is searched apart: a query's candidates have its own length. Ties go to the smaller
id. Fewer candidates than ``k``: all of them. Repeated rows with one id are candidates each for itself,
but none is a candidate of a query of its id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, stash, unused

#: Queries in one broadcast block, vectors coded at once, sampled vectors for the centre.
BLOCK, CHUNK, CENTRE = 8192, 8192, 4096
#: Growth of the nested samples that raise the floors.
STEP = 16
BITS = 4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def product(across: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of the columns with the query in double precision, added up from the first
    component to the last, so equal vectors have equal products wherever they lie."""
    total = np.zeros(across.shape[1])
    for part, q in zip(across, query, strict=True):
        total += part * q
    return total


class Codes:
    """Packed bits and correction scalars of a chunk of vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        dim = vectors.shape[1]
        rest = (vectors - centre) @ turn.T
        self.norm = np.linalg.norm(rest, axis=1)
        unit = rest / np.maximum(self.norm, 1e-300)[:, None]
        bits = unit >= 0
        self.words = np.packbits(np.pad(bits, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little").view("<u8")
        self.fit = np.maximum(np.abs(unit).sum(axis=1) / dim**0.5, 1e-9)  # <x, o>
        self.ones = bits.sum(axis=1)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0) / self.fit**2 / max(dim - 1, 1))
        self.dim = dim

    def estimate(self, query: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of <o, q> times the norm for one rotated query, and their error bounds."""
        low, high = query.min(), query.max()
        step = max((high - low) / (2**BITS - 1), 1e-300)
        whole = np.rint((query - low) / step).astype(np.uint8)
        total = np.zeros(len(self.norm))
        for b in range(BITS):
            plane = np.packbits(np.pad((whole >> b) & 1, (0, -self.dim % 64)), bitorder="little").view("<u8")
            total += float(1 << b) * np.bitwise_count(self.words & plane).sum(axis=1)
        # <x, q> = (2 * sum over set bits - sum over all) / sqrt(dim)
        dot = (2 * (step * total + low * self.ones) - (step * whole.sum(dtype=np.int64) + low * self.dim)) / self.dim**0.5
        error = np.sqrt((self.spread * np.linalg.norm(query)) ** 2 + step**2 / 12 / self.fit**2)
        return self.norm * dot / self.fit, self.norm * (sure * error)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, ...]:
    """The ``k`` best vectors of one chunk for each query: query id, id, exact product.

    ``floor``: a score of each query that its k-th best is known to reach; it is raised to what this
    chunk shows. A vector below it is no result and may be missing here.
    """
    codes, across = Codes(vectors, centre, turn), np.ascontiguousarray(vectors.T)
    base, turned = queries @ centre, queries @ turn.T
    out: list[tuple[np.ndarray, ...]] = []
    for q, query in enumerate(queries):
        guess, bound = codes.estimate(turned[q], sure)
        upper = guess + bound + base[q]
        some = np.flatnonzero((upper >= floor[q]) & (ids != query_ids[q]))
        if len(some) > 4 * k:  # the likeliest first: they raise the floor for the others
            lead = some[np.argpartition(-upper[some], 2 * k)[: 2 * k]]
            score = product(across[:, lead], query)
            floor[q] = max(floor[q], np.partition(score, len(score) - k)[len(score) - k])
            some = some[upper[some] >= floor[q]]
        score = product(across[:, some], query)
        best = _best(score, ids[some], k)
        if len(best) == k:
            floor[q] = max(floor[q], score[best[-1]])
        best = best[score[best] >= floor[q]]
        out.append((np.full(len(best), query_ids[q]), ids[some][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vector_col: str, others: list[Column]) -> DataFrame:
    """``id``, ``vector`` and ``others`` of those that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), *others)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sure: float = 2.5, id_col: str = "vec_id", vector_col: str = "embedding", step: int = STEP, sample: int = CENTRE) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` of each query's ``k`` nearest vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    query = unused("_query", vectors.columns)
    fine = usable(vectors.withColumn(query, is_query), id_col, vector_col, [F.col(query).alias("_query")])
    parts = max(1, -(-fine.count() // CHUNK))
    marked = stash(fine.repartition(parts), "vectors")
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    lengths = sorted(r[0] for r in marked.select(F.size("vector")).distinct().collect())
    found = [part for dim in lengths for part in _search(marked.where(F.size("vector") == dim), dim, k, sure, step, sample)]
    if not found:
        return empty
    return reduce(DataFrame.unionAll, found).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _search(marked: DataFrame, dim: int, k: int, sure: float, step: int, sample: int) -> list[DataFrame]:
    """(query_id, id, score, rank) of the nearest among vectors of one length, by block of queries."""
    spark = marked.sparkSession
    drawn = marked.orderBy(F.xxhash64("id")).limit(sample).collect()  # bounded sample
    near, near_ids = np.array([r["vector"] for r in drawn]), np.array([r["id"] for r in drawn])
    centre, turn = near.mean(axis=0), rotation(dim)
    sizes = marked.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("_query"), 1)).alias("asked")).first()
    # the smaller the remainder, the more samples a vector is in; 1 is the whole table
    shares, size = [1], sizes["all"] // step
    while size > sample:
        shares.insert(0, shares[0] * step)
        size //= step
    blocks = max(1, -(-sizes["asked"] // BLOCK))
    asked = marked.where("_query").withColumn("_block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)))
    found = []
    for b in range(blocks):
        part = asked.where(F.col("_block") == b).select("id", "vector").collect()  # about BLOCK rows
        if not part:
            continue
        query_ids, queries = np.array([r["id"] for r in part]), np.array([r["vector"] for r in part])
        # the sample's k-th best, rows of the query's id apart, less what rounding may do
        known = np.where(near_ids[:, None] == query_ids, -np.inf, near @ queries.T)
        known = np.sort(known, axis=0)[-k] if len(near) >= k else np.full(len(part), -np.inf)
        floor = known - 1e-9 * np.abs(known)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        for share in shares:
            held = marked.where(F.pmod(F.xxhash64("id", F.lit("nest")), F.lit(share)) == 0).select("id", "vector")
            block = spark.sparkContext.broadcast((query_ids, queries, floor))  # about BLOCK vectors

            def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                query_ids, queries, floor = block.value
                floor = floor.copy()
                for table in _chunks(batches):
                    ids, flat = table.column("id").to_numpy(), table.column("vector").combine_chunks().flatten().to_numpy()
                    q, i, s = scan(flat.reshape(len(ids), -1), ids, queries, query_ids, floor, centre, turn, k, sure)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "id", "score"])

            ranked = held.mapInArrow(work, "query_id long, id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            if share > 1:
                best = {r[0]: r[1] for r in ranked.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number a query
                floor = np.maximum(floor, [best.get(int(q), -np.inf) for q in query_ids])
            else:
                found.append(stash(ranked, "nearest"))
    return found


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``CHUNK``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
