"""Sums over all rows of what numpy makes of blocks of rows.

``gather`` runs a function on Arrow batches, adds up its named vectors inside each task, and sums the
tasks' entries by (name, place) in Spark. What reaches the driver is the size of the statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_importable

Block = dict[str, np.ndarray]
_SCHEMA = "name string, place long, value double"


def columns(batch: pa.RecordBatch | pa.Table) -> Block:
    """Columns as arrays; nulls of a number become NaN."""
    return {n: batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in batch.schema.names}


def _entries(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    name, place, value = [], [], []
    for k, v in total.items():
        at = np.flatnonzero(v)
        name += [k] * len(at)
        place.append(at)
        value.append(v[at])
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(np.concatenate(place) if place else np.zeros(0, np.int64), pa.int64()), pa.array(np.concatenate(value) if value else np.zeros(0), pa.float64())], ["name", "place", "value"])


def _add(total: dict[str, np.ndarray], part: dict[str, np.ndarray | float]) -> None:
    for k, v in part.items():
        v = np.atleast_1d(np.asarray(v, float)).ravel()
        total[k] = total[k] + v if k in total else v.copy()


def in_series(rows: DataFrame, by: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a series (equal ``by``) in one partition, together and ordered; ``_first`` marks where one begins.

    Series are dealt over a few partitions a core, so that each has many of them for ``gather`` to do at once;
    where the shuffle makes more partitions, a task takes several.
    """
    keys = [F.col(c).asc_nulls_last() for c in order] or [F.lit(0)]
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(tasks, by)
    return dealt.withColumn("_first", F.row_number().over(Window.partitionBy(by).orderBy(*keys)) == 1).coalesce(tasks)


def whole_series(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole series from batches of ``in_series``, of about ``most`` rows unless one series has more."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size + batch.num_rows > most and held:
            begun = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(begun):  # all before the last begun series is whole
                cut = int(begun[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def gather(rows: DataFrame, work: Callable[[Block], dict[str, np.ndarray | float]], sizes: dict[str, tuple[int, ...]], series: bool = False) -> dict[str, np.ndarray]:
    """Sum of ``work(block)`` over all blocks, in the shapes of ``sizes``.

    With ``series`` the rows are those of ``in_series``, and a block is several whole series.
    """
    ensure_importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in whole_series(batches) if series else batches:
            if batch.num_rows:
                _add(total, work(columns(batch)))
        yield _entries(total)

    summed = rows.mapInArrow(run, _SCHEMA).groupBy("name", "place").agg(F.sum("value").alias("value")).toArrow()
    out = {k: np.zeros(int(np.prod(s, dtype=np.int64))) for k, s in sizes.items()}
    names = np.array(summed.column("name").to_pylist(), object)
    place, value = summed.column("place").to_numpy(), summed.column("value").to_numpy()
    for k in out:
        mine = names == k
        out[k][place[mine]] = value[mine]
    return {k: v.reshape(sizes[k]) for k, v in out.items()}


def gather_qr(rows: DataFrame, work: Callable[[Block], np.ndarray], width: int, fan: int = 16) -> np.ndarray:
    """Triangular factor of the rows that ``work(block)`` makes, stacked over all blocks (tall-skinny QR).

    Every task keeps one factor of ``width`` columns; factors are then stacked and factored ``fan`` at a
    time until one is left, so neither a task nor the driver holds more than ``fan`` of them.
    """
    ensure_importable(rows.sparkSession)

    def pack(factor: np.ndarray, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.ascontiguousarray(factor, float).tobytes()], pa.binary())], ["part", "factor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack((held, work(columns(batch)))), mode="r")
        if len(held):
            yield pack(held, 0)

    def stack(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, float).reshape(-1, width) for x in table.column("factor").to_pylist()]
        return pa.Table.from_batches([pack(np.linalg.qr(np.vstack(parts), mode="r"), table.column("part")[0].as_py())])

    schema, many = "part long, factor binary", rows.rdd.getNumPartitions()
    found = rows.mapInArrow(run, schema).withColumn("part", F.spark_partition_id().cast("long"))
    while many > 1:
        many = -(-many // fan)
        found = found.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("part").applyInArrow(stack, schema)
    last = [np.frombuffer(r["factor"], float).reshape(-1, width) for r in found.collect()]  # one factor, or few
    return np.linalg.qr(np.vstack(last), mode="r") if last else np.zeros((0, width))


def cross(index: np.ndarray, value: np.ndarray, weight: np.ndarray, width: int, other: tuple[np.ndarray, np.ndarray, int] | None = None) -> np.ndarray:
    """Weighted cross product of sparse rows (columns, values), flat: with themselves or with ``other``."""
    left = expand(index, value, width)
    right = left if other is None else expand(*other)
    return (left.T @ (right * weight[:, None])).ravel()


def expand(index: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Dense rows; entries of one column add up."""
    n = len(index)
    flat = np.arange(n, dtype=np.int64)[:, None] * width + index
    return np.bincount(flat.ravel(), value.ravel(), n * width).reshape(n, width)


def cross_pairs(rows: DataFrame, index: str, value: str, weight: str | None = None) -> DataFrame:
    """The same as a table (i, j, v) with i <= j, from array columns, without Python: for wide matrices."""
    w = F.col(weight) if weight else F.lit(1.0)
    entry = F.arrays_zip(F.col(index).alias("k"), F.col(value).alias("v"))
    left = rows.select(entry.alias("e"), w.alias("w")).select("e", "w", F.explode("e").alias("a"))
    pair = left.select("w", "a", F.explode("e").alias("b")).where(F.col("a.k") <= F.col("b.k"))
    return pair.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("v"))
