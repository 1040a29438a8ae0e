"""What the operators of this subpackage have in common.

* ``stash`` cuts lineage through a Parquet table in the folder that all executors share
  (``spark.checkpoint.dir``), so a lost executor costs a re-read and no recomputation.
* ``arrow_map`` feeds whole texts to numpy in slices of bounded size.
* ``Segments`` finds words in a UTF-8 buffer and hashes words, lines and word windows without a
  Python-level loop.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_importable

#: Bytes of text that one numpy pass works on; a longer single text is one slice of its own.
SLICE_BYTES = 1 << 19
#: Rows in one Arrow batch sent to Python. Texts are long, so the default of 10,000 is lowered.
BATCH_ROWS = 1024
#: Bytes from which a batch is sent with fewer rows.
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_NEAR = 64
_COMBINE = np.uint64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='knotwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stashed tables whose last reader is done."""
    for t in tables:
        _remove(t.sparkSession, t._stashed_at)


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is then the cluster's to clear
        return


def small_batches(spark: SparkSession) -> None:
    """Before Python work: workers find this package, and an Arrow batch has ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at most."""
    ensure_importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null text is an empty one."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of at most ``SLICE_BYTES`` of text, with their bytes and offsets."""
    data, offsets = texts_of(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def arrow_map(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None]) -> DataFrame:
    """``work(rows, bytes, offsets)`` on every slice of ``df``; its batches are the result."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                out = work(rows, data, offsets)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _units(which: int) -> np.ndarray:
    """What ``run_hashes`` makes of a byte at one of the first ``_NEAR`` places."""
    return mix(np.arange(_NEAR << 8, dtype=np.uint64) + _SALTS[which])


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of byte values, which are ascending and do not overlap.

    Each byte is mixed with its place in its run before the run's bytes are added up, so no two
    strings collide but by chance. Hash number 1 adds up other values of the same bytes.
    """
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    unit = values[np.repeat(starts, sizes) + place] + (place << 8)
    if sizes.max(initial=0) <= _NEAR:
        unit = _units(which)[unit]
    else:
        unit = mix(unit.astype(np.uint64) + _SALTS[which])
    sums = np.zeros(len(unit) + 1, np.uint64)
    np.cumsum(unit, out=sums[1:])
    return mix((sums[first + sizes] - sums[first]) ^ mix(sizes.astype(np.uint64) + _SALTS[which]))


def _combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _COMBINE + right)


class Segments:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts; a word never crosses two rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~_SPACE[self.data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of row r: bounds[r]:bounds[r+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, which)

    def rows(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, width: int) -> np.ndarray:
        """First words of all runs of ``width`` words inside one row, ascending."""
        room = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(room >= width)


def gram_hashes(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the word runs of ``width`` words that begin at ``first``, by doubling."""
    whole, at, level, size = None, first, words, 1
    while True:
        if width & size:
            part = level[at]
            whole, at = part if whole is None else _combine(whole, part), at + size
        if 2 * size > width:
            return mix(whole ^ np.uint64(width))
        level = _combine(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2


def repeats_in_row(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the keys that occur twice or more in their row, and of those that are not the first."""
    salted = mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(salted, kind="stable")
    ranked = salted[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    later[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    any_of = np.zeros(len(keys), bool)
    any_of[order] = twice
    return any_of, later


def covered(first: np.ndarray, widths: np.ndarray | int, n: int) -> np.ndarray:
    """Mask over ``n`` places of those inside one of the runs that begin at ``first``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + widths, -1)
    return np.cumsum(steps[:-1]) > 0
