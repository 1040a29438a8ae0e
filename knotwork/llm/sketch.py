"""Count-min sketch that tells which keys may occur twice or more.

Every partition counts its keys' cells, saturating at two, in every row of the sketch, and emits
them by block of 65,536 cells: an offset of two bytes for a cell counted once, twice the offset for
more. The blocks of all partitions are merged by adding. What remains is one bit a cell, set where
the merged count is at least two. A key whose cell is unset in any row occurs once at most; a
key that occurs twice is never missed.

The number of cells follows the expected number of keys, so the share of single keys that pass does
not grow with the input. Up to 2**``most`` cells (``MAX_LOG2``: 32 MB a row) the bit maps are
broadcast by ``build``; a caller whose keys need more (``fits`` tells) asks ``repeated``, where
nothing is broadcast: keys are sent to their cells' blocks and the answers come back by a join, in
pieces of one slice and block each. A caller may also bound a sketch that merely orders keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, release, slices, small_batches, stash

BLOCK_BITS, MIN_LOG2, MAX_LOG2, ROWS = 16, 20, 28, 2
#: Keys that a partition gathers before it emits their cells.
FLUSH = 1 << 20
_SALT = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def log2_cells(expected: int, per_key: int = 4, most: int = MAX_LOG2) -> int:
    """Cells of a row, as a power of two: ``per_key`` for each expected key, up to 2**most."""
    return int(min(most, max(MIN_LOG2, (max(expected, 1) * per_key - 1).bit_length())))


def fits(expected: int, per_key: int = 4, most: int = MAX_LOG2) -> bool:
    """Whether a sketch for so many keys may be broadcast."""
    return log2_cells(expected, per_key, 63) <= most


def cells(keys: np.ndarray, row: int, log2: int) -> np.ndarray:
    return mix(keys ^ _SALT[row]) >> np.uint64(64 - log2)


class Sketch:
    """Level of every cell's count: how many of ``limits`` it exceeds, as bit planes."""

    def __init__(self, log2: int, depth: int = ROWS, limits: tuple[float, ...] = (1,)) -> None:
        self.log2, self.limits = log2, limits
        self.maps = np.zeros((depth, len(limits).bit_length(), (1 << log2) // 8), np.uint8)

    def put(self, row: int, block: int, planes: bytes) -> None:
        width = (1 << BLOCK_BITS) // 8
        self.maps[row, :, block * width : (block + 1) * width] = np.frombuffer(planes, np.uint8).reshape(-1, width)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Smallest level of each key among the rows; level 0 is a key that occurs once at most."""
        found = None
        for row, planes in enumerate(self.maps):
            c = cells(keys, row, self.log2)
            at, bit = (c >> np.uint64(3)).astype(np.int64), (c & np.uint64(7)).astype(np.uint8)
            level = sum((((plane[at] >> bit) & 1) << k for k, plane in enumerate(planes)), np.zeros(len(keys), np.uint8))
            found = level if found is None else np.minimum(found, level)
        return found

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        return self.levels(keys) > 0


def _emit(keys: np.ndarray, log2: int, depth: int) -> pa.RecordBatch:
    rows, blocks, found = [], [], []
    for row in range(depth):
        c = np.sort(cells(keys, row, log2))
        third = np.zeros(len(c), bool)
        third[2:] = c[2:] == c[:-2]
        c = c[~third]
        block = (c >> np.uint64(BLOCK_BITS)).astype(np.int64)
        offset = (c & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, b in zip(at, np.append(at[1:], len(c)), strict=True):
            rows.append(row)
            blocks.append(int(block[a]))
            found.append(offset[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int64()), pa.array(found, pa.binary())], ["row", "block", "offsets"])


def _merge(limits: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, key = np.zeros(1 << BLOCK_BITS, np.int64), None
        for batch in group:
            key = key or (batch.column("row")[0].as_py(), batch.column("block")[0].as_py())
            for part in batch.column("offsets"):
                count += np.bincount(np.frombuffer(part.as_buffer(), "<u2"), minlength=1 << BLOCK_BITS)
        level = sum((count > x).astype(np.uint8) for x in limits)
        if key is not None and level.any():
            planes = b"".join(np.packbits((level >> k) & 1, bitorder="little").tobytes() for k in range(len(limits).bit_length()))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([planes], pa.binary())], ["row", "block", "planes"])

    return run


def build(docs: DataFrame, text: str, expected: int, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], depth: int = ROWS, per_key: int = 4, most: int = MAX_LOG2, graded: bool = False) -> Sketch:
    """Sketch, of ``depth`` rows, of the keys that ``keys_of(bytes, offsets)`` finds in all texts.

    ``graded``: with three limits in place of one, the upper two far above the mean of all cells.
    """
    small_batches(docs.sparkSession)
    log2 = log2_cells(expected, per_key, most)
    mean = expected / 2**log2
    limits = (1, 8 * (1 + mean), 64 * (1 + mean)) if graded else (1,)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in slices(batch, text):
                held.append(keys_of(data, offsets))
                n += len(held[-1])
                if n >= FLUSH:
                    yield _emit(np.concatenate(held), log2, depth)
                    held, n = [], 0
        if n:
            yield _emit(np.concatenate(held), log2, depth)

    parts = docs.select(text).mapInArrow(count, "row int, block long, offsets binary")
    merged = parts.groupBy("row", "block").applyInArrow(_merge(limits), "row int, block long, planes binary")
    sketch = Sketch(log2, depth, limits)
    for r in merged.toLocalIterator():  # the bit planes' bytes, one partition at a time
        sketch.put(r["row"], r["block"], r["planes"])
    return sketch


def repeated(keyed: DataFrame, expected: int, per_key: int = 4, depth: int = ROWS) -> DataFrame:
    """(``slice``, ``hits``): places, as 32-bit integers, of the keys that may repeat among those of each
    row (``slice``, ``keys``) of a stored table; ``keys`` are 64-bit hashes. Rows without a hit are missing.
    """
    log2 = log2_cells(expected, per_key, 63)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, raw in zip(batch.column("slice").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys, found = np.frombuffer(raw, "<u8"), []
                for row in range(depth if len(keys) else 0):
                    c = cells(keys, row, log2)
                    order = np.argsort(c, kind="stable")
                    block = (c[order] >> np.uint64(BLOCK_BITS)).astype(np.int64)
                    at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                    low = (c[order] & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
                    found += [(one, row, int(block[a]), low[a:b].tobytes(), order[a:b].astype("<u4").tobytes()) for a, b in zip(at, np.append(at[1:], len(c)), strict=True)]
                if found:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["slice", "row", "block", "offsets", "places"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for low, places, plane in zip(*(batch.column(c).to_pylist() for c in ("offsets", "places", "planes")), strict=True):
                low = np.frombuffer(low, "<u2")
                bit = (np.frombuffer(plane, np.uint8)[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                hits.append(np.frombuffer(places, "<u4")[bit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(hits, pa.binary())], ["slice", "hits"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.flatnonzero(np.bincount(np.frombuffer(b"".join(x), "<u4")) == depth).astype("<u4").tobytes() for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(hits, pa.binary())], ["slice", "hits"])

    parts = stash(keyed.mapInArrow(ask, "slice long, row int, block long, offsets binary, places binary"), "cells")
    merged = parts.select("row", "block", "offsets").groupBy("row", "block").applyInArrow(_merge((1,)), "row int, block long, planes binary")
    met = parts.join(merged, ["row", "block"]).mapInArrow(answer, "slice long, hits binary")
    held = met.where(F.octet_length("hits") > 0).groupBy("slice").agg(F.collect_list("hits").alias("parts"))  # one slice's places
    out = stash(held.mapInArrow(agree, "slice long, hits binary").where(F.octet_length("hits") > 0), "hits")
    release(parts)
    return out


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)
