"""Jaccard self-join of documents on word n-grams, by a size-aware heavy-light join.

Two documents link if ``100 * intersection >= percent * union`` of their shingle sets.

1. Shingles are graded by how many documents hold them. A set with too many that one document holds
   can't link with another text and is done. The order (grade, hash) is one for all sets; partners share
   one of the first ``m - least_shared(n) + 1`` of a set's ``m`` shingles that may be shared, and no
   more are listed. Grades come from a count-min sketch that is broadcast, while it has ``LOAD`` shingles a
   cell at most with 2**``GRADES_LOG2`` cells. Beyond that they are exact counts, by grouping the shingles of
   the lowest hashes (``graded_share``; the others come last in the order), and the texts of the classes
   that a list compares are read again for their sets.
2. Sets that are equal form a class, by a 128-bit commutative hash; classes are joined, not copies.
3. Light sets, up to the boundary size, list all their subsets of the sizes that an intersection
   with a partner can have; partners share a subset. Heavy sets scan the inverted lists of their
   first shingles. Light sets just below the boundary are in the lists too, for their heavy partners. The boundary is
   the largest size at which listing subsets costs no more rows than scanning lists does:
   subsets(n) <= prefix(n) * mean list length.
4. In each list all members are first compared with one hub, the class of most copies. Members near
   the hub are then judged exactly by their differences from it, without comparing sets in pairs;
   pairs with a member far from the hub are compared one by one, where they are in different components and
   sizes and numbers of shared shingles allow a link. No list or partner is left out.

Whole sets are read for classes that a list compares, not for the others. Intermediate tables are deleted when their last reader is done.

The sets are compared by 64-bit shingle hashes. No group is collected: counts are aggregated before
they are shuffled and joins read plain tables, whose skewed keys Spark splits.

Cases: a null text, or one without words, is an empty set, linked with nothing. With fewer words
than a shingle the whole sequence is the one shingle. A row with a null id links with nothing and
has a null component. Repeated rows are equal sets. An empty table gives an empty result. Columns
of the input with clashing names are not carried by ``classes`` and are kept by ``representatives``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import Segments, arrow_map, gram_hashes, mix, release, stash, unused

#: Most cells of a grading sketch that is broadcast, as a power of two: at two bits a cell 32 MB.
GRADES_LOG2 = 27
#: Shingles a cell from which that sketch tells too little.
LOAD = 1.5
#: Sets up to this size are kept whole where the larger ones are read again.
SMALL = 64
_SALTS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def least_shared(n: int, percent: int) -> int:
    """Smallest intersection of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def graded_share(percent: int) -> float:
    """Share of all hashes whose shingles are counted: enough to choose a set's listed ones among the rare ones."""
    return min(1.0, max(0.1, 5 * (100 - percent) / 100))


def subsets(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in range(n - least_shared(n, percent) + 1))


def boundary(mean_list: float, percent: int, largest: int) -> int:
    """Largest size of a light set, where no set is larger than ``largest``."""
    n = 0
    while n < largest and subsets(n + 1, percent) <= (n + 2 - least_shared(n + 1, percent)) * mean_list:
        n += 1
    return n


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a slice, ascending."""
    seg = Segments(data, offsets, lower=True)
    words = seg.word_hashes()
    first = seg.windows(width)
    rows, hashes = [np.searchsorted(seg.bounds, first, "right") - 1], [gram_hashes(words, first, width)]
    for count in range(1, width):
        few = np.flatnonzero(seg.counts == count)
        rows.append(few)
        hashes.append(gram_hashes(words, seg.bounds[few], count))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary array whose elements are ``counts`` consecutive 64-bit values each."""
    ends = np.append(0, 8 * np.cumsum(counts)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _may_link(n: str, m: str, other_n: str, other_m: str, percent: int) -> Column:
    """Whether sizes and shared shingles of two sets leave room for a link."""
    most = F.least(F.col(m), F.col(other_m))
    return 100 * most >= percent * (F.col(n) + F.col(other_n) - most)


def _sums(hashes: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Two commutative hashes of each row's set."""
    at, out = np.append(0, np.cumsum(n)), []
    for salt in _SALTS:
        total = np.append(np.uint64(0), np.cumsum(mix(hashes ^ salt)))
        out.append(_signed(total[at[1:]] - total[at[:-1]]))
    return out


def _rank(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hide(column: pa.Array, none: pa.Array) -> pa.Array:
    return pc.if_else(none, pa.scalar(None, column.type), column)


def _table(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, most: int) -> tuple[DataFrame, bool]:
    """Every document's set size; of those that may link also the hash, the number of shingles that may be
    shared (``m``), these in the common order (``shared``) and those that a list takes (``head``).
    And whether ``shared`` holds larger sets as well.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    expected = sketch.text_bytes(docs, text_col) // 6
    names = "n long, m long, one long, two long, head binary, shared binary"
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _key long, {names}"
    if expected > LOAD * 2**most:
        limit = np.uint64(min(int(2**64 * graded_share(percent)), 2**64 - 1))
        return stash(_counted(rows, schema, limit, width, percent), "sets"), False
    seen = rows.sparkSession.sparkContext.broadcast(sketch.build(rows, "_text", expected, lambda data, offsets: _sets(data, offsets, width)[1], depth=1, per_key=2, most=most, graded=True))  # at most 2**most cells

    def work(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, hashes = _sets(data, offsets, width)
        n = np.bincount(row, minlength=batch.num_rows)
        sums, grade = _sums(hashes, n), seen.value.levels(hashes)
        m = n - np.bincount(row[grade == 0], minlength=batch.num_rows)
        live = (n > 0) & (100 * m >= percent * n)
        pick = (grade > 0) & live[row]
        row, hashes, grade, m = row[pick], hashes[pick], grade[pick], np.where(live, m, 0)
        hashes = hashes[np.lexsort((hashes, grade, row))]
        listed = np.where(live, m + (-percent * n // 100) + 1, 0)  # m - least_shared(n) + 1
        head, none = _rank(m) < np.repeat(listed, m), pa.array(~live)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(m, pa.int64()), *(_hide(c, none) for c in (*sums, _binaries(hashes[head], listed), _binaries(hashes, m)))], ["_id", "_key", *(x.split()[0] for x in names.split(", "))])

    return stash(arrow_map(rows, "_text", schema, work).withColumn("_row", F.monotonically_increasing_id()), "sets"), True


def _counted(rows: DataFrame, schema: str, limit: np.uint64, width: int, percent: int) -> DataFrame:
    """The table with grades from exact counts; ``shared`` holds sets of up to ``SMALL`` shingles."""

    def lowest(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, hashes = _sets(data, offsets, width)
        n = np.bincount(row, minlength=batch.num_rows)
        low = np.bincount(row[hashes <= limit], minlength=batch.num_rows)
        size = np.where(n <= SMALL, n, np.maximum(low, n + (-percent * n // 100) + 1))  # enough to list from
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *_sums(hashes, n), _binaries(hashes[_rank(n) < np.repeat(size, n)], size)], ["_id", "_key", "n", "one", "two", "low"])

    kind = rows.schema["_id"].dataType.simpleString()
    low = stash(arrow_map(rows, "_text", f"_id {kind}, _key long, n long, one long, two long, low binary", lowest).withColumn("_row", F.monotonically_increasing_id()), "lowest")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, "<u8") for x in batch.column("low").to_pylist()]
            held = [x[x <= limit] for x in held]
            of = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(of), _signed(np.concatenate([np.zeros(0, np.uint64), *held]))], ["_row", "element"])

    elements = low.where("n > 0").mapInArrow(spread, "_row long, element long")
    often = stash(elements.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    known = elements.join(often, "element").groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("known"))  # one set's shingles

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, whole, ms = [], [], []
            for n, raw, found in zip(batch.column("n").to_pylist(), batch.column("low").to_pylist(), batch.column("known").to_pylist(), strict=True):
                held = np.frombuffer(raw, "<u8")
                graded = held <= limit
                ranked = np.array([x["element"] for x in found or []], np.int64).view(np.uint64)
                once = int(graded.sum()) - len(ranked)
                live = n > 0 and 100 * (n - once) >= percent * n
                listed = n - once - least_shared(n, percent) + 1
                heads.append(np.concatenate((ranked, held[~graded]))[:listed].tobytes() if live else None)
                whole.append(held.tobytes() if live and n <= SMALL else None)
                ms.append(n)
            none = pa.array([h is None for h in heads], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), batch.column("n"), pa.array(ms, pa.int64()), _hide(batch.column("one"), none), _hide(batch.column("two"), none), pa.array(heads, pa.binary()), pa.array(whole, pa.binary()), batch.column("_row")], ["_id", "_key", "n", "m", "one", "two", "head", "shared", "_row"])

    met = low.join(known, low["_row"] == known["_of"], "left").drop("_of")
    return met.mapInArrow(choose, f"{schema}, _row long")


def _read_again(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Whole sets, as ``shared``, of the classes ``wanted`` (class, _id, _key)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    met = rows.join(wanted, ["_id", "_key"]).dropDuplicates(["class"]).select("class", "_text")

    def work(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, hashes = _sets(data, offsets, width)
        n = np.bincount(row, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(n, pa.int64()), _binaries(hashes, n)], ["_row", "n", "m", "shared"])

    return stash(arrow_map(met, "_text", "_row long, n long, m long, shared binary", work), "sets")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column("head").to_pylist()
        row = pa.array(np.repeat(np.arange(len(held)), [len(x) // 8 for x in held]))
        raw = np.frombuffer(b"".join(held), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(raw), *(batch.column(c).take(row) for c in ("class", "n", "m", "copies"))], ["key", "class", "n", "m", "copies"])


def _subset_keys(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of all subsets of a light set that may be its intersection with a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for n, values in zip(batch.column("n").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                mixed = mix(np.frombuffer(values, "<u8") ^ _SALTS[0])
                whole = mixed.sum(dtype=np.uint64)
                gone = [mixed[list(c)].sum(dtype=np.uint64) for out in range(len(mixed) - least_shared(n, percent) + 1) for c in combinations(range(len(mixed)), out)]
                found.append(mix((whole - np.array(gone, np.uint64)) ^ _SALTS[1]))
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found[1:]]))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), *(batch.column(c).take(row) for c in ("class", "n", "m", "copies"))], ["key", "class", "n", "m", "copies"])

    return run


def _lists(first: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Rows (key, class, n, m, copies): what the light sets' subsets and the heavy sets' lists hold.

    Where ``sets`` are not ``whole``, the largest light set is one that it holds.
    """
    schema, known = "key long, class long, n long, m long, copies long", first.select("class", "n", "m", "copies")
    heads = stash(sets.where("head is not null").select(F.col("_row").alias("class"), "head").join(known, "class").mapInArrow(_unpack, schema), "heads")
    sized = heads.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1").agg(F.avg("df").alias("mean")).first()
    largest = first.agg(F.max("n").alias("n")).first()["n"] or 0
    largest = largest if whole else min(largest, SMALL)
    edge = boundary(sized["mean"] or 1.0, percent, largest)
    heavy = heads.where(F.col("n") >= min(edge + 1, least_shared(edge + 1, percent)))
    light = sets.where((F.col("n") <= edge) & F.col("shared").isNotNull()).select(F.col("_row").alias("class"), "shared").join(known, "class")
    out = stash(heavy.union(light.mapInArrow(_subset_keys(percent), schema)), "lists")
    release(heads)
    return out


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b): whether they ``link``; of those about twice as far apart as a link allows,
    the shared shingles of a alone and of b alone (``differ``), their number and that of a's.
    """
    near = 2 * percent - 100

    def side(name: str) -> DataFrame:
        return sets.where("shared is not null").select(F.col("_row").alias(name), F.col("n").alias(f"n_{name}"), F.col("m").alias(f"m_{name}"), F.col("shared").alias(f"set_{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link, differ, apart, lack = [], [], [], []
            for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("set_a", "set_b", "n_a", "n_b")), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                other = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(other)) // 2
                close = 100 * both >= near * (p + q - both)
                link.append(100 * both >= percent * (p + q - both))
                differ.append(np.concatenate((mine := np.intersect1d(other, x, assume_unique=True), np.setdiff1d(other, mine, assume_unique=True))).tobytes() if close else None)
                apart.append(len(other))
                lack.append(len(x) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_b"), batch.column("m_b"), pa.array(link, pa.bool_()), pa.array(differ, pa.binary()), pa.array(apart, pa.int64()), pa.array(lack, pa.int64())], ["a", "b", "n", "m", "link", "differ", "apart", "lack"])

    joined = pairs.join(side("b"), "b").join(side("a").join(pairs.select("a").distinct(), "a", "left_semi"), "a")
    return joined.mapInArrow(work, "a long, b long, n long, m long, link boolean, differ binary, apart long, lack long")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of a difference; ``more``: the hub has it not."""
    for batch in batches:
        held = batch.column("differ").to_pylist()
        sizes = np.array([len(x) // 8 for x in held], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        more = place >= batch.column("lack").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("hub", "class", "label")), pa.array(np.frombuffer(b"".join(held), "<i8")), pa.array(more)], ["hub", "class", "label", "element", "more"])


def _links(lists: DataFrame, sets: Callable[[DataFrame], DataFrame], first: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is connected.

    Members x and y share exactly ``(|x| + |y| - apart(x) - apart(y)) / 2 + common`` shingles, where ``apart`` is the size of a member's
    difference from the hub and ``common`` the number of shingles in both differences. So members near a hub
    need no comparison of sets: those that link without a common difference are found from sizes,
    the others by joining on (hub, differing shingle), for shingles that lie in several members' differences.
    A link's ends differ in their distances from the hub by no more than a link's, so what links
    with a member far from the hub has no link with the hub itself; only these pairs are left to be compared one by one.
    """
    near = 2 * percent - 100
    hubs = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("copies", (-F.col("class")).alias("minus"), F.col("n").alias("hub_n"), F.col("m").alias("hub_m"))).alias("h")).where("members > 1")
    hubs = stash(hubs.select("key", (-F.col("h.minus")).alias("hub"), "h.hub_n", "h.hub_m"), "hubs")
    held = stash(lists.join(hubs, "key").where("hub <> class"), "held")
    release(hubs, lists)
    sets = sets(held.select("class").union(held.select("hub")).distinct())
    tried = stash(held.where(_may_link("n", "m", "hub_n", "hub_m", near)).select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    done = stash(_compare(tried, sets, percent), "compared")
    release(tried)
    linked = done.where("link").select("a", "b")
    label = components(linked)

    def labelled(rows: DataFrame) -> DataFrame:
        named = label.select(F.col("node").alias("class"), "label")
        return rows.join(named, "class", "left").withColumn("label", F.coalesce("label", "class"))

    # members near a hub, and the hub itself, of the hubs whose members are in several components
    zero = F.lit(0).cast("long")
    own = done.select(F.col("a").alias("class")).distinct().join(first.select("class", "n", "m"), "class").select(F.col("class").alias("hub"), "class", "n", "m", F.lit(b"").alias("differ"), zero.alias("apart"), zero.alias("lack"))
    around = done.where("differ is not null").select(F.col("a").alias("hub"), F.col("b").alias("class"), "n", "m", "differ", "apart", "lack").unionByName(own)
    every = stash(labelled(around), "around")
    several = every.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("hub")
    around = stash(every.join(several, "hub"), "around")
    release(every)
    main = around.where("class = hub").select("hub", F.col("label").alias("main"))
    out = stash(around.join(main, "hub").where("label <> main").drop("main"), "outside")

    def links(common: Column) -> Column:
        # shared shingles of both: those of the hub, less what either lacks, and more
        both = (F.col("m") + F.col("y_m") - F.col("apart") - F.col("y_apart")) / 2 + common
        return 100 * both >= percent * (F.col("n") + F.col("y_n") - both)

    best = around.groupBy("hub", "label", "n").agg(F.max(F.struct((F.col("m") - F.col("apart")).alias("rest"), "class", "m", "apart")).alias("r"))
    best = best.select("hub", F.col("label").alias("y_label"), F.col("n").alias("y_n"), F.col("r.class").alias("y"), F.col("r.m").alias("y_m"), F.col("r.apart").alias("y_apart"))
    plain = stash(out.drop("differ").join(best, "hub").where((F.col("label") != F.col("y_label")) & links(F.lit(0))).select(F.col("class").alias("a"), F.col("y").alias("b")), "plain")
    # differing shingles that lie in the differences of several of a hub's members, one of them outside
    parts = "hub long, class long, label long, element long, more boolean"
    wanted = out.mapInArrow(_explode, parts).select("hub", "element").distinct()
    theirs = stash(around.mapInArrow(_explode, parts).join(wanted, ["hub", "element"], "left_semi"), "differences")
    often = theirs.groupBy("hub", "element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("hub", "element")
    theirs2 = stash(theirs.join(often, ["hub", "element"]), "differences")
    release(theirs)
    # no more shingles are common than both lack, or have beyond the hub, among these
    room = theirs2.groupBy("hub", "class").agg(F.count(F.when(~F.col("more"), 1)).alias("lacks"), F.count(F.when(F.col("more"), 1)).alias("adds"))
    room = around.join(main, "hub").select("hub", "class", "n", "m", "apart", "label", (F.col("label") != F.col("main")).alias("outside")).join(room, ["hub", "class"])
    room = stash(room, "room")
    each = stash(theirs2.select("hub", "class", "element").join(room, ["hub", "class"]), "each")
    release(theirs2, room)
    y = each.select("hub", "element", *[F.col(c).alias(f"y_{c}") for c in ("class", "n", "m", "apart", "label", "lacks", "adds")])
    met = each.where("outside").join(y, ["hub", "element"]).where((F.col("label") != F.col("y_label")) & links(F.least("lacks", "y_lacks") + F.least("adds", "y_adds")))
    met = met.groupBy("hub", "class", "y_class", "n", "m", "apart", "y_n", "y_m", "y_apart").agg(F.count(F.lit(1)).alias("common"))
    met = stash(met.where(links(F.col("common"))).select(F.col("class").alias("a"), F.col("y_class").alias("b")), "met")
    release(each, out, around)
    # pairs of which one is far from the hub: neither links with it
    state = done.select(F.col("a").alias("hub"), F.col("b").alias("class"), "link", F.col("differ").isNotNull().alias("near"))
    away = held.join(state, ["hub", "class"], "left").where("link is null or not link")
    away = stash(labelled(away.select("key", "class", "n", "m", F.coalesce("near", F.lit(False)).alias("near"))), "away")
    other = away.select("key", F.col("class").alias("y"), F.col("n").alias("y_n"), F.col("m").alias("y_m"), F.col("label").alias("y_label"))
    rest = away.where("not near").join(other, "key").where((F.col("label") != F.col("y_label")) & _may_link("n", "m", "y_n", "y_m", percent))
    rest = stash(rest.select(F.least("class", "y").alias("a"), F.greatest("class", "y").alias("b")).distinct(), "pairs")
    release(held, away)
    far = stash(_compare(rest, sets, percent).where("link").select("a", "b"), "far")
    out = stash(linked.union(plain).union(met).union(far), "links")
    release(done, plain, met, far, rest)
    return out


def classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most: int = GRADES_LOG2) -> DataFrame:
    """``n_shingles`` and ``component_id``, the smallest id that links reach, of every document."""
    table, whole = _table(docs, width, percent, id_col, text_col, most)
    live = table.where("one is not null and _id is not null")
    # a class is known by the row of its smallest id
    first = stash(live.groupBy("one", "two").agg(F.min(F.struct("_id", "_row", "_key", "n", "m")).alias("f"), F.count(F.lit(1)).alias("copies")).select("one", "two", F.col("f._id").alias("least"), F.col("f._row").alias("class"), F.col("f._key").alias("_key"), "f.n", "f.m", "copies"), "classes")
    lists = _lists(first, table, percent, whole)
    again: list[DataFrame] = []

    def sets(wanted: DataFrame) -> DataFrame:
        if whole:
            return table
        again.append(_read_again(docs, first.join(wanted, "class").select("class", F.col("least").alias("_id"), "_key"), width, id_col, text_col))
        return again[0]

    links = _links(lists, sets, first, percent)
    label = first.join(components(links), F.col("class") == F.col("node"), "left").select("one", "two", "least", F.coalesce("label", "class").alias("label"))
    label = stash(label, "labels")
    smallest = label.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stash(label.join(smallest, "label").select("one", "two", "component_id"), "named")
    rows = stash(table.select("_id", "n", "one", "two"), "rows")
    release(table, first, links, label, *again)
    return rows.join(named, ["one", "two"], "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest id of each component, with all its columns; of repeated rows one."""
    found = classes(docs, width, percent, id_col, text_col)
    gone, twice = unused("_gone", docs.columns), unused("_twice", docs.columns)
    lost = stash(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(gone)), "gone")
    left = docs.join(lost, F.col(id_col) == F.col(gone), "left_anti")
    repeated = stash(docs.select(F.col(id_col).alias(twice)).groupBy(twice).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(twice).where(F.col(twice).isNotNull()), "twice")
    if not repeated.limit(1).count():
        return left
    again = left.join(repeated, F.col(id_col) == F.col(twice), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, F.col(id_col) == F.col(twice), "left_anti").unionByName(again)
