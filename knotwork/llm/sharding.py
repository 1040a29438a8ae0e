"""Shards by a hierarchical weighted hash tree (law ``key``), in DataFrame functions alone.

A row descends from the root through regions and racks to a shard. At each node every child draws
``-ln(u) / weight``, u a hash of the row's key and the child's name, and the smallest draw wins. A
child's draw depends on nothing but the key, its name and its weight: if weights change, rows move
only out of subtrees that lost and into subtrees that gained weight.

Shards fill racks of 4 and regions of 12. A region's or rack's weight is that of all its places, taken
or still empty, so it does not change when a shard is added. Where the places are not all taken, the
draw of the node is that of its winning child, and every other child's is later by a draw of its
own; so a row whose winning place is empty takes the next one, and comes back when the place is
taken. Hence one more shard takes rows only into itself, for every number of shards, and
``grown_shard`` is the shard of ``assign`` with one more. At most one region and one rack are partly
taken; elsewhere a row costs one hash for each child on its path.

Slots are numbered by shard and hash bucket: the rows before a bucket come from a table of
shards * buckets counts, the rest from a row number inside the bucket. No shard is one task's work.

Cases: a null text has size 8 and the CRC-32 of no bytes, 0. Null keys hash like one key.
Repeated rows go to one shard and get slots of their own. An empty table gives an empty result.
Equal texts with different keys are not kept together. Clashing columns are not carried by
``assign``; ``write`` keeps all columns and adds ``shard`` and ``slot``, or raises where they exist.
No shard, or a weight that is not positive, is an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused

RACK, REGION, BUCKETS = 4, 12, 256


@dataclass(frozen=True)
class Tree:
    """``shards`` shards, numbered from 0, in racks and regions; ``weights`` are 1 unless given."""

    shards: int
    weights: Mapping[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.shards < 1 or any(w <= 0 for w in self.weights.values()):
            raise ValueError("a tree needs a shard, and weights above 0")

    def _weight(self, first: int, size: int) -> float:
        return float(sum(self.weights.get(s, 1.0) for s in range(first, first + size)))

    def _places(self, kind: str, first: int, size: int, step: int) -> list[tuple[int, str, float]]:
        """First shard, name and weight of the children, of ``step`` shards each, of a node."""
        return [(s, f"{kind}{s // step}", self._weight(s, step)) for s in range(first, first + size, step)]

    def shard(self, key: Column) -> Column:
        """The shard of a key."""

        def draw(name: Column, weight: Column) -> Column:
            u = (F.pmod(F.xxhash64(key, name), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return -F.log(u) / weight

        def drawn(children: list[tuple[int, str, float]]) -> Column:
            """(draw, first shard) of the winning child."""
            table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(s).alias("first")) for s, n, w in children])
            return F.array_min(F.transform(table, lambda c: F.struct(draw(c["name"], c["weight"]).alias("draw"), c["first"].alias("first"))))

        def winner(kind: str, nodes: list[int], size: int, step: int, at: Column) -> Column:
            """First shard of the winning child of the node ``at``, one of ``nodes``."""
            table = F.create_map(*[x for s in nodes for x in (F.lit(s), F.array(*[F.struct(F.lit(f).alias("first"), F.lit(n).alias("name"), F.lit(w).alias("weight")) for f, n, w in self._places(kind, s, size, step)]))])
            return F.array_min(F.transform(F.element_at(table, at), lambda c: F.struct(draw(c["name"], c["weight"]).alias("draw"), c["first"].alias("first"))))["first"]

        def children(kind: str, first: int, size: int, step: int, time: Column) -> list[tuple[int, Column]]:
            """First shard and time of each child of a node that is partly taken."""
            places = self._places(kind, first, size, step)
            won = drawn(places)["first"]
            return [(s, F.when(won == s, time).otherwise(time + draw(F.lit(f"{n}/later"), F.lit(w)))) for s, n, w in places]

        def entry(time: Column, shard: Column) -> Column:
            return F.struct(time.alias("time"), shard.cast("int").alias("shard"))

        full, found = self.shards // REGION, []
        if full:
            regions = [k * REGION for k in range(full)]
            best = drawn(self._places("region", 0, full * REGION, REGION))
            rack = winner("rack", regions, REGION, RACK, best["first"])
            racks = list(range(0, full * REGION, RACK))
            found.append(entry(best["draw"], winner("shard", racks, RACK, 1, rack)))
        if self.shards % REGION:
            ((begin, name, weight),) = self._places("region", full * REGION, REGION, REGION)
            for rack_first, time in children("rack", begin, REGION, RACK, draw(F.lit(name), F.lit(weight))):
                if rack_first + RACK <= self.shards:
                    found.append(entry(time, drawn(self._places("shard", rack_first, RACK, 1))["first"]))
                elif rack_first < self.shards:
                    found += [entry(t, F.lit(s)) for s, t in children("shard", rack_first, RACK, 1, time) if s < self.shards]
        return (F.array_min(F.array(*found)) if len(found) > 1 else found[0])["shard"]


def with_slots(rows: DataFrame, order: list[str], key: str, buckets: int = BUCKETS) -> DataFrame:
    """``slot``, gapless from 0 inside each ``shard``; ``buckets`` parts of a shard are numbered apart."""
    bucket, own, before, n, b, s = (unused(c, rows.columns) for c in ("_bucket", "_own", "_before", "_n", "_b", "_shard"))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)))
    ahead = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    counts = counts.select(F.col("shard").alias(s), F.col(bucket).alias(b), F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before))
    ranked = rows.withColumn(own, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*order)) - 1)
    met = ranked.join(F.broadcast(counts), (F.col("shard") == F.col(s)) & (F.col(bucket) == F.col(b)))  # shards * buckets rows at most
    return met.withColumn("slot", F.col(before) + F.col(own)).drop(bucket, b, s, before, own)


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, digest, shard, slot, and the shard if there were one more."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.col(id_col)
    rows = docs.select(key, size.alias("size"), crc.alias("text_crc32"), Tree(shards).shard(key).alias("shard"))
    slots = with_slots(rows, [id_col, "text_crc32", "size"], id_col)
    return slots.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", Tree(shards + 1).shard(key).alias("grown_shard"))


def write(docs: DataFrame, path: str, tree: Tree, id_col: str = "doc_id") -> None:
    """One folder of Parquet files for each shard, with slots."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("the table has a column named shard or slot")
    with_slots(docs.withColumn("shard", tree.shard(F.col(id_col))), [id_col], id_col).write.partitionBy("shard").parquet(path)
