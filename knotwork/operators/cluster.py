"""Series clustering for approximate factor smooths: bins, counts by series and bin, k-means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_edges(df: DataFrame, variables: Sequence[str], bins: dict[str, int] | None = None, excl: Sequence[str] = ()) -> dict[str, tuple[float, float, int]]:
    """(low, high, bins) by variable, but for ``excl``; int(sqrt(distinct values)) equal bins unless given."""
    variables, wanted = [v for v in variables if v not in excl], []
    for v in variables:
        wanted += [F.min(v).cast("double"), F.max(v).cast("double"), F.countDistinct(v)]
    row = df.agg(*wanted).first()
    return {v: (row[3 * k], row[3 * k + 1], (bins or {}).get(v) or max(1, int(row[3 * k + 2] ** 0.5))) for k, v in enumerate(variables)}


def bin_of(v: str, low: float, high: float, bins: int) -> Column:
    """Number of the equal bin, 0..bins-1; the highest value is in the last one."""
    if high <= low:
        return F.lit(0)
    return F.least(F.floor((F.col(v) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def bin_counts(df: DataFrame, series: str, edges: dict[str, tuple[float, float, int]], split_by: Sequence[str] = ()) -> DataFrame:
    """(split..., series, variable, bin, n): rows of each series in each bin."""
    parts = [F.struct(F.lit(v).alias("variable"), bin_of(v, *e).alias("bin")) for v, e in edges.items()]
    long = df.select(*split_by, series, F.explode(F.array(*parts)).alias("b"))
    return long.groupBy(*split_by, series, "b.variable", "b.bin").agg(F.count(F.lit(1)).alias("n"))


def cluster_series(df: DataFrame, series: str, edges: dict[str, tuple[float, float, int]], k: int | None = None, restarts: int = 5, seed: int = 0, split_by: Sequence[str] = (), stat: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of similar series: (split..., series, cluster) and (split..., cluster, weight, representative).

    Rows of the counts matrix are series, columns bins, normalised by column; k-means++ runs
    ``restarts`` times and the lowest sum of squares wins. The representative has most rows. Each combination of ``split_by`` is clustered for itself.
    ``stat`` "n" makes a variable one column of its numbers of rows, "n_unique" is a column a bin.
    """
    if set((stat or {}).values()) - {"n", "n_unique"}:
        raise ValueError("stat must be n or n_unique")
    edges = {v: (low, high, 1 if (stat or {}).get(v) == "n" else n) for v, (low, high, n) in edges.items()}
    if split_by:
        pairs = []
        for level in df.select(*split_by).distinct().orderBy(*split_by).collect():  # levels of factors
            own = df.where(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(level[c])) for c in split_by]))
            marks = [F.lit(level[c]).cast(df.schema[c].dataType).alias(c) for c in split_by]
            pairs.append([d.select(*marks, "*") for d in cluster_series(own, series, edges, k, restarts, seed)])
        if pairs:
            return tuple(reduce(DataFrame.unionByName, x) for x in zip(*pairs, strict=True))
    counts = bin_counts(df, series, edges).withColumn("cell", F.concat_ws("_", "variable", "bin"))
    cells = [f"{v}_{b}" for v, (_, _, n) in edges.items() for b in range(n)]
    wide = counts.groupBy(series).pivot("cell", cells).agg(F.sum("n")).fillna(0)
    total = wide.agg(*[F.sum(f"`{c}`").alias(f"t{j}") for j, c in enumerate(cells)]).first()
    scaled = wide.select(series, *[(F.col(f"`{c}`") / float(total[j] or 1)).alias(f"x{j}") for j, c in enumerate(cells)])
    points = VectorAssembler(inputCols=[f"x{j}" for j in range(len(cells))], outputCol="features").transform(scaled).cache()
    n = points.select("features").distinct().count()
    k = max(2, min(n, k or int((len(cells) * n) ** 0.5)))
    if n < 2:
        found = points.select(series, F.lit(0).alias("cluster"))
    else:
        fits = [KMeans(k=k, seed=seed + r, initMode="k-means||").fit(points) for r in range(restarts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        found = best.transform(points).select(series, F.col("prediction").alias("cluster"))
    sizes = df.groupBy(series).agg(F.count(F.lit(1)).alias("rows"))
    groups = found.join(sizes, series).groupBy("cluster").agg(F.count(F.lit(1)).alias("weight"), F.max_by(series, F.struct("rows", series)).alias("representative"))
    return found, groups
