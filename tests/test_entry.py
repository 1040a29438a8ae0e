"""Registered queries, against their SQL where they have one; files and streams."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from knotwork import queries as engine
from knotwork.operators.cluster import bin_counts, bin_edges, cluster_series
from knotwork.plans.gamm import GAMM
from knotwork.plans.terms import Formula, f, i, lhs
from knotwork.sources import readers
from knotwork.streaming.scoring import Running, score_stream


def flat(df):
    rows = df[sorted(df.columns)].itertuples(index=False)
    return sorted((tuple("null" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(v) if isinstance(v, str | bool) else round(float(v), 5) + 0.0 for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = engine.QUERIES[name](spark, sf).toPandas(), duck.execute(engine.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert flat(got) == flat(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(engine.QUERIES) <= set(entry.queries())


def test_semi_markov_fit_runs_to_tolerance(spark, sf):
    model, d = engine._hsmm(spark, sf)
    gradient = model.local(model._prepare(d), model.fitted.coef, second=False)[1]
    assert model.fitted.converged and abs(gradient).max() < 0.01
    cut = model.fit(d, init_coef=model.fitted.coef + 0.3, max_outer=1, max_inner=1)
    assert not cut.fitted.converged
    assert {r[0] for r in engine.hsmm_fit(spark, sf).select("converged").collect()} == {1.0}


def test_files(spark, tmp_path):
    for k in range(2):
        pd.DataFrame({"y": [1.0, None, 3.0], "g": ["b", "a", "c"][k:] + ["a"] * k, "x": [k, k + 1, k + 2]}).to_csv(tmp_path / f"{k}.csv", index=False)
    d = readers.read_csv(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")])
    assert d.count() == 6 and readers.read_unique(d, "g") == ["a", "b", "c"]
    assert readers.read_cov(d, "y", "x").count() == 4 and readers.read_cov_no_cor(d, "x").count() == 6
    assert readers.read_dtype(spark, "y", str(tmp_path / "0.csv")).simpleString() == "double"


def test_clusters(spark):
    rows = [(f"s{k}", float(v + 50 * (k % 2))) for k in range(20) for v in range(10)]
    d = spark.createDataFrame(rows, "s string, v double")
    edges = bin_edges(d, ["v"], {"v": 6})
    assert bin_counts(d, "s", edges).agg(F.sum("n")).first()[0] == 200
    found, groups = cluster_series(d, "s", edges, k=2, restarts=2)
    assert found.withColumn("odd", F.substring("s", 2, 3).cast("int") % 2).select("cluster", "odd").distinct().count() == 2
    assert groups.agg(F.sum("weight")).first()[0] == 20


def test_clusters_of_sub_groups(spark):
    rows = [(f"s{k}", "ab"[k % 4 // 2], float(v + 50 * (k % 2)), float(v)) for k in range(24) for v in range(10 if k % 2 else 30)]
    d = spark.createDataFrame(rows, "s string, g string, v double, w double")
    edges = bin_edges(d, ["v"], {"v": 6})
    found, groups = cluster_series(d, "s", edges, k=2, restarts=2, split_by=["g"])
    seen = found.withColumn("odd", F.substring("s", 2, 3).cast("int") % 2).select("g", "cluster", "odd").distinct()
    assert seen.count() == 4 and found.count() == 24
    assert {r["g"]: r["n"] for r in groups.groupBy("g").agg(F.sum("weight").alias("n")).collect()} == {"a": 12, "b": 12}
    both = bin_edges(d, ["v", "w"], {"v": 6, "w": 6})
    found, _ = cluster_series(d, "s", both, restarts=1, stat={"v": "n", "w": "n"})
    assert found.withColumn("odd", F.substring("s", 2, 3).cast("int") % 2).select("cluster", "odd").distinct().count() == 2


def test_streams(spark, tmp_path):
    d = spark.range(400).select((F.col("id") / 400).alias("x"), F.sin(F.col("id") / 40).alias("y"))
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    model = GAMM(Formula(lhs("y"), [i(), f(["x"])])).fit(d)
    seen = []
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, model, lambda batch, number: seen.append(batch.agg(F.sum("fit"), F.count("fit")).first()), str(tmp_path / "mark")).awaitTermination()
    whole = model.predict(d).agg(F.sum("fit"), F.count("fit")).first()
    assert sum(r[1] for r in seen) == whole[1] and abs(sum(r[0] for r in seen) - whole[0]) < 1e-8
    running = Running(model)
    for part in d.randomSplit([0.5, 0.5], 1):
        running.update(part)
    assert abs(running.solve().edf - model.fitted.edf) < 0.05
