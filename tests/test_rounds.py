"""Operators that work in rounds end when all is done, not after a number of rounds."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import search, spatial
from kerbline.operators.components import components
from kerbline.plans.graph_queries import tiles_of


def test_a_search_that_is_not_done_is_an_error(spark):
    arcs = spark.range(6).select(F.lit("m").alias("mode"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("weight"))
    tiles = spark.range(7).select(F.col("id").alias("node"), F.col("id").alias("tile"))
    starts = spark.createDataFrame([("m", 0, 0, 0.0)], "mode string, query long, node long, cost double")
    with pytest.raises(RuntimeError):
        search.costs(arcs, starts, tiles, most_rounds=3)
    assert {r["node"]: r["cost"] for r in search.costs(arcs, starts, tiles).collect()} == {n: float(n) for n in range(7)}


def test_components_that_still_change_are_an_error(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components(links, most_rounds=1)
    assert {r["component"] for r in components(links).collect()} == {0}


def test_the_nearest_target_is_found_however_far(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0)], "p long, x double, y double")
    targets = spark.createDataFrame([(7, 200.0 * 2**14, 1.0), (8, None, None)], "id long, tx double, ty double")
    assert [(r["p"], r["near_id"]) for r in spatial.nearest_anywhere(points, targets, "p", 200.0).collect()] == [(1, 7)]
    assert spatial.nearest_anywhere(points, targets.limit(0), "p", 200.0).count() == 0


def test_tiles_grow_so_that_rounds_stay_few(spark, tmp_path):
    part = spark.range(800_000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(900.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    tiles = tiles_of(spark, str(tmp_path)).groupBy("tile").count().collect()
    assert len(tiles) <= 25 and max(r["count"] for r in tiles) <= 40_000


def test_neighbouring_tiles_are_settled_together(spark):
    arcs = spark.range(12).select(F.lit("m").alias("mode"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("weight"))
    tiles = spark.range(13).select(F.col("id").alias("node"), F.col("id").alias("tile"))
    starts = spark.createDataFrame([("m", 0, 0, 0.0)], "mode string, query long, node long, cost double")
    for together, rounds in ((100, 1), (5, 3)):
        assert {r["node"]: r["cost"] for r in search.costs(arcs, starts, tiles, most_rounds=rounds, together=together).collect()} == {n: float(n) for n in range(13)}
