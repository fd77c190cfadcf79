"""Reports, pages and jobs on small tables made by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions.geo import chord_bearing
from kerbline.operators import details
from kerbline.sources import jobs, sinks


def test_jobs_go_on_after_failures_and_skip_what_is_there(spark, tmp_path):
    calls = []

    def layer(n):
        def job():
            calls.append(n)
            return spark.range(n)

        return job

    def broken():
        raise OSError("no route\nto host")

    folder = str(tmp_path)
    first = [tuple(r) for r in jobs.fetch_all(spark, {"a": layer(3), "b": broken, "c": layer(5)}, folder).collect()]
    assert first == [("a", "fetched", 3, None), ("b", "failed", None, "no route"), ("c", "fetched", 5, None)]
    again = jobs.fetch_all(spark, {"a": layer(4), "b": layer(2), "c": layer(5)}, folder)
    assert [r["state"] for r in again.collect()] == ["cached", "fetched", "cached"] and sorted(calls) == [2, 3, 5]
    assert jobs.fetch_all(spark, {"a": layer(4)}, folder, refresh=True).first()["n_features"] == 4
    assert json.loads(jobs.provenance(again, "x").first()["value"])["name"] == "b"
    assert [jobs.newest_stamp(t) for t in ('{"format": 4}', '{"format": "4"}', '{"format": 4.0}', '{"format": true}', "[]", "{", "{}")] == [4, 0, 0, 0, 0, 0, 0]


def test_collections_are_whole_json_with_lines_and_rings(spark, tmp_path):
    rows = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.5), (float("nan"), 0.0)], None), (2, None, "x")], "id long, coords array<struct<lon:double,lat:double>>, note string")
    rows = rows.withColumns({"alon": F.lit(5.0), "alat": F.lit(6.0), "blon": F.lit(7.0), "blat": F.lit(8.0)})
    sinks.write_collection(sinks.line_features(rows, ["id", "note"]).coalesce(1), f"{tmp_path}/lines")
    found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/lines").collect()))
    assert [(f["properties"], f["geometry"]["coordinates"]) for f in found["features"]] == [({"id": 1, "note": None}, [[0.0, 1.0], [2.0, 3.5]]), ({"id": 2, "note": "x"}, [[5.0, 6.0], [7.0, 8.0]])]
    cells = spark.createDataFrame([(2, 3)], "col long, row long").withColumn("ring", sinks.cell_ring(F.col("col"), F.col("row"), 10.0, 20.0, 0.5, 0.25))
    one = json.loads(sinks.polygon_features(cells, []).first()["value"])
    assert one["geometry"]["coordinates"] == [[[11.0, 20.75], [11.5, 20.75], [11.5, 21.0], [11.0, 21.0], [11.0, 20.75]]] and one["properties"] == {}
    sinks.write_collection(sinks.polygon_features(cells.limit(0), []).coalesce(1), f"{tmp_path}/none")


@pytest.mark.parametrize("line, at, want", [([(0, 0), (50, 0)], (20, 9), 0.0), ([(0, 0), (50, 0), (50, 50)], (60, 40), 90.0), ([(0, 0), (50, 0), (50, 50)], (50, 0), 45.0), ([(0, 0), (0, 0), (-30, 30)], (-10, 10), 135.0), ([(50, 0), (0, 0)], (70, 1), 0.0), ([(3, 3), (3, 3)], (0, 0), None), ([(3, 3)], (0, 0), None)])
def test_chord_bearings_of_bent_lines(spark, line, at, want):
    row = spark.createDataFrame([([tuple(map(float, p)) for p in line],)], "line array<struct<x:double,y:double>>")
    got = row.select(chord_bearing(F.col("line"), F.lit(float(at[0])), F.lit(float(at[1]))).alias("b")).first()["b"]
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-9)


def test_extents_need_two_points(spark):
    rows = spark.createDataFrame([(1, 2.0, 10.0), (1, 3.0, 12.0), (2, 5.0, 5.0), (3, None, 1.0), (3, 1.0, 1.0)], "p long, lon double, lat double")
    assert [tuple(r) for r in details.extents(rows, "p").collect()] == [(1, 2.0, 10.0, 3.0, 12.0)]
    wide = details.extents(rows, "p", pad_m=1105.4).first()
    assert math.isclose(wide["south"], 9.99) and wide["west"] < 2.0 - 0.0099


def test_snapshots_are_faulted_for_each_skew(spark):
    def faults(*stamps):
        return [r["fault"] for r in details.snapshot_faults(spark.createDataFrame([(*s,) for s in stamps], "kind string, format string"), 4).collect()]

    assert faults(("meta", "4"), ("city", "4")) == []
    assert faults(("meta", "4")) == ["no city pages"]
    assert faults(("meta", "5"), ("city", '"5"')) == ["a city page is format 0", "the stamps differ"]
    assert faults(("city", "4")) == ["the snapshot is format 0"]


def test_a_trip_before_and_after_a_project(spark):
    """From 0 to 3 straight along a busy street, or around by a quiet one until the busy one is protected."""
    streets = [(0, 1, "busy_street", 400.0), (1, 3, "busy_street", 400.0), (0, 2, "quiet_street", 700.0), (2, 3, "quiet_street", 700.0)]
    both = [(a, b, 0, c, m) for u, v, c, m in streets for a, b in ((u, v), (v, u))]
    edges = spark.createDataFrame(both, "u long, v long, k int, cls string, length double")
    edges = edges.withColumns({"road_busy": F.col("cls") == "busy_street", "crash_factor": F.lit(1.0), "xpen": F.lit(0.0), "climb": F.lit(0.0), "stress_mult": F.lit(1.0)})
    trips = spark.createDataFrame([(9, 0, 3)], "trip long, source long, target long")
    tiles = spark.range(4).select(F.col("id").alias("node"), (F.col("id") % 2).alias("tile"))
    got = details.trip_whatif(edges, trips, tiles, F.col("cls") == "busy_street").first().asDict()
    assert got == {"trip": 9, "km_change": -0.6, "protected_change": 100, "n_upgraded": 2}


def test_requests_say_what_they_come_from(spark):
    from kerbline.sources import connectors

    asked = connectors._fetcher({"agent": "browser", "fetcher": "tests.test_details:said"})
    assert asked("http://x") == connectors.AGENTS["browser"] and asked("http://x", None, {"User-Agent": "own"}) == "own"
    assert connectors._fetcher({"fetcher": "tests.test_details:said"}) is said
    assert connectors._fetcher({}) is connectors.fetch


def said(url, data=None, headers=None):
    return (headers or {}).get("User-Agent")
