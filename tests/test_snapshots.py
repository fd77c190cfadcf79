import json
import os

import pytest
from pyspark.sql import functions as F

from kerbline.sources import jobs, snapshots


def listed(spark, folder):
    return {r["name"]: bytes(r["content"]).decode() for r in snapshots.read_files(spark, folder).collect()}


def broken(rows, at):
    """The rows, of which the task that reaches `at` fails."""
    return rows.withColumn("content", F.when(F.col("name") == at, F.raise_error(F.lit("the task fails"))).otherwise(F.col("content")))


def test_a_failed_write_leaves_the_files_that_were_there(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame([(f"town{i}.json", f"old {i}", json.dumps({"n": i})) for i in range(9)], "name string, content string, entry string").repartition(3)
    snapshots.write_files(first, folder)
    assert listed(spark, folder) == {f"town{i}.json": f"old {i}" for i in range(9)}
    assert [(r["file"], r["n"], r["bytes"]) for r in snapshots.read_index(spark, folder).collect()] == [(f"town{i}.json", i, 5) for i in range(9)]
    new = first.withColumn("content", F.replace("content", F.lit("old"), F.lit("new")))
    with pytest.raises(Exception, match="the task fails"):
        snapshots.write_files(broken(new, "town7.json"), folder)
    assert listed(spark, folder)["town0.json"] == "old 0"
    snapshots.write_files(new.where("name <> 'town8.json'"), folder)
    assert listed(spark, folder) == {f"town{i}.json": f"new {i}" for i in range(8)}
    versions = {n for n in os.listdir(folder) if n.startswith("v-")}  # what a task of the failed write left after its end is gone as well
    assert len(versions) == snapshots.KEPT and os.path.basename(snapshots.current(spark, folder)) in versions


@pytest.mark.parametrize("name", ["", None, "../up.json", "/etc/x", "a//b", ".", "a/..", "é.json", "index.json", "a b"])
def test_names_that_would_write_elsewhere_are_refused(spark, tmp_path, name):
    with pytest.raises(ValueError):
        snapshots.check_name(name)
    if name == "":
        with pytest.raises(Exception, match="refusing to write"):
            snapshots.write_files(spark.createDataFrame([("ok.json", "x"), (name, "x")], "name string, content string"), str(tmp_path))
        assert snapshots.current(spark, str(tmp_path)) is None


def test_two_rows_of_one_name_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", "1"), ("a.json", "2")], "name string, content string").repartition(2)
    with pytest.raises(Exception, match="two rows are named"):
        snapshots.write_files(rows, str(tmp_path))
    assert snapshots.current(spark, str(tmp_path)) is None
    snapshots.write_files(rows.limit(0), str(tmp_path))
    assert listed(spark, str(tmp_path)) == {}


def test_city_pages_are_escaped_and_indexed(spark, tmp_path):
    cities = spark.createDataFrame([("a-b", "A & <B> \"quoted\" 'x'", 1.5, None), ("c", "C", 2.0, 7)], "slug string, name string, safe_km double, pockets long")
    snapshots.write_files(snapshots.city_files(cities, ["safe_km", "pockets"]), str(tmp_path))
    got = listed(spark, str(tmp_path))
    assert set(got) == {"a-b.json", "a-b/index.html", "c.json", "c/index.html"}
    page = got["a-b/index.html"]
    assert "A &amp; &lt;B&gt; &quot;quoted&quot; &#x27;x&#x27;" in page and "<B>" not in page and "pockets: not measured" in page
    assert json.loads(got["a-b.json"]) == {"slug": "a-b", "name": "A & <B> \"quoted\" 'x'", "safe_km": 1.5, "pockets": None}
    index = {r["slug"]: r["safe_km"] for r in snapshots.read_index(spark, str(tmp_path)).where("slug IS NOT NULL").collect()}
    assert index == {"a-b": 1.5, "c": 2.0}
    with pytest.raises(Exception, match="no usable slug"):
        snapshots.write_files(snapshots.city_files(cities.withColumn("slug", F.when(F.col("name") == "C", "").otherwise("x")), ["safe_km"]), str(tmp_path))
    assert set(listed(spark, str(tmp_path))) == set(got)


def test_a_failed_refresh_keeps_the_layer(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda n: lambda: spark.range(n)
    late = lambda: spark.range(40).repartition(4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("page 39 is missing"))).otherwise(F.col("id")).alias("id"))
    first = {r["name"]: r["state"] for r in jobs.fetch_all(spark, {f"l{i}": rows(i + 1) for i in range(5)}, folder).collect()}
    assert set(first.values()) == {"fetched"}
    again = {r["name"]: (r["state"], r["error"]) for r in jobs.fetch_all(spark, {"l0": late, "l1": rows(50), "l2": rows(60)}, folder, refresh=True).collect()}
    assert again["l0"][0] == "failed" and again["l0"][1] and again["l1"][0] == "fetched"
    assert jobs.layer(spark, folder, "l0").count() == 1 and jobs.layer(spark, folder, "l1").count() == 50
    assert sum(n.startswith("v-") for n in os.listdir(f"{folder}/l0")) == 1
    open_before = jobs.layer(spark, folder, "l1")
    jobs.fetch_all(spark, {"l1": rows(70)}, folder, refresh=True)
    assert open_before.count() == 50 and jobs.layer(spark, folder, "l1").count() == 70
    with pytest.raises(FileNotFoundError):
        jobs.layer(spark, folder, "never")
