import shutil
from pathlib import Path

from pyspark.sql import functions as F

from kerbline import dims
from kerbline.sources import tile_store


def at(tile):
    """The middle of a tile."""
    return dims.TILE_LON0 + (tile + 0.5) * dims.TILE_DEG, dims.TILE_LAT0 + (tile + 0.5) * dims.TILE_DEG


def store(spark, folder):
    """Tiles 0 to 9 either way, with as many streets as their numbers add up to, one at least."""
    rows = [(c * 100 + r, i, c, r) for c in range(10) for r in range(10) for i in range(max(1, c + r))]
    tile_store.write(spark.createDataFrame(rows, "u long, v long, tile_col long, tile_row long"), str(folder))
    return str(folder)


def points(spark, tiles):
    return spark.createDataFrame([(at(c)[0], at(r)[1]) for c, r in tiles], "lon double, lat double")


def tiles_of(rows):
    return {(r["tile_col"], r["tile_row"]): r["n"] for r in rows.groupBy("tile_col", "tile_row").agg(F.count("*").alias("n")).collect()}


def remove_all_but(folder, kept):
    """Takes the other tiles' files away: whoever opens one fails."""
    for c in Path(folder, "tiles").glob("tile_col=*"):
        for r in c.glob("tile_row=*"):
            if (int(c.name.partition("=")[2]), int(r.name.partition("=")[2])) not in kept:
                shutil.rmtree(r)


def test_a_box_opens_its_tiles_only(spark, tmp_path):
    folder = store(spark, tmp_path)
    lon0, lat0 = at(2)[0], at(3)[1]
    rows = tile_store.in_box(spark, folder, lon0, lat0, at(4)[0], at(3)[1])
    want = {(c, 3) for c in (2, 3, 4)}
    assert "PartitionFilters: [isnotnull(tile_col" in rows._jdf.queryExecution().toString()
    remove_all_but(folder, want)
    assert tiles_of(rows) == {t: sum(t) for t in want}


def test_a_corridor_opens_its_tiles_only_and_leaves_out_loaded_ones(spark, tmp_path):
    folder = store(spark, tmp_path)
    line = points(spark, [(1, 1), (1, 2), (2, 2), (2, 2), (7, 7)])
    loaded = spark.createDataFrame([(1, 1), (7, 7), (90, 90)], "tile_col long, tile_row long")
    rows = tile_store.along(spark, folder, line, margin=0, loaded=loaded)
    assert "dynamicpruning" in rows._jdf.queryExecution().toString()
    remove_all_but(folder, {(1, 2), (2, 2)})
    assert tiles_of(rows) == {(1, 2): 3, (2, 2): 4}


def test_margins_tiles_that_are_not_there_and_nothing_left(spark, tmp_path):
    folder = store(spark, tmp_path)
    got = tiles_of(tile_store.along(spark, folder, points(spark, [(0, 0), (50, 50)]), margin=1))
    assert got == {(c, r): max(1, c + r) for c in (0, 1) for r in (0, 1)}
    everything = tile_store.manifest(spark, folder).select("tile_col", "tile_row")
    assert tile_store.along(spark, folder, points(spark, [(4, 4)]), loaded=everything).count() == 0
    assert tile_store.manifest(spark, folder).agg(F.sum("n_edges")).first()[0] == sum(max(1, c + r) for c in range(10) for r in range(10))
