import json
import struct
import urllib.parse
import zlib

import numpy as np
import pytest

from kerbline.operators import ingest
from kerbline.sources import connectors, files, sinks
from kerbline.sources.png import decode

LAYER = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [-71.1, 42.4]}, "properties": {"OBJECTID": i, "TOWN": "A" if i % 2 else "B"}} for i in range(2345)]


def layer(url, data=None, headers=None):
    q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(url).query))
    if "bad" in url:
        return json.dumps({"error": {"code": 400}}).encode()
    rows = [f for f in LAYER if "TOWN = 'A'" not in q["where"] or f["properties"]["TOWN"] == "A"]
    if "returnCountOnly" in q:
        return json.dumps({"count": len(rows)}).encode()
    at = int(q["resultOffset"])
    return json.dumps({"features": rows[at : at + 1000]}).encode()


def mirrors(url, data=None, headers=None):
    """Only the third host has the answer: the first breaks off, the second sends a page of its own."""
    if "first" in url:
        raise TimeoutError("took too long")
    if "second" in url:
        return b"<html>busy, come back later</html>"
    found = [{"id": 11, "tags": {"amenity": "toilets"}, "lon": -70.9, "lat": 42.1}, {"id": 12, "tags": {"cuisine": "ice_cream", "name": "Scoop"}, "center": {"lon": -70.95, "lat": 42.2}}, {"id": 13, "tags": {"shop": "bicycle"}, "lon": 2.0, "lat": 2.0}, {"id": 14, "tags": {"leisure": "playground"}}]
    return json.dumps({"elements": found}).encode()


def rows(url, data=None, headers=None):
    asked = urllib.parse.unquote_plus(url)
    return json.dumps([{"a": 1, "b": "x"}, {"a": None, "b": asked}]).encode()


@pytest.fixture(scope="module")
def session(spark):
    connectors.register(spark)
    return spark


def opened(session, name, function, **options):
    return session.read.format(name).options(fetcher=f"tests.test_sources:{function}", **options).load()


def test_layer_pages_and_pushed_filter(session):
    df = opened(session, "arcgis_layer", "layer", url="http://x/0", columns="TOWN")
    assert df.count() == 2345 and df.rdd.getNumPartitions() == 3
    assert df.where("TOWN = 'A'").count() == 1172
    assert connectors.pushed([connectors.EqualTo(("TOWN",), "O'A"), connectors.In(("N",), (1, 2)), connectors.EqualTo(("other",), 1)], {"TOWN", "N"})[0] == ["TOWN = 'O''A'", "N IN (1, 2)"]
    with pytest.raises(Exception, match="400"):
        opened(session, "arcgis_layer", "layer", url="http://bad/0").count()


def test_elements_from_whichever_host_has_them(session):
    df = opened(session, "map_elements", "mirrors", urls="http://first,http://second,http://third", query="q", pause="0")
    got = {(r["id"], r["kind"], r["name"], r["lon"]) for r in ingest.places_of(df).collect()}
    assert got == {(11, "restroom", "", -70.9), (12, "ice_cream", "Scoop", -70.95)}
    with pytest.raises(Exception, match="no mirror answered"):
        opened(session, "map_elements", "mirrors", urls="http://first,http://second", query="q", pause="0").count()


def test_rows_with_conditions_and_keys(session):
    df = opened(session, "json_rows", "rows", url="http://x", columns="a,b", where="status='Active'")
    got = df.collect()
    assert got[0]["a"] == "1" and "$where=status='Active'" in got[1]["b"]
    with pytest.raises(Exception, match="access key"):
        opened(session, "json_rows", "rows", url="http://x", columns="a", needs_key="true").count()


def test_feature_files(spark, tmp_path):
    ring = [[0, 0], [0.1, 0], [0.1, 0.1], [0, 0]]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-71.5, 41.0]}, "properties": {"kind": "school", "n": 1}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring, ring], [ring[:3]]]}, "properties": {"TOWN": "A"}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-71.1, 42.4], [-71.2, 42.4], [-71.2, 42.5]]}, "properties": {"TYPE": "Trail"}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc))
    df = files.features(spark, str(tmp_path / "a.geojson"))
    p = files.points(df).first()
    assert (round(p["x"], 3), round(p["y"], 3), p["properties"]["kind"]) == (200000.0, 750000.0, "school")
    assert [len(r) for r in files.rings(df).first()["rings"]] == [4], "outer rings of four points or more"
    assert files.segments(df).count() == 2
    assert files.features(spark, str(tmp_path / "none.geojson")).count() == 0


def png(image):
    h, w, n = image.shape
    raw = b""
    before = np.zeros((w, n), np.uint8)
    for y in range(h):
        line = image[y]
        if y % 3 == 0:
            raw += b"\x00" + line.tobytes()
        elif y % 3 == 1:
            raw += b"\x01" + np.diff(line, axis=0, prepend=np.zeros((1, n), np.uint8)).astype(np.uint8).tobytes()
        else:
            raw += b"\x02" + (line - before).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_tiles_of_pixels(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (decode(png(image)) == image).all()
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "9.png").write_bytes(png(image))
    (tmp_path / "7" / "8.png").write_bytes(b"broken")
    got = files.pixels(spark, str(tmp_path / "7")).where("px = 4 AND py = 5").collect()
    assert [(r["tile_x"], r["tile_y"], r["r"], r["g"], r["b"]) for r in got] == [(7, 9, *map(int, image[5, 4]))]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, -71.1, 42.4, -71.2, 42.5, None, 'say "hi", ok')], "id long, alon double, alat double, blon double, blat double, crashes long, name string")
    sinks.write_features(df, ["id", "crashes", "name"], str(tmp_path / "f"))
    one = json.loads(spark.read.text(str(tmp_path / "f")).first()[0])
    assert one["properties"] == {"id": 1, "crashes": None, "name": 'say "hi", ok'} and one["geometry"]["coordinates"][1] == [-71.2, 42.5]
    sinks.write_csv(df.select("id", "name"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()["name"] == 'say "hi", ok'
    tiled = spark.createDataFrame([(1, 2, 5), (1, 3, 6)], "tile_col int, tile_row int, u long")
    sinks.write_tiles(tiled, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("tile_row = 3").first()["u"] == 6
    sinks.write_log(spark.createDataFrame([("towns", 3)], "name string, n_features long"), "here", str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_newest_snapshot(spark, tmp_path):
    for name, day in (("old", "2026-01-01"), ("new", "2026-02-01")):
        spark.createDataFrame([(day,)], "built string").write.parquet(str(tmp_path / name))
    at = lambda n: str(tmp_path / n)
    assert files.newest(spark, at("old"), at("new")).first()[0] == "2026-02-01"
    assert files.newest(spark, at("new"), at("old")).first()[0] == "2026-02-01"
    assert files.newest(spark, at("old"), at("missing")).first()[0] == "2026-01-01"
