import datetime

import pytest
from pyspark.sql import functions as F

from kerbline.functions import sentences, text
from kerbline.functions.geo import length_midpoint, num, on_ring, in_any_ring, in_rings_even_odd


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_one_decimal_is_exact(spark):
    values = [1.65, 0.25, 0.75, 2.35, 1.05, 12.0, 0.0, 0.049, 1650.0 / 1000, 3.15, 99.95, 7.449999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(text.one_decimal(F.col("v"), False), text.one_decimal(F.col("v"))).collect()]
    assert [g[0] for g in got] == [f"{v:.1f}" for v in values]
    assert [g[1] for g in got] == ["0.3" if v == 0.25 else f"{v:.1f}" for v in values]


def test_sunset_in_summer_and_winter(spark):
    for day, low, high in ((datetime.date(2026, 6, 21), 24 * 60 + 15, 24 * 60 + 35), (datetime.date(2026, 12, 21), 21 * 60 + 5, 21 * 60 + 25)):
        got = one(spark, text.sunset_minutes(F.lit(day.timetuple().tm_yday), num(42.383), num(-71.105)))
        assert low <= got <= high


def test_versions_places_and_grades(spark):
    assert one(spark, text.newer_version(F.lit("app-v9"), F.lit(" app-v10 "))) is True
    assert one(spark, text.newer_version(F.lit("app-v9"), F.lit("v10"))) is False
    assert one(spark, text.place_sign(F.lit("Grandma's House"))) == "🏠" and one(spark, text.place_sign(F.lit("Pond"))) == "📍"
    assert one(spark, sentences.class_grade(F.lit("lane"))) == "C" and one(spark, sentences.class_grade(F.lit("canal"))) is None


def test_town_sentences(spark):
    said = lambda safe, pocket: one(spark, sentences.town_sentence(num(safe), num(pocket), F.lit(7), num(20.0), 2.5))
    assert "Almost no street" in said(0.0, 0.0)
    assert "don't join up: 6.0 km of them sit in 7 pockets" in said(10.0, 6.0)
    assert "20.0 km of it" in said(100.0, 6.0)


def test_project_and_report_sentences(spark):
    got = one(spark, sentences.project_sentence(F.lit("Elm"), F.lit("sharrow"), F.lit("spot_fix"), num(14.0), num(1250.0), F.lit(1), F.lit("A, B")))
    assert got == "a spot fix on Elm (A, B) — 14 m of it, today shared-lane markings only; unlocks 1.2 km of kid-safe streets; 1 bike crash since 2021"
    assert one(spark, sentences.project_sentence(F.lit("Elm"), F.lit("lane"), F.lit("corridor"), num(100.0), num(0.0), F.lit(None).cast("int"), None, num(1.5))).endswith("recorded bike crashes nearby")
    assert one(spark, sentences.report_sentence(F.lit("Pothole"), F.lit(" deep "), num(42.4), num(-71.1))) == "Bike hazard report: Pothole. deep. Location: 42.400000,-71.100000."
    assert one(spark, sentences.ride_sentence(F.lit("May 1"), num(8600.0), num(3600.0), F.lit(50), F.lit(30))).startswith("🚲 Family bike ride, May 1: 8.6 km in 60 min (8.6 km/h)")


def test_links_round_trip(spark):
    frag = sentences.link_of(num(-71.1), num(42.4), num(-71.2), num(42.5), F.lit("solo"), F.lit(True), num(300.0), F.array(F.lit("lane"), F.lit("sharrow")))
    got = spark.range(1).select(frag.alias("f")).select(*(c.alias(k) for k, c in sentences.link_fields(F.col("f")).items())).first()
    assert got.asDict() == {"start": [-71.1, 42.4], "end": [-71.2, 42.5], "profile": "solo", "flat": True, "walk_m": 300.0, "avoid": ["lane", "sharrow"], "option": None}
    bad = spark.range(1).select(F.lit("s=x,1&m=car&wk=abc&o=loop").alias("f")).select(*(c.alias(k) for k, c in sentences.link_fields(F.col("f")).items())).first()
    assert bad.asDict() == {"start": None, "end": None, "profile": None, "flat": False, "walk_m": 0.0, "avoid": [], "option": None}


def ring(*points):
    return F.array(*(F.struct(num(x).alias("x"), num(y).alias("y")) for x, y in points))


def test_rings_and_midpoints(spark):
    outer, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (7, 3), (7, 7), (3, 7))
    at = (num(5.0), num(5.0))
    assert one(spark, in_any_ring(*at, F.array(outer, hole))) is True and one(spark, in_rings_even_odd(*at, F.array(outer, hole))) is False
    assert one(spark, on_ring(num(10.0), num(4.0), outer)) is True and one(spark, on_ring(num(9.0), num(4.0), outer)) is False
    mid = one(spark, length_midpoint(ring((0, 0), (1, 0), (4, 0))))
    assert mid["x"] == pytest.approx(2.0)
