"""Queries of text, links, ingest rules and imagery, over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import imagery, sentences, text
from kerbline.functions.geo import num
from kerbline.operators import ingest
from kerbline.plans import grid
from kerbline.plans.graph_queries import _SEV, _kept
from kerbline.plans.network_queries import _WEIGHED, weighed
from kerbline.plans.registry import query


def _case(key: str, words: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in words.items()) + " END"


@query("slugs", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark, folder):
    c = grid.table(spark, folder, "customer")
    return c.select("c_custkey", text.slug(F.concat("c_name", F.lit(" & "), "c_mktsegment", F.lit("!"))).alias("slug"))


@query("html_escapes", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS digest FROM documents")
def html_escapes(spark, folder):
    return grid.table(spark, folder, "documents").select("doc_id", F.md5(text.html_escape(F.col("text")).cast("binary")).alias("digest"))


@query("title_case", "SELECT n_nationkey::BIGINT AS id, 'O''Neil-Nation_' || n_nationkey AS name FROM nation")
def title_case(spark, folder):
    n = grid.table(spark, folder, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"), text.title_case(F.concat(F.lit("o'NEIL-"), "n_name")).alias("name"))


_GUIDE = "CASE WHEN m < 15 THEN 0 WHEN m < 100 THEN floor(m / 10 + 0.5)::BIGINT * 10 WHEN m < 500 THEN floor(m / 50 + 0.5)::BIGINT * 50 ELSE floor(m / 100 + 0.5)::BIGINT * 100 END"


@query("guide_distances", f"WITH d AS (SELECT event_id, value * 13 AS m FROM events), r AS (SELECT event_id, {_GUIDE} AS r FROM d) SELECT event_id, r AS metres, CASE WHEN r = 0 THEN 'now' WHEN r < 1000 THEN r || ' m' WHEN r % 1000 = 0 THEN r // 1000 || ' km' ELSE format('{{:.1f}}', r / 1000.0::DOUBLE) || ' km' END AS said FROM r")
def guide_distances(spark, folder):
    m = F.col("value") * 13
    return grid.table(spark, folder, "events").select("event_id", text.guide_metres(m).alias("metres"), text.guide_distance(m).alias("said"))


@query("turn_words", "WITH d AS (SELECT event_id, (event_id * 17 % 360)::DOUBLE - 180 AS d FROM events) SELECT event_id, CASE WHEN abs(d) < 25 THEN NULL WHEN abs(d) < 60 THEN 'slight ' WHEN abs(d) < 135 THEN 'turn ' ELSE 'sharp ' END || CASE WHEN d < 0 THEN 'left' ELSE 'right' END AS word, (['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])[(floor(((event_id * 17 % 360)::DOUBLE) / 45 + 0.5)::BIGINT % 8) + 1] AS point FROM d")
def turn_words(spark, folder):
    b = (F.col("event_id") * 17 % 360).cast("double")
    return grid.table(spark, folder, "events").select("event_id", text.turn_words(b - 180).alias("word"), text.compass_point(b).alias("point"))


@query("announce_distance", "SELECT event_id, greatest(60.0::DOUBLE, least(200.0::DOUBLE, CASE WHEN value / 4 > 0.8 THEN value / 4 ELSE 8000.0::DOUBLE / 3600 END * 25)) AS metres FROM events")
def announce_distance(spark, folder):
    speed = F.when(F.col("value") / 4 > 0.8, F.col("value") / 4).otherwise(num(8000) / 3600)
    return grid.table(spark, folder, "events").select("event_id", F.greatest(num(60), F.least(num(200), speed * 25)).alias("metres"))


@query("sunsets", """WITH d AS (SELECT DISTINCT dayofyear(o_orderdate) AS doy FROM orders), g AS (SELECT doy, (doy - 1) * (2 * pi() / 365) AS g FROM d),
e AS (SELECT doy, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g)
SELECT doy, round(720 - 4 * (-71.105::DOUBLE - degrees(acos(greatest(-1, least(1, cos(radians(90.833)) / (cos(radians(42.383)) * cos(decl)) - tan(radians(42.383)) * tan(decl)))))) - eq, 3) AS minutes FROM e""")
def sunsets(spark, folder):
    d = grid.table(spark, folder, "orders").select(F.dayofyear("o_orderdate").cast("bigint").alias("doy")).distinct()
    return d.select("doy", F.round(text.sunset_minutes(F.col("doy"), num(42.383), num(-71.105)), 3).alias("minutes"))


@query("newer_snapshots", "WITH p AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS remote, CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE strftime(ts + INTERVAL 1 DAY * (event_id % 3 - 1), '%Y-%m-%d') END AS bundled FROM events) SELECT event_id, regexp_full_match(bundled, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND remote > bundled AS newer FROM p")
def newer_snapshots(spark, folder):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    other = F.when(F.col("event_id") % 9 == 0, F.lit("soon")).otherwise(day(F.expr("ts + make_dt_interval(event_id % 3 - 1)")))
    return grid.table(spark, folder, "events").select("event_id", text.newer_build(day("ts"), other).alias("newer"))


@query("street_cards", grid.sql(f""", {_WEIGHED}, m0 AS (SELECT u, v, coalesce(name, 'unnamed') AS name, cls, crash_count AS c FROM w) SELECT u, v, concat_ws(' | ', CASE WHEN cls IN ('path', 'separated', 'quiet_street') THEN 'A' WHEN cls IN ('buffered', 'service') THEN 'B' WHEN cls = 'lane' THEN 'C' WHEN cls IN ('sharrow', 'moderate_street') THEN 'D' ELSE 'F' END, name,
{_case('cls', sentences.LABEL)}, {_case('cls', sentences.MEANING)}, CASE WHEN c > 0 THEN c || ' bike crash' || CASE WHEN c > 1 THEN 'es' ELSE '' END || ' recorded nearby' END) AS card FROM m0"""))
def street_cards(spark, folder):
    return weighed(spark, folder).select("u", "v", sentences.street_card(F.col("name"), F.col("cls"), F.col("crash_count")).alias("card"))


@query("project_sentences", grid.sql(f""", {_SEV} SELECT street, cls, run, concat_ws('; ', CASE WHEN kind = 'spot_fix' THEN 'a spot fix on ' || street || ' — ' || format('{{:.0f}} m', length_m) || ' of it, today ' ELSE format('{{:.0f}} m', length_m) || ' of ' || street || ' — today ' END || {_case('cls', sentences.TODAY)},
CASE WHEN join_m > 0 THEN 'unlocks ' || format('{{:.1f}}', join_m / 1000) || ' km of kid-safe streets' END, CASE WHEN crashes > 0 THEN crashes || ' bike crash' || CASE WHEN crashes = 1 THEN '' ELSE 'es' END || ' since 2021' END) AS summary FROM kept""", recursive=True))
def project_sentences(spark, folder):
    said = sentences.project_sentence(F.col("street"), F.col("cls"), F.col("kind"), F.col("length_m"), F.col("join_m"), F.col("crashes"))
    return _kept(spark, folder).select("street", "cls", "run", said.alias("summary"))


@query("link_round_trip", "SELECT event_id, round(-71.2 + value / 1000, 6) AS lon, round(42.3 + value / 2000, 6) AS lat, CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 'solo' ELSE 'young_kids' END AS profile, event_id % 2 = 0 AS flat, CASE event_id % 3 WHEN 1 THEN 500.0 WHEN 2 THEN 2000.0 ELSE 0.0 END::DOUBLE AS walk_m, CASE WHEN event_id % 5 = 0 THEN 'lane' ELSE '' END AS avoid FROM events")
def link_round_trip(spark, folder):
    e = grid.table(spark, folder, "events")
    n = F.col("event_id")
    m = F.when(n % 4 == 0, "nobody").when(n % 4 == 1, "kids").when(n % 4 == 2, "young_kids").otherwise("solo")
    frag = F.concat_ws("&", F.concat(F.lit("s="), F.format_string("%.6f,%.6f", num(-71.2) + F.col("value") / 1000, num(42.3) + F.col("value") / 2000)), F.concat(F.lit("m="), m), F.when(n % 2 == 0, F.lit("f=1")), F.when(n % 3 == 1, F.lit("wk=1")).when(n % 3 == 2, F.lit("wk=9000")), F.when(n % 5 == 0, F.lit("x=lane,road")))
    f = sentences.link_fields(frag)
    return e.select("event_id", f["start"][0].alias("lon"), f["start"][1].alias("lat"), f["profile"].alias("profile"), f["flat"].alias("flat"), f["walk_m"].alias("walk_m"), F.array_join(f["avoid"], ",").alias("avoid"))


@query("town_names", "SELECT DISTINCT trim(t) AS town FROM (SELECT unnest(string_split(CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE c_mktsegment || ', ' || n_name END, ',')) AS t FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE trim(t) NOT IN ('', '-')")
def town_names(spark, folder):
    c = grid.table(spark, folder, "customer").join(grid.table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    lists = c.select(F.when(F.col("c_custkey") % 7 == 0, "-").otherwise(F.concat("c_mktsegment", F.lit(", "), "n_name")).alias("towns"))
    return ingest.distinct_towns(lists)


_WORK = """zone AS (SELECT event_id AS id, CASE event_id % 11 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS starts, CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE strftime(ts + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S') END AS ends, -71.7 + value * 0.01 AS lon, 42.3::DOUBLE AS lat FROM events WHERE event_type IN ('click', 'error'))"""


@query("work_zones", f"WITH {_WORK}, z AS (SELECT id, 'zone' AS src, starts, ends FROM zone WHERE (try_cast(ends AS TIMESTAMP) IS NULL OR try_cast(ends AS TIMESTAMP) >= TIMESTAMP '2024-01-10') AND (try_cast(starts AS TIMESTAMP) IS NULL OR try_cast(starts AS TIMESTAMP) <= TIMESTAMP '2024-01-31') AND lon BETWEEN -71.6 AND -70.78 AND lat BETWEEN 42.0 AND 42.63) SELECT id, src, left(coalesce(starts, ''), 10) AS starts, left(coalesce(ends, ''), 10) AS ends FROM z UNION ALL SELECT s_suppkey, 'permit', '', '' FROM supplier WHERE s_suppkey % 4 <> 0")
def work_zones(spark, folder):
    e = grid.table(spark, folder, "events").where("event_type IN ('click', 'error')")
    n, iso = F.col("event_id"), "yyyy-MM-dd'T'HH:mm:ss"
    zones = e.select(n.alias("id"), F.when(n % 11 == 0, "not a date").when(n % 11 != 1, F.date_format("ts", iso)).alias("starts"), F.when(n % 13 == 0, "").when(n % 13 != 1, F.date_format(F.expr("ts + INTERVAL 5 DAYS"), iso)).alias("ends"), F.array(F.array(F.struct((num(-71.7) + F.col("value") * num(0.01)).alias("lon"), num(42.3).alias("lat")))).alias("parts"))
    s = grid.table(spark, folder, "supplier")
    permits = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, "-71.1").alias("longitude"), F.lit("42.4").alias("latitude"), F.lit("").alias("starts"), F.lit("").alias("ends"))
    return ingest.construction(zones, permits, "2024-01-10")


@query("census_people", "SELECT c_custkey AS id, coalesce(try_cast(CASE c_custkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN (c_custkey * 7)::VARCHAR END AS BIGINT), 0) AS pop FROM customer")
def census_people(spark, folder):
    c = grid.table(spark, folder, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, "n/a").when(F.col("c_custkey") % 3 == 1, (F.col("c_custkey") * 7).cast("string"))
    return c.select(F.col("c_custkey").alias("id"), ingest.people(raw).alias("pop"))


@query("poi_kinds", "SELECT id, kind FROM (SELECT s_suppkey AS id, CASE s_nationkey % 5 WHEN 0 THEN 'playground' WHEN 1 THEN 'school' WHEN 2 THEN 'ice_cream' WHEN 3 THEN 'restroom' END AS kind FROM supplier WHERE s_suppkey % 6 <> 0) WHERE kind IS NOT NULL")
def poi_kinds(spark, folder):
    s = grid.table(spark, folder, "supplier")
    n = F.col("s_nationkey") % 5
    tags = F.when(n == 0, F.create_map(F.lit("leisure"), F.lit("playground"))).when(n == 1, F.create_map(F.lit("amenity"), F.lit("kindergarten"))).when(n == 2, F.create_map(F.lit("cuisine"), F.lit("ice_cream"))).when(n == 3, F.create_map(F.lit("amenity"), F.lit("toilets"))).otherwise(F.create_map(F.lit("shop"), F.lit("bakery")))
    e = s.select(F.col("s_suppkey").alias("id"), tags.alias("tags"), F.when(F.col("s_suppkey") % 2 == 0, num(-71.1)).alias("lon"), F.when(F.col("s_suppkey") % 2 == 0, num(42.4)).alias("lat"), F.when(F.col("s_suppkey") % 6 != 0, F.struct(num(-71.2).alias("lon"), num(42.3).alias("lat"))).alias("center"))
    e = e.withColumns({"lon": F.when(F.col("id") % 6 != 0, F.col("lon")), "lat": F.when(F.col("id") % 6 != 0, F.col("lat"))})
    return ingest.places_of(e).select("id", "kind")


@query("crash_scan", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus LIKE '%O%'")
def crash_scan(spark, folder):
    o = grid.table(spark, folder, "orders")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").like("%O%")).select(F.col("o_orderkey").alias("id"))


_PIXEL = "px AS (SELECT l_orderkey % 50 AS site, (l_partkey * 7 % 256)::DOUBLE AS r, (l_suppkey * 31 % 256)::DOUBLE AS g, (l_linenumber * 37 % 256)::DOUBLE AS b FROM lineitem)"


@query("terrain_elevation", f"WITH {_PIXEL} SELECT site, round(avg(r * 256 + g + b / 256 - 32768), 4) AS elevation FROM px GROUP BY 1")
def terrain_elevation(spark, folder):
    return _pixels(spark, folder).groupBy("site").agg(F.round(F.avg(imagery.elevation_of(F.col("r"), F.col("g"), F.col("b"))), 4).alias("elevation"))


def _pixels(spark, folder: str) -> DataFrame:
    return grid.table(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("site"), (F.col("l_partkey") * 7 % 256).cast("double").alias("r"), (F.col("l_suppkey") * 31 % 256).cast("double").alias("g"), (F.col("l_linenumber") * 37 % 256).cast("double").alias("b"))


@query("marking_ratios", f"""WITH {_PIXEL}, n AS (SELECT site, r / 255 AS r, g / 255 AS g, b / 255 AS b, greatest(r, g, b) / 255 AS v, greatest(r, g, b) / 255 - least(r, g, b) / 255 AS c FROM px),
h AS (SELECT site, v, CASE WHEN v > 0 THEN c / v ELSE 0 END AS s, CASE WHEN c = 0 THEN 0 WHEN v = r THEN ((g - b) / c - 6 * floor((g - b) / c / 6)) * 60 WHEN v = g THEN ((b - r) / c + 2) * 60 ELSE ((r - g) / c + 4) * 60 END AS h FROM n)
SELECT site, round(avg(CASE WHEN h BETWEEN 128 AND 178 AND s >= 0.3 AND v BETWEEN 0.28 AND 0.9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS green, round(avg(CASE WHEN s <= 0.22 AND v >= 0.68 THEN 1.0::DOUBLE ELSE 0 END), 6) AS white FROM h GROUP BY 1""")
def marking_ratios(spark, folder):
    share = lambda c: F.round(F.avg(F.when(c, num(1)).otherwise(num(0))), 6)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _pixels(spark, folder).groupBy("site").agg(share(imagery.is_green_paint(r, g, b)).alias("green"), share(imagery.is_white_marking(r, g, b)).alias("white"))


_SITE = "site AS (SELECT p_partkey AS id, (['separated', 'lane', 'path', 'buffered'])[p_partkey % 4 + 1] AS cls, CASE WHEN p_partkey % 9 <> 0 THEN (p_size % 10)::DOUBLE / 100 END AS g0, CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 7)::DOUBLE / 100 END AS g1, (p_partkey % 50)::DOUBLE / 100 AS w0, (p_partkey * 3 % 50)::DOUBLE / 100 AS w1, (p_partkey % 11)::DOUBLE / 10 AS v FROM part)"


@query("site_verdicts", f"WITH {_SITE} SELECT id, CASE WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN CASE WHEN v < 0.18 OR w0 >= 0.45 OR w1 >= 0.45 THEN 'unclear' WHEN (cls <> 'path' AND abs(g1 - g0) >= 0.04) OR abs(w1 - w0) >= 0.22 THEN 'changed' WHEN cls <> 'path' AND g1 < 0.015 AND w1 < 0.015 THEN 'no_markings' ELSE 'ok' END WHEN g1 IS NULL THEN 'no_imagery' ELSE 'ok' END AS verdict FROM site")
def site_verdicts(spark, folder):
    p = grid.table(spark, folder, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    hundredth = lambda c: c.cast("double") / 100
    cls = F.element_at(F.array(*map(F.lit, ("separated", "lane", "path", "buffered"))), (k % 4 + 1).cast("int"))
    v = (k % 11).cast("double") / 10
    said = imagery.verdict(cls, (F.when(k % 9 != 0, hundredth(s % 10)), F.when(k % 7 != 0, hundredth(s % 7))), (hundredth(k % 50), hundredth(k * 3 % 50)), (v, v))
    return p.select(k.alias("id"), said.alias("verdict"))


@query("nearest_photos", "WITH s AS (SELECT p_partkey AS site, (p_partkey % 40) * 98.0::DOUBLE AS x, (p_partkey // 40) * 100.0::DOUBLE AS y FROM part), i AS (SELECT s_suppkey AS photo, (s_suppkey * 53 % 3900)::DOUBLE AS px, (s_suppkey * 71 % 4890)::DOUBLE AS py FROM supplier) SELECT site, photo FROM (SELECT site, photo, row_number() OVER (PARTITION BY site ORDER BY pow(x - px, 2) + pow(y - py, 2), photo) AS rn FROM s JOIN i ON pow(x - px, 2) + pow(y - py, 2) <= 3600) WHERE rn = 1")
def nearest_photos(spark, folder):
    from kerbline.operators import spatial

    sites = grid.nodes(spark, folder).select(F.col("id").alias("site"), "x", "y")
    photos = grid.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 3900).cast("double").alias("tx"), (F.col("s_suppkey") * 71 % 4890).cast("double").alias("ty"))
    return spatial.nearest(sites, photos, "site", 60.0).select("site", F.col("near_id").alias("photo"))


@query("run_metadata", grid.sql(f", {_SEV} SELECT count(*) AS n_candidates, count(*) FILTER (kind = 'spot_fix') AS n_spot_fixes, count(*) FILTER (join_m > 0) AS n_joining, round(sum(length_m), 1) AS metres FROM kept", recursive=True))
def run_metadata(spark, folder):
    return _kept(spark, folder).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("kind") == "spot_fix").alias("n_spot_fixes"), F.count_if(F.col("join_m") > 0).alias("n_joining"), F.round(F.sum("length_m"), 1).alias("metres"))


@query("backup_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rides' ELSE 'places' END AS kept FROM events WHERE event_id % 3 < 2")
def backup_keys(spark, folder):
    n = F.col("event_id")
    stored = F.create_map(F.when(n % 3 == 0, "rides").when(n % 3 == 1, "places").otherwise("cookies"), F.lit("x"))
    e = grid.table(spark, folder, "events").select("event_id", ingest.allowed(stored, ("rides", "places")).alias("m"))
    return e.where(F.size("m") > 0).select("event_id", F.map_keys("m")[0].alias("kept"))
