"""Queries of the smaller steps of reports and pages, on the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions import sentences, text
from kerbline.functions.geo import chord_bearing, num
from kerbline.operators import details, projects, spatial
from kerbline.plans import grid
from kerbline.plans.feature_queries import _SITE, _case, site_verdicts
from kerbline.plans.graph_queries import TOGETHER, _CAND, _CC, _SEV, _kept, arcs, tiles_of
from kerbline.plans.lineage import cut
from kerbline.plans.network_queries import _WEIGHED, weighed
from kerbline.plans.registry import query
from kerbline.plans.route_queries import _OD, _trips
from kerbline.sources.sinks import cell_ring

_DEST = "dest AS (SELECT DISTINCT near_id AS id FROM (SELECT poi_id, n.id AS near_id, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - n.x, 2) + pow(p.y - n.y, 2), n.id) AS rn FROM place p, node n WHERE kind IN ('school', 'playground', 'library')) WHERE rn = 1)"


def destinations(spark, folder: str) -> DataFrame:
    """id of every node that is the nearest one of a destination."""
    wanted = grid.places(spark, folder).where(F.col("kind").isin(*dims.DESTINATIONS))
    nodes = grid.nodes(spark, folder).select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.nearest_anywhere(wanted, nodes, "poi_id", 200.0).select(F.col("near_id").alias("id")).distinct()


def _opened(spark, folder: str) -> DataFrame:
    """island, opened: destinations on each island of child-safe street."""
    return projects.islands(weighed(spark, folder))[0].join(destinations(spark, folder), "id").groupBy("island").agg(F.count("*").alias("opened"))


@query("island_destinations", grid.sql(f", {_CC}, {_DEST} SELECT island, count(*) AS opened FROM dest JOIN comp USING (id) GROUP BY 1", recursive=True))
def island_destinations(spark, folder):
    return _opened(spark, folder)


@query("project_sentences_full", grid.sql(f""", {_SEV}, {_DEST}, per AS (SELECT island, count(*) AS opened FROM dest JOIN comp USING (id) GROUP BY 1),
s AS (SELECT k.*, format('{{:.1f}} km', join_m / 1000) AS gain, i.metres AS larger, per.opened, (length_m * 37)::BIGINT % 5000 AS gaining FROM kept k LEFT JOIN island i ON i.island = k.big LEFT JOIN per ON per.island = k.small)
SELECT street, cls, run, concat_ws('; ', CASE WHEN kind = 'spot_fix' THEN 'a spot fix on ' || street || ' — ' || format('{{:.0f}} m', length_m) || ' of it, today ' ELSE format('{{:.0f}} m', length_m) || ' of ' || street || ' — today ' END || {_case('cls', sentences.TODAY)},
  CASE WHEN join_m > 0 THEN CASE WHEN joins_region THEN 'connects ' || gain || ' of kid-safe streets to the region-wide network' WHEN larger IS NOT NULL THEN 'connects ' || gain || ' of kid-safe streets to a ' || format('{{:.1f}} km', larger / 1000) || ' network' ELSE 'unlocks ' || gain || ' of kid-safe streets' END END,
  CASE WHEN opened > 0 THEN 'opens a network with ' || opened || CASE WHEN opened = 1 THEN ' school, playground or library' ELSE ' schools, playgrounds and libraries' END || ' on it' END,
  CASE WHEN gaining > 0 THEN 'about ' || format('{{:,}}', gaining) || ' residents gain a safe route' END,
  CASE WHEN crashes > 0 THEN crashes || ' bike crash' || CASE WHEN crashes = 1 THEN '' ELSE 'es' END || ' since 2021' END) AS summary FROM s""", recursive=True))
def project_sentences_full(spark, folder):
    """Every branch of a project's sentence; residents are derived from its length."""
    sizes = cut(projects.islands(weighed(spark, folder))[1]).select(F.col("island").alias("big"), F.col("metres").alias("larger"))
    rows = _kept(spark, folder).join(sizes, "big", "left").join(_opened(spark, folder).withColumnRenamed("island", "small"), "small", "left")
    gaining = ((F.col("length_m") * 37).cast("bigint") % 5000).cast("double")
    said = sentences.project_sentence(F.col("street"), F.col("cls"), F.col("kind"), F.col("length_m"), F.col("join_m"), F.col("crashes"), joins_region=F.col("joins_region"), larger_m=F.col("larger"), opened=F.col("opened"), gaining=gaining)
    return rows.select("street", "cls", "run", said.alias("summary"))


@query("project_extents", grid.sql(f", {_CAND}, pts AS (SELECT street, bad.cls, run, unnest([u, v]) AS id FROM bad JOIN run USING (street, cls) JOIN cand USING (street, cls, run) WHERE run.id = bad.u) SELECT street, cls, run, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM pts JOIN node USING (id) GROUP BY 1, 2, 3", recursive=True))
def project_extents(spark, folder):
    rows, members = projects.candidates(weighed(spark, folder))
    ends = members.join(rows.select("street", "cls", "run"), ["street", "cls", "run"], "left_semi").select("street", "cls", "run", F.explode(F.array("u", "v")).alias("id"))
    found = details.extents(ends.join(grid.nodes(spark, folder).select("id", "lon", "lat"), "id"), "street", "cls", "run")
    return found.select("street", "cls", "run", *(F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")))


@query("padded_boxes", grid.sql(", b AS (SELECT ride_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM fix GROUP BY 1 HAVING count(*) >= 2) SELECT ride_id, round(w - 250 / (cos(radians((s + n) / 2)) * 111320), 7) AS west, round(s - 250::DOUBLE / 110540, 7) AS south, round(e + 250 / (cos(radians((s + n) / 2)) * 111320), 7) AS east, round(n + 250::DOUBLE / 110540, 7) AS north FROM b"))
def padded_boxes(spark, folder):
    found = details.extents(grid.fixes(spark, folder), "ride_id", pad_m=250.0)
    return found.select("ride_id", *(F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")))


_SUN = """g AS (SELECT *, (doy - 1) * (2 * pi() / 365) AS g FROM d),
e AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g),
m AS (SELECT *, 720 - 4 * (-71.105::DOUBLE - degrees(acos(greatest(-1, least(1, cos(radians(90.833)) / (cos(radians(42.383)) * cos(decl)) - tan(radians(42.383)) * tan(decl)))))) - eq - (start + ride) AS margin FROM e)"""


@query("daylight_margins", f"WITH d AS (SELECT o_orderkey AS id, dayofyear(o_orderdate)::BIGINT AS doy, (1080 + o_orderkey % 420)::DOUBLE AS start, (o_custkey % 90)::DOUBLE AS ride FROM orders), {_SUN} SELECT id, round(margin, 3) AS margin, CASE WHEN margin < 0 THEN 'this ride ends after sunset — lights on, and try dark mode' WHEN margin < 30 THEN 'you''d arrive with ~' || floor(margin + 0.5)::BIGINT || ' min of light' END AS said FROM m")
def daylight_margins(spark, folder):
    o = grid.table(spark, folder, "orders")
    margin, said = details.daylight(F.dayofyear("o_orderdate").cast("bigint"), (F.lit(1080) + F.col("o_orderkey") % 420).cast("double"), (F.col("o_custkey") % 90).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), F.round(margin, 3).alias("margin"), said.alias("said"))


@query("usable_stats", "WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS km, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 = 0 END AS leaves, CASE WHEN o_orderkey % 17 > 0 THEN 'x' ELSE '' END AS name FROM orders) SELECT id, km IS NOT NULL AND NOT isnan(km) AND NOT isinf(km) AND leaves IS NOT NULL AND name <> '' AS usable FROM s")
def usable_stats(spark, folder):
    k = F.col("o_orderkey")
    odd = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, num(float("nan"))).when(k % 13 == 0, num(float("inf"))).otherwise(F.col("o_totalprice").cast("double"))
    s = grid.table(spark, folder, "orders").select(k.alias("id"), odd.alias("km"), F.when(k % 5 > 0, k % 2 == 0).alias("leaves"), F.when(k % 17 > 0, "x").otherwise("").alias("name"))
    return s.select("id", details.usable(["km"], ["leaves"], ["name"]).alias("usable"))


@query("city_projects", "SELECT o_custkey % 25 AS town_id, o_orderkey AS project FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) <= 40")
def city_projects(spark, folder):
    """The first 40 projects of each town in stored order: the cap is the feature."""
    rows = grid.table(spark, folder, "orders").select((F.col("o_custkey") % 25).alias("town_id"), F.col("o_orderkey").alias("project"))
    return details.first_in_order(rows, "town_id", "project", 40)


@query("sites_to_audit", f"WITH {_SITE}, b AS (SELECT id, CASE WHEN id % 3 = 0 AND cls IN ('separated', 'buffered', 'lane') THEN 'osm_only' ELSE cls END AS bucket FROM site) SELECT id, list_position(['osm_only', 'separated', 'buffered', 'lane', 'path'], bucket)::BIGINT AS rank FROM b ORDER BY rank, id LIMIT 200")
def sites_to_audit(spark, folder):
    """The first 200 sites to look at: the cap is the feature."""
    k = F.col("p_partkey")
    cls = F.element_at(F.array(*map(F.lit, ("separated", "lane", "path", "buffered"))), (k % 4 + 1).cast("int"))
    sites = grid.table(spark, folder, "part").select(k.alias("id"), cls.alias("cls"), F.when(k % 3 == 0, "osm").otherwise("record").alias("source"))
    return details.sites_to_audit(sites, 200).select("id", F.col("rank").cast("bigint").alias("rank"))


@query("flagged_sites", f"WITH {_SITE}, v AS (SELECT id, 'street ' || lpad((id % 37)::VARCHAR, 2, '0') AS name, CASE WHEN g0 IS NOT NULL AND g1 IS NOT NULL THEN CASE WHEN v < 0.18 OR w0 >= 0.45 OR w1 >= 0.45 THEN 'unclear' WHEN (cls <> 'path' AND abs(g1 - g0) >= 0.04) OR abs(w1 - w0) >= 0.22 THEN 'changed' WHEN cls <> 'path' AND g1 < 0.015 AND w1 < 0.015 THEN 'no_markings' ELSE 'ok' END WHEN g1 IS NULL THEN 'no_imagery' ELSE 'ok' END AS verdict FROM site) SELECT row_number() OVER (ORDER BY verdict <> 'changed', name, id) AS place, id, name, verdict FROM v WHERE verdict IN ('changed', 'no_markings')")
def flagged_sites(spark, folder):
    named = site_verdicts(spark, folder).withColumn("name", F.concat(F.lit("street "), F.lpad((F.col("id") % 37).cast("string"), 2, "0")))
    return details.flagged(named).select(F.col("place").cast("bigint").alias("place"), "id", "name", "verdict")


@query("snapshot_faults", "WITH s AS (SELECT CASE WHEN n_nationkey = 3 THEN 'meta' ELSE 'city' END AS kind, CASE n_nationkey WHEN 5 THEN '\"4\"' WHEN 6 THEN '4.9' WHEN 3 THEN '4' ELSE '5' END AS format FROM nation), v AS (SELECT min(n) FILTER (kind = 'meta') AS meta, min(n) FILTER (kind = 'city') AS city FROM (SELECT kind, CASE WHEN regexp_matches(format, '^-?[0-9]+$') THEN format::BIGINT ELSE 0 END AS n FROM s)) SELECT fault FROM (SELECT unnest([CASE WHEN city IS NULL THEN 'no city pages' END, CASE WHEN city < 4 THEN 'a city page is format ' || city END, CASE WHEN coalesce(meta, 0) < 4 THEN 'the snapshot is format ' || meta END, CASE WHEN meta <> city THEN 'the stamps differ' END]) AS fault FROM v) WHERE fault IS NOT NULL")
def snapshot_faults(spark, folder):
    k = F.col("n_nationkey")
    stamps = grid.table(spark, folder, "nation").select(F.when(k == 3, "meta").otherwise("city").alias("kind"), F.when(k == 5, '"4"').when(k == 6, "4.9").when(k == 3, "4").otherwise("5").alias("format"))
    return details.snapshot_faults(stamps, 4)


@query("freshness_manifest", "SELECT event_type AS name, floor(epoch(max(ts)))::BIGINT AS retrieved, arg_max(event_id, (ts, user_id, event_id)) AS n_features FROM events GROUP BY 1".replace("(ts, user_id, event_id)", "{'t': ts, 's': lpad(user_id::VARCHAR, 12, '0'), 'n': event_id}"))
def freshness_manifest(spark, folder):
    log = grid.table(spark, folder, "events").select(F.col("event_type").alias("name"), F.lpad(F.col("user_id").cast("string"), 12, "0").alias("source"), F.col("ts").alias("retrieved"), F.col("event_id").alias("n_features"))
    return details.freshness(log).select("name", F.unix_timestamp("retrieved").alias("retrieved"), "n_features")


@query("place_labels", "WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 90)::VARCHAR END AS house, CASE WHEN c_custkey % 3 < 2 AND c_custkey % 7 > 2 THEN 'Road ' || c_nationkey END AS road, CASE WHEN c_custkey % 11 = 0 THEN c_mktsegment END AS suburb FROM customer) SELECT id, coalesce(nullif(name, ''), nullif(concat_ws(' ', house, road), ''), suburb, 'Customer') AS label FROM p")
def place_labels(spark, folder):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    road = F.when((k % 3 < 2) & (k % 7 > 2), F.concat(F.lit("Road "), F.col("c_nationkey").cast("string")))
    label = text.place_label(F.when(k % 5 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 0, (k % 90).cast("string")), road, none, F.when(k % 11 == 0, F.col("c_mktsegment")), none, F.lit("Customer, of, all"))
    return grid.table(spark, folder, "customer").select(k.alias("id"), label.alias("label"))


@query("recategorised_reports", grid.sql(", a AS (SELECT event_id % 400 AS id, event_type AS category, ts, event_id FROM events), n AS (SELECT id, arg_max(category, {'t': ts, 'c': category}) AS said FROM a GROUP BY 1) SELECT crash_id AS id, coalesce(said, 'other') AS category FROM crash LEFT JOIN n ON n.id = crash_id"))
def recategorised_reports(spark, folder):
    answers = grid.table(spark, folder, "events").select((F.col("event_id") % 400).alias("id"), F.col("event_type").alias("category"), F.col("ts").alias("at"))
    return details.recategorised(grid.crashes(spark, folder).select(F.col("crash_id").alias("id"), F.lit("other").alias("category")), answers)


_CHORD = """l AS (SELECT p_partkey AS id, 98.0::DOUBLE AS a, 100.0::DOUBLE AS b, (p_partkey % 13 * 10 - 10)::DOUBLE AS x, (p_size % 13 * 10 - 10)::DOUBLE AS y FROM part),
f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x / a)) AS t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y / b)) AS s FROM l),
d AS (SELECT *, pow(t * a - x, 2) + pow(y, 2) AS d1, pow(a - x, 2) + pow(s * b - y, 2) AS d2 FROM f), w AS (SELECT *, CASE WHEN d1 < d2 OR (d1 = d2 AND t * a <= a + s * b) THEN t * a ELSE a + s * b END AS along FROM d),
e AS (SELECT *, greatest(0.0::DOUBLE, along - 6) AS m, least(a + b, along + 6) AS n FROM w)
SELECT id, round(((degrees(atan2(greatest(n - a, 0) - greatest(m - a, 0), least(n, a) - least(m, a))) % 180) + 180) % 180, 6) AS bearing FROM e"""


@query("chord_bearings", f"WITH {_CHORD}")
def chord_bearings(spark, folder):
    """Bearings about points beside lines that run east and then turn north."""
    at = lambda x, y: F.struct(num(x).alias("x"), num(y).alias("y"))
    line = F.array(at(0, 0), at(98, 0), at(98, 100))
    p = grid.table(spark, folder, "part")
    x, y = ((F.col(c) % 13 * 10 - 10).cast("double") for c in ("p_partkey", "p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.round(chord_bearing(line, x, y), 6).alias("bearing"))


@query("detours", grid.sql(f""", {_WEIGHED}, {_OD}, arc AS (SELECT u, v, min(weight) AS weight FROM w GROUP BY 1, 2), stop AS (SELECT poi_id, (poi_id * 17) % (SELECT count(*) FROM node) AS node FROM place WHERE kind = 'playground'),
find(trip, node, d) USING KEY (trip, node) AS (SELECT trip, source, 0.0::DOUBLE FROM od WHERE source <> target UNION SELECT s.trip, a.v, min(s.d + a.weight) FROM find s JOIN arc a ON a.u = s.node LEFT JOIN recurring.find r ON r.trip = s.trip AND r.node = a.v WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2)
SELECT trip AS rider, arg_min(poi_id, {{'d': d, 'p': poi_id}}) AS poi_id, round(min(d), 3) AS cost FROM find JOIN stop USING (node) GROUP BY 1""", recursive=True))
def detours(spark, folder):
    """The playground that each rider gets to most cheaply from where they are."""
    n = grid.table(spark, folder, "part").count()
    places = grid.places(spark, folder).where("kind = 'playground'").select("poi_id", (F.col("poi_id") * 17 % n).alias("node"))
    riders = _trips(spark, folder).select(F.col("trip").alias("rider"), F.col("source").alias("node"))
    return details.detours(arcs(spark, folder), riders, places, tiles_of(spark, folder), together=TOGETHER).select("rider", "poi_id", F.round("cost", 3).alias("cost"))


#: The cheapest path of each trip now and with every moderate street protected, read back node by node: of equally cheap ways the
#: node before is the least.
_CHANGED = grid.sql(f""", {_WEIGHED}, {_OD}, one AS (SELECT 'now' AS mode, u, v, k, length, cls, weight, false AS built FROM w UNION ALL SELECT 'built', u, v, k, length, cls, CASE WHEN cls = 'moderate_street' THEN length ELSE length * stress_mult * crash_factor + xpen END, cls = 'moderate_street' FROM w),
arc AS MATERIALIZED (SELECT mode, u, v, min(weight) AS weight, arg_min({{'m': length, 'c': cls, 'b': built}}, {{'w': weight, 'k': k}}) AS x FROM one GROUP BY 1, 2, 3),
find(mode, trip, node, d) USING KEY (mode, trip, node) AS (SELECT mode, trip, source, 0.0::DOUBLE FROM od, (VALUES ('now'), ('built')) m(mode) WHERE source <> target UNION SELECT s.mode, s.trip, a.v, min(s.d + a.weight) FROM find s JOIN arc a ON a.mode = s.mode AND a.u = s.node LEFT JOIN recurring.find r ON r.mode = s.mode AND r.trip = s.trip AND r.node = a.v WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2, 3),
before AS MATERIALIZED (SELECT s.mode, s.trip, a.v, min(a.u) AS u FROM find s JOIN arc a ON a.mode = s.mode AND a.u = s.node JOIN find t ON t.mode = s.mode AND t.trip = s.trip AND t.node = a.v WHERE t.d > 0 AND s.d + a.weight = t.d GROUP BY 1, 2, 3),
back(mode, trip, u, v) AS (SELECT b.mode, b.trip, b.u, b.v FROM before b JOIN od ON od.trip = b.trip AND od.target = b.v UNION ALL SELECT b.mode, b.trip, b.u, b.v FROM back x JOIN before b ON b.mode = x.mode AND b.trip = x.trip AND b.v = x.u),
leg AS (SELECT back.mode, trip, x.m AS m, x.b AS b, x.b OR x.c IN ('path', 'separated', 'buffered') AS p FROM back JOIN arc USING (mode, u, v)),
per AS (SELECT trip, sum(m) FILTER (mode = 'now') AS nm, sum(m) FILTER (mode = 'built') AS bm, coalesce(sum(m) FILTER (mode = 'now' AND p), 0) AS np, coalesce(sum(m) FILTER (mode = 'built' AND p), 0) AS bp, count(*) FILTER (mode = 'built' AND b) AS n FROM leg GROUP BY 1)
SELECT trip, CASE WHEN abs((bm - nm) / 1000) >= 0.1 THEN round((bm - nm) / 1000, 1) ELSE 0 END AS km_change, (floor(bp * 100 / bm + 0.5) - floor(np * 100 / nm + 0.5))::BIGINT AS protected_change, n AS n_upgraded FROM per""", recursive=True)


@query("trip_whatif", _CHANGED)
def trip_whatif(spark, folder):
    """trip, km_change, protected_change, n_upgraded of each trip's safest route if all moderate streets were protected."""
    return details.trip_whatif(weighed(spark, folder), _trips(spark, folder), tiles_of(spark, folder), F.col("cls") == "moderate_street")


@query("heat_cell_rings", grid.sql(", c AS (SELECT DISTINCT round((lon + 71.2::DOUBLE) * 1000000)::BIGINT // 5000 AS col, round((lat - 42.3::DOUBLE) * 1000000)::BIGINT // 5000 AS row FROM node) SELECT col, row, format('[[[{:.6f},{:.6f}],[{:.6f},{:.6f}],[{:.6f},{:.6f}],[{:.6f},{:.6f}],[{:.6f},{:.6f}]]]', -71.2 + col * 0.005::DOUBLE, 42.3 + row * 0.005::DOUBLE, -71.2 + (col + 1) * 0.005::DOUBLE, 42.3 + row * 0.005::DOUBLE, -71.2 + (col + 1) * 0.005::DOUBLE, 42.3 + (row + 1) * 0.005::DOUBLE, -71.2 + col * 0.005::DOUBLE, 42.3 + (row + 1) * 0.005::DOUBLE, -71.2 + col * 0.005::DOUBLE, 42.3 + row * 0.005::DOUBLE) AS ring FROM c"))
def heat_cell_rings(spark, folder):
    """The outline of every cell with a node, as a polygon's coordinates."""
    at = grid.nodes(spark, folder).select(F.expr("cast(round((lon + 71.2D) * 1000000) as bigint) div 5000").alias("col"), F.expr("cast(round((lat - 42.3D) * 1000000) as bigint) div 5000").alias("row")).distinct()
    return at.select("col", "row", cell_ring(F.col("col"), F.col("row"), -71.2, 42.3, 0.005, 0.005).alias("ring"))


@query("image_worklist", grid.sql(""", mid AS (SELECT e.u, e.v, e.k, e.cls, e.name, (a.lon + b.lon) / 2 AS lon, (a.lat + b.lat) / 2 AS lat FROM edge e JOIN node a ON a.id = e.u JOIN node b ON b.id = e.v WHERE e.cls IN ('path', 'separated', 'buffered', 'lane')),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY floor(lon / 0.0012::DOUBLE), floor(lat / 0.0009::DOUBLE) ORDER BY u, v, k) AS rn FROM mid) WHERE rn = 1 ORDER BY u, v, k LIMIT 200),
shot AS (SELECT event_id AS photo, epoch_us(ts) AS captured, -71.2::DOUBLE + (event_id * 37 % 40) * 0.0012::DOUBLE + 0.0005 AS lon, 42.3::DOUBLE + (event_id * 91 % 50) * 0.0009::DOUBLE + 0.0002 AS lat FROM events)
SELECT k.u, k.v, k.k, round(k.lon, 6) AS lon, round(k.lat, 6) AS lat, cls, name, arg_max(photo, {'c': captured, 'p': -photo}) AS photo, max(captured) AS captured, format('lat={:.6f}&lng={:.6f}&z=17', k.lat, k.lon) AS viewer FROM kept k LEFT JOIN shot s ON abs(s.lon - k.lon) <= 0.0004 AND abs(s.lat - k.lat) <= 0.0004 GROUP BY ALL"""))
def image_worklist(spark, folder):
    """Places to look at and the newest photo of each."""
    at = grid.nodes(spark, folder).select("id", "lon", "lat")
    e = grid.edges(spark, folder).join(at.select(F.col("id").alias("u"), F.col("lon").alias("alon"), F.col("lat").alias("alat")), "u").join(at.select(F.col("id").alias("v"), F.col("lon").alias("blon"), F.col("lat").alias("blat")), "v")
    streets = e.select("u", "v", "k", "cls", "name", ((F.col("alon") + F.col("blon")) / 2).alias("lon"), ((F.col("alat") + F.col("blat")) / 2).alias("lat"))
    n = F.col("event_id")
    photos = grid.table(spark, folder, "events").select(n.alias("photo"), F.unix_micros(F.col("ts").cast("timestamp")).alias("captured"), (num(-71.2) + (n * 37 % 40) * num(0.0012) + num(0.0005)).alias("lon"), (num(42.3) + (n * 91 % 50) * num(0.0009) + num(0.0002)).alias("lat"))
    return details.image_worklist(streets, photos)


@query("listed_projects", "WITH p AS (SELECT p_partkey AS cid, (p_size * 7 % 23)::DOUBLE / 23 AS score FROM part) SELECT row_number() OVER (ORDER BY score DESC, cid) AS place, cid, score FROM p ORDER BY score DESC, cid LIMIT 20")
def listed_projects(spark, folder):
    rows = grid.table(spark, folder, "part").select(F.col("p_partkey").alias("cid"), ((F.col("p_size") * 7 % 23).cast("double") / 23).alias("score"))
    return details.listed_projects(rows).select("place", "cid", "score")
