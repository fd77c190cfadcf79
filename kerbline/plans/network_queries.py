"""Queries of classification, weights, overlays' outcome, heat cells and tiles on the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import cell, num
from kerbline.operators import cells, weights
from kerbline.plans import grid
from kerbline.plans.registry import query

_KIDS = "CASE WHEN road_busy AND e.cls = 'lane' THEN 10.0::DOUBLE WHEN road_busy AND e.cls = 'buffered' THEN 6.0::DOUBLE ELSE m.kids END"
_SOLO = "CASE WHEN road_busy AND e.cls = 'lane' THEN 2.5::DOUBLE WHEN road_busy AND e.cls = 'buffered' THEN 1.8::DOUBLE ELSE m.solo END"
#: Crash counts here: events of type error whose number falls on the street's start node; exact in any engine.
_COUNTS = "cc AS (SELECT u, v, k, count(*) AS n FROM edge JOIN crash ON crash_id % (SELECT count(*) FROM node) = u GROUP BY 1, 2, 3)"
_WEIGHED = f"""{_COUNTS},
busy AS (SELECT DISTINCT unnest([u, v]) AS id FROM edge WHERE road_busy),
pen AS (SELECT n.id, n.elev, CASE WHEN b.id IS NULL THEN 0.0::DOUBLE WHEN coalesce(highway, crossing) = 'traffic_signals' THEN 30.0 ELSE 250.0 END AS penalty FROM node n LEFT JOIN busy b ON b.id = n.id),
w0 AS (SELECT e.*, coalesce(cc.n, 0) AS crash_count, least(1 + 0.6::DOUBLE * coalesce(cc.n, 0) / (greatest(e.length, 20) / 100), 2.5::DOUBLE) AS crash_factor, {_KIDS} AS stress_mult, {_SOLO} AS solo_mult,
  CASE WHEN road_busy THEN 0.0::DOUBLE ELSE (pu.penalty + pv.penalty) / 2 END AS pen, greatest(0.0::DOUBLE, pv.elev - pu.elev) AS climb, pu.elev AS elev_u, pv.elev AS elev_v
  FROM edge e JOIN mult m ON m.cls = e.cls LEFT JOIN cc ON cc.u = e.u AND cc.v = e.v AND cc.k = e.k JOIN pen pu ON pu.id = e.u JOIN pen pv ON pv.id = e.v),
w AS (SELECT *, pen AS xpen, length * stress_mult * crash_factor + pen AS weight, length * solo_mult * crash_factor + pen * 0.3::DOUBLE AS weight_solo FROM w0)"""


def crash_counts(spark, folder: str) -> DataFrame:
    """u, v, k, crash_count: crashes booked to the streets that leave a node."""
    n = grid.table(spark, folder, "part").count()
    booked = grid.crashes(spark, folder).groupBy((F.col("crash_id") % n).alias("u")).agg(F.count("*").alias("crash_count"))
    return grid.edges(spark, folder).select("u", "v", "k").join(booked, "u")


def weighed(spark, folder: str) -> DataFrame:
    return weights.weigh(grid.edges(spark, folder), grid.nodes(spark, folder), crash_counts(spark, folder))


@query("class_distribution", grid.sql(" SELECT cls, sum(length) AS metres, count(*) AS n_edges FROM edge GROUP BY cls"))
def class_distribution(spark, folder):
    return grid.edges(spark, folder).groupBy("cls").agg(F.sum("length").alias("metres"), F.count("*").alias("n_edges"))


@query("edge_weights_kids", grid.sql(f", {_WEIGHED} SELECT u, v, k, crash_count, round(crash_factor, 3) AS crash_factor, stress_mult, xpen, climb, round(weight, 3) AS weight FROM w"))
def edge_weights_kids(spark, folder):
    return weighed(spark, folder).select("u", "v", "k", "crash_count", F.round("crash_factor", 3).alias("crash_factor"), "stress_mult", "xpen", "climb", F.round("weight", 3).alias("weight"))


@query("edge_weights_solo", grid.sql(f", {_WEIGHED} SELECT u, v, k, round(weight_solo, 3) AS weight_solo FROM w"))
def edge_weights_solo(spark, folder):
    return weighed(spark, folder).select("u", "v", "k", F.round("weight_solo", 3).alias("weight_solo"))


_PROFILES = "profile(profile, lane, buffered, scale) AS (VALUES ('young_kids', 10.0::DOUBLE, 6.0::DOUBLE, 1.0::DOUBLE), ('older_kids', 5.0, 3.0, 0.6), ('solo', 2.5, 1.8, 0.3))"
_PROFILE_MULT = "CASE WHEN road_busy AND w.cls = 'lane' THEN p.lane WHEN road_busy AND w.cls = 'buffered' THEN p.buffered WHEN profile = 'young_kids' THEN m.kids WHEN profile = 'older_kids' THEN m.older ELSE m.solo END"


@query("profile_weights", grid.sql(f", {_WEIGHED}, {_PROFILES} SELECT profile, w.cls, count(*) AS n, round(sum(length * {_PROFILE_MULT} * crash_factor + xpen * scale), 2) AS cost FROM w JOIN mult m ON m.cls = w.cls CROSS JOIN profile p GROUP BY 1, 2"))
def profile_weights(spark, folder):
    w = weighed(spark, folder)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), weights.profile_weight(p).alias("cost")) for p in dims.PROFILES)))
    return w.select("cls", each.alias("p")).groupBy("p.profile", "cls").agg(F.count("*").alias("n"), F.round(F.sum("p.cost"), 2).alias("cost"))


_HILL = "climb * 12 * CASE WHEN climb / length > 0.04 THEN 2 ELSE 1 END"


@query("flat_weights", grid.sql(f", {_WEIGHED} SELECT u, v, k, round(length * stress_mult * crash_factor + xpen + {_HILL}, 3) AS cost FROM w"))
def flat_weights(spark, folder):
    return weighed(spark, folder).select("u", "v", "k", F.round(weights.profile_weight("young_kids", prefer_flat=True), 3).alias("cost"))


@query("avoid_weights", grid.sql(f", {_WEIGHED} SELECT u, v, k, round((length * CASE WHEN cls IN ('lane', 'sharrow') THEN greatest(stress_mult, 30) ELSE stress_mult END * crash_factor + xpen) * CASE WHEN u % 7 = 0 THEN 5 ELSE 1 END * CASE WHEN v % 11 = 0 THEN 4 ELSE 1 END, 3) AS cost FROM w"))
def avoid_weights(spark, folder):
    cost = weights.profile_weight("young_kids", avoid=("lane", "sharrow"), sketchy=F.col("u") % 7 == 0, construction=F.col("v") % 11 == 0)
    return weighed(spark, folder).select("u", "v", "k", F.round(cost, 3).alias("cost"))


@query("whatif_weights", grid.sql(f", {_WEIGHED} SELECT u, v, k, CASE WHEN cls = 'busy_street' THEN 'separated' ELSE cls END AS shown_cls, round(CASE WHEN cls = 'busy_street' THEN length ELSE length * stress_mult * crash_factor + xpen END, 3) AS cost FROM w"))
def whatif_weights(spark, folder):
    built = F.col("cls") == "busy_street"
    return weighed(spark, folder).select("u", "v", "k", F.when(built, "separated").otherwise(F.col("cls")).alias("shown_cls"), F.round(weights.profile_weight("young_kids", upgraded=built), 3).alias("cost"))


@query("walk_weights", grid.sql(" SELECT u, v, k, round(length * 2.4, 3) AS cost FROM edge"))
def walk_weights(spark, folder):
    return grid.edges(spark, folder).select("u", "v", "k", F.round(F.col("length") * dims.WALK_FACTOR, 3).alias("cost"))


#: Tags made from the classes: lists, empty strings and nulls included.
_TAGS = """tags AS (SELECT u, v, CASE cls WHEN 'path' THEN ['cycleway', 'path'] WHEN 'busy_street' THEN ['primary', 'tertiary'] WHEN 'moderate_street' THEN ['tertiary'] WHEN 'service' THEN ['service'] WHEN 'sharrow' THEN ['residential', ''] ELSE ['residential'] END AS highway,
  CASE WHEN h = 2 THEN ['track'] WHEN h = 3 THEN ['buffered_lane', 'lane'] WHEN h IN (10, 11) THEN ['lane', ''] WHEN h = 12 THEN ['share_busway'] WHEN h = 17 THEN [NULL, 'lane'] END AS cycleway, CASE u % 4 WHEN 0 THEN ['35 mph'] WHEN 1 THEN ['', 'walk', '25'] WHEN 2 THEN ['signals'] END AS maxspeed FROM edge)"""


def tags(spark, folder: str) -> DataFrame:
    lists = lambda *w: F.array(*(F.lit(x).cast("string") for x in w))
    cls, h, u = F.col("cls"), F.col("h"), F.col("u") % 4
    highway = F.when(cls == "path", lists("cycleway", "path")).when(cls == "busy_street", lists("primary", "tertiary")).when(cls == "moderate_street", lists("tertiary")).when(cls == "service", lists("service")).when(cls == "sharrow", lists("residential", "")).otherwise(lists("residential"))
    cycleway = F.when(h == 2, lists("track")).when(h == 3, lists("buffered_lane", "lane")).when(h.isin(10, 11), lists("lane", "")).when(h == 12, lists("share_busway")).when(h == 17, lists(None, "lane"))
    speed = F.when(u == 0, lists("35 mph")).when(u == 1, lists("", "walk", "25")).when(u == 2, lists("signals"))
    return grid.edges(spark, folder).select("u", "v", highway.alias("highway"), cycleway.alias("cycleway"), speed.alias("maxspeed"))


_SPEED = "list_filter(list_transform(list_filter(coalesce(maxspeed, []), lambda t: t IS NOT NULL AND t <> ''), lambda t: try_cast(string_split(trim(t), ' ')[1] AS DOUBLE)), lambda x: x IS NOT NULL)[1]"


@query("classify_tags", grid.sql(f""", {_TAGS}, p AS (SELECT u, v, list_filter(highway, lambda t: t IS NOT NULL AND t <> '') AS r, list_filter(coalesce(cycleway, []), lambda t: t IS NOT NULL AND t <> '') AS c, {_SPEED} AS s FROM tags)
SELECT u, v, CASE WHEN len(r) > 0 AND list_has_all(['cycleway', 'path', 'footway', 'pedestrian', 'track', 'bridleway', 'steps'], r) THEN 'path' WHEN list_has_any(c, ['track', 'separate', 'separated']) THEN 'separated' WHEN list_contains(c, 'buffered_lane') THEN 'buffered' WHEN list_contains(c, 'lane') THEN 'lane'
  WHEN list_has_any(c, ['shared_lane', 'share_busway']) THEN 'sharrow' WHEN list_contains(r, 'primary') THEN 'busy_street' WHEN list_contains(r, 'tertiary') THEN 'moderate_street' WHEN list_contains(r, 'service') THEN 'service' WHEN s > 30 THEN 'moderate_street' ELSE 'quiet_street' END AS cls, list_contains(r, 'primary') AS road_busy FROM p"""))
def classify_tags(spark, folder):
    cls, busy = weights.classify(F.col("highway"), F.col("cycleway"), F.col("maxspeed"))
    return tags(spark, folder).select("u", "v", cls.alias("cls"), busy.alias("road_busy"))


@query("maxspeed_parse", grid.sql(f", {_TAGS} SELECT u, v, {_SPEED} AS mph FROM tags"))
def maxspeed_parse(spark, folder):
    return tags(spark, folder).select("u", "v", weights.max_speed(F.col("maxspeed")).alias("mph"))


@query("safer_fold", grid.sql(" SELECT e.u, e.v, CASE WHEN u % 5 = 0 THEN NULL WHEN m.kids <= x.kids THEN e.cls ELSE x.cls END IS NULL AS kept_null, CASE WHEN u % 5 = 0 THEN x.cls WHEN m.kids <= x.kids THEN e.cls ELSE x.cls END AS cls FROM edge e JOIN mult m ON m.cls = e.cls JOIN mult x ON x.cls = (['path', 'buffered', 'lane', 'service', 'sharrow'])[v % 5 + 1]"))
def safer_fold(spark, folder):
    overlay = F.element_at(F.array(*map(F.lit, ("path", "buffered", "lane", "service", "sharrow"))), (F.col("v") % 5 + 1).cast("int"))
    base = F.when(F.col("u") % 5 != 0, F.col("cls"))
    return grid.edges(spark, folder).select("u", "v", base.isNull().alias("kept_null"), weights.safer(base, overlay).alias("cls"))


@query("lts_escalation", grid.sql(" SELECT u, v, CASE WHEN u % 5 >= 3 AND cls = 'quiet_street' THEN 'moderate_street' WHEN u % 5 >= 3 AND cls = 'moderate_street' THEN 'busy_street' ELSE cls END AS cls FROM edge WHERE u % 5 BETWEEN 1 AND 4"))
def lts_escalation(spark, folder):
    rated = grid.edges(spark, folder).withColumn("lts", (F.col("u") % 5).cast("int")).where(F.col("lts").isin(1, 2, 3, 4))
    return rated.select("u", "v", weights.escalated(F.col("cls"), F.col("lts")).alias("cls"))


@query("overrides", grid.sql(" SELECT u, v, CASE WHEN u % 13 = 0 THEN 'quiet_street' ELSE cls END AS cls, CASE WHEN u % 13 = 0 THEN 'override' ELSE 'base' END AS cls_source FROM edge"))
def overrides(spark, folder):
    e = grid.edges(spark, folder)
    manual = e.where("u % 13 = 0").select("u", "v", "k", F.lit("quiet_street").alias("manual"))
    return e.join(manual, ["u", "v", "k"], "left").select("u", "v", F.coalesce("manual", "cls").alias("cls"), F.when(F.col("manual").isNull(), "base").otherwise("override").alias("cls_source"))


@query("crash_factor", grid.sql(f", {_WEIGHED} SELECT u, v, crash_count, round(crash_factor, 3) AS crash_factor FROM w"))
def crash_factor(spark, folder):
    return weighed(spark, folder).select("u", "v", "crash_count", F.round("crash_factor", 3).alias("crash_factor"))


@query("corridor_bump", grid.sql(f", {_WEIGHED} SELECT u, v, round(CASE WHEN v % 9 = 0 THEN least(crash_factor * 1.5, 3.75) ELSE crash_factor END, 3) AS crash_factor FROM w"))
def corridor_bump(spark, folder):
    return weighed(spark, folder).select("u", "v", F.round(weights.crash_factor(F.col("crash_count"), F.col("length"), F.col("v") % 9 == 0), 3).alias("crash_factor"))


@query("node_penalty", grid.sql(f", {_WEIGHED} SELECT id, penalty FROM pen"))
def node_penalty(spark, folder):
    return weights.node_penalties(grid.edges(spark, folder), grid.nodes(spark, folder))


@query("climb", grid.sql(f", {_WEIGHED} SELECT u, v, round(elev_u, 1) AS elev, climb FROM w"))
def climb(spark, folder):
    elev = grid.nodes(spark, folder).select(F.col("id").alias("u"), F.bround("elev", 1).alias("elev"))
    return weighed(spark, folder).select("u", "v", "climb").join(elev, "u").select("u", "v", "elev", "climb")


@query("gateways", grid.sql(" SELECT n.id, n.lon, n.lat FROM node n WHERE highway = 'traffic_signals' AND id IN (SELECT unnest([u, v]) FROM edge WHERE road_busy)"))
def gateways(spark, folder):
    busy = grid.edges(spark, folder).where("road_busy").select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return grid.nodes(spark, folder).where("highway = 'traffic_signals'").join(busy, "id", "left_semi").select("id", "lon", "lat")


@query("street_key", grid.sql(" SELECT coalesce(name, '') AS name, cls, count(*) AS n FROM edge GROUP BY 1, 2"))
def street_key(spark, folder):
    names = F.when(F.col("name").isNotNull(), F.array("name", F.lit("other")))
    return grid.edges(spark, folder).select(F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("name"), "cls").groupBy("name", "cls").agg(F.count("*").alias("n"))


@query("anti_join_footpaths", grid.sql(", bike AS (SELECT u, v, k, cls, 'bike' AS origin FROM edge WHERE u % 3 <> 0), foot AS (SELECT u, v, k, cls, 'foot' AS origin FROM edge WHERE u % 2 = 0) SELECT * FROM bike UNION ALL SELECT f.* FROM foot f ANTI JOIN bike b ON b.u = f.u AND b.v = f.v AND b.k = f.k"))
def anti_join_footpaths(spark, folder):
    e = grid.edges(spark, folder).select("u", "v", "k", "cls")
    bike, foot = e.where("u % 3 <> 0").withColumn("origin", F.lit("bike")), e.where("u % 2 = 0").withColumn("origin", F.lit("foot"))
    return bike.unionByName(foot.join(bike.select("u", "v", "k"), ["u", "v", "k"], "left_anti"))


@query("union_crash_years", grid.sql(" SELECT year, count(*) AS n FROM crash WHERE year BETWEEN 2021 AND 2026 GROUP BY year"))
def union_crash_years(spark, folder):
    c = grid.crashes(spark, folder)
    parts = [c.where(F.col("year") == y) for y in range(2021, 2027)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("year").agg(F.count("*").alias("n"))


_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v), round(length, 1) ORDER BY u, v, k) AS rn FROM edge) WHERE rn = 1)"


def once(edges: DataFrame) -> DataFrame:
    """One row for each undirected street of one length, the first by (u, v, k)."""
    w = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), F.round("length", 1)).orderBy("u", "v", "k")
    return edges.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@query("undirected_dedupe", grid.sql(f", {_ONCE} SELECT u, v, k, cls, length FROM once"))
def undirected_dedupe(spark, folder):
    return once(grid.edges(spark, folder)).select("u", "v", "k", "cls", "length")


_SAMPLES = f"""{_ONCE}, ends AS (SELECT o.*, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM once o JOIN node a ON a.id = o.u JOIN node b ON b.id = o.v),
sized AS (SELECT *, greatest(1, round_even(length / 35, 0)::INT) AS n FROM ends),
samples AS (SELECT s.*, length / n AS m, alon + (blon - alon) * ((i + 0.5::DOUBLE) / n) AS lon, alat + (blat - alat) * ((i + 0.5::DOUBLE) / n) AS lat FROM sized s, unnest(range(n)) AS r(i)),
celled AS (SELECT *, floor((lon + 71.2001::DOUBLE) / 0.0012::DOUBLE)::BIGINT AS col, floor((lat - 42.2999::DOUBLE) / 0.0009::DOUBLE)::BIGINT AS row FROM samples)"""


def sampled(spark, folder: str) -> DataFrame:
    at = grid.nodes(spark, folder).select("id", "lon", "lat")
    e = once(grid.edges(spark, folder)).join(at.select(F.col("id").alias("u"), F.col("lon").alias("alon"), F.col("lat").alias("alat")), "u").join(at.select(F.col("id").alias("v"), F.col("lon").alias("blon"), F.col("lat").alias("blat")), "v")
    return cells.sample_lines(e).withColumn("col", cell(F.col("lon"), -71.2001, dims.HEAT_LON)).withColumn("row", cell(F.col("lat"), 42.2999, dims.HEAT_LAT))


@query("heat_cells", grid.sql(f", {_SAMPLES} SELECT col, row, round(sum(m), 3) AS metres, round(sum(m * {_KIDS}) / sum(m), 3) AS stress, CASE WHEN sum(m * {_KIDS}) / sum(m) <= 2 THEN 'low' WHEN sum(m * {_KIDS}) / sum(m) <= 5 THEN 'medium' ELSE 'high' END AS band FROM celled e JOIN mult m ON m.cls = e.cls GROUP BY 1, 2 HAVING sum(m) >= 30".replace("sum(m)", "sum(e.m)").replace("sum(m *", "sum(e.m *")))
def heat_cells(spark, folder):
    return cells.stress_heat(sampled(spark, folder).withColumn("stress", weights.stress_mult(F.col("cls"), F.col("road_busy"))))


@query("lane_cells", grid.sql(f", {_SAMPLES} SELECT col, row, round(sum(m), 3) AS facility_m, round(coalesce(sum(m) FILTER (cls IN ('path', 'separated')), 0), 3) AS protected_m, CASE WHEN coalesce(sum(m) FILTER (cls IN ('path', 'separated')), 0) >= 0.5 * sum(m) THEN 'protected' WHEN coalesce(sum(m) FILTER (cls IN ('path', 'separated')), 0) > 0 THEN 'mixed' ELSE 'painted' END AS band FROM celled WHERE cls IN ('path', 'separated', 'buffered', 'lane') GROUP BY 1, 2 HAVING sum(m) >= 20"))
def lane_cells(spark, folder):
    return cells.lane_heat(sampled(spark, folder))


@query("elevation_bands", grid.sql(", cells AS (SELECT cx // 2 AS col, cy // 2 AS row, max(elev) AS top, avg(elev) AS mean FROM node GROUP BY 1, 2) SELECT col, row, round(mean, 3) AS mean_m, CASE WHEN mean < 5 THEN 0 WHEN mean < 15 THEN 1 WHEN mean < 25 THEN 2 WHEN mean < 35 THEN 3 WHEN mean < 45 THEN 4 ELSE 5 END AS band FROM cells"))
def elevation_bands(spark, folder):
    return cells.elevation_bands(grid.nodes(spark, folder).select(F.floor(F.col("cx") / 2).alias("col"), F.floor(F.col("cy") / 2).alias("row"), "elev"))


_TILES = """tiled AS (SELECT e.*, floor(((a.lon + b.lon) / 2 + 73.6::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_col, floor(((a.lat + b.lat) / 2 - 41.1::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_row FROM edge e JOIN node a ON a.id = e.u JOIN node b ON b.id = e.v)"""


def tiled(spark, folder: str) -> DataFrame:
    return cells.assign_tiles(grid.edges(spark, folder), grid.nodes(spark, folder))


@query("tile_assignment", grid.sql(f", {_TILES} SELECT u, v, k, tile_col, tile_row FROM tiled"))
def tile_assignment(spark, folder):
    return tiled(spark, folder).select("u", "v", "k", "tile_col", "tile_row")


@query("tile_manifest", grid.sql(f", {_TILES} SELECT tile_col || '_' || tile_row AS tile, count(*) AS n_edges, count(DISTINCT coalesce(name, '')) AS n_names FROM tiled GROUP BY 1"))
def tile_manifest(spark, folder):
    return tiled(spark, folder).groupBy(F.concat_ws("_", "tile_col", "tile_row").alias("tile")).agg(F.count("*").alias("n_edges"), F.countDistinct(F.coalesce("name", F.lit(""))).alias("n_names"))


@query("tile_local_ids", grid.sql(f", {_TILES}, ends AS (SELECT DISTINCT tile_col, tile_row, unnest([u, v]) AS gid FROM tiled) SELECT tile_col, tile_row, gid, dense_rank() OVER (PARTITION BY tile_col, tile_row ORDER BY gid) - 1 AS local_id FROM ends"))
def tile_local_ids(spark, folder):
    return cells.local_ids(tiled(spark, folder)).select("tile_col", "tile_row", "gid", "local_id")


@query("bbox_tiles", grid.sql(f", {_TILES}, boxed AS (SELECT DISTINCT tile_col, tile_row FROM tiled) SELECT tile_col, tile_row FROM boxed WHERE tile_col BETWEEN floor((-71.19::DOUBLE + 73.6) / 0.02)::BIGINT - 1 AND floor((-71.17::DOUBLE + 73.6) / 0.02)::BIGINT + 1 AND tile_row BETWEEN floor((42.31::DOUBLE - 41.1) / 0.02)::BIGINT - 1 AND floor((42.32::DOUBLE - 41.1) / 0.02)::BIGINT + 1"))
def bbox_tiles(spark, folder):
    return cells.tiles_in_box(tiled(spark, folder).select("tile_col", "tile_row").distinct(), -71.19, 42.31, -71.17, 42.32, margin=1)


@query("corridor_tiles", grid.sql(f", {_TILES}, line AS (SELECT -71.199::DOUBLE + i * 0.001::DOUBLE AS lon, 42.301::DOUBLE + i * 0.0008::DOUBLE AS lat FROM unnest(range(45)) r(i)), keys AS (SELECT DISTINCT floor((lon + 73.6) / 0.02)::BIGINT + dx AS tile_col, floor((lat - 41.1) / 0.02)::BIGINT + dy AS tile_row FROM line, unnest([-1, 0, 1]) a(dx), unnest([-1, 0, 1]) b(dy)) SELECT tile_col, tile_row, count(*) AS n_edges FROM tiled SEMI JOIN keys USING (tile_col, tile_row) GROUP BY 1, 2"))
def corridor_tiles(spark, folder):
    i = F.col("id").cast("double")
    line = spark.range(45).select((num(-71.199) + i * 0.001).alias("lon"), (num(42.301) + i * 0.0008).alias("lat"))
    keys = cells.corridor_keys(line, margin=1)
    return tiled(spark, folder).join(F.broadcast(keys), ["tile_col", "tile_row"], "left_semi").groupBy("tile_col", "tile_row").agg(F.count("*").alias("n_edges"))  # at most 45 x 9 keys


@query("tile_merge", grid.sql(f", {_TILES}, ends AS (SELECT DISTINCT unnest([u, v]) AS gid FROM tiled WHERE tile_col % 2 = 0 OR tile_row % 2 = 0) SELECT count(*) AS n_nodes, sum(gid)::BIGINT AS id_sum FROM ends"))
def tile_merge(spark, folder):
    t = cells.local_ids(tiled(spark, folder))
    return t.where("tile_col % 2 = 0").unionByName(t.where("tile_row % 2 = 0")).dropDuplicates(["gid"]).agg(F.count("*").alias("n_nodes"), F.sum("gid").alias("id_sum"))


@query("basemap_tile_keys", grid.sql(", pts AS (SELECT lon, lat, z FROM node, unnest([13, 14, 15, 16]) r(z) WHERE cy = 0) SELECT DISTINCT z::INT AS zoom, floor((lon + 180) / 360 * pow(2, z))::BIGINT AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z))::BIGINT AS y FROM pts"))
def basemap_tile_keys(spark, folder):
    return cells.basemap_keys(grid.nodes(spark, folder).where("cy = 0").select("lon", "lat"))


@query("compact_graph", grid.sql(f", {_ONCE} SELECT u, v, dense_rank() OVER (ORDER BY coalesce(name, '')) - 1 AS name_id, dense_rank() OVER (ORDER BY cls) - 1 AS class_id, round(length, 1) AS length FROM once"))
def compact_graph(spark, folder):
    return cells.dictionary_encoded(once(grid.edges(spark, folder)))
