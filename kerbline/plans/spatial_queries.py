"""Queries of the spatial joins on the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions import geo
from kerbline.functions.geo import num
from kerbline.operators import spatial, weights
from kerbline.plans import grid
from kerbline.plans.registry import query


def _d2(px, py, ax="ax", ay="ay", bx="bx", by="by_") -> str:
    t = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2))"


@query("crash_within_radius", grid.sql(f" SELECT e.u, e.v, e.k, count(*) AS crash_count FROM pedge e JOIN crash c ON c.x BETWEEN least(ax, bx) - 25 AND greatest(ax, bx) + 25 AND c.y BETWEEN least(ay, by_) - 25 AND greatest(ay, by_) + 25 AND {_d2('c.x', 'c.y')} <= 625 GROUP BY 1, 2, 3"))
def crash_within_radius(spark, folder):
    return spatial.count_near(grid.crashes(spark, folder), grid.placed_edges(spark, folder))


@query("corridor_match", grid.sql(f" SELECT DISTINCT e.u, e.v, e.k FROM pedge e JOIN facility f ON code = 'SLM' AND {_d2('(e.ax + e.bx) / 2', '(e.ay + e.by_) / 2', 'f.ax', 'f.ay', 'f.bx', 'f.by_')} <= 225"))
def corridor_match(spark, folder):
    mid = grid.placed_edges(spark, folder).select("u", "v", "k", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    lines = grid.facility_lines(spark, folder).where("code = 'SLM'").select("ax", "ay", "bx", "by")
    return spatial.points_near_segments(mid, lines, dims.CORRIDOR_RADIUS_M).select("u", "v", "k").distinct()


def facilities(spark, folder: str) -> DataFrame:
    """Facility lines with the class that their code stands for."""
    codes = dims.crosswalk_dim(spark).where("source = 'boston'").select(F.col("facility").alias("code"), "cls")
    return grid.facility_lines(spark, folder).join(F.broadcast(codes), "code")  # a fixed dimension table


_FACILITY = "fc AS (SELECT *, CASE code WHEN 'SBL' THEN 'separated' WHEN 'BFBL' THEN 'buffered' WHEN 'BL' THEN 'lane' WHEN 'SLM' THEN 'sharrow' ELSE 'path' END AS fcls FROM facility)"
_MATCH = f"""{_FACILITY}, near AS (SELECT e.u, e.v, e.k, e.cls, f.facility_id, fcls, {_d2('(e.ax + e.bx) / 2', '(e.ay + e.by_) / 2', 'f.ax', 'f.ay', 'f.bx', 'f.by_')} AS d2 FROM pedge e JOIN fc f ON (abs(e.ax - e.bx) > 1) = (abs(f.ax - f.bx) > 1)
  AND (e.ax + e.bx) / 2 BETWEEN least(f.ax, f.bx) - 18 AND greatest(f.ax, f.bx) + 18 AND (e.ay + e.by_) / 2 BETWEEN least(f.ay, f.by_) - 18 AND greatest(f.ay, f.by_) + 18 WHERE fcls <> 'path' OR e.cls = 'path'),
best AS (SELECT u, v, k, cls, fcls, facility_id FROM (SELECT *, row_number() OVER (PARTITION BY u, v, k ORDER BY d2, facility_id) AS rn FROM near WHERE d2 <= 324) WHERE rn = 1)"""


def matched(spark, folder: str) -> DataFrame:
    e = grid.placed_edges(spark, folder).withColumn("is_pathlike", F.col("cls") == "path")
    return spatial.match_overlay(e, facilities(spark, folder))


@query("overlay_match", grid.sql(f", {_MATCH} SELECT u, v, k, fcls AS cls, facility_id FROM best"))
def overlay_match(spark, folder):
    return matched(spark, folder)


#: Facilities that run east and then turn north, as long as two streets each way.
_BENT = """bent AS (SELECT s_suppkey AS facility_id, (['separated', 'buffered', 'lane', 'sharrow', 'path'])[s_nationkey % 5 + 1] AS fcls, ((s_suppkey * 131 % 36) * 98 + s_suppkey % 25)::DOUBLE AS x0, ((s_suppkey * 57 % 46) * 100 + s_suppkey % 23)::DOUBLE AS y0, 190.0::DOUBLE AS a, 195.0::DOUBLE AS b FROM supplier),
pair AS (SELECT e.u, e.v, e.k, e.cls, e.ax = e.bx AS upright, f.*, (e.ax + e.bx) / 2 - x0 AS px, (e.ay + e.by_) / 2 - y0 AS py FROM pedge e JOIN bent f ON (e.ax + e.bx) / 2 BETWEEN x0 - 18 AND x0 + a + 18 AND (e.ay + e.by_) / 2 BETWEEN y0 - 18 AND y0 + b + 18 WHERE fcls <> 'path' OR e.cls = 'path'),
foot AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, px / a)) AS t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, py / b)) AS s FROM pair),
far AS (SELECT *, pow(t * a - px, 2) + pow(py, 2) AS d1, pow(a - px, 2) + pow(s * b - py, 2) AS d2 FROM foot), place AS (SELECT *, least(d1, d2) AS d, CASE WHEN d1 < d2 OR (d1 = d2 AND t * a <= a + s * b) THEN t * a ELSE a + s * b END AS along FROM far),
chord AS (SELECT *, greatest(0.0::DOUBLE, along - 6) AS m, least(a + b, along + 6) AS n FROM place WHERE least(d1, d2) <= 324),
turned AS (SELECT *, ((degrees(atan2(greatest(n - a, 0) - greatest(m - a, 0), least(n, a) - least(m, a))) % 180) + 180) % 180 AS bearing FROM chord),
fit AS (SELECT * FROM turned WHERE least(abs(bearing - CASE WHEN upright THEN 90 ELSE 0 END) % 180, 180 - abs(bearing - CASE WHEN upright THEN 90 ELSE 0 END) % 180) <= 30)"""


@query("overlay_match_bent", grid.sql(f", {_BENT.replace('place AS (', 'placed AS (').replace('FROM place WHERE', 'FROM placed WHERE')} SELECT u, v, k, fcls AS cls, facility_id FROM (SELECT *, row_number() OVER (PARTITION BY u, v, k ORDER BY d, facility_id) AS rn FROM fit) WHERE rn = 1"))
def overlay_match_bent(spark, folder):
    """Facilities that bend, matched to streets by the chords about their nearest points."""
    s = grid.table(spark, folder, "supplier")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    k = F.col("s_suppkey")
    x, y = (k * 131 % 36 * 98 + k % 25).cast("double"), (k * 57 % 46 * 100 + k % 23).cast("double")
    cls = F.element_at(F.array(*map(F.lit, ("separated", "buffered", "lane", "sharrow", "path"))), (F.col("s_nationkey") % 5 + 1).cast("int"))
    bent = s.select(k.alias("facility_id"), cls.alias("cls"), F.array(at(x, y), at(x + 190, y), at(x + 190, y + 195)).alias("line"))
    streets = grid.placed_edges(spark, folder).select("u", "v", "k", (F.col("cls") == "path").alias("is_pathlike"), F.array(at(F.col("ax"), F.col("ay")), at(F.col("bx"), F.col("by"))).alias("line"))
    return spatial.match_lines(streets, bent)


@query("overlay_fold", grid.sql(f", {_MATCH} SELECT e.u, e.v, e.k, CASE WHEN b.fcls IS NULL OR m.kids <= x.kids THEN e.cls ELSE b.fcls END AS cls, CASE WHEN b.fcls IS NULL OR m.kids <= x.kids THEN 'osm' ELSE 'boston' END AS cls_source FROM edge e JOIN mult m ON m.cls = e.cls LEFT JOIN best b ON b.u = e.u AND b.v = e.v AND b.k = e.k LEFT JOIN mult x ON x.cls = b.fcls"))
def overlay_fold(spark, folder):
    e = grid.edges(spark, folder).join(matched(spark, folder).withColumnRenamed("cls", "overlay"), ["u", "v", "k"], "left")
    folded = weights.safer(F.col("cls"), F.col("overlay"))
    return e.select("u", "v", "k", folded.alias("cls"), F.when(folded == F.col("cls"), "osm").otherwise("boston").alias("cls_source"))


@query("facility_crosswalk", grid.sql(f", {_FACILITY} SELECT fcls AS cls, count(*) AS n FROM fc GROUP BY 1"))
def facility_crosswalk(spark, folder):
    return facilities(spark, folder).groupBy("cls").agg(F.count("*").alias("n"))


def _ids(spark, folder: str) -> DataFrame:
    return grid.nodes(spark, folder).select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))


@query("nearest_node", grid.sql(" SELECT poi_id, near_id, round(sqrt(d2), 3) AS distance_m FROM (SELECT poi_id, n.id AS near_id, pow(p.x - n.x, 2) + pow(p.y - n.y, 2) AS d2, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - n.x, 2) + pow(p.y - n.y, 2), n.id) AS rn FROM place p JOIN node n ON abs(p.x - n.x) <= 500 AND abs(p.y - n.y) <= 500) WHERE rn = 1 AND d2 <= 250000"))
def nearest_node(spark, folder):
    found = spatial.nearest(grid.places(spark, folder), _ids(spark, folder), "poi_id", dims.SNAP_NODE_M)
    return found.select("poi_id", "near_id", F.round(F.sqrt("d2"), 3).alias("distance_m"))


@query("nearest_edge", grid.sql(" SELECT poi_id, u, v FROM (SELECT poi_id, u, v, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - (ax + bx) / 2, 2) + pow(p.y - (ay + by_) / 2, 2), u, v) AS rn, pow(p.x - (ax + bx) / 2, 2) + pow(p.y - (ay + by_) / 2, 2) AS d2 FROM place p JOIN pedge e ON abs(p.x - (ax + bx) / 2) <= 40 AND abs(p.y - (ay + by_) / 2) <= 40) WHERE rn = 1 AND d2 <= 1600"))
def nearest_edge(spark, folder):
    e = grid.placed_edges(spark, folder)
    mid = e.select(F.struct("u", "v").alias("id"), ((F.col("ax") + F.col("bx")) / 2).alias("tx"), ((F.col("ay") + F.col("by")) / 2).alias("ty"))
    found = spatial.nearest(grid.places(spark, folder), mid, "poi_id", dims.SNAP_CONSTRUCTION_M, size=100.0)
    return found.select("poi_id", "near_id.u", "near_id.v")


@query("points_to_edge_set", grid.sql(", hit AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - (ax + bx) / 2, 2) + pow(p.y - (ay + by_) / 2, 2), u, v) AS rn, pow(p.x - (ax + bx) / 2, 2) + pow(p.y - (ay + by_) / 2, 2) AS d2 FROM place p JOIN pedge e ON abs(p.x - (ax + bx) / 2) <= 30 AND abs(p.y - (ay + by_) / 2) <= 30) WHERE rn = 1 AND d2 <= 900) SELECT DISTINCT e.u, e.v FROM edge e JOIN hit h ON (e.u = h.u AND e.v = h.v) OR (e.u = h.v AND e.v = h.u)"))
def points_to_edge_set(spark, folder):
    e = grid.placed_edges(spark, folder)
    mid = e.select(F.struct("u", "v").alias("id"), ((F.col("ax") + F.col("bx")) / 2).alias("tx"), ((F.col("ay") + F.col("by")) / 2).alias("ty"))
    hit = spatial.nearest(grid.places(spark, folder), mid, "poi_id", dims.SNAP_SKETCHY_M, size=100.0).select("near_id.u", "near_id.v")
    both = hit.union(hit.select("v", "u")).distinct()
    return e.select("u", "v").join(both, ["u", "v"], "left_semi").distinct()


@query("destination_nodes", grid.sql(" SELECT DISTINCT near_id AS id FROM (SELECT poi_id, n.id AS near_id, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - n.x, 2) + pow(p.y - n.y, 2), n.id) AS rn FROM place p, node n WHERE kind IN ('school', 'playground', 'library')) WHERE rn = 1"))
def destination_nodes(spark, folder):
    wanted = grid.places(spark, folder).where(F.col("kind").isin(*dims.DESTINATIONS))
    return spatial.nearest_anywhere(wanted, _ids(spark, folder), "poi_id", 200.0).select(F.col("near_id").alias("id")).distinct()


_IN_TOWN = "n.x >= x0 AND n.x < x0 + 800 AND n.y >= y0 AND n.y < y0 + 1000"
_IN_HOLE = "holed AND n.x >= x0 + 300 AND n.x < x0 + 500 AND n.y >= y0 + 300 AND n.y < y0 + 500"


@query("point_in_town", grid.sql(f" SELECT n.id, town FROM node n JOIN town ON {_IN_TOWN}"))
def point_in_town(spark, folder):
    return spatial.points_in_rings(grid.nodes(spark, folder).select("id", "x", "y"), grid.towns(spark, folder), even_odd=False).select("id", "town")


@query("points_in_holes", grid.sql(f" SELECT n.id, town FROM node n JOIN town ON {_IN_TOWN} AND NOT ({_IN_HOLE})"))
def points_in_holes(spark, folder):
    return spatial.points_in_rings(grid.nodes(spark, folder).select("id", "x", "y"), grid.towns(spark, folder), even_odd=True).select("id", "town")


@query("street_town_by_midpoint", grid.sql(f", mid AS (SELECT u, v, k, (ax + bx) / 2 AS x, (ay + by_) / 2 AS y FROM pedge WHERE u < v) SELECT n.u, n.v, n.k, town FROM mid n JOIN town ON {_IN_TOWN} AND NOT ({_IN_HOLE})"))
def street_town_by_midpoint(spark, folder):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    mid = grid.placed_edges(spark, folder).where("u < v").withColumn("m", geo.length_midpoint(F.array(point("ax", "ay"), point("bx", "by"))))
    return spatial.points_in_rings(mid.select("u", "v", "k", F.col("m.x").alias("x"), F.col("m.y").alias("y")), grid.towns(spark, folder), even_odd=True).select("u", "v", "k", "town")


@query("town_membership", grid.sql(f""", probe AS (SELECT u, v, 0 AS p, ax AS x, ay AS y FROM pedge WHERE u < v UNION ALL SELECT u, v, 1, (ax + bx) / 2, (ay + by_) / 2 FROM pedge WHERE u < v UNION ALL SELECT u, v, 2, bx, by_ FROM pedge WHERE u < v),
hit AS (SELECT n.u, n.v, town, min(p * 1000 + town_id) AS o FROM probe n JOIN town ON {_IN_TOWN} GROUP BY 1, 2, 3) SELECT u, v, string_agg(town, ', ' ORDER BY o) AS towns FROM hit GROUP BY 1, 2"""))
def town_membership(spark, folder):
    e = grid.placed_edges(spark, folder).where("u < v").select(F.struct("u", "v").alias("line"), "ax", "ay", "bx", "by")
    probes = e.select("line", F.explode(F.array(*(F.struct(F.lit(i).alias("probe"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(((F.col("ax"), F.col("ay")), ((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2), (F.col("bx"), F.col("by"))))))).alias("p")).select("line", "p.*")
    return spatial.towns_of_lines(probes, grid.towns(spark, folder), "line").select("line.u", "line.v", "towns")


_POP = """inside AS (SELECT id, block_id, pop FROM node n JOIN block b ON n.x BETWEEN x0 AND x1 AND n.y BETWEEN y0 AND y1), shared AS (SELECT id, pop::DOUBLE / count(*) OVER (PARTITION BY block_id) AS pop FROM inside),
far AS (SELECT id, pop FROM (SELECT n.id, b.pop, row_number() OVER (PARTITION BY block_id ORDER BY pow((x0 + x1) / 2 - n.x, 2) + pow((y0 + y1) / 2 - n.y, 2), n.id) AS rn FROM block b ANTI JOIN inside i USING (block_id), node n) WHERE rn = 1),
people AS (SELECT id, sum(pop) AS pop FROM (SELECT * FROM shared UNION ALL SELECT * FROM far) GROUP BY id)"""


@query("node_population", grid.sql(f", {_POP} SELECT id, round(pop, 3) AS pop FROM people"))
def node_population(spark, folder):
    return spatial.share_population(grid.nodes(spark, folder), grid.blocks(spark, folder)).select("id", F.round("pop", 3).alias("pop"))


@query("population_proxy", grid.sql(" SELECT id, sum(m) AS pop FROM (SELECT unnest([u, v]) AS id, length / 2 AS m FROM half WHERE cls IN ('quiet_street', 'moderate_street')) GROUP BY id"))
def population_proxy(spark, folder):
    return spatial.proxy_population(grid.halves(spark, folder))


@query("state_plane", grid.sql(" SELECT id, round({}, 3) AS east, round({}, 3) AS north FROM node".format(*geo.state_plane_sql("lon", "lat"))))
def state_plane(spark, folder):
    east, north = geo.state_plane(F.col("lon"), F.col("lat"))
    return grid.nodes(spark, folder).select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


_DIST = "sqrt(pow((lon - -71.19::DOUBLE) * cos(radians({})) * 111320, 2) + pow((lat - 42.31::DOUBLE) * 110540, 2))"


@query("distances", grid.sql(f" SELECT id, round({_DIST.format('42.31::DOUBLE')}, 3) AS at_query, round({_DIST.format('lat')}, 3) AS at_start, round({_DIST.format('(lat + 42.31::DOUBLE) / 2')}, 3) AS at_mean FROM node"))
def distances(spark, folder):
    lon, lat, qlon, qlat = F.col("lon"), F.col("lat"), num(-71.19), num(42.31)
    return grid.nodes(spark, folder).select("id", F.round(geo.flat_distance(qlon, qlat, lon, lat, qlat), 3).alias("at_query"), F.round(geo.flat_distance(lon, lat, qlon, qlat, lat), 3).alias("at_start"), F.round(geo.mean_lat_distance(lon, lat, qlon, qlat), 3).alias("at_mean"))


@query("gap_alternatives", grid.sql(", g AS (SELECT name, cls, u % 7 AS i1, v % 7 AS i2, u, v FROM half) SELECT u, v, count(*) OVER (PARTITION BY coalesce(name, ''), cls, least(i1, i2), greatest(i1, i2)) AS group_size FROM g"))
def gap_alternatives(spark, folder):
    g = grid.halves(spark, folder).withColumns({"i1": F.col("u") % 7, "i2": F.col("v") % 7})
    w = Window.partitionBy(F.coalesce("name", F.lit("")), "cls", F.least("i1", "i2"), F.greatest("i1", "i2"))
    return g.select("u", "v", F.count("*").over(w).alias("group_size"))


@query("hazard_upsert", grid.sql(", rep AS (SELECT crash_id AS report_id, x, y FROM crash), mark AS (SELECT poi_id AS mark_id, poi_id % 7 AS ord, x AS mx, y AS my FROM place), hit AS (SELECT report_id, mark_id, row_number() OVER (PARTITION BY report_id ORDER BY ord, mark_id) AS rn FROM rep JOIN mark ON pow(x - mx, 2) + pow(y - my, 2) < 400) SELECT r.report_id, coalesce(mark_id, -r.report_id) AS mark_id, mark_id IS NOT NULL AS amended FROM rep r LEFT JOIN hit h ON h.report_id = r.report_id AND rn = 1"))
def hazard_upsert(spark, folder):
    reports = grid.crashes(spark, folder).select(F.col("crash_id").alias("report_id"), "x", "y")
    marks = grid.places(spark, folder).select(F.col("poi_id").alias("mark_id"), (F.col("poi_id") % 7).alias("ord"), F.col("x").alias("mx"), F.col("y").alias("my"))
    return spatial.amend_or_insert(reports, marks)


@query("near_duplicate_places", grid.sql(", r AS (SELECT id, lon + (id % 3) * 0.0003::DOUBLE AS lon, lat FROM node) SELECT a.id AS keep_id, b.id AS drop_id FROM r a JOIN r b ON a.id < b.id AND abs(a.lon - b.lon) < 0.0007 AND abs(a.lat - b.lat) < 0.0003"))
def near_duplicate_places(spark, folder):
    r = grid.nodes(spark, folder).select("id", (F.col("lon") + (F.col("id") % 3) * num(0.0003)).alias("lon"), "lat")
    return spatial.near_pairs(r, 0.0007, 0.0003)
