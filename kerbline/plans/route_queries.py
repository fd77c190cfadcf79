"""Queries on routes: what is told about given ones, and searches for options, walks and loops.

Given routes are staircases over the derived network, one for each supplier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import num
from kerbline.operators import cells, routes, trips
from kerbline.operators.weights import profile_weight
from kerbline.plans import grid
from kerbline.plans.graph_queries import TOGETHER, tiles_of
from kerbline.plans.lineage import cut, scratch
from kerbline.plans.network_queries import _WEIGHED, weighed
from kerbline.plans.registry import query
from kerbline.sources import tile_store

_LEG = f"""{_WEIGHED}, step AS (SELECT s_suppkey AS route_id, i AS seq, (s_suppkey * 7 % 30) + i - i // 3 AS cx, (s_suppkey % 5) + i // 3 AS cy FROM supplier, unnest(range(25)) r(i)),
stepn AS (SELECT route_id, seq, cy * 40 + cx AS node FROM step WHERE cx < 40),
leg AS (SELECT a.route_id, a.seq::BIGINT AS seq, w.u, w.v, w.k, w.length, w.cls, coalesce(w.name, '') AS name, w.crash_factor, w.xpen, w.climb, w.road_busy, w.stress_mult, w.cls = 'busy_street' AND a.route_id % 2 = 0 AS walk, w.elev_u AS e0, w.elev_v AS e1, nu.lon AS alon, nu.lat AS alat, nv.lon AS blon, nv.lat AS blat
  FROM stepn a JOIN stepn b ON b.route_id = a.route_id AND b.seq = a.seq + 1 JOIN w ON w.u = a.node AND w.v = b.node JOIN node nu ON nu.id = w.u JOIN node nv ON nv.id = w.v)"""


def legs(spark, folder: str) -> DataFrame:
    s = grid.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("route_id"), F.explode(F.expr("sequence(0L, 24L)")).alias("seq"))
    up = F.floor(F.col("seq") / 3)
    cx, cy = F.col("route_id") * 7 % 30 + F.col("seq") - up, F.col("route_id") % 5 + up
    steps = s.where(cx < grid.WIDTH).select("route_id", "seq", (cy * grid.WIDTH + cx).alias("u"))
    pairs = steps.join(steps.select("route_id", (F.col("seq") - 1).alias("seq"), F.col("u").alias("v")), ["route_id", "seq"])
    at = grid.nodes(spark, folder)
    a = at.select(F.col("id").alias("u"), F.col("elev").alias("e0"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    b = at.select(F.col("id").alias("v"), F.col("elev").alias("e1"), F.col("lon").alias("blon"), F.col("lat").alias("blat"))
    walk = (F.col("cls") == "busy_street") & (F.col("route_id") % 2 == 0)
    return pairs.join(weighed(spark, folder), ["u", "v"]).join(a, "u").join(b, "v").withColumns({"walk": walk, "name": F.coalesce("name", F.lit(""))})


_M = "floor({} + 0.5)::BIGINT"
#: One decimal; true ties (odd quarters) go up.
_ONE = "format('{{:.1f}}', {0} + CASE WHEN {0} * 4 = floor({0} * 4) AND floor({0} * 4)::BIGINT % 2 = 1 THEN 0.01::DOUBLE ELSE 0 END)"
_FMT = "CASE WHEN {0} < 1000 THEN floor({0} + 0.5)::BIGINT || ' m' ELSE " + _ONE.format("({0} / 1000)").replace("{:.1f}", "{{:.1f}}") + " || ' km' END"
_SUM = """s AS (SELECT route_id, sum(length) AS t, coalesce(sum(length) FILTER (walk), 0) AS w, sum(climb) AS c, coalesce(sum(length) FILTER (NOT walk AND cls IN ('path', 'separated', 'buffered')), 0) AS p, coalesce(sum(length) FILTER (NOT walk AND cls IN ('quiet_street', 'service')), 0) AS q FROM leg GROUP BY 1)"""


@query("route_summary", grid.sql(f", {_LEG}, {_SUM} SELECT route_id, floor(t + 0.5)::BIGINT AS meters, floor(((t - w) / 1000 / 8 + w / 1000 / 4) * 60 + 0.5)::BIGINT AS minutes, floor(w + 0.5)::BIGINT AS walk_m, floor(c + 0.5)::BIGINT AS climb_m, floor(100 * p / t + 0.5)::BIGINT AS pct_protected, floor(100 * q / t + 0.5)::BIGINT AS pct_quiet FROM s"))
def route_summary(spark, folder):
    return routes.summaries(legs(spark, folder))


@query("route_class_metres", grid.sql(f", {_LEG}, c AS (SELECT route_id, cls, sum(length) AS m, min(seq) AS f FROM leg WHERE NOT walk GROUP BY 1, 2) SELECT route_id, cls, floor(m + 0.5)::BIGINT AS meters, row_number() OVER (PARTITION BY route_id ORDER BY m DESC, f) AS place FROM c"))
def route_class_metres(spark, folder):
    return routes.metres_by_class(legs(spark, folder))


@query("route_grades", grid.sql(f""", {_LEG}, g AS (SELECT route_id, sum(length) AS t, sum(length * CASE WHEN walk THEN 1.3 ELSE stress_mult END * crash_factor + xpen) / sum(length) AS mean, coalesce(sum(length) FILTER (NOT walk AND cls IN ('sharrow', 'moderate_street', 'busy_street')), 0) AS s, coalesce(sum(length) FILTER (cls IN ('path', 'separated', 'buffered')), 0) AS p FROM leg GROUP BY 1)
SELECT route_id, CASE WHEN mean <= 1.6 THEN 'A' WHEN mean <= 2.4 THEN 'B' WHEN mean <= 4 THEN 'C' WHEN mean <= 8 THEN 'D' ELSE 'F' END AS grade, 'avg kid-stress ' || {_ONE.format('mean')} || '× per meter — ' || floor(100 * p / t + 0.5)::BIGINT || '% protected, ' || CASE WHEN s < 30 THEN 'no busy/moderate streets' ELSE ({_FMT.format('s')}) || ' on busy/moderate streets' END AS reason FROM g"""))
def route_grades(spark, folder):
    return routes.grades(legs(spark, folder))


_CAUTION = """c0 AS (SELECT *, CASE WHEN name = '' THEN 'unnamed' ELSE name END AS label FROM leg WHERE NOT walk AND cls IN ('sharrow', 'moderate_street', 'busy_street')),
c1 AS (SELECT *, CASE WHEN lag(label) OVER o = label AND lag(cls) OVER o = cls THEN 0 ELSE 1 END AS fresh FROM c0 WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM c1),
caution AS (SELECT route_id, min(seq) AS seq, min(label) AS name, min(cls) AS cls, sum(length) AS m, arg_min(alon, seq) AS lon, arg_min(alat, seq) AS lat FROM c2 GROUP BY route_id, run HAVING sum(length) >= 15)"""


@query("route_cautions", grid.sql(f", {_LEG}, {_CAUTION} SELECT route_id, seq, name, cls, floor(m + 0.5)::BIGINT AS meters, lon, lat FROM caution"))
def route_cautions(spark, folder):
    return routes.cautions(legs(spark, folder))


_SAFE = """p1 AS (SELECT *, cls IN ('path', 'separated') AS ok, CASE WHEN lag(cls IN ('path', 'separated'), 1, false) OVER (PARTITION BY route_id ORDER BY seq) <> (cls IN ('path', 'separated')) THEN 1 ELSE 0 END AS fresh FROM leg),
p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY seq) AS run FROM p1),
p3 AS (SELECT route_id, run, name, sum(length) AS m, min(seq) AS f FROM p2 WHERE ok GROUP BY 1, 2, 3),
saferun AS (SELECT route_id, min(f) AS seq, coalesce(arg_max(name, {'m': m, 'f': -f}) FILTER (name <> ''), 'off-street path') AS name, sum(m) AS meters FROM p3 GROUP BY route_id, run HAVING sum(m) >= 1)"""


@query("route_protected_runs", grid.sql(f", {_LEG}, {_SAFE} SELECT * FROM saferun"))
def route_protected_runs(spark, folder):
    return routes.protected_runs(legs(spark, folder))


@query("route_stress_figures", grid.sql(f", {_LEG} SELECT route_id, coalesce(sum(length) FILTER (NOT walk AND cls IN ('sharrow', 'moderate_street', 'busy_street')), 0) AS stress_m, coalesce(sum(length) FILTER (crash_factor >= 1.25), 0) AS hotspot_m FROM leg GROUP BY 1"))
def route_stress_figures(spark, folder):
    return routes.stress_figures(legs(spark, folder))


@query("route_ribbon", grid.sql(f", {_LEG} SELECT route_id, seq, cls, length AS m, e0, e1, NOT walk AND xpen > 100 AS crossing, walk, (sum(length) OVER (PARTITION BY route_id ORDER BY seq) - length) / sum(length) OVER (PARTITION BY route_id) AS x0, sum(length) OVER (PARTITION BY route_id ORDER BY seq) / sum(length) OVER (PARTITION BY route_id) AS x1 FROM leg"))
def route_ribbon(spark, folder):
    return routes.ribbon(legs(spark, folder))


@query("route_cues", grid.sql(f""", {_LEG}, q AS (SELECT *, CASE WHEN name = '' THEN '(unnamed path)' ELSE name END AS label, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM leg),
q2 AS (SELECT *, coalesce(lag(label) OVER o = label AND lag(walk) OVER o = walk, false) AS same FROM q WINDOW o AS (PARTITION BY route_id ORDER BY seq))
SELECT route_id, seq, floor(done / 100 + 0.5) / 10 AS km, CASE WHEN walk THEN '🚶 walk the bike — ' || label ELSE label || ' — ' || replace(cls, '_', ' ') END AS text FROM q2 WHERE NOT same
UNION ALL SELECT route_id, max(seq) + 1, floor(sum(length) / 100 + 0.5) / 10, 'arrive' FROM leg GROUP BY 1"""))
def route_cues(spark, folder):
    return routes.cues(legs(spark, folder))


_TURN = """t0 AS (SELECT *, sqrt(pow((blon - alon) * cos(radians((alat + blat) / 2)) * 111320, 2) + pow((blat - alat) * 110540, 2)) AS gm, degrees(atan2((blon - alon) * cos(radians((alat + blat) / 2)) * 111320, (blat - alat) * 110540)) AS brg FROM leg),
t1 AS (SELECT *, coalesce(sum(gm) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_m, lag(brg) OVER o AS was, lag(name) OVER o AS before FROM t0 WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
t2 AS (SELECT *, CASE WHEN brg - was > 180 THEN brg - was - 360 WHEN brg - was <= -180 THEN brg - was + 360 ELSE brg - was END AS d, CASE WHEN name <> '' THEN name WHEN cls = 'path' THEN 'the bike path' WHEN cls = 'separated' THEN 'the separated lane' WHEN cls IN ('buffered', 'lane') THEN 'the bike lane' WHEN cls = 'service' THEN 'the service road' ELSE 'the side street' END AS target FROM t1 WHERE was IS NOT NULL),
turn AS (SELECT route_id, seq, at_m, target AS text, CASE WHEN abs(d) < 25 THEN 'continue' WHEN abs(d) < 60 THEN 'slight ' ELSE CASE WHEN abs(d) < 135 THEN 'turn ' ELSE 'sharp ' END END || CASE WHEN abs(d) < 25 THEN '' WHEN d < 0 THEN 'left' ELSE 'right' END || ' onto ' || target AS voice FROM t2 WHERE abs(d) >= 25 OR (name <> '' AND name <> before)
  UNION ALL SELECT route_id, max(seq) + 1, sum(gm), 'destination', 'you have arrived' FROM t0 GROUP BY 1)"""


@query("route_turns", grid.sql(f", {_LEG}, {_TURN} SELECT route_id, seq, round(at_m, 3) AS at_m, text, voice FROM turn"))
def route_turns(spark, folder):
    return routes.turns(legs(spark, folder)).withColumn("at_m", F.round("at_m", 3))


_FOLD = f"""{_LEG}, {_TURN}, nth AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS k FROM turn),
kept(route_id, k, place, at_m, text, voice) AS (SELECT route_id, k, 0, at_m, text, voice FROM nth WHERE k = 1 UNION ALL
  SELECT route_id, k, CASE WHEN joins THEN place ELSE place + 1 END, CASE WHEN joins THEN was_m ELSE at_m END, text, CASE WHEN joins THEN was || ', then ' || voice ELSE voice END
  FROM (SELECT n.*, m.place, m.at_m AS was_m, m.voice AS was, n.at_m - m.at_m < 15 AND n.text <> 'destination' AND NOT contains(m.voice, ', then ') AS joins FROM kept m JOIN nth n ON n.route_id = m.route_id AND n.k = m.k + 1))"""


@query("route_maneuvers", grid.sql(f", {_FOLD} SELECT route_id, place, round(at_m, 3) AS at_m, text, voice FROM kept QUALIFY row_number() OVER (PARTITION BY route_id, place ORDER BY k DESC) = 1", recursive=True))
def route_maneuvers(spark, folder):
    return routes.maneuvers(legs(spark, folder)).withColumn("at_m", F.round("at_m", 3))


_ALERT = f"""{_LEG}, r0 AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here_m, lag(cls) OVER o AS was, lag(walk) OVER o AS walked, max(seq) OVER (PARTITION BY route_id) AS last FROM leg WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
r1 AS (SELECT *, sum(CASE WHEN was = cls THEN 0 ELSE 1 END) OVER o AS run, sum(CASE WHEN coalesce(walked, false) = walk THEN 0 ELSE 1 END) OVER o AS foot, CASE cls WHEN 'sharrow' THEN 'a shared lane' WHEN 'moderate_street' THEN 'a moderate street' WHEN 'busy_street' THEN 'a busy street' END AS word FROM r0 WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
stretch AS (SELECT route_id, min(here_m) AS at_m, max(seq) + 0.5::DOUBLE AS ord, sum(length) AS m, any_value(word) AS word FROM r1 WHERE word IS NOT NULL GROUP BY route_id, run HAVING sum(length) >= 30),
walks AS (SELECT route_id, min(here_m) AS at_m, max(here_m + length) AS to_m, max(seq) AS ord, sum(length) AS m, any_value(last) AS last FROM r1 WHERE walk GROUP BY route_id, foot),
event AS (SELECT route_id, here_m AS at_m, seq::DOUBLE AS ord, 'busy street crossing. gather up.' AS voice FROM r1 WHERE NOT walk AND xpen > {dims.CROSSING_FLAG_M}
  UNION ALL SELECT route_id, at_m, ord, 'entering ' || word || ' for ' || floor(m / 10 + 0.5)::BIGINT * 10 || ' meters. ride carefully.' FROM stretch
  UNION ALL SELECT route_id, at_m, ord + 0.6::DOUBLE, 'hop off and walk the bike for about ' || floor(m / 10 + 0.5)::BIGINT * 10 || ' meters.' FROM walks
  UNION ALL SELECT route_id, to_m, ord + 0.7::DOUBLE, 'you can ride again.' FROM walks WHERE ord < last),
nth AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY at_m, ord, voice) AS k FROM event),
thin(route_id, k, place, kept_m, fresh) AS (SELECT route_id, k, 0, at_m, true FROM nth WHERE k = 1 UNION ALL
  SELECT n.route_id, n.k, CASE WHEN n.at_m - t.kept_m < 30 THEN t.place ELSE t.place + 1 END, CASE WHEN n.at_m - t.kept_m < 30 THEN t.kept_m ELSE n.at_m END, n.at_m - t.kept_m >= 30 FROM thin t JOIN nth n ON n.route_id = t.route_id AND n.k = t.k + 1)"""


@query("route_alerts", grid.sql(f", {_ALERT} SELECT route_id, place, at_m, voice FROM thin JOIN nth USING (route_id, k) WHERE fresh", recursive=True))
def route_alerts(spark, folder):
    return routes.alerts(legs(spark, folder))


_TRACK = """k0 AS (SELECT route_id, seq * 2 AS pos, alon AS lon, alat AS lat FROM leg UNION ALL SELECT route_id, seq * 2 + 1, blon, blat FROM leg),
k1 AS (SELECT *, coalesce(lag(lon) OVER o = lon AND lag(lat) OVER o = lat, false) AS again FROM k0 WINDOW o AS (PARTITION BY route_id ORDER BY pos)),
k2 AS (SELECT *, row_number() OVER o - 1 AS idx, coalesce(sqrt(pow((lon - lag(lon) OVER o) * cos(radians((lat + lag(lat) OVER o) / 2)) * 111320, 2) + pow((lat - lag(lat) OVER o) * 110540, 2)), 0) AS step FROM k1 WHERE NOT again WINDOW o AS (PARTITION BY route_id ORDER BY pos)),
track AS (SELECT route_id, idx, lon, lat, sum(step) OVER (PARTITION BY route_id ORDER BY idx) AS cum_m FROM k2)"""


@query("track_metres", grid.sql(f", {_LEG}, {_TRACK} SELECT route_id, idx, lon, lat, round(cum_m, 3) AS cum_m FROM track"))
def track_metres(spark, folder):
    return routes.track(legs(spark, folder)).withColumn("cum_m", F.round("cum_m", 3))


@query("track_bearing_ahead", grid.sql(f""", {_LEG}, {_TRACK}, far AS (SELECT a.route_id, a.idx, a.lon, a.lat, coalesce(min(b.idx) FILTER (b.cum_m - a.cum_m >= 60), max(b.idx)) AS j FROM track a JOIN track b ON b.route_id = a.route_id AND b.idx > a.idx GROUP BY 1, 2, 3, 4)
SELECT f.route_id, f.idx, round(((degrees(atan2((b.lon - f.lon) * cos(radians((f.lat + b.lat) / 2)) * 111320, (b.lat - f.lat) * 110540)) + 360) % 360), 3) AS bearing FROM far f JOIN track b ON b.route_id = f.route_id AND b.idx = f.j"""))
def track_bearing_ahead(spark, folder):
    return routes.bearing_ahead(routes.track(legs(spark, folder))).withColumn("bearing", F.round("bearing", 3))


@query("track_ridden", grid.sql(f""", {_LEG}, {_TRACK}, r AS (SELECT *, lag(cum_m) OVER o AS pm, lag(lon) OVER o AS plon, lag(lat) OVER o AS plat, 250.0 + route_id % 10 * 37 AS upto FROM track WINDOW o AS (PARTITION BY route_id ORDER BY idx))
SELECT route_id, idx, round(CASE WHEN cum_m < upto THEN lon ELSE plon + (upto - pm) / (cum_m - pm) * (lon - plon) END, 7) AS lon, round(CASE WHEN cum_m < upto THEN lat ELSE plat + (upto - pm) / (cum_m - pm) * (lat - plat) END, 7) AS lat FROM r WHERE cum_m < upto OR (pm < upto AND cum_m > pm)"""))
def track_ridden(spark, folder):
    out = routes.ridden(routes.track(legs(spark, folder)), num(250) + F.col("route_id") % 10 * 37)
    return out.select("route_id", "idx", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("gpx_points", grid.sql(f", {_LEG}, {_TRACK} SELECT route_id, count(*) AS n_points FROM track GROUP BY 1"))
def gpx_points(spark, folder):
    docs = routes.gpx(routes.track(legs(spark, folder)), F.concat(F.lit("route <"), F.col("route_id").cast("string"), F.lit(">")), "kerbline")
    return docs.select("route_id", (F.size(F.split("gpx", "<trkpt ")) - 1).cast("bigint").alias("n_points"))


@query("track_snap", grid.sql(f""", {_LEG}, {_TRACK}, sg AS (SELECT route_id, idx, lon AS alon, lat AS alat, lead(lon) OVER o AS blon, lead(lat) OVER o AS blat, cum_m FROM track WINDOW o AS (PARTITION BY route_id ORDER BY idx)),
fx AS (SELECT route_id, seq, (alon + blon) / 2 + (seq % 5) * 0.0001::DOUBLE AS lon, (alat + blat) / 2 + (seq % 3) * 0.0001::DOUBLE AS lat FROM leg),
v AS (SELECT f.route_id, f.seq, s.idx, s.cum_m, (f.lon - alon) * cos(radians(f.lat)) * 111320 AS ax, (f.lat - alat) * 110540 AS ay, (blon - alon) * cos(radians(f.lat)) * 111320 AS bx, (blat - alat) * 110540 AS b_y FROM fx f JOIN sg s ON s.route_id = f.route_id AND blon IS NOT NULL),
t AS (SELECT *, greatest(0, least(1, (ax * bx + ay * b_y) / (bx * bx + b_y * b_y))) AS t FROM v), d AS (SELECT *, sqrt(pow(ax - t * bx, 2) + pow(ay - t * b_y, 2)) AS off_m FROM t)
SELECT route_id, seq, round(off_m, 3) AS off_m, round(cum_m + t * sqrt(bx * bx + b_y * b_y), 2) AS along_m FROM (SELECT *, row_number() OVER (PARTITION BY route_id, seq ORDER BY off_m, idx) AS rn FROM d) WHERE rn = 1"""))
def track_snap(spark, folder):
    rows = legs(spark, folder)
    fixes = rows.select("route_id", "seq", ((F.col("alon") + F.col("blon")) / 2 + (F.col("seq") % 5) * num(0.0001)).alias("lon"), ((F.col("alat") + F.col("blat")) / 2 + (F.col("seq") % 3) * num(0.0001)).alias("lat"))
    return routes.snapped(fixes, routes.track(rows)).select("route_id", "seq", F.round("off_m", 3).alias("off_m"), F.round("along_m", 2).alias("along_m"))


@query("route_labels", grid.sql(f", {_LEG}, l AS (SELECT route_id, arg_min(name, seq) AS a, arg_max(name, seq) AS b FROM leg WHERE name <> '' GROUP BY 1) SELECT route_id, CASE WHEN a = b THEN a ELSE a || ' → ' || b END AS label FROM l"))
def route_labels(spark, folder):
    return routes.labels(legs(spark, folder))


# searches


def _trips(spark, folder: str) -> DataFrame:
    """trip, source, target: a pair of nodes for each nation."""
    n = grid.table(spark, folder, "part").count()
    key = F.col("n_nationkey").cast("bigint")
    return grid.table(spark, folder, "nation").select(key.alias("trip"), (key * 83 % n).alias("source"), ((key * 131 + 57) % n).alias("target")).where("source <> target")


_OD = "od AS (SELECT n_nationkey::BIGINT AS trip, (n_nationkey * 83) % (SELECT count(*) FROM node) AS source, (n_nationkey * 131 + 57) % (SELECT count(*) FROM node) AS target FROM nation)"
_ODARC = f"""{_WEIGHED}, {_OD}, arc AS (SELECT 'safest' AS option, u, v, min(weight) AS weight FROM w GROUP BY 2, 3 UNION ALL SELECT 'balanced', u, v, min(length * CASE WHEN road_busy AND cls = 'lane' THEN 5.0 WHEN road_busy AND cls = 'buffered' THEN 3.0 ELSE (SELECT older FROM mult WHERE mult.cls = w.cls) END * crash_factor + xpen * 0.6::DOUBLE) FROM w GROUP BY 2, 3 UNION ALL SELECT 'direct', u, v, min(length) FROM w GROUP BY 2, 3),
find(option, trip, node, d) USING KEY (option, trip, node) AS (SELECT option, trip, source, 0.0::DOUBLE FROM od, (VALUES ('safest'), ('balanced'), ('direct')) o(option) WHERE source <> target UNION SELECT s.option, s.trip, a.v, min(s.d + a.weight) FROM find s JOIN arc a ON a.option = s.option AND a.u = s.node LEFT JOIN recurring.find r ON r.option = s.option AND r.trip = s.trip AND r.node = a.v WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2, 3)"""


@query("route_option_costs", grid.sql(f", {_ODARC} SELECT trip, f.option, round(d, 3) AS cost FROM find f JOIN od USING (trip) WHERE f.node = od.target", recursive=True))
def route_option_costs(spark, folder):
    found = trips.option_costs(weighed(spark, folder), _trips(spark, folder), tiles_of(spark, folder), "young_kids")
    return found.select("trip", "option", F.round("cost", 3).alias("cost"))


#: Each option's path read back from its costs node by node (of equally cheap ways the least node before), then told as route_summary and route_grades tell it.
_TOLD = f"""{_ODARC}, one AS (SELECT 'safest' AS option, u, v, k, weight, length, cls, climb, crash_factor, xpen, stress_mult FROM w
  UNION ALL SELECT 'balanced', u, v, k, length * CASE WHEN road_busy AND cls = 'lane' THEN 5.0 WHEN road_busy AND cls = 'buffered' THEN 3.0 ELSE (SELECT older FROM mult WHERE mult.cls = w.cls) END * crash_factor + xpen * 0.6::DOUBLE, length, cls, climb, crash_factor, xpen, stress_mult FROM w
  UNION ALL SELECT 'direct', u, v, k, length, length, cls, climb, crash_factor, xpen, stress_mult FROM w),
street AS MATERIALIZED (SELECT option, u, v, arg_min({{'m': length, 'c': cls, 'up': climb, 'f': crash_factor, 'x': xpen, 's': stress_mult}}, {{'w': weight, 'k': k}}) AS x FROM one GROUP BY 1, 2, 3),
before AS MATERIALIZED (SELECT s.option, s.trip, a.v, min(a.u) AS u FROM find s JOIN arc a ON a.option = s.option AND a.u = s.node JOIN find t ON t.option = s.option AND t.trip = s.trip AND t.node = a.v WHERE t.d > 0 AND s.d + a.weight = t.d GROUP BY 1, 2, 3),
back(option, trip, u, v, n) AS (SELECT b.option, b.trip, b.u, b.v, 0 FROM before b JOIN od ON od.trip = b.trip AND od.target = b.v UNION ALL SELECT b.option, b.trip, b.u, b.v, x.n + 1 FROM back x JOIN before b ON b.option = x.option AND b.trip = x.trip AND b.v = x.u),
shape AS (SELECT option, trip, list(u ORDER BY n) AS path FROM back GROUP BY 1, 2), kept AS (SELECT option, trip FROM shape QUALIFY row_number() OVER (PARTITION BY trip, path ORDER BY list_position(['safest', 'balanced', 'direct'], option)) = 1),
figure AS (SELECT trip, option, sum(x.m) AS t, sum(x.up) AS c, coalesce(sum(x.m) FILTER (x.c IN ('path', 'separated', 'buffered')), 0) AS p, coalesce(sum(x.m) FILTER (x.c IN ('quiet_street', 'service')), 0) AS q, sum(x.m * x.s * x.f + x.x) / sum(x.m) AS mean FROM back JOIN kept USING (option, trip) JOIN street USING (option, u, v) GROUP BY 1, 2),
told AS (SELECT *, floor(t + 0.5)::BIGINT AS meters FROM figure)
SELECT trip, option, meters, floor(t / 1000 / 8 * 60 + 0.5)::BIGINT AS minutes, floor(c + 0.5)::BIGINT AS climb_m, floor(100 * p / t + 0.5)::BIGINT AS pct_protected, floor(100 * q / t + 0.5)::BIGINT AS pct_quiet,
  CASE WHEN mean <= 1.6 THEN 'A' WHEN mean <= 2.4 THEN 'B' WHEN mean <= 4 THEN 'C' WHEN mean <= 8 THEN 'D' ELSE 'F' END AS grade, floor((meters / min(meters) OVER (PARTITION BY trip) - 1) * 100 + 0.5)::BIGINT AS detour_pct FROM told"""


@query("route_options", grid.sql(f", {_TOLD}", recursive=True))
def route_options(spark, folder):
    """trip, option, meters, minutes, grade, detour_pct of options that differ."""
    found = trips.options(weighed(spark, folder), grid.nodes(spark, folder), _trips(spark, folder), tiles_of(spark, folder), "young_kids")
    return trips.described(found, "young_kids")


_WALK = f"""{_WEIGHED}, {_OD}, arc AS (SELECT u * 2 AS a, v * 2 AS b, min(weight) AS weight FROM w GROUP BY 1, 2 UNION ALL SELECT u * 2 + 1, v * 2 + 1, min(length) * 2.4::DOUBLE FROM w GROUP BY 1, 2 UNION ALL SELECT id * 2, id * 2 + 1, 90.0 FROM node UNION ALL SELECT id * 2 + 1, id * 2, 40.0 FROM node),
find(trip, node, d) USING KEY (trip, node) AS (SELECT trip, source * 2, 0.0::DOUBLE FROM od WHERE source <> target UNION SELECT s.trip, a.b, min(s.d + a.weight) FROM find s JOIN arc a ON a.a = s.node LEFT JOIN recurring.find r ON r.trip = s.trip AND r.node = a.b WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2)"""


@query("walk_path_costs", grid.sql(f", {_WALK} SELECT trip, round(min(CASE WHEN f.node % 2 = 0 THEN d ELSE d + 40 END), 3) AS cost FROM find f JOIN od USING (trip) WHERE f.node // 2 = od.target GROUP BY 1", recursive=True))
def walk_path_costs(spark, folder):
    arcs = weighed(spark, folder).select("u", "v", "k", F.col("weight").alias("ride"), "length")
    return trips.walk_costs(arcs, _trips(spark, folder), tiles_of(spark, folder), (dims.WALK_FACTOR,)).select("trip", F.round("cost", 3).alias("cost"))


#: Six prices of walking, each path read back; the first at which a trip walks at most 300 m, else riding alone.
_WITHIN = f"""{_WEIGHED}, {_OD}, price AS (SELECT 2.4::DOUBLE * pow(2, i) AS factor FROM range(6) r(i)), short AS MATERIALIZED (SELECT u, v, min(weight) AS ride, min(length) AS length FROM w GROUP BY 1, 2),
arc AS MATERIALIZED (SELECT factor, u * 2 AS a, v * 2 AS b, ride AS weight FROM short, price UNION ALL SELECT factor, u * 2 + 1, v * 2 + 1, length * factor FROM short, price UNION ALL SELECT factor, id * 2, id * 2 + 1, 90.0 FROM node, price UNION ALL SELECT factor, id * 2 + 1, id * 2, 40.0 FROM node, price),
find(factor, trip, node, d) USING KEY (factor, trip, node) AS (SELECT factor, trip, source * 2, 0.0::DOUBLE FROM od, price WHERE source <> target UNION SELECT s.factor, s.trip, a.b, min(s.d + a.weight) FROM find s JOIN arc a ON a.factor = s.factor AND a.a = s.node LEFT JOIN recurring.find r ON r.factor = s.factor AND r.trip = s.trip AND r.node = a.b WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2, 3),
ends AS (SELECT f.factor, f.trip, arg_min(node, {{'d': d + CASE WHEN node % 2 = 1 THEN 40 ELSE 0 END, 'n': node}}) AS node, min(d + CASE WHEN node % 2 = 1 THEN 40 ELSE 0 END) AS cost FROM find f JOIN od USING (trip) WHERE node // 2 = target GROUP BY 1, 2),
before AS MATERIALIZED (SELECT s.factor, s.trip, a.b, min(a.a) AS a FROM find s JOIN arc a ON a.factor = s.factor AND a.a = s.node JOIN find t ON t.factor = s.factor AND t.trip = s.trip AND t.node = a.b WHERE t.d > 0 AND s.d + a.weight = t.d GROUP BY 1, 2, 3),
back(factor, trip, a, b) AS (SELECT b.factor, b.trip, b.a, b.b FROM before b JOIN ends e ON e.factor = b.factor AND e.trip = b.trip AND e.node = b.b UNION ALL SELECT b.factor, b.trip, b.a, b.b FROM back x JOIN before b ON b.factor = x.factor AND b.trip = x.trip AND b.b = x.a),
walked AS (SELECT factor, trip, sum(length) AS m FROM back JOIN short ON u = a // 2 AND v = b // 2 WHERE a % 2 = 1 AND b % 2 = 1 GROUP BY 1, 2),
priced AS (SELECT e.trip, e.factor, coalesce(m, 0) AS m, cost FROM ends e LEFT JOIN walked USING (factor, trip)), good AS (SELECT * FROM priced WHERE m <= 300 QUALIFY row_number() OVER (PARTITION BY trip ORDER BY factor) = 1),
alone(trip, node, d) USING KEY (trip, node) AS (SELECT trip, source, 0.0::DOUBLE FROM od WHERE source <> target AND trip NOT IN (SELECT trip FROM good) UNION SELECT s.trip, a.v, min(s.d + a.ride) FROM alone s JOIN short a ON a.u = s.node LEFT JOIN recurring.alone r ON r.trip = s.trip AND r.node = a.v WHERE r.d IS NULL OR s.d + a.ride < r.d GROUP BY 1, 2)
SELECT trip, factor, round(m, 1) AS walked_m, round(cost, 3) AS cost FROM good UNION ALL SELECT trip, NULL, 0.0, round(d, 3) FROM alone JOIN od USING (trip) WHERE node = target AND trip IN (SELECT trip FROM priced)"""


@query("walk_within_budget", grid.sql(f", {_WITHIN}", recursive=True))
def walk_within_budget(spark, folder):
    """trip, factor, walked_m, cost: the first walking price at which a trip walks at most 300 m."""
    arcs = weighed(spark, folder).select("u", "v", "k", F.col("weight").alias("ride"), "length")
    return trips.walk_within(arcs, _trips(spark, folder), tiles_of(spark, folder), 300.0).select("trip", "factor", F.round("walked_m", 1).alias("walked_m"), F.round("cost", 3).alias("cost"))


@query("loop_stops", grid.sql(", home AS (SELECT n_nationkey::BIGINT AS trip, x, y FROM nation JOIN node ON id = (n_nationkey * 83) % (SELECT count(*) FROM node)), c AS (SELECT trip, poi_id, sqrt(pow(p.x - h.x, 2) + pow(p.y - h.y, 2)) AS beeline FROM home h, place p WHERE kind <> 'cafe') SELECT trip, poi_id, round(beeline, 3) AS beeline FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY abs(beeline - 1050), poi_id) AS rn FROM c WHERE beeline > 240 AND beeline < 1650) WHERE rn <= 12"))
def loop_stops(spark, folder):
    n = grid.table(spark, folder, "part").count()
    homes = grid.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("trip"), (F.col("n_nationkey").cast("bigint") * 83 % n).alias("id")).join(grid.nodes(spark, folder).select("id", "x", "y"), "id")
    stops = grid.places(spark, folder).where("kind <> 'cafe'").select("poi_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return trips.loop_stops(homes, stops, 3000.0).select("trip", "poi_id", F.round("beeline", 3).alias("beeline"))


@query("loop_routes")
def loop_routes(spark, folder):
    """trip, poi_id, total_m: a round trip of about 2 km with a stop, for a few starts."""
    n = grid.table(spark, folder, "part").count()
    homes = _trips(spark, folder).select("trip", F.col("source").alias("id")).join(grid.nodes(spark, folder).select("id", "x", "y"), "id")
    stops = grid.places(spark, folder).select("poi_id", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("poi_id") * 17 % n).alias("node"))
    return trips.loops(weighed(spark, folder), cut(homes), stops, tiles_of(spark, folder), 2000.0, together=TOGETHER)


@query("heading_bias", grid.sql(""", b AS (SELECT e.u, e.v, e.k, (degrees(atan2((nv.lon - nu.lon) * cos(radians((nu.lat + nv.lat) / 2)) * 111320, (nv.lat - nu.lat) * 110540)) + 360) % 360 AS brg, (e.u * 37) % 360 AS heading FROM edge e JOIN node nu ON nu.id = e.u JOIN node nv ON nv.id = e.v),
d AS (SELECT *, abs(brg - heading) % 360 AS x FROM b) SELECT u, v, k, 8.0 AS factor FROM d WHERE CASE WHEN x > 180 THEN 360 - x ELSE x END > 110"""))
def heading_bias(spark, folder):
    at = grid.nodes(spark, folder).select("id", "lon", "lat")
    e = grid.edges(spark, folder).join(at.select(F.col("id").alias("u"), F.col("lon").alias("alon"), F.col("lat").alias("alat")), "u").join(at.select(F.col("id").alias("v"), F.col("lon").alias("blon"), F.col("lat").alias("blat")), "v")
    return trips.heading_bias(e, (F.col("u") * 37 % 360).cast("double")).select("u", "v", "k", "factor")


@query("whatif_reach", grid.sql(f""", {_WEIGHED}, arc AS (SELECT 'now' AS mode, u, v, min(weight) AS weight FROM w GROUP BY 2, 3 UNION ALL SELECT 'built', u, v, min(CASE WHEN cls = 'moderate_street' THEN length ELSE length * stress_mult * crash_factor + xpen END) FROM w GROUP BY 2, 3),
hub AS (SELECT DISTINCT (n_nationkey * 83)::BIGINT % (SELECT count(*) FROM node) AS centre FROM nation),
find(mode, centre, node, d) USING KEY (mode, centre, node) AS (SELECT mode, centre, centre, 0.0::DOUBLE FROM hub, (VALUES ('now'), ('built')) m(mode) UNION SELECT s.mode, s.centre, a.v, min(s.d + a.weight) FROM find s JOIN arc a ON a.mode = s.mode AND a.u = s.node LEFT JOIN recurring.find r ON r.mode = s.mode AND r.centre = s.centre AND r.node = a.v WHERE (r.d IS NULL OR s.d + a.weight < r.d) AND s.d + a.weight <= 2500 GROUP BY 1, 2, 3),
ee AS (SELECT 'now' AS mode, u, v, length, weight FROM w UNION ALL SELECT 'built', u, v, length, CASE WHEN cls = 'moderate_street' THEN length ELSE length * stress_mult * crash_factor + xpen END FROM w),
km AS (SELECT mode, centre, sum(length) / 1000 AS km FROM find JOIN ee USING (mode) WHERE ee.u = find.node AND d + weight <= 2500 GROUP BY 1, 2),
pair AS (SELECT centre, max(km) FILTER (mode = 'now') AS a, max(km) FILTER (mode = 'built') AS b FROM km GROUP BY 1)
SELECT centre, round(a, 3) AS km_now, round(b, 3) AS km_built, round(b - coalesce(a, 0), 3) AS gained FROM pair WHERE b IS NOT NULL""", recursive=True))
def whatif_reach(spark, folder):
    """What every town's hub reaches within the budget, now and with moderate streets protected."""
    w = weighed(spark, folder)
    n = grid.table(spark, folder, "part").count()
    hubs = grid.table(spark, folder, "nation").select((F.col("n_nationkey").cast("bigint") * 83 % n).alias("node")).distinct()
    arcs = w.select(F.lit("now").alias("mode"), "u", "v", "k", "weight", "length").union(w.select(F.lit("built"), "u", "v", "k", profile_weight("young_kids", upgraded=F.col("cls") == "moderate_street"), "length"))
    km = trips.reach_km(cut(arcs), hubs, tiles_of(spark, folder), dims.ACCESS_BUDGET_M)
    each = km.groupBy(F.col("query").alias("centre")).agg(F.max(F.when(F.col("mode") == "now", F.col("km"))).alias("a"), F.max(F.when(F.col("mode") == "built", F.col("km"))).alias("b")).where("b IS NOT NULL")
    return each.select("centre", F.round("a", 3).alias("km_now"), F.round("b", 3).alias("km_built"), F.round(F.col("b") - F.coalesce("a", num(0)), 3).alias("gained"))


@query("tile_store_corridor", grid.sql(f""", {_OD}, key AS (SELECT floor((lon + 73.6::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_col, floor((lat - 41.1::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_row, trip % 2 = 0 AND id = source AS had FROM od JOIN node ON id IN (source, target) WHERE source <> target),
tiled AS (SELECT e.u, e.v, floor(((a.lon + b.lon) / 2 + 73.6::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_col, floor(((a.lat + b.lat) / 2 - 41.1::DOUBLE) / 0.02::DOUBLE)::BIGINT AS tile_row FROM edge e JOIN node a ON a.id = e.u JOIN node b ON b.id = e.v)
SELECT tile_col, tile_row, count(*) AS n_edges, sum(u)::BIGINT AS id_sum FROM tiled SEMI JOIN key USING (tile_col, tile_row) ANTI JOIN (SELECT * FROM key WHERE had) USING (tile_col, tile_row) GROUP BY 1, 2"""))
def tile_store_corridor(spark, folder):
    """What is read of a tile store for the ends of all trips, if the tiles where every second trip starts are loaded already."""
    at = scratch(spark, f"tiles-{uuid.uuid4().hex}")
    tile_store.write(cells.assign_tiles(grid.edges(spark, folder), grid.nodes(spark, folder)), at)
    nodes = grid.nodes(spark, folder).select("id", "lon", "lat")
    ends = _trips(spark, folder).select("trip", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("first")), F.struct(F.col("target").alias("id"), F.lit(False).alias("first")))).alias("e")).select("trip", "e.id", "e.first")
    points = ends.join(nodes, "id")
    loaded = cells.corridor_keys(points.where("first AND trip % 2 = 0").select("lon", "lat"), margin=0)
    new = tile_store.along(spark, at, points.select("lon", "lat"), margin=0, loaded=loaded)
    return new.groupBy(F.col("tile_col").cast("bigint").alias("tile_col"), F.col("tile_row").cast("bigint").alias("tile_row")).agg(F.count("*").alias("n_edges"), F.sum("u").alias("id_sum"))
