"""Queries of islands, candidate projects, severance, ranking, access and searches on the derived network."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import num
from kerbline.operators import projects, search, spatial
from kerbline.operators.components import components, largest_strong_component
from kerbline.operators.weights import profile_weight
from kerbline.plans import grid
from kerbline.plans.lineage import cut
from kerbline.plans.network_queries import _WEIGHED, weighed
from kerbline.plans.registry import query

#: Rows of the grid, 40 nodes wide, that a tile of a search holds at most: 250,000 nodes.
MOST_SIDE = 6250
#: A network of at most so many nodes is one tile, which a task settles at once.
ONE_TILE = 50_000
#: Nodes of neighbouring tiles that a task settles together, and those whose hops over an overlay it does (some ten hops a node).
TOGETHER, TOGETHER_HOPS = 150_000, 50_000

_CC = """cc_node AS (SELECT a AS id FROM safe UNION SELECT b FROM safe), ways AS (SELECT a, b FROM safe UNION ALL SELECT b, a FROM safe),
comp(id, island) USING KEY (id) AS (SELECT id, id FROM cc_node UNION SELECT e.b, min(c.island) FROM comp c JOIN ways e ON e.a = c.id JOIN recurring.comp r ON r.id = e.b WHERE c.island < r.island GROUP BY e.b),
island AS (SELECT island, sum(m) AS metres FROM safe JOIN comp ON comp.id = safe.a GROUP BY 1)"""


def _islands(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = cut(weighed(spark, folder))
    nodes_of, sizes = projects.islands(e)
    return e, cut(nodes_of), cut(sizes)


@query("islands", grid.sql(f", {_CC} SELECT id, island FROM comp", recursive=True))
def islands(spark, folder):
    return projects.islands(weighed(spark, folder))[0]


@query("island_sizes", grid.sql(f", {_CC} SELECT island, metres FROM island", recursive=True))
def island_sizes(spark, folder):
    return projects.islands(weighed(spark, folder))[1]


@query("island_summary", grid.sql(f", {_CC} SELECT count(*) AS n_islands, count(*) FILTER (metres >= 200) AS n_real, round(sum(metres), 1) AS metres, (SELECT string_agg(round(metres / 1000, 1)::VARCHAR, ',' ORDER BY metres DESC, island) FROM (SELECT * FROM island ORDER BY metres DESC, island LIMIT 5)) AS top_km FROM island", recursive=True))
def island_summary(spark, folder):
    sizes = cut(projects.islands(weighed(spark, folder))[1])
    top = sizes.orderBy(F.desc("metres"), "island").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("metres", (-F.col("island")).alias("i"))), False), lambda t: F.round(t["metres"] / 1000, 1).cast("string")), ",").alias("top_km"))
    return sizes.agg(F.count("*").alias("n_islands"), F.count_if(F.col("metres") >= dims.REAL_ISLAND_M).alias("n_real"), F.round(F.sum("metres"), 1).alias("metres")).join(top, F.lit(True))


_ONE_WAY = "arc AS (SELECT u AS a, v AS b FROM edge WHERE NOT (v = u + 40 AND u % 4 = 0) AND NOT (v = u - 40 AND v % 3 = 0 AND u % 40 < 30) AND u % 23 <> 0)"


@query("largest_scc", grid.sql(f""", {_ONE_WAY}, core AS (SELECT DISTINCT unnest([a, b]) AS id FROM arc),
fw(s, t) AS (SELECT id, id FROM core UNION SELECT f.s, a.b FROM fw f JOIN arc a ON a.a = f.t),
strong AS (SELECT x.s AS id, min(x.t) AS comp FROM fw x JOIN fw y ON x.s = y.t AND x.t = y.s GROUP BY 1)
SELECT id FROM strong WHERE comp = (SELECT comp FROM strong GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)""", recursive=True))
def largest_scc(spark, folder):
    e = grid.edges(spark, folder).where("NOT (v = u + 40 AND u % 4 = 0) AND NOT (v = u - 40 AND v % 3 = 0 AND u % 40 < 30) AND u % 23 <> 0")
    return largest_strong_component(e.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("id"))


_CAND = f"""{_WEIGHED}, bad AS (SELECT coalesce(name, '') AS street, cls, u, v, k, length, crash_count, crash_factor FROM w WHERE stress_mult > 2 AND u < v),
bnode AS (SELECT street, cls, u AS id FROM bad UNION SELECT street, cls, v FROM bad), bboth AS (SELECT street, cls, u AS a, v AS b FROM bad UNION ALL SELECT street, cls, v, u FROM bad),
run(street, cls, id, run) USING KEY (street, cls, id) AS (SELECT street, cls, id, id FROM bnode UNION SELECT e.street, e.cls, e.b, min(c.run) FROM run c JOIN bboth e ON e.street = c.street AND e.cls = c.cls AND e.a = c.id JOIN recurring.run r ON r.street = e.street AND r.cls = e.cls AND r.id = e.b WHERE c.run < r.run GROUP BY 1, 2, 3),
cand AS (SELECT street, bad.cls, run, sum(length) AS length_m, count(*) AS n_edges, sum(crash_count)::BIGINT AS crashes, sum(length * crash_factor) / sum(length) AS crash_pressure FROM bad JOIN run USING (street, cls) WHERE run.id = bad.u GROUP BY 1, 2, 3 HAVING sum(length) BETWEEN 5 AND 1500)"""

_SEV = f"""{_CC}, {_CAND}, cend AS (SELECT DISTINCT street, cls, run, unnest([u, v]) AS id FROM bad JOIN run USING (street, cls) WHERE run.id = bad.u),
touch AS (SELECT DISTINCT street, cls, run, island, metres FROM cend JOIN comp ON comp.id = cend.id JOIN island USING (island) WHERE metres >= 200),
ranked AS (SELECT *, row_number() OVER (PARTITION BY street, cls, run ORDER BY metres DESC, island) AS rn FROM touch),
two AS (SELECT street, cls, run, count(*) AS touched, max(metres) FILTER (rn = 2) AS join_m, max(island) FILTER (rn = 1) AS big, max(island) FILTER (rn = 2) AS small FROM ranked GROUP BY 1, 2, 3),
sev AS (SELECT c.*, coalesce(touched, 0) AS touched, coalesce(join_m, 0.0::DOUBLE) AS join_m, big, small, coalesce(join_m > 0 AND big = (SELECT island FROM island WHERE metres >= 200 ORDER BY metres DESC, island LIMIT 1), false) AS joins_region FROM cand c LEFT JOIN two t ON t.street = c.street AND t.cls = c.cls AND t.run = c.run),
sig AS (SELECT DISTINCT street, cls, run FROM cend JOIN node n ON n.id = cend.id WHERE highway = 'traffic_signals'),
kept AS (SELECT s.*, g.run IS NOT NULL AS signalised, CASE WHEN length_m <= 60 AND join_m > 0 AND g.run IS NULL THEN 'spot_fix' ELSE 'corridor' END AS kind FROM sev s LEFT JOIN sig g ON g.street = s.street AND g.cls = s.cls AND g.run = s.run WHERE length_m >= 25 OR join_m > 0)"""


def _candidates(spark, folder: str):
    e, nodes_of, sizes = _islands(spark, folder)
    rows, members = projects.candidates(e)
    return projects.severance(rows, members, nodes_of, sizes), members


@query("candidates", grid.sql(f", {_CAND} SELECT street, cls, run, length_m, n_edges, crashes, round(crash_pressure, 3) AS crash_pressure FROM cand", recursive=True))
def candidates(spark, folder):
    rows, _ = projects.candidates(weighed(spark, folder))
    return rows.select("street", "cls", "run", "length_m", "n_edges", "crashes", F.round("crash_pressure", 3).alias("crash_pressure"))


@query("severance", grid.sql(f", {_SEV} SELECT street, cls, run, length_m, touched, join_m, joins_region FROM sev", recursive=True))
def severance(spark, folder):
    return _candidates(spark, folder)[0].select("street", "cls", "run", "length_m", "touched", "join_m", "joins_region")


def _kept(spark, folder: str) -> DataFrame:
    return _classified(spark, folder, *_candidates(spark, folder))


def _classified(spark, folder: str, rows: DataFrame, members: DataFrame) -> DataFrame:
    ends = members.select("street", "cls", "run", F.explode(F.array("u", "v")).alias("id"))
    lights = grid.nodes(spark, folder).where("highway = 'traffic_signals'").select("id")
    return projects.classified(rows, ends.join(lights, "id", "left_semi").select("street", "cls", "run").distinct())


@query("spot_fixes", grid.sql(f", {_SEV} SELECT street, cls, run, length_m, kind, signalised FROM kept", recursive=True))
def spot_fixes(spark, folder):
    return _kept(spark, folder).select("street", "cls", "run", "length_m", "kind", "signalised")


_ALT = "CASE WHEN join_m > 0 THEN count(*) OVER (PARTITION BY street, cls, least(big, small), greatest(big, small), join_m > 0) ELSE 1 END"


@query("alternatives", grid.sql(f", {_SEV} SELECT street, cls, run, {_ALT} AS alternatives FROM kept", recursive=True))
def alternatives(spark, folder):
    w = Window.partitionBy("street", "cls", F.least("big", "small"), F.greatest("big", "small"), F.col("join_m") > 0)
    return _kept(spark, folder).select("street", "cls", "run", F.when(F.col("join_m") > 0, F.count("*").over(w)).otherwise(1).alias("alternatives"))


_NORM = "CASE WHEN {1} > 0 THEN ln(1 + {0}) / ln(1 + {1}) ELSE 0 END"
_SCORE = f"""{_SEV}, kept2 AS (SELECT *, join_m / greatest(length_m, 25) AS sv, crashes / greatest(length_m, 50) * 1000 AS cr FROM kept), tops AS (SELECT max(sv) AS j, max(cr) AS c FROM kept2),
scored AS (SELECT kept2.*, round({_NORM.format('sv', 'j')} * 0.4::DOUBLE + {_NORM.format('cr', 'c')} * 0.15::DOUBLE, 4) AS score FROM kept2, tops),
numb AS (SELECT *, 'c' || lpad(row_number() OVER (ORDER BY street, cls, run)::VARCHAR, 5, '0') AS cid FROM scored)"""


def _scored(spark, folder: str) -> DataFrame:
    """Candidates scored where access has not been measured."""
    rows = projects.scored(projects.measured(_kept(spark, folder)), {"severance": ("sv", dims.W_SEVERANCE), "crash": ("cr", dims.W_CRASH)})
    return projects.numbered(rows, [F.col("street"), F.col("cls"), F.col("run")], "_n").withColumn("cid", F.concat(F.lit("c"), F.lpad(F.col("_n").cast("string"), 5, "0")))


@query("priority_scores", grid.sql(f", {_SCORE} SELECT cid, street, cls, run, score FROM numb", recursive=True))
def priority_scores(spark, folder):
    return _scored(spark, folder).select("cid", "street", "cls", "run", "score")


@query("priorities_csv", grid.sql(f", {_SCORE} SELECT row_number() OVER (ORDER BY score DESC, cid) AS rank, cid, street, cls, kind, format('{{:.4f}}', score) AS score, round(length_m, 1) AS length_m, join_m FROM numb", recursive=True))
def priorities_csv(spark, folder):
    ranked = projects.numbered(_scored(spark, folder), [F.desc("score"), F.col("cid"), F.col("_n")], "rank")  # beyond 99,999 a cid is cut to five digits, as in SQL
    return ranked.select("rank", "cid", "street", "cls", "kind", F.format_string("%.4f", "score").alias("score"), F.round("length_m", 1).alias("length_m"), "join_m")


@query("priority_slice", grid.sql(f""", {_SCORE}, lead_ AS (SELECT cid FROM (SELECT cid, row_number() OVER (ORDER BY sv DESC, cid) AS r FROM numb WHERE sv > 0) WHERE r <= 20 UNION SELECT cid FROM (SELECT cid, row_number() OVER (ORDER BY cr DESC, cid) AS r FROM numb WHERE cr > 0) WHERE r <= 20 UNION SELECT cid FROM numb WHERE kind = 'spot_fix'),
rest AS (SELECT cid FROM (SELECT cid, row_number() OVER (ORDER BY score DESC, cid) AS r FROM numb WHERE cid NOT IN (SELECT cid FROM lead_)) WHERE r <= greatest(0, 80 - (SELECT count(*) FROM lead_))) SELECT cid, score FROM numb WHERE cid IN (SELECT cid FROM lead_ UNION ALL SELECT cid FROM rest)""", recursive=True))
def priority_slice(spark, folder):
    return projects.slice_for_map(cut(_scored(spark, folder)), ["sv", "cr"], 80).select("cid", "score")


@query("rerank", grid.sql(f", {_SCORE}, r AS (SELECT cid, kind, round((2 * CASE WHEN j > 0 THEN ln(1 + sv) / ln(1 + j) ELSE 0 END + CASE WHEN c > 0 THEN ln(1 + cr) / ln(1 + c) ELSE 0 END) / 3, 3) AS client_score, street, cls, least(big, small) AS g1, greatest(big, small) AS g2 FROM numb, tops WHERE join_m > 0) SELECT cid, client_score FROM (SELECT *, row_number() OVER (PARTITION BY street, cls, g1, g2 ORDER BY client_score DESC, cid) AS rn FROM r) WHERE rn = 1", recursive=True))
def rerank(spark, folder):
    rows = projects.scored(cut(_scored(spark, folder)).drop("score"), {"severance": ("sv", 2 / 3), "crash": ("cr", 1 / 3)}, digits=3)
    w = Window.partitionBy("street", "cls", F.least("big", "small"), F.greatest("big", "small")).orderBy(F.desc("score"), "cid")
    return rows.where("join_m > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cid", F.col("score").alias("client_score"))


# searches


def tiles_of(spark, folder: str, side: int | None = None) -> DataFrame:
    """node, tile: squares of side x side nodes. Unless given, the side grows with the root of the network, so that both
    a tile's nodes and the tiles, which bound a search's rounds, do; up to MOST_SIDE, which bounds a task's memory."""
    if side is None:
        nodes = grid.table(spark, folder, "part").count()
        side = MOST_SIDE if nodes <= ONE_TILE else min(max(grid.WIDTH, math.isqrt(nodes)), MOST_SIDE)
    return grid.nodes(spark, folder).select(F.col("id").alias("node"), (F.floor(F.col("cy") / side) * (1 << 32) + F.floor(F.col("cx") / side)).cast("bigint").alias("tile"))


def arcs(spark, folder: str, mode: str = "kids", weight=None) -> DataFrame:
    return weighed(spark, folder).select(F.lit(mode).alias("mode"), "u", "v", "k", (F.col("weight") if weight is None else weight).alias("weight"), "length", "cls", F.coalesce("name", F.lit("")).alias("name"), "climb", "crash_factor", "xpen", "road_busy")


_SP = f"""{_WEIGHED}, arc AS (SELECT u, v, min(weight) AS weight FROM w GROUP BY 1, 2),
sp(q, node, d) USING KEY (q, node) AS (SELECT n_nationkey::BIGINT, (n_nationkey * 377)::BIGINT % (SELECT count(*) FROM node), 0.0::DOUBLE FROM nation UNION SELECT s.q, a.v, min(s.d + a.weight) FROM sp s JOIN arc a ON a.u = s.node LEFT JOIN recurring.sp r ON r.q = s.q AND r.node = a.v WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2)"""


def _starts(spark, folder: str, mode: str = "kids") -> DataFrame:
    """A start for every nation."""
    total = grid.table(spark, folder, "part").count()
    key = F.col("n_nationkey").cast("bigint")
    return grid.table(spark, folder, "nation").select(F.lit(mode).alias("mode"), key.alias("query"), (key * 377 % total).alias("node"), num(0).alias("cost"))


def _from_starts(spark, folder: str, budget: float | None = None) -> DataFrame:
    return search.costs(arcs(spark, folder), _starts(spark, folder), tiles_of(spark, folder), budget, together=TOGETHER)


@query("shortest_path_cost", grid.sql(f", {_SP} SELECT q AS query, node, round(d, 3) AS cost FROM sp", recursive=True))
def shortest_path_cost(spark, folder):
    return _from_starts(spark, folder).select("query", "node", F.round("cost", 3).alias("cost"))


@query("shortest_path_small_tiles", grid.sql(f", {_SP} SELECT q AS query, node, round(d, 3) AS cost FROM sp", recursive=True))
def shortest_path_small_tiles(spark, folder):
    """The same costs by exchange between tiles of 10 x 10 nodes, as many neighbouring ones in a task as it holds."""
    found = search.costs(arcs(spark, folder), _starts(spark, folder), tiles_of(spark, folder, 10), together=TOGETHER)
    return found.select("query", "node", F.round("cost", 3).alias("cost"))


@query("shortest_path_overlay", grid.sql(f", {_SP} SELECT q AS query, node, round(d, 3) AS cost FROM sp", recursive=True))
def shortest_path_overlay(spark, folder):
    """The same costs over an overlay of border nodes, each tile of 10 x 10 nodes opened once for a query."""
    over = search.overlay(arcs(spark, folder), tiles_of(spark, folder, 10))
    return search.overlay_costs(over, _starts(spark, folder), together=TOGETHER_HOPS).select("query", "node", F.round("cost", 3).alias("cost"))


#: Streets of a brand and service roads are closed to through rides, paths are made cheaper: prices of a what-if that falls and rises.
_RECOST = "weight * CASE WHEN cls = 'service' THEN 4.0::DOUBLE WHEN cls = 'path' THEN 0.5::DOUBLE WHEN cls = 'quiet_street' AND (u + v) % 5 = 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END"


@query("recost_repair", grid.sql(f""", {_WEIGHED}, arc AS (SELECT u, v, min({_RECOST}) AS weight FROM w GROUP BY 1, 2),
sp(q, node, d) USING KEY (q, node) AS (SELECT n_nationkey::BIGINT, (n_nationkey * 377)::BIGINT % (SELECT count(*) FROM node), 0.0::DOUBLE FROM nation UNION SELECT s.q, a.v, min(s.d + a.weight) FROM sp s JOIN arc a ON a.u = s.node LEFT JOIN recurring.sp r ON r.q = s.q AND r.node = a.v WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1, 2)
SELECT q AS query, node, round(d, 3) AS cost FROM sp""", recursive=True))
def recost_repair(spark, folder):
    """Costs after some streets have become dearer and some cheaper, from the trees of the search before."""
    before = cut(arcs(spark, folder))
    factor = F.when(F.col("cls") == "service", num(4)).when(F.col("cls") == "path", num(0.5)).when((F.col("cls") == "quiet_street") & ((F.col("u") + F.col("v")) % 5 == 0), num(3)).otherwise(num(1))
    tiles = tiles_of(spark, folder)
    found = search.costs(before, _starts(spark, folder), tiles)
    return search.repaired(found, before, before.withColumn("weight", F.col("weight") * factor), tiles).select("query", "node", F.round("cost", 3).alias("cost"))


_REACH = f"{_SP}, out_ AS (SELECT q, w.u, w.v, w.k, w.length FROM sp JOIN w ON w.u = sp.node WHERE sp.d + w.weight <= 1500)"


@query("reach_edges", grid.sql(f", {_REACH} SELECT q AS query, u, v, k FROM out_", recursive=True))
def reach_edges(spark, folder):
    return _reach(spark, folder).select("query", "u", "v", "k")


def _reach(spark, folder: str, budget: float = 1500.0) -> DataFrame:
    found = _from_starts(spark, folder, budget).select("query", F.col("node").alias("u"), "cost")
    return found.join(arcs(spark, folder), "u").where(F.col("cost") + F.col("weight") <= budget)


@query("reach_summary", grid.sql(f", {_REACH} SELECT q AS query, round(sum(length) / 1000, 3) AS km, round(100 * sum(length) / (SELECT sum(length) FROM edge), 3) AS pct FROM out_ GROUP BY 1", recursive=True))
def reach_summary(spark, folder):
    total = grid.edges(spark, folder).agg(F.sum("length").alias("total"))
    return _reach(spark, folder).groupBy("query").agg(F.sum("length").alias("m")).join(F.broadcast(total), F.lit(True)).select("query", F.round(F.col("m") / 1000, 3).alias("km"), F.round(F.col("m") * 100 / F.col("total"), 3).alias("pct"))


@query("nearest_reachable", grid.sql(f", {_SP}, target AS (SELECT s_suppkey::BIGINT AS ord, (s_suppkey * 17) % (SELECT count(*) FROM node) AS node FROM supplier) SELECT q AS query, min_by(ord, (d, ord)) AS target, round(min(d), 3) AS cost FROM sp JOIN target USING (node) GROUP BY 1".replace("min_by(ord, (d, ord))", "arg_min(ord, {'d': d, 'o': ord})"), recursive=True))
def nearest_reachable(spark, folder):
    total = grid.table(spark, folder, "part").count()
    targets = grid.table(spark, folder, "supplier").select(F.col("s_suppkey").cast("bigint").alias("ord"), (F.col("s_suppkey") * 17 % total).alias("node"))
    return _from_starts(spark, folder).join(targets, "node").groupBy("query").agg(F.min(F.struct("cost", "ord")).alias("b")).select("query", F.col("b.ord").alias("target"), F.round("b.cost", 3).alias("cost"))


@query("town_routability", grid.sql(f", {_SP}, hub AS (SELECT n_nationkey::BIGINT AS town_id, (n_nationkey * 83) % (SELECT count(*) FROM node) AS node FROM nation) SELECT town_id, count(sp.q) AS routes, round(avg(d), 2) AS mean_cost FROM hub LEFT JOIN sp USING (node) GROUP BY 1", recursive=True))
def town_routability(spark, folder):
    total = grid.table(spark, folder, "part").count()
    hubs = grid.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("town_id"), (F.col("n_nationkey").cast("bigint") * 83 % total).alias("node"))
    return hubs.join(_from_starts(spark, folder).select("node", "cost", "query"), "node", "left").groupBy("town_id").agg(F.count("query").alias("routes"), F.round(F.avg("cost"), 2).alias("mean_cost"))


_BASE = f"""{_WEIGHED}, dest AS (SELECT DISTINCT near_id AS id FROM (SELECT poi_id, n.id AS near_id, row_number() OVER (PARTITION BY poi_id ORDER BY pow(p.x - n.x, 2) + pow(p.y - n.y, 2), n.id) AS rn FROM place p, node n WHERE kind IN ('school', 'playground', 'library')) WHERE rn = 1),
arc AS (SELECT u, v, min(weight) AS weight FROM w GROUP BY 1, 2),
base(node, d) USING KEY (node) AS (SELECT id, 0.0::DOUBLE FROM dest UNION SELECT a.u, min(s.d + a.weight) FROM base s JOIN arc a ON a.v = s.node LEFT JOIN recurring.base r ON r.node = a.u WHERE r.d IS NULL OR s.d + a.weight < r.d GROUP BY 1)"""


def access_costs(spark, folder: str, budget: float | None = None) -> DataFrame:
    """node, cost of the cheapest way to any destination: a search from all of them on reversed arcs."""
    wanted = grid.places(spark, folder).where(F.col("kind").isin(*dims.DESTINATIONS))
    nodes = grid.nodes(spark, folder).select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    dest = spatial.nearest_anywhere(wanted, nodes, "poi_id", 200.0).select(F.lit("kids").alias("mode"), F.lit(0).cast("bigint").alias("query"), F.col("near_id").alias("node"), num(0).alias("cost")).distinct()
    back = arcs(spark, folder).select("mode", F.col("v").alias("u"), F.col("u").alias("v"), "weight")
    return search.costs(back, dest, tiles_of(spark, folder), budget).select("node", "cost")


@query("access_baseline", grid.sql(f", {_BASE} SELECT node, round(d, 3) AS cost FROM base", recursive=True))
def access_baseline(spark, folder):
    return access_costs(spark, folder).select("node", F.round("cost", 3).alias("cost"))


_POP = """inside AS (SELECT id, block_id, pop FROM node n JOIN block b ON n.x BETWEEN x0 AND x1 AND n.y BETWEEN y0 AND y1), shared AS (SELECT id, pop::DOUBLE / count(*) OVER (PARTITION BY block_id) AS pop FROM inside),
far AS (SELECT id, pop FROM (SELECT n.id, b.pop, row_number() OVER (PARTITION BY block_id ORDER BY pow((x0 + x1) / 2 - n.x, 2) + pow((y0 + y1) / 2 - n.y, 2), n.id) AS rn FROM block b ANTI JOIN inside i USING (block_id), node n) WHERE rn = 1),
people AS (SELECT id, sum(pop) AS pop FROM (SELECT * FROM shared UNION ALL SELECT * FROM far) GROUP BY id)"""


def _people_costs(spark, folder: str) -> DataFrame:
    pop = spatial.share_population(grid.nodes(spark, folder), grid.blocks(spark, folder))
    far = dims.ACCESS_BUDGET_M * dims.CLAMP
    return pop.join(access_costs(spark, folder).withColumnRenamed("node", "id"), "id", "left").withColumn("cost", F.least(F.coalesce("cost", num(far)), num(far)))


@query("stranded", grid.sql(f", {_BASE}, {_POP} SELECT round(sum(pop), 1) AS residents, round(coalesce(sum(pop) FILTER (coalesce(d, 10000) >= 2500), 0), 1) AS stranded, round(100 * coalesce(sum(pop) FILTER (coalesce(d, 10000) >= 2500), 0) / sum(pop), 1) AS pct FROM people p LEFT JOIN base b ON b.node = p.id", recursive=True))
def stranded(spark, folder):
    out = F.col("cost") >= dims.ACCESS_BUDGET_M
    return _people_costs(spark, folder).agg(F.sum("pop").alias("t"), F.sum(F.when(out, F.col("pop")).otherwise(num(0))).alias("s")).select(F.round("t", 1).alias("residents"), F.round("s", 1).alias("stranded"), F.round(F.col("s") * 100 / F.col("t"), 1).alias("pct"))


@query("coverage_cells", grid.sql(f", {_BASE}, {_POP}, c AS (SELECT round((lon + 71.2::DOUBLE) * 1000000)::BIGINT // 5000 AS col, round((lat - 42.3::DOUBLE) * 1000000)::BIGINT // 5000 AS row, round(pop * 1000000)::BIGINT AS pop, coalesce(d, 10000) AS d FROM people p JOIN node n ON n.id = p.id LEFT JOIN base b ON b.node = p.id), cell AS (SELECT col, row, sum(pop)::BIGINT AS p, coalesce(sum(pop) FILTER (d < 2500), 0)::BIGINT AS s FROM c GROUP BY 1, 2) SELECT col, row, ((p + 5000) // 10000) / 100.0::DOUBLE AS residents, ((20000 * s + p) // (2 * p)) / 100.0::DOUBLE AS served_pct, CASE WHEN 10 * s >= 8 * p THEN 'good' WHEN 10 * s >= 4 * p THEN 'some' ELSE 'poor' END AS band FROM cell WHERE p > 0", recursive=True))
def coverage_cells(spark, folder):
    """Residents and their share with a safe way by cell: whole millionths, so sums and roundings are exact."""
    at = grid.nodes(spark, folder).select("id", F.expr("cast(round((lon + 71.2D) * 1000000) as bigint) div 5000").alias("col"), F.expr("cast(round((lat - 42.3D) * 1000000) as bigint) div 5000").alias("row"))
    people = projects.millionths(F.col("pop"))
    per = _people_costs(spark, folder).join(at, "id").groupBy("col", "row").agg(F.sum(people).alias("p"), F.sum(F.when(F.col("cost") < dims.ACCESS_BUDGET_M, people).otherwise(0)).alias("s")).where("p > 0")
    band = F.when(F.col("s") * 10 >= F.col("p") * 8, "good").when(F.col("s") * 10 >= F.col("p") * 4, "some").otherwise("poor")
    return per.select("col", "row", (F.expr("(p + 5000) div 10000") / 100).alias("residents"), (F.expr("(20000 * s + p) div (2 * p)") / 100).alias("served_pct"), band.alias("band"))


_GAIN = f"""{_SCORE}, {_BASE[len(_WEIGHED) + 2:]}, {_POP}, own0 AS (SELECT b.street, b.cls, r.run, b.u, b.v, b.length FROM bad b JOIN run r ON r.street = b.street AND r.cls = b.cls AND r.id = b.u JOIN kept k ON k.street = b.street AND k.cls = b.cls AND k.run = r.run),
own AS (SELECT street, cls, run, u, v, min(length) AS weight FROM (SELECT * FROM own0 UNION ALL SELECT street, cls, run, v, u, length FROM own0) GROUP BY 1, 2, 3, 4, 5),
imp(street, cls, run, node, d) USING KEY (street, cls, run, node) AS (SELECT o.street, o.cls, o.run, o.u, min(o.weight + b.d) FROM own o JOIN base b ON b.node = o.v LEFT JOIN base n ON n.node = o.u WHERE b.d < 10000 AND o.weight + b.d < least(coalesce(n.d, 10000), 10000) GROUP BY 1, 2, 3, 4
  UNION SELECT x.street, x.cls, x.run, x.node, min(x.d) FROM (SELECT i.street, i.cls, i.run, a.u AS node, i.d + least(a.weight, coalesce(o.weight, a.weight)) AS d FROM imp i JOIN arc a ON a.v = i.node LEFT JOIN own o ON o.street = i.street AND o.cls = i.cls AND o.run = i.run AND o.u = a.u AND o.v = a.v) x
    LEFT JOIN base b ON b.node = x.node LEFT JOIN recurring.imp r ON r.street = x.street AND r.cls = x.cls AND r.run = x.run AND r.node = x.node WHERE x.d < least(coalesce(b.d, 10000), 10000) AND (r.d IS NULL OR x.d < r.d) GROUP BY 1, 2, 3, 4),
gain AS (SELECT i.street, i.cls, i.run, sum(round(pop * 1000000)::HUGEINT * round((least(coalesce(b.d, 10000), 10000) - i.d) * 1000000)::HUGEINT)::HUGEINT AS saved_e12, coalesce(sum(round(pop * 1000000)::BIGINT) FILTER (least(coalesce(b.d, 10000), 10000) >= 2500 AND i.d < 2500), 0)::BIGINT AS gaining_e6 FROM imp i JOIN people p ON p.id = i.node LEFT JOIN base b ON b.node = i.node GROUP BY 1, 2, 3),
full0 AS (SELECT n.*, coalesce(saved_e12, 0)::HUGEINT AS saved_e12, coalesce(gaining_e6, 0)::BIGINT AS gaining_e6, coalesce(saved_e12, 0)::DOUBLE / 1e12 AS saved, coalesce(gaining_e6, 0)::DOUBLE / 1e6 AS gaining FROM numb n LEFT JOIN gain g ON g.street = n.street AND g.cls = n.cls AND g.run = n.run), tops2 AS (SELECT max(saved) AS a, max(gaining) AS v FROM full0)"""


def _gained(spark, folder: str) -> DataFrame:
    """Candidates with what building each would save residents, and how many would gain a safe way."""
    rows, members = _candidates(spark, folder)
    kept = cut(_classified(spark, folder, rows, members))
    streets = members.join(kept.select("street", "cls", "run"), ["street", "cls", "run"], "left_semi").select("street", "cls", "run", "u", "v", "length")
    least = arcs(spark, folder).groupBy("u", "v").agg(F.min("weight").alias("weight"))
    pop = cut(spatial.share_population(grid.nodes(spark, folder), grid.blocks(spark, folder)))
    gain = projects.accessibility(streets, least, access_costs(spark, folder), pop, tiles_of(spark, folder))
    out = projects.measured(kept).join(gain, ["street", "cls", "run"], "left")
    return out.withColumns({"saved": F.coalesce("saved", num(0)), "gaining": F.coalesce("gaining", num(0)), "saved_e12": F.coalesce("saved_e12", F.lit(0).cast("decimal(38,0)")), "gaining_e6": F.coalesce("gaining_e6", F.lit(0))})


@query("project_access", grid.sql(f", {_GAIN} SELECT street, cls, run, ((saved_e12 + 50000000000) // 100000000000)::BIGINT / 10.0::DOUBLE AS saved, ((gaining_e6 + 5000) // 10000) / 100.0::DOUBLE AS gaining FROM full0", recursive=True))
def project_access(spark, folder):
    return _gained(spark, folder).select("street", "cls", "run", (F.expr("(saved_e12 + 50000000000) div 100000000000") / 10).alias("saved"), (F.expr("(gaining_e6 + 5000) div 10000") / 100).alias("gaining"))


@query("project_ranking", grid.sql(f", {_GAIN} SELECT cid, round({_NORM.format('sv', 'j')} * 0.4::DOUBLE + {_NORM.format('saved', 'a')} * 0.3::DOUBLE + {_NORM.format('cr', 'c')} * 0.15::DOUBLE + {_NORM.format('gaining', 'v')} * 0.15::DOUBLE, 3) AS score FROM full0, tops, tops2", recursive=True))
def project_ranking(spark, folder):
    """Every candidate's composite score over all four measures."""
    measures = {"severance": ("sv", dims.W_SEVERANCE), "access": ("saved", dims.W_ACCESS), "crash": ("cr", dims.W_CRASH), "coverage": ("gaining", dims.W_COVERAGE)}
    rows = projects.scored(cut(_gained(spark, folder)), measures, digits=3)
    numbered = projects.numbered(rows, [F.col("street"), F.col("cls"), F.col("run")], "_n")
    return numbered.select(F.concat(F.lit("c"), F.lpad(F.col("_n").cast("string"), 5, "0")).alias("cid"), "score")


# towns


_CITY = f"""{_CC}, street AS (SELECT h.*, n_nationkey FROM (SELECT h.*, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my FROM half h JOIN node a ON a.id = h.u JOIN node b ON b.id = h.v) h JOIN nation ON floor((mx + 50) / 800) = n_nationkey % 5 AND floor((my + 50) / 1000) = n_nationkey // 5 AND NOT (n_nationkey % 2 = 0 AND mx - ((n_nationkey % 5) * 800 - 50) >= 300 AND mx - ((n_nationkey % 5) * 800 - 50) < 500 AND my - ((n_nationkey // 5) * 1000 - 50) >= 300 AND my - ((n_nationkey // 5) * 1000 - 50) < 500)),
local AS (SELECT n_nationkey::BIGINT AS town_id, island, sum(length) AS metres FROM street JOIN safe ON safe.a = u AND safe.b = v JOIN comp ON comp.id = u GROUP BY 1, 2),
main AS (SELECT *, row_number() OVER (PARTITION BY town_id ORDER BY metres DESC, island) AS rn FROM local)"""


def _local_islands(spark, folder: str) -> DataFrame:
    """town_id, island, metres: child-safe streets booked to the town their middle lies in."""
    e, nodes_of, _ = _islands(spark, folder)
    mid = grid.placed_edges(spark, folder).where("u < v").select("u", "v", "k", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    booked = spatial.points_in_rings(mid, grid.towns(spark, folder), even_odd=True).select("u", "v", "k", "town_id")
    safe = e.where(F.col("stress_mult") <= dims.KID_SAFE_MAX).select("u", "v", "k", "length")
    return booked.join(safe, ["u", "v", "k"]).join(nodes_of.withColumnRenamed("id", "u"), "u").groupBy("town_id", "island").agg(F.sum("length").alias("metres"))


@query("city_stats", grid.sql(f", {_CITY} SELECT town_id, round(sum(metres) / 1000, 3) AS safe_km, round(max(metres) / 1000, 3) AS connected_km, max(island) FILTER (rn = 1) AS main_island, count(*) FILTER (rn > 1 AND metres >= 200) AS pockets FROM main GROUP BY 1", recursive=True))
def city_stats(spark, folder):
    order = Window.partitionBy("town_id").orderBy(F.desc("metres"), "island")
    m = _local_islands(spark, folder).withColumn("rn", F.row_number().over(order))
    return m.groupBy("town_id").agg(F.round(F.sum("metres") / 1000, 3).alias("safe_km"), F.round(F.max("metres") / 1000, 3).alias("connected_km"), F.max(F.when(F.col("rn") == 1, F.col("island"))).alias("main_island"), F.count_if((F.col("rn") > 1) & (F.col("metres") >= 200)).alias("pockets"))


@query("city_pockets", grid.sql(f", {_CITY} SELECT town_id, island, metres, CASE WHEN rn = 1 THEN 0 WHEN metres >= 200 THEN least(rn - 1, 8) ELSE 8 END::BIGINT AS pocket FROM main", recursive=True))
def city_pockets(spark, folder):
    order = Window.partitionBy("town_id").orderBy(F.desc("metres"), "island")
    m = _local_islands(spark, folder).withColumn("rn", F.row_number().over(order))
    return m.select("town_id", "island", "metres", F.when(F.col("rn") == 1, 0).when(F.col("metres") >= 200, F.least(F.col("rn") - 1, F.lit(8))).otherwise(8).cast("bigint").alias("pocket"))


@query("city_coverage", grid.sql(", cellt AS (SELECT block_id // 10 AS town_id, block_id, pop, CASE WHEN block_id % 7 <> 0 THEN (block_id * 13) % 101 END AS pct FROM block) SELECT town_id, sum(pop)::BIGINT AS residents, coalesce(sum(pop) FILTER (pct IS NULL), 0)::BIGINT AS unmeasured, round(sum(pop * (100 - pct) / 100.0), 2) AS stranded FROM cellt GROUP BY 1"))
def city_coverage(spark, folder):
    c = grid.blocks(spark, folder).select(F.floor(F.col("block_id") / 10).alias("town_id"), "pop", F.when(F.col("block_id") % 7 != 0, F.col("block_id") * 13 % 101).alias("pct"))
    return c.groupBy("town_id").agg(F.sum("pop").alias("residents"), F.sum(F.when(F.col("pct").isNull(), F.col("pop")).otherwise(0)).alias("unmeasured"), F.round(F.sum(F.col("pop") * (100 - F.col("pct")) / 100), 2).alias("stranded"))
