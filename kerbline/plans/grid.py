"""A street network derived from the star-schema tables, so that every operator runs on them.

Nodes are parts on a grid 40 wide, 98 m by 100 m; edges run right and up, both ways. Crashes come from
events, places of interest and facility lines from suppliers, towns from nations, census blocks from
customers, position fixes from events by user. The functions give DataFrames; SQL has the same
relations as common table expressions for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import num

WIDTH, EAST_M, NORTH_M = 40, 98.0, 100.0
KINDS = ("school", "playground", "library", "ice_cream", "cafe", "park")
FACILITIES = ("SBL", "BFBL", "BL", "SLM", "SUP")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """id, cx, cy, lon, lat, x, y (metres), elev, name, highway, crossing, pr."""
    part = table(spark, folder, "part")
    cx, cy = F.col("p_partkey") % WIDTH, F.floor(F.col("p_partkey") / WIDTH).cast("bigint")
    return part.select(
        F.col("p_partkey").alias("id"), cx.alias("cx"), cy.alias("cy"), (num(-71.2) + cx * num(0.0012)).alias("lon"), (num(42.3) + cy * num(0.0009)).alias("lat"), (cx * num(EAST_M)).alias("x"), (cy * num(NORTH_M)).alias("y"),
        F.col("p_size").cast("double").alias("elev"), F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("name"),
        F.when(F.col("p_type") == "PROMO", "traffic_signals").alias("highway"), F.when(F.col("p_type") == "SMALL", "traffic_signals").alias("crossing"), F.col("p_retailprice").alias("pr"), F.col("p_size").cast("bigint").alias("sz"),
    )


def halves(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each street: u, v, h, length, name, cls, road_busy."""
    a = nodes(spark, folder).select("id", "cx", "cy", "sz", "pr", "name")
    b = a.select(F.col("id").alias("v"), F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("sz").alias("bsz"), F.col("pr").alias("bpr"))
    right = a.join(b, (F.col("v") == F.col("id") + 1) & (F.col("by") == F.col("cy"))).select(F.col("id").alias("u"), "v", ((F.col("sz") * 7 + F.col("bsz") * 3) % 20).alias("h"), (F.lit(60) + F.floor("pr") % 40).cast("double").alias("length"), "name")
    up = a.join(b, F.col("v") == F.col("id") + WIDTH).select(F.col("id").alias("u"), "v", ((F.col("sz") * 5 + F.col("bsz") * 11) % 20).alias("h"), (F.lit(60) + F.floor("bpr") % 40).cast("double").alias("length"), "name")
    h = F.col("h")
    cls = F.when(h < 2, "path").when(h < 3, "separated").when(h < 4, "buffered").when(h < 9, "quiet_street").when(h < 10, "service").when(h < 12, "lane").when(h < 13, "sharrow").when(h < 16, "moderate_street").otherwise("busy_street")
    both = right.union(up).withColumn("cls", cls)
    return both.withColumn("road_busy", (F.col("cls") == "busy_street") | (F.col("cls").isin("lane", "buffered") & (F.col("u") % 3 == 0)))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Directed edges with parallel key k; both directions of every street, k counting streets between the same ends."""
    half = halves(spark, folder)
    return half.withColumn("k", F.lit(0)).union(half.select(F.col("v").alias("u"), F.col("u").alias("v"), "h", "length", "name", "cls", "road_busy", F.lit(0).alias("k")))


def placed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with both ends' ax, ay, bx, by in metres."""
    at = nodes(spark, folder).select("id", "x", "y")
    e = edges(spark, folder)
    e = e.join(at.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), "u")
    return e.join(at.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by")), "v")


def crashes(spark: SparkSession, folder: str) -> DataFrame:
    """crash_id, x, y, year."""
    e = table(spark, folder, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("crash_id"), (F.col("event_id") * 37 % 3920).cast("double").alias("x"), (F.col("event_id") * 91 % 4900).cast("double").alias("y"), (F.lit(2021) + F.col("event_id") % 6).cast("int").alias("year"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """poi_id, kind, x, y."""
    s = table(spark, folder, "supplier")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("s_nationkey") % 6 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("poi_id"), kind.alias("kind"), (F.col("s_suppkey") * 53 % 3900 + num(0.25)).alias("x"), (F.col("s_suppkey") * 71 % 4890 + num(0.5)).alias("y"))


def facility_lines(spark: SparkSession, folder: str) -> DataFrame:
    """facility_id, code, ax, ay, bx, by: lines along the grid's streets, some metres beside them."""
    s = table(spark, folder, "supplier")
    code = F.element_at(F.array(*map(F.lit, FACILITIES)), (F.col("s_nationkey") % 5 + 1).cast("int"))
    across = F.col("s_suppkey") % 2 == 0
    x = (F.col("s_suppkey") * 131 % 38) * num(EAST_M)
    y = (F.col("s_suppkey") * 57 % 48) * num(NORTH_M)
    off = (F.col("s_suppkey") % 25).cast("double")
    return s.select(
        F.col("s_suppkey").alias("facility_id"), code.alias("code"), F.when(across, x + 10).otherwise(x + off).alias("ax"), F.when(across, y + off).otherwise(y + 10).alias("ay"),
        F.when(across, x + 190).otherwise(x + off).alias("bx"), F.when(across, y + off).otherwise(y + 190).alias("by"),
    )


def _box(x0, y0, x1, y1):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def towns(spark: SparkSession, folder: str) -> DataFrame:
    """town_id, town, rings: a rectangle each, with a hole where the number is even."""
    n = table(spark, folder, "nation")
    key = F.col("n_nationkey").cast("bigint")
    x0, y0 = (key % 5) * num(800) - 50, F.floor(key / 5) * num(1000) - 50
    outer, hole = _box(x0, y0, x0 + 800, y0 + 1000), _box(x0 + 300, y0 + 300, x0 + 500, y0 + 500)
    return n.select(key.alias("town_id"), F.col("n_name").alias("town"), F.when(key % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """block_id, pop, x0, y0, x1, y1: customers of a nation and segment, in a rectangle inside the town."""
    c = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("pop"))
    segment = F.array_position(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), F.col("c_mktsegment")) - 1
    key = F.col("c_nationkey").cast("bigint")
    x0, y0 = (key % 5) * num(800) - 30 + segment * num(150), F.floor(key / 5) * num(1000) + 20
    return c.select((key * 10 + segment).alias("block_id"), "pop", x0.alias("x0"), y0.alias("y0"), (x0 + 140).alias("x1"), (y0 + 700).alias("y1"))


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Position fixes of rides, one ride for each user: east at walking pace with wander, some far jumps, gaps in
    speed and heading, stretches off the route, and pauses."""
    e = table(spark, folder, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    cls = F.element_at(F.array(*map(F.lit, ("path", "separated", "buffered", "quiet_street", "busy_street"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = e.select(F.col("user_id").alias("ride_id"), seq.alias("seq"), "event_id", cls.alias("cls"))
    n, q = F.col("event_id"), F.col("seq")
    t = (q * 5 + n % 4 + F.floor(q / 40) * 900).cast("double")
    return e.select(
        "ride_id", "seq", t.alias("t_s"), F.timestamp_seconds(t + 1704067200).alias("ts"),
        (num(-71.2) + q * num(0.0002) + (n * 17 % 7) * num(0.00001) + F.when(n % 37 == 0, num(0.01)).otherwise(num(0))).alias("lon"), (num(42.3) + (n * 7 % 5) * num(0.00002)).alias("lat"),
        (n % 80).cast("double").alias("accuracy"), F.when(n % 3 != 0, num(2) + (n % 5) * num(0.5)).alias("speed"), F.when(n % 4 != 0, (n % 360).cast("double")).alias("heading"),
        (q * 20 - F.when(n % 11 == 0, 15).otherwise(0) - F.when(q >= 20, 900).otherwise(0)).cast("double").alias("along_m"), (n * 13 % 60).cast("double").alias("off_m"), "cls", num(1500).alias("route_m"),
    )


SQL = """
node AS (SELECT p_partkey AS id, p_partkey % 40 AS cx, p_partkey // 40 AS cy, -71.2::DOUBLE + (p_partkey % 40) * 0.0012::DOUBLE AS lon, 42.3::DOUBLE + (p_partkey // 40) * 0.0009::DOUBLE AS lat,
  ((p_partkey % 40) * 98)::DOUBLE AS x, ((p_partkey // 40) * 100)::DOUBLE AS y, p_size::DOUBLE AS elev, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS name,
  CASE WHEN p_type = 'PROMO' THEN 'traffic_signals' END AS highway, CASE WHEN p_type = 'SMALL' THEN 'traffic_signals' END AS crossing, p_retailprice AS pr, p_size::BIGINT AS sz FROM part),
half0 AS (SELECT a.id AS u, b.id AS v, (a.sz * 7 + b.sz * 3) % 20 AS h, (60 + floor(a.pr)::BIGINT % 40)::DOUBLE AS length, a.name FROM node a JOIN node b ON b.id = a.id + 1 AND b.cy = a.cy
  UNION ALL SELECT a.id, b.id, (a.sz * 5 + b.sz * 11) % 20, (60 + floor(b.pr)::BIGINT % 40)::DOUBLE, a.name FROM node a JOIN node b ON b.id = a.id + 40),
half1 AS (SELECT *, CASE WHEN h < 2 THEN 'path' WHEN h < 3 THEN 'separated' WHEN h < 4 THEN 'buffered' WHEN h < 9 THEN 'quiet_street' WHEN h < 10 THEN 'service' WHEN h < 12 THEN 'lane' WHEN h < 13 THEN 'sharrow' WHEN h < 16 THEN 'moderate_street' ELSE 'busy_street' END AS cls FROM half0),
half AS (SELECT *, cls = 'busy_street' OR (cls IN ('lane', 'buffered') AND u % 3 = 0) AS road_busy FROM half1),
edge AS (SELECT u, v, h, length, name, cls, road_busy, 0 AS k FROM half UNION ALL SELECT v, u, h, length, name, cls, road_busy, 0 FROM half),
pedge AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM edge e JOIN node a ON a.id = e.u JOIN node b ON b.id = e.v),
crash AS (SELECT event_id AS crash_id, (event_id * 37 % 3920)::DOUBLE AS x, (event_id * 91 % 4900)::DOUBLE AS y, (2021 + event_id % 6)::INT AS year FROM events WHERE event_type = 'error'),
place AS (SELECT s_suppkey AS poi_id, (['school', 'playground', 'library', 'ice_cream', 'cafe', 'park'])[s_nationkey % 6 + 1] AS kind, (s_suppkey * 53 % 3900)::DOUBLE + 0.25 AS x, (s_suppkey * 71 % 4890)::DOUBLE + 0.5 AS y FROM supplier),
fac0 AS (SELECT s_suppkey AS f, s_suppkey % 2 = 0 AS across, (['SBL', 'BFBL', 'BL', 'SLM', 'SUP'])[s_nationkey % 5 + 1] AS code, ((s_suppkey * 131 % 38) * 98)::DOUBLE AS x, ((s_suppkey * 57 % 48) * 100)::DOUBLE AS y, (s_suppkey % 25)::DOUBLE AS o FROM supplier),
facility AS (SELECT f AS facility_id, code, CASE WHEN across THEN x + 10 ELSE x + o END AS ax, CASE WHEN across THEN y + o ELSE y + 10 END AS ay, CASE WHEN across THEN x + 190 ELSE x + o END AS bx, CASE WHEN across THEN y + o ELSE y + 190 END AS by_ FROM fac0),
town AS (SELECT n_nationkey::BIGINT AS town_id, n_name AS town, ((n_nationkey % 5) * 800 - 50)::DOUBLE AS x0, ((n_nationkey // 5) * 1000 - 50)::DOUBLE AS y0, n_nationkey % 2 = 0 AS holed FROM nation),
block AS (SELECT c_nationkey::BIGINT * 10 + seg AS block_id, pop, ((c_nationkey % 5) * 800 - 30 + seg * 150)::DOUBLE AS x0, ((c_nationkey // 5) * 1000 + 20)::DOUBLE AS y0, ((c_nationkey % 5) * 800 - 30 + seg * 150 + 140)::DOUBLE AS x1, ((c_nationkey // 5) * 1000 + 720)::DOUBLE AS y1
  FROM (SELECT c_nationkey, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS seg, count(*) AS pop FROM customer GROUP BY 1, 2)),
fix0 AS (SELECT user_id AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq, event_id AS n FROM events),
fix AS (SELECT ride_id, seq, (seq * 5 + n % 4 + seq // 40 * 900)::DOUBLE AS t_s, make_timestamp((1704067200 + seq * 5 + n % 4 + seq // 40 * 900)::BIGINT * 1000000) AS ts,
  -71.2::DOUBLE + seq * 0.0002::DOUBLE + (n * 17 % 7) * 0.00001::DOUBLE + CASE WHEN n % 37 = 0 THEN 0.01::DOUBLE ELSE 0 END AS lon, 42.3::DOUBLE + (n * 7 % 5) * 0.00002::DOUBLE AS lat, (n % 80)::DOUBLE AS accuracy,
  CASE WHEN n % 3 <> 0 THEN 2.0::DOUBLE + (n % 5) * 0.5::DOUBLE END AS speed, CASE WHEN n % 4 <> 0 THEN (n % 360)::DOUBLE END AS heading,
  (seq * 20 - CASE WHEN n % 11 = 0 THEN 15 ELSE 0 END - CASE WHEN seq >= 20 THEN 900 ELSE 0 END)::DOUBLE AS along_m, (n * 13 % 60)::DOUBLE AS off_m, (['path', 'separated', 'buffered', 'quiet_street', 'busy_street'])[n % 5 + 1] AS cls FROM fix0),
mult(cls, kids, older, solo) AS (VALUES ('path', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('separated', 1.0, 1.0, 1.0), ('buffered', 2.0, 1.5, 1.1), ('lane', 3.0, 2.0, 1.3), ('quiet_street', 1.4, 1.2, 1.1), ('service', 2.0, 1.6, 1.3), ('sharrow', 6.0, 3.5, 2.0), ('moderate_street', 8.0, 4.0, 2.5), ('busy_street', 25.0, 12.0, 6.0)),
safe AS (SELECT least(e.u, e.v) AS a, greatest(e.u, e.v) AS b, min(length) AS m FROM edge e JOIN mult USING (cls)
  WHERE CASE WHEN road_busy AND e.cls = 'lane' THEN 10 WHEN road_busy AND e.cls = 'buffered' THEN 6 ELSE kids END <= 2 GROUP BY 1, 2)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A query over the derived relations, as one statement."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL.strip()}{body}"
