"""Spatial joins as equi-joins on grid cells followed by an exact test.

A row is expanded over the cells its shape may reach within the radius, the other side keeps the one
cell it lies in, so a pair meets exactly once and no side need be broadcast. A crowded cell is an
ordinary skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions import geo
from kerbline.functions.geo import num
from kerbline.plans.lineage import cut


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint"))


def supercover(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """segments (ax, ay, bx, by) with a row for each cell (_cx, _cy) that any point within the radius may lie in.

    Cells are taken column by column, only over the stretch of the segment that comes near the column, so their number grows with
    the segment's length and not with the area of its box.
    """
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    rows = segments.withColumn("_cx", F.explode(_cells(F.least(ax, bx) - radius, F.greatest(ax, bx) + radius, size)))
    dx = F.nullif(bx - ax, num(0))
    edges = ((F.col("_cx") * size - radius - ax) / dx, ((F.col("_cx") + 1) * size + radius - ax) / dx)
    t0 = F.greatest(num(0), F.least(num(1), F.coalesce(F.least(*edges), num(0))))
    t1 = F.greatest(num(0), F.least(num(1), F.coalesce(F.greatest(*edges), num(1))))
    y0, y1 = ay + t0 * (by - ay), ay + t1 * (by - ay)
    return rows.withColumn("_cy", F.explode(_cells(F.least(y0, y1) - radius, F.greatest(y0, y1) + radius, size)))


def line_segments(lines: DataFrame, line: str = "line") -> DataFrame:
    """A row for each straight part of a line (an array of x, y): the other columns, ax, ay, bx, by. A line of one point is one part without length."""
    points = F.col(line)
    parts = F.when(F.size(points) == 1, F.array(F.struct(points[0].alias("a"), points[0].alias("b")))).otherwise(F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    rest = [c for c in lines.columns if c != line]
    each = lines.where(F.size(points) > 0).select(*rest, F.explode(parts).alias("_s"))
    return each.select(*rest, *(F.col(f"_s.{end}.{axis}").alias(end + axis) for end in "ab" for axis in "xy"))


def points_near_lines(points: DataFrame, lines: DataFrame, key: list[str], line_key: str, radius: float) -> DataFrame:
    """The columns of key, line_key and d2 (the least) of every point (x, y) and line (line_key, line) within the radius, each pair once."""
    parts = line_segments(lines.select(line_key, "line"))
    return points_near_segments(points.select(*key, "x", "y"), parts, radius, distance2=geo.offset_distance2).groupBy(*key, line_key).agg(F.min("d2").alias("d2"))


def match_lines(edges: DataFrame, lines: DataFrame, radius: float = dims.FACILITY_RADIUS_M, max_angle: float = dims.FACILITY_MAX_ANGLE) -> DataFrame:
    """u, v, k, cls, facility_id as by match_overlay, of streets and facilities that bend: edges (u, v, k, is_pathlike, line) and lines
    (facility_id, cls, line), lines being arrays of (x, y).

    A facility is met from any of its cells. Bearings are those of the short chords about the street's middle and about the facility's point next to it.
    """
    mid = edges.select("u", "v", "k", "is_pathlike", "line", geo.plane_midpoint(F.col("line")).alias("m")).select("*", F.col("m.x").alias("x"), F.col("m.y").alias("y"))
    mid = mid.select("u", "v", "k", "is_pathlike", "x", "y", geo.chord_bearing(F.col("line"), F.col("x"), F.col("y")).alias("bearing")).where("x IS NOT NULL")
    near = points_near_lines(mid, lines, ["u", "v", "k"], "facility_id", radius)
    met = near.join(mid, ["u", "v", "k"]).join(lines.select("facility_id", F.col("cls").alias("facility"), "line"), "facility_id")
    angle = geo.undirected_difference(F.col("bearing"), geo.chord_bearing(F.col("line"), F.col("x"), F.col("y")))
    fit = met.where((angle <= max_angle) & ((F.col("facility") != "path") | F.col("is_pathlike")))
    best = fit.groupBy("u", "v", "k").agg(F.min(F.struct("d2", "facility_id", "facility")).alias("b"))
    return best.select("u", "v", "k", F.col("b.facility").alias("cls"), F.col("b.facility_id").alias("facility_id"))


def nearest_line(points: DataFrame, lines: DataFrame, key: str, line_key: str, limit: float) -> DataFrame:
    """key, line_key, d2 of the line nearest to each point within the limit, the least key of equals."""
    near = points_near_lines(points, lines, [key], line_key, limit)
    return near.groupBy(key).agg(F.min(F.struct("d2", line_key)).alias("b")).select(key, f"b.{line_key}", "b.d2")


def points_near_segments(points: DataFrame, segments: DataFrame, radius: float, size: float | None = None, distance2=geo.segment_distance2) -> DataFrame:
    """All pairs of a point (x, y) and a segment (ax, ay, bx, by) within the radius, with the squared distance d2."""
    size = size or max(4 * radius, 100.0)
    s = supercover(segments, radius, size)
    p = points.withColumn("_cx", F.floor(F.col("x") / size).cast("bigint")).withColumn("_cy", F.floor(F.col("y") / size).cast("bigint"))
    d2 = distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return p.join(s, ["_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("_cx", "_cy")


def count_near(points: DataFrame, edges: DataFrame, radius: float = dims.CRASH_RADIUS_M) -> DataFrame:
    """u, v, k, crash_count of edges with a point in range; a point counts on every edge in range."""
    return points_near_segments(points.select("x", "y"), edges.select("u", "v", "k", "ax", "ay", "bx", "by"), radius).groupBy("u", "v", "k").agg(F.count("*").alias("crash_count"))


def match_overlay(edges: DataFrame, lines: DataFrame, radius: float = dims.FACILITY_RADIUS_M, max_angle: float = dims.FACILITY_MAX_ANGLE) -> DataFrame:
    """u, v, k, cls, facility_id: the nearest facility line (least id of equals) within the radius of an edge's
    midpoint and roughly parallel; paths only match path-like edges."""
    mid = edges.select("u", "v", "k", "is_pathlike", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), geo.line_bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("bearing"))
    near = points_near_segments(mid, lines.select("facility_id", F.col("cls").alias("facility"), "ax", "ay", "bx", "by"), radius)
    angle = geo.undirected_difference(F.col("bearing"), geo.line_bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    fit = near.where((angle <= max_angle) & ((F.col("facility") != "path") | F.col("is_pathlike")))
    best = fit.groupBy("u", "v", "k").agg(F.min(F.struct("d2", "facility_id", "facility")).alias("m"))
    return best.select("u", "v", "k", F.col("m.facility").alias("cls"), F.col("m.facility_id").alias("facility_id"))


def nearest(points: DataFrame, targets: DataFrame, key: str, limit: float, size: float | None = None) -> DataFrame:
    """points with near_id and d2 of the nearest target (id, tx, ty) within a limit; the least id of equals."""
    size = size or limit
    p = points.withColumn("_cx", F.explode(_cells(F.col("x") - limit, F.col("x") + limit, size))).withColumn("_cy", F.explode(_cells(F.col("y") - limit, F.col("y") + limit, size)))
    t = targets.select("id", "tx", "ty", F.floor(F.col("tx") / size).cast("bigint").alias("_cx"), F.floor(F.col("ty") / size).cast("bigint").alias("_cy"))
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    pairs = p.join(t, ["_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= limit * limit)
    best = pairs.groupBy(key).agg(F.min(F.struct("d2", "id")).alias("m"))
    return points.join(best, key, "left").select(*points.columns, F.col("m.id").alias("near_id"), F.col("m.d2").alias("d2")).where("near_id IS NOT NULL")


def nearest_anywhere(points: DataFrame, targets: DataFrame, key: str, first: float) -> DataFrame:
    """The nearest target however far: points that find none within a distance try again at twice that.

    Points and targets without a finite position have no nearest and are none."""
    if first <= 0:
        raise ValueError("the first distance must be positive")
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    targets = cut(targets.where(finite("tx") & finite("ty")))
    out, left, limit = None, cut(points.where(finite("x") & finite("y"))), first
    if targets.isEmpty():
        return nearest(left, targets, key, limit)
    while True:
        found = cut(nearest(left, targets, key, limit))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select(key), key, "left_anti"))
        if left.isEmpty():
            break
        limit *= 2
    return out


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 500.0) -> DataFrame:
    """All pairs of a point and a box (x0, y0, x1, y1) that covers it, boundary included."""
    b = boxes.withColumn("_cx", F.explode(_cells(F.col("x0"), F.col("x1"), size))).withColumn("_cy", F.explode(_cells(F.col("y0"), F.col("y1"), size)))
    p = points.withColumn("_cx", F.floor(F.col("x") / size).cast("bigint")).withColumn("_cy", F.floor(F.col("y") / size).cast("bigint"))
    return p.join(b, ["_cx", "_cy"]).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").drop("_cx", "_cy")


def points_in_rings(points: DataFrame, areas: DataFrame, even_odd: bool, size: float = 500.0) -> DataFrame:
    """Pairs of a point and an area (rings): in any ring, or by even-odd over all rings so that holes are out."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    boxed = areas.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    test = geo.in_rings_even_odd if even_odd else geo.in_any_ring
    return points_in_boxes(points, boxed, size).where(test(F.col("x"), F.col("y"), F.col("rings"))).drop("x0", "y0", "x1", "y1")


def share_population(nodes: DataFrame, blocks: DataFrame, first_reach: float = 400.0) -> DataFrame:
    """id, pop: a block's people in equal shares on the nodes it covers, or all on the node nearest its centre."""
    inside = points_in_boxes(nodes.select("id", "x", "y"), blocks.select("block_id", "pop", "x0", "y0", "x1", "y1"))
    per = inside.groupBy("block_id").agg(F.count("*").alias("n"))
    shared = inside.join(per, "block_id").select("id", (F.col("pop") / F.col("n")).alias("pop"))
    bare = blocks.join(per.select("block_id"), "block_id", "left_anti").select("block_id", "pop", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    far = nearest_anywhere(bare, nodes.select("id", F.col("x").alias("tx"), F.col("y").alias("ty")), "block_id", first_reach)
    return shared.unionByName(far.select(F.col("near_id").alias("id"), F.col("pop").cast("double").alias("pop"))).groupBy("id").agg(F.sum("pop").alias("pop"))


def proxy_population(edges: DataFrame) -> DataFrame:
    """id, pop: half of the length of residential streets at each end, where there is no census."""
    half = edges.where(F.col("cls").isin("quiet_street", "moderate_street")).select(F.explode(F.array("u", "v")).alias("id"), (F.col("length") / 2).alias("m"))
    return half.groupBy("id").agg(F.sum("m").alias("pop"))


def towns_of_lines(probes: DataFrame, towns: DataFrame, key: str) -> DataFrame:
    """key, towns: comma list of the towns that a line's first, middle and last points lie in, in that order."""
    hits = points_in_rings(probes, towns.select("town_id", "town", "rings"), even_odd=False)
    first = hits.groupBy(key, "town").agg(F.min(F.struct("probe", "town_id")).alias("o"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "town"))), lambda t: t["town"]), ", ").alias("towns"))


def amend_or_insert(reports: DataFrame, marks: DataFrame, within: float = 20.0) -> DataFrame:
    """report_id, mark_id, amended: the first mark (by ord) within reach is amended, else a new one is made."""
    hit = nearest_first(reports, marks, within)
    return reports.join(hit, "report_id", "left").select("report_id", F.coalesce("mark_id", -F.col("report_id")).alias("mark_id"), F.col("mark_id").isNotNull().alias("amended"))


def nearest_first(reports: DataFrame, marks: DataFrame, within: float) -> DataFrame:
    r = reports.select("report_id", "x", "y").withColumn("_cx", F.explode(_cells(F.col("x") - within, F.col("x") + within, within))).withColumn("_cy", F.explode(_cells(F.col("y") - within, F.col("y") + within, within)))
    m = marks.select("mark_id", "ord", "mx", "my", F.floor(F.col("mx") / within).cast("bigint").alias("_cx"), F.floor(F.col("my") / within).cast("bigint").alias("_cy"))
    near = r.join(m, ["_cx", "_cy"]).where((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) < num(within * within))
    return near.groupBy("report_id").agg(F.min_by("mark_id", F.struct("ord", "mark_id")).alias("mark_id"))


def near_pairs(places: DataFrame, lon_reach: float, lat_reach: float) -> DataFrame:
    """keep_id, drop_id of places (id, lon, lat) closer than both reaches, the lower id kept. Spark's estimates know nothing of the rows that
    explode makes, so the join is told not to broadcast a side."""
    around = lambda c, reach: F.explode(F.sequence(F.floor(F.col(c) / reach) - 1, F.floor(F.col(c) / reach) + 1))
    a = places.select(F.col("id").alias("keep_id"), F.col("lon").alias("alon"), F.col("lat").alias("alat")).withColumn("_cx", around("alon", lon_reach)).withColumn("_cy", around("alat", lat_reach))
    b = places.select(F.col("id").alias("drop_id"), F.col("lon").alias("blon"), F.col("lat").alias("blat"), F.floor(F.col("lon") / lon_reach).alias("_cx"), F.floor(F.col("lat") / lat_reach).alias("_cy"))
    near = (F.col("keep_id") < F.col("drop_id")) & (F.abs(F.col("alon") - F.col("blon")) < lon_reach) & (F.abs(F.col("alat") - F.col("blat")) < lat_reach)
    return a.join(b.hint("merge"), ["_cx", "_cy"]).where(near).select("keep_id", "drop_id")
