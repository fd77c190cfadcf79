import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import spatial

LINE = "array<struct<x:double,y:double>>"


def drawn(seed, n, longest, span=1500.0):
    draw, out = random.Random(seed), []
    for _ in range(n):
        x, y, points = draw.uniform(-span, span), draw.uniform(-span, span), []
        for _ in range(draw.randint(1, longest)):
            points.append((x, y))
            if draw.random() < 0.9:
                x, y = x + draw.uniform(-300, 300), y + draw.uniform(-300, 300)
        out.append(points)
    return out


def foot(p, a, b):
    l2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / l2)) if l2 else 0.0
    q = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
    return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, t


def at(line, m):
    for a, b in zip(line, line[1:]):
        d = math.dist(a, b)
        if d > 0 and m <= d + 1e-12:
            return a[0] + (b[0] - a[0]) * m / d, a[1] + (b[1] - a[1]) * m / d
        m -= d
    return line[-1]


def chord(line, p):
    best, run, whole = None, 0.0, sum(map(math.dist, line, line[1:]))
    for a, b in zip(line, line[1:]):
        d2, t = foot(p, a, b)
        if math.dist(a, b) > 0:
            best = min(best or (d2, 0), (d2, run + t * math.dist(a, b))) if best else (d2, run + t * math.dist(a, b))
        run += math.dist(a, b)
    if best is None:
        return None
    a, b = at(line, max(0.0, best[1] - 6)), at(line, min(whole, best[1] + 6))
    return math.degrees(math.atan2(b[1] - a[1], b[0] - a[0])) % 180


def test_points_near_bent_lines_are_all_found_once(spark):
    lines = drawn(1, 120, 9)
    draw = random.Random(2)
    points = [(draw.uniform(-1800, 1800), draw.uniform(-1800, 1800)) for _ in range(600)]
    table = spark.createDataFrame(list(enumerate(lines)), f"line_id long, line {LINE}")
    got = spatial.points_near_lines(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double"), table, ["id"], "line_id", 40.0).collect()
    want = {}
    for i, p in enumerate(points):
        for j, line in enumerate(lines):
            d2 = min(foot(p, a, b)[0] for a, b in (zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]))
            if d2 <= 1600:
                want[i, j] = d2
    assert len(got) == len(want) and all(want[r["id"], r["line_id"]] == pytest.approx(r["d2"]) for r in got)


def test_a_long_slanting_line_takes_cells_along_it_only(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 10_000.0, 9_000.0), (0.0, 0.0, 0.0, 10_000.0)], "ax double, ay double, bx double, by double")
    cells = spatial.supercover(rows, 20.0, 100.0).groupBy("bx").count().collect()
    assert all(r["count"] < 450 for r in cells)  # its box has 9,000


def test_matching_by_chords_against_every_pair(spark):
    streets, facilities = drawn(5, 90, 5, 700.0), drawn(6, 60, 7, 700.0)
    classes = ["path" if i % 3 == 0 else "lane" for i in range(60)]
    e = spark.createDataFrame([(i, i + 1, 0, i % 2 == 0, line) for i, line in enumerate(streets)], f"u long, v long, k int, is_pathlike boolean, line {LINE}")
    f = spark.createDataFrame([(j, c, line) for j, (c, line) in enumerate(zip(classes, facilities))], f"facility_id long, cls string, line {LINE}")
    got = {r["u"]: r["facility_id"] for r in spatial.match_lines(e, f, radius=60.0).collect()}
    want = {}
    for i, street in enumerate(streets):
        mid = at(street, sum(map(math.dist, street, street[1:])) / 2)
        own, best = chord(street, mid), None
        for j, line in enumerate(facilities):
            d2 = min(foot(mid, a, b)[0] for a, b in (zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]))
            other = chord(line, mid)
            if d2 > 3600 or own is None or other is None or (classes[j] == "path" and i % 2):
                continue
            turn = abs(own - other) % 180
            if min(turn, 180 - turn) <= 30:
                best = min(best or (d2, j), (d2, j))
        if best:
            want[i] = best[1]
    assert got == want and len(want) > 5


def test_midpoints(spark):
    lines = [[], [(1.0, 2.0)], [(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (10.0, 0.0), (10.0, 30.0)]]
    rows = spark.createDataFrame([(line,) for line in lines], f"line {LINE}")
    got = [r["m"] and (r["m"]["x"], r["m"]["y"]) for r in rows.select(geo.plane_midpoint(F.col("line")).alias("m")).collect()]
    assert got == [None, (1.0, 2.0), (0.0, 0.0), (10.0, 10.0)]


def test_distances_from_lines_round_as_counted_from_their_start(spark):
    """Both lines pass through the street's middle; SQL, which counts from a line's start, finds 874 nearer by a rounding."""
    bent = lambda x: [(x, 0.0), (x + 190.0, 0.0), (x + 190.0, 195.0)]
    lines = spark.createDataFrame([(46, "separated", bent(1393.0)), (874, "separated", bent(1396.0))], f"facility_id long, cls string, line {LINE}")
    streets = spark.createDataFrame([(14, 15, 0, False, [(1372.0, 0.0), (1470.0, 0.0)]), (15, 16, 0, False, [(1470.0, 0.0), (1568.0, 0.0)])], f"u long, v long, k int, is_pathlike boolean, line {LINE}")
    off = lambda m, x: (m - x) / 190.0 * 190.0 - (m - x)
    assert all(off(m, 1393.0) ** 2 > off(m, 1396.0) ** 2 == 0 for m in (1421.0, 1519.0))
    assert {(r["u"], r["facility_id"]) for r in spatial.match_lines(streets, lines).collect()} == {(14, 874), (15, 874)}


def test_near_pairs_do_not_broadcast_the_rows_they_multiply(spark):
    places = spark.range(1, 4).selectExpr("id", "CASE id WHEN 1 THEN 0D WHEN 2 THEN 0.0005D ELSE 0.01D END AS lon", "CASE id WHEN 2 THEN 0.0001D ELSE 0D END AS lat")
    pairs = spatial.near_pairs(places, 0.0007, 0.0003)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
