"""Geometry as column expressions: five ways to measure, bearings, projections, rings and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M_LON, M_LAT = 111320.0, 110540.0


def num(x: float) -> Column:
    return F.lit(float(x))


def flat_distance(lon1, lat1, lon2, lat2, at_lat) -> Column:
    """Metres on a plane whose east-west scale is that of latitude `at_lat` (of the query, the start or the mean)."""
    dx = (lon2 - lon1) * F.cos(F.radians(at_lat)) * M_LON
    dy = (lat2 - lat1) * M_LAT
    return F.sqrt(dx * dx + dy * dy)


def mean_lat_distance(lon1, lat1, lon2, lat2) -> Column:
    return flat_distance(lon1, lat1, lon2, lat2, (lat1 + lat2) / 2)


def compass_bearing(lon1, lat1, lon2, lat2) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * M_LON
    return F.pmod(F.degrees(F.atan2(dx, (lat2 - lat1) * M_LAT)), num(360))


def turn_angle(before: Column, after: Column) -> Column:
    """Signed turn between two bearings, above -180 up to 180; negative is left."""
    d = F.pmod(after - before + 540, num(360)) - 180
    return F.when(d == -180, num(180)).otherwise(d)


def line_bearing(dx: Column, dy: Column) -> Column:
    """Undirected bearing of a vector, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), num(180))


def undirected_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), num(180))
    return F.least(d, 180 - d)


def along_segment(px, py, ax, ay, bx, by) -> Column:
    """Where the foot of a point lies on a segment: 0 at its start, 1 at its end."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length2, num(0))
    return F.coalesce(F.greatest(num(0), F.least(num(1), t)), num(0))


def segment_distance2(px, py, ax, ay, bx, by) -> Column:
    """Square of the distance from a point to a segment in plane coordinates."""
    t = along_segment(px, py, ax, ay, bx, by)
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return dx * dx + dy * dy


def offset_distance2(px, py, ax, ay, bx, by) -> Column:
    """segment_distance2 counted from the segment's start, so that points which lie alike beside two like segments have the
    same distance from them wherever these are on the map."""
    t = along_segment(px, py, ax, ay, bx, by)
    dx, dy = t * (bx - ax) - (px - ax), t * (by - ay) - (py - ay)
    return dx * dx + dy * dy


def ring_crossings(px: Column, py: Column, ring: Column) -> Column:
    """How many sides of a ring (array of struct x, y) a ray to the east crosses."""
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))

    def side(a: Column, b: Column) -> Column:
        crosses = (a["y"] > py) != (b["y"] > py)
        x = a["x"] + (py - a["y"]) / F.nullif(b["y"] - a["y"], num(0)) * (b["x"] - a["x"])
        return F.when(crosses & (px < x), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, following, side), F.lit(0), lambda s, v: s + v)


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    touch = F.zip_with(ring, following, lambda a, b: segment_distance2(px, py, a["x"], a["y"], b["x"], b["y"]) == 0)
    return F.exists(touch, lambda t: t)


def in_any_ring(px: Column, py: Column, rings: Column) -> Column:
    """In at least one ring, each tested on its own."""
    return F.exists(rings, lambda r: ring_crossings(px, py, r) % 2 == 1)


def in_rings_even_odd(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd over all rings at once, so holes are outside."""
    return F.aggregate(rings, F.lit(0), lambda s, r: s + ring_crossings(px, py, r)) % 2 == 1


def length_midpoint(line: Column) -> Column:
    """The point halfway along a line (array of struct x, y in degrees) by its length on the ground."""
    kx = F.cos(F.radians(line[0]["y"]))
    spans = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.sqrt(F.pow((b["x"] - a["x"]) * kx, num(2)) + F.pow(b["y"] - a["y"], num(2))).alias("s")))
    half = F.aggregate(spans, num(0), lambda t, p: t + p["s"]) / 2

    def step(state: Column, p: Column) -> Column:
        here = F.when(p["s"] > 0, (half - state["run"]) / p["s"]).otherwise(num(0))
        point = F.struct((p["a"]["x"] + (p["b"]["x"] - p["a"]["x"]) * here).alias("x"), (p["a"]["y"] + (p["b"]["y"] - p["a"]["y"]) * here).alias("y"))
        hit = state["at"].isNull() & (state["run"] + p["s"] >= half)
        return F.struct((state["run"] + p["s"]).alias("run"), F.when(hit, point).otherwise(state["at"]).alias("at"))

    start = F.struct(num(0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    last = F.element_at(line, -1)
    return F.when(F.size(line) < 2, line[0]).otherwise(F.coalesce(F.aggregate(spans, start, step, lambda s: s["at"]), last))


def plane_midpoint(line: Column) -> Column:
    """The point halfway along a line (array of struct x, y in metres), null for an empty one."""
    following = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    spans = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), following, lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("m")))
    half = F.aggregate(spans, num(0), lambda t, p: t + p["m"]) / 2

    def step(state: Column, p: Column) -> Column:
        share = F.when(p["m"] > 0, (half - state["run"]) / p["m"]).otherwise(num(0))
        here = F.struct((p["a"]["x"] + (p["b"]["x"] - p["a"]["x"]) * share).alias("x"), (p["a"]["y"] + (p["b"]["y"] - p["a"]["y"]) * share).alias("y"))
        hit = state["at"].isNull() & (state["run"] + p["m"] >= half)
        return F.struct((state["run"] + p["m"]).alias("run"), F.when(hit, here).otherwise(state["at"]).alias("at"))

    start = F.struct(num(0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    return F.when(F.size(line) > 0, F.coalesce(F.aggregate(spans, start, step, lambda s: s["at"]), F.struct(line[0]["x"].alias("x"), line[0]["y"].alias("y"))))


def cell(value: Column, origin: float, step: float) -> Column:
    """Floor, never cast: coordinates may be negative."""
    return F.floor((value - num(origin)) / num(step)).cast("bigint")


def slippy_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Web map tile of a point at a zoom."""
    n = F.pow(num(2), zoom)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / num(math.pi)) / 2 * n)
    return x.cast("bigint"), y.cast("bigint")


# The state plane zone EPSG:26986 on GRS80.
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _LAT1, _LAT2, _FE, _FN = 41.0, -71.5, 42 + 41 / 60, 41 + 43 / 60, 200000.0, 750000.0
_E = math.sqrt(2 * _F - _F * _F)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


LCC_N = (math.log(_m(math.radians(_LAT1))) - math.log(_m(math.radians(_LAT2)))) / (math.log(_t(math.radians(_LAT1))) - math.log(_t(math.radians(_LAT2))))
LCC_AF = _A * _m(math.radians(_LAT1)) / (LCC_N * _t(math.radians(_LAT1)) ** LCC_N)
LCC_R0 = LCC_AF * _t(math.radians(_LAT0)) ** LCC_N


def state_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels: metres east and north."""
    phi = F.radians(lat)
    s = F.sin(phi) * num(_E)
    t = F.tan(num(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), num(_E / 2))
    r = F.pow(t, num(LCC_N)) * num(LCC_AF)
    theta = F.radians(lon - num(_LON0)) * num(LCC_N)
    return r * F.sin(theta) + num(_FE), num(LCC_R0) - r * F.cos(theta) + num(_FN)


def state_plane_sql(lon: str, lat: str) -> tuple[str, str]:
    s = f"({_E!r} * sin(radians({lat})))"
    t = f"(tan({math.pi / 4!r} - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {_E / 2!r}))"
    r = f"({LCC_AF!r} * pow({t}, {LCC_N!r}))"
    theta = f"(radians({lon} - ({_LON0!r})) * {LCC_N!r})"
    return f"({r} * sin({theta}) + {_FE!r})", f"({LCC_R0!r} - {r} * cos({theta}) + {_FN!r})"


def chord_bearing(line: Column, x: Column, y: Column, chord: float = 6.0) -> Column:
    """Bearing (0 to 180, from the x axis) of a polyline, an array of (x, y), about its point nearest to (x, y): that of
    the chord from `chord` before it to `chord` after it along the line; null for a line without length."""
    legs = F.transform(F.slice(line, 1, F.size(line) - 1), lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), F.get(line, i + 1)["x"].alias("bx"), F.get(line, i + 1)["y"].alias("by")))
    long = F.filter(F.transform(legs, lambda s: s.withField("m", F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]))), lambda s: s["m"] > 0)

    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def placed(s):
        starts = F.transform(s, lambda leg, i: F.aggregate(F.slice(s, 1, i), F.lit(0.0), lambda t, o: t + o["m"]))
        return F.zip_with(s, starts, lambda leg, at: leg.withField("at", at))

    def along(s):
        def foot(leg):
            t = ((x - leg["ax"]) * (leg["bx"] - leg["ax"]) + (y - leg["ay"]) * (leg["by"] - leg["ay"])) / (leg["m"] * leg["m"])
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
            dx, dy = t * (leg["bx"] - leg["ax"]) - (x - leg["ax"]), t * (leg["by"] - leg["ay"]) - (y - leg["ay"])
            return F.struct((dx * dx + dy * dy).alias("d2"), (leg["at"] + t * leg["m"]).alias("along"))

        return F.array_min(F.transform(s, foot))["along"]

    def point(s, at):
        leg = F.element_at(F.filter(s, lambda leg, i: (leg["at"] <= at) | (i == 0)), -1)
        return let(leg, lambda leg: let(F.least(F.lit(1.0), (at - leg["at"]) / leg["m"]), lambda t: F.struct((leg["ax"] + t * (leg["bx"] - leg["ax"])).alias("x"), (leg["ay"] + t * (leg["by"] - leg["ay"])).alias("y"))))

    def bearing(s):
        whole = F.element_at(s, -1)["at"] + F.element_at(s, -1)["m"]
        ends = let(along(s), lambda d: F.struct(point(s, F.greatest(F.lit(0.0), d - chord)).alias("a"), point(s, F.least(whole, d + chord)).alias("b")))
        return let(ends, lambda e: F.pmod(F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"])), F.lit(180.0)))

    return F.when(F.size(long) > 0, let(placed(long), bearing))
