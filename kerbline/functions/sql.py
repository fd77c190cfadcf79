"""The library from SQL text: geometry and prices as SQL functions, searches and rides as table functions.

register(spark) makes them known to a session. The scalar functions are SQL expressions that the optimizer puts into the query, so they
cost what the columns of `functions.geo` cost. The table functions take a table, partitioned by what belongs together:

    SELECT * FROM route_costs(TABLE(SELECT ...) PARTITION BY (network))
    SELECT * FROM ride_events_of(TABLE(SELECT ...) PARTITION BY (ride_id) ORDER BY (seq))

route_costs settles one network in one task, which holds that network and one query's costs, so a network is a town or a
tile; operators.search is for what is larger. ride_events_of holds one ride's small state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import M_LAT, M_LON, state_plane_sql
from kerbline.operators import search
from kerbline.streaming.ride_state import Ride, advance


def _double(*names: str) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names)


def _multipliers(profile: str) -> str:
    mult, lane, buffered, *_ = dims.PROFILES[profile]
    known = " ".join(f"WHEN cls = '{c}' THEN {m!r}D" for c, m in mult.items())
    return f"WHEN profile = '{profile}' THEN CASE WHEN road_busy AND cls = 'lane' THEN {lane!r}D WHEN road_busy AND cls = 'buffered' THEN {buffered!r}D {known} END"


def _foot() -> str:
    return "coalesce(greatest(0D, least(1D, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0D))), 0D)"


#: name: (parameters, type, expression)
SCALARS: dict[str, tuple[str, str, str]] = {
    "ground_distance": (_double("lon1", "lat1", "lon2", "lat2"), "DOUBLE", f"sqrt(pow((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) * {M_LON!r}D, 2) + pow((lat2 - lat1) * {M_LAT!r}D, 2))"),
    "compass_bearing": (_double("lon1", "lat1", "lon2", "lat2"), "DOUBLE", f"pmod(degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) * {M_LON!r}D, (lat2 - lat1) * {M_LAT!r}D)), 360D)"),
    "turn_angle": (_double("arriving", "leaving"), "DOUBLE", "CASE WHEN pmod(leaving - arriving + 540D, 360D) = 0D THEN 180D ELSE pmod(leaving - arriving + 540D, 360D) - 180D END"),
    "undirected_difference": (_double("a", "b"), "DOUBLE", "least(pmod(abs(a - b), 180D), 180D - pmod(abs(a - b), 180D))"),
    "segment_distance": (_double("px", "py", "ax", "ay", "bx", "by"), "DOUBLE", f"sqrt(pow(px - (ax + {_foot()} * (bx - ax)), 2) + pow(py - (ay + {_foot()} * (by - ay)), 2))"),
    "map_tile_x": ("lon DOUBLE, zoom INT", "BIGINT", "CAST(floor((lon + 180D) / 360D * pow(2D, zoom)) AS BIGINT)"),
    "map_tile_y": ("lat DOUBLE, zoom INT", "BIGINT", "CAST(floor((1D - asinh(tan(radians(lat))) / pi()) / 2D * pow(2D, zoom)) AS BIGINT)"),
    "state_plane_x": (_double("lon", "lat"), "DOUBLE", state_plane_sql("lon", "lat")[0]),
    "state_plane_y": (_double("lon", "lat"), "DOUBLE", state_plane_sql("lon", "lat")[1]),
    "stress_multiplier": ("profile STRING, cls STRING, road_busy BOOLEAN", "DOUBLE", "CASE " + " ".join(map(_multipliers, dims.PROFILES)) + " END"),
    "is_kid_safe": ("multiplier DOUBLE", "BOOLEAN", f"coalesce(multiplier, 99D) <= {dims.KID_SAFE_MAX!r}D"),
}

_COSTS = "mode string, query long, node long, cost double, prev long"


class RouteCosts:
    """Rows of a network: its arcs (query null, u, v, weight) and starts (query, u, weight: the cost there, v null).

    A partition may come in several batches, so arcs and starts are gathered and settled at its end, one query at a time.
    """

    def __init__(self) -> None:
        self.out_of: dict[int, list] = {}
        self.starts: dict[tuple, list] = {}
        self.modes: dict[str, dict] = {}

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for mode, query, u, v, weight in zip(*(batch.column(c).to_pylist() for c in ("mode", "query", "u", "v", "weight"))):
            if query is None:
                best = self.modes.setdefault(mode, {})
                best[u, v] = min(weight, best.get((u, v), weight))
            else:
                self.starts.setdefault((mode, query), []).append((search.OFFER, [u], [-1], [weight]))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        arcs: dict[str, dict[int, list]] = {}
        for mode, least in self.modes.items():
            for (u, v), w in least.items():
                arcs.setdefault(mode, {}).setdefault(u, []).append((v, w, u))
        for (mode, query), rows in self.starts.items():
            best, prev, _ = search._settled(0, arcs.get(mode, {}), {}, rows, float("inf"))
            nodes = list(best)
            yield pa.table(
                {"mode": pa.array([mode] * len(nodes), pa.string()), "query": pa.array([query] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.int64()), "cost": pa.array(list(best.values()), pa.float64()), "prev": pa.array([None if prev[n] < 0 else prev[n] for n in nodes], pa.int64())}
            )


class RideEventsOf:
    """A ride's fixes in order -> what each of them causes. Columns as for streaming.rides."""

    def __init__(self) -> None:
        self.ride = Ride()

    def eval(self, row) -> Iterator[tuple]:
        held = row.asDict()
        if held["seq"] <= self.ride.last_seq:
            return
        self.ride.last_seq = held["seq"]
        values = (held[c] for c in ("t_s", "lon", "lat", "accuracy", "speed", "heading", "along_m", "off_m", "cls", "route_m"))
        for place, (event, value) in enumerate(advance(self.ride, *values, held.get("turns") or [], held.get("hazards") or [])):
            yield held["ride_id"], held["seq"], place, event, float(value)


def register(spark: SparkSession) -> None:
    """Makes every function known to the session, under names that hold for the session only."""
    for name, (parameters, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("route_costs", F.arrow_udtf(RouteCosts, returnType=_COSTS))
    spark.udtf.register("ride_events_of", F.udtf(RideEventsOf, returnType="ride_id long, seq long, place int, event string, value double"))
