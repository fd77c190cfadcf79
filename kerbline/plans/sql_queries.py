"""Queries written as SQL text over the registered functions, with the answers of the DataFrame queries."""

from __future__ import annotations

from kerbline.functions import sql
from kerbline.plans import grid, ride_queries
from kerbline.plans.graph_queries import _SP, _starts, arcs
from kerbline.plans.registry import query


@query("sql_geometry", grid.sql(""", e AS (SELECT e.u, e.v, e.k, e.cls, e.road_busy, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM edge e JOIN node a ON a.id = e.u JOIN node b ON b.id = e.v)
SELECT u, v, k, round(sqrt(pow((blon - alon) * cos(radians((alat + blat) / 2)) * 111320, 2) + pow((blat - alat) * 110540, 2)), 6) AS metres, round((degrees(atan2((blon - alon) * cos(radians((alat + blat) / 2)) * 111320, (blat - alat) * 110540)) + 360) % 360, 6) AS bearing,
  floor((alon + 180) / 360 * 32768)::BIGINT AS tile_x, floor((1 - asinh(tan(radians(alat))) / pi()) / 2 * 32768)::BIGINT AS tile_y, CASE WHEN road_busy AND e.cls = 'lane' THEN 10 WHEN road_busy AND e.cls = 'buffered' THEN 6 ELSE kids END <= 2 AS safe,
  round(CASE WHEN ax = bx THEN abs(ax - 1000) ELSE greatest(0, least(ax, bx) - 1000, 1000 - greatest(ax, bx)) END, 6) AS off_line FROM e JOIN mult USING (cls)"""))
def sql_geometry(spark, folder):
    """Distance, bearing, map tile and safety of every street, and how far it lies from a meridian of the plane."""
    sql.register(spark)
    placed, at = grid.placed_edges(spark, folder), grid.nodes(spark, folder)
    text = """SELECT e.u, e.v, e.k, round(ground_distance(a.lon, a.lat, b.lon, b.lat), 6) AS metres, round(compass_bearing(a.lon, a.lat, b.lon, b.lat), 6) AS bearing, map_tile_x(a.lon, 15) AS tile_x, map_tile_y(a.lat, 15) AS tile_y,
      is_kid_safe(stress_multiplier('young_kids', e.cls, e.road_busy)) AS safe, round(segment_distance(1000D, e.ay, e.ax, e.ay, e.bx, e.ay), 6) AS off_line
      FROM {streets} e JOIN {nodes} a ON a.id = e.u JOIN {nodes} b ON b.id = e.v"""
    return spark.sql(text, streets=placed, nodes=at)


@query("sql_route_costs", grid.sql(f", {_SP} SELECT q AS query, node, round(d, 3) AS cost FROM sp", recursive=True))
def sql_route_costs(spark, folder):
    """The costs of shortest_path_cost by a table function; each start is dealt to a partition of its own with the network."""
    sql.register(spark)
    text = """WITH network AS (SELECT q.query AS part, a.mode, CAST(NULL AS BIGINT) AS query, a.u, a.v, a.weight FROM {arcs} a CROSS JOIN (SELECT DISTINCT query % 8 AS query FROM {starts}) q
      UNION ALL SELECT query % 8, mode, query, node, CAST(NULL AS BIGINT), cost FROM {starts})
      SELECT query, node, round(cost, 3) AS cost FROM route_costs(TABLE(SELECT * FROM network) PARTITION BY part)"""
    return spark.sql(text, arcs=arcs(spark, folder).select("mode", "u", "v", "weight"), starts=_starts(spark, folder))


@query("sql_ride_events", ride_queries._MARKED)
def sql_ride_events(spark, folder):
    """The events of ride_events by a table function over each ride's fixes in order."""
    sql.register(spark)
    return spark.sql("SELECT * FROM ride_events_of(TABLE(SELECT * FROM {fixes}) PARTITION BY ride_id ORDER BY seq)", fixes=ride_queries._guided(spark, folder))
