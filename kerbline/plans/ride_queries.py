"""Queries on rides, from the derived position fixes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import num
from kerbline.operators import spatial
from kerbline.plans import grid
from kerbline.plans.lineage import scratch
from kerbline.plans.registry import query
from kerbline.streaming import rides

_D = "sqrt(pow(({0}.lon - {1}.lon) * cos(radians(({0}.lat + {1}.lat) / 2)) * 111320, 2) + pow(({0}.lat - {1}.lat) * 110540, 2))"
#: The same rules one fix after another: plausibility, the recorder's two ways of measuring, smoothed speed.
_STATE = f"""st(ride_id, seq, lon, lat, strange, ok, t_s, started, base, top, banked, gained, alon, alat, at_s, speed, mlon, mlat, fix_t, head) AS (
  SELECT ride_id, seq, lon, lat, 0, true, t_s, true, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, lon, lat, t_s, coalesce(speed, 0.0::DOUBLE), lon, lat, t_s, CASE WHEN coalesce(speed, 0) > 0.7 THEN heading END FROM fix WHERE seq = 1
  UNION ALL SELECT ride_id, seq, CASE WHEN ok THEN nlon ELSE lon END, CASE WHEN ok THEN nlat ELSE lat END, strange, ok, t_s, true,
    CASE WHEN ok AND on_route AND (base IS NULL OR along < base - 50) THEN along ELSE base END,
    CASE WHEN ok AND on_route AND (base IS NULL OR along < base - 50 OR along > top) THEN along ELSE top END,
    CASE WHEN ok AND on_route AND along < base - 50 THEN banked + top - base WHEN ok AND NOT on_route AND t_s - at_s >= 10 AND span >= 12 THEN banked + span ELSE banked END,
    CASE WHEN NOT ok THEN 0 WHEN on_route AND base IS NOT NULL AND along >= base - 50 AND along > top THEN along - top WHEN NOT on_route AND t_s - at_s >= 10 AND span >= 12 THEN span ELSE 0 END,
    CASE WHEN ok AND NOT on_route AND t_s - at_s >= 10 THEN nlon ELSE alon END, CASE WHEN ok AND NOT on_route AND t_s - at_s >= 10 THEN nlat ELSE alat END, CASE WHEN ok AND NOT on_route AND t_s - at_s >= 10 THEN t_s ELSE at_s END,
    CASE WHEN NOT ok THEN speed WHEN nspeed IS NOT NULL THEN CASE WHEN speed = 0 THEN nspeed ELSE speed * 0.6::DOUBLE + nspeed * 0.4::DOUBLE END WHEN t_s - fix_t > 0.2 AND v < 25 THEN CASE WHEN speed = 0 THEN v ELSE speed * 0.7::DOUBLE + v * 0.3::DOUBLE END ELSE speed END,
    CASE WHEN ok AND moved > 3 THEN nlon ELSE mlon END, CASE WHEN ok AND moved > 3 THEN nlat ELSE mlat END, CASE WHEN ok THEN t_s ELSE fix_t END,
    CASE WHEN NOT ok THEN head WHEN nheading IS NOT NULL AND coalesce(nspeed, 0) > 0.7 THEN nheading WHEN moved > 5 THEN (degrees(atan2((nlon - mlon) * cos(radians((nlat + mlat) / 2)) * 111320, (nlat - mlat) * 110540)) % 360 + 360) % 360 ELSE head END
  FROM (SELECT p.*, CASE WHEN jump > 500 THEN p.strange0 + 1 ELSE 0 END AS strange, NOT (jump > 500 AND p.strange0 + 1 < 3) AS ok, moved / nullif(t_s - fix_t, 0) AS v
    FROM (SELECT s.ride_id, n.seq, s.lon, s.lat, n.lon AS nlon, n.lat AS nlat, s.strange AS strange0, n.t_s, s.base, s.top, s.banked, s.alon, s.alat, s.at_s, s.speed, s.head, n.speed AS nspeed, n.heading AS nheading, s.mlon, s.mlat, s.fix_t, n.along_m AS along, n.off_m <= 40 AS on_route,
      {_D.format('n', 's')} AS jump, sqrt(pow((n.lon - s.alon) * cos(radians((n.lat + s.alat) / 2)) * 111320, 2) + pow((n.lat - s.alat) * 110540, 2)) AS span, sqrt(pow((n.lon - s.mlon) * cos(radians((n.lat + s.mlat) / 2)) * 111320, 2) + pow((n.lat - s.mlat) * 110540, 2)) AS moved
      FROM st s JOIN fix n ON n.ride_id = s.ride_id AND n.seq = s.seq + 1) p))"""


@query("ride_fix_states", grid.sql(f", {_STATE} SELECT ride_id, seq, round(speed, 6) AS speed, round(banked + CASE WHEN base IS NULL THEN 0 ELSE top - base END, 3) AS total_m, round(head, 6) AS heading, ok AS plausible FROM st", recursive=True))
def ride_fix_states(spark, folder):
    return rides.fix_states(grid.fixes(spark, folder)).select("ride_id", "seq", F.round("speed", 6).alias("speed"), F.round("total_m", 3).alias("total_m"), F.round("heading", 6).alias("heading"), "plausible")


@query("ride_high_water", grid.sql(f", {_STATE}, e AS (SELECT ride_id, arg_max(banked + CASE WHEN base IS NULL THEN 0 ELSE top - base END, seq) AS m FROM st GROUP BY 1) SELECT ride_id, floor(m + 0.5)::BIGINT AS meters FROM e WHERE m >= 200", recursive=True))
def ride_high_water(spark, folder):
    return rides.ride_summaries(grid.fixes(spark, folder)).select("ride_id", "meters")


_SUMMARY = f"""{_STATE}, g AS (SELECT ride_id, sum(gained) AS k, sum(gained) FILTER (cls IN ('path', 'separated', 'buffered')) AS p, sum(gained) FILTER (cls IN ('quiet_street', 'service')) AS q FROM st JOIN fix USING (ride_id, seq) GROUP BY 1),
e AS (SELECT ride_id, arg_max(banked + CASE WHEN base IS NULL THEN 0 ELSE top - base END, seq) AS m FROM st GROUP BY 1)"""


@query("ride_class_mix", grid.sql(f", {_SUMMARY} SELECT ride_id, CASE WHEN k > 0 THEN floor(100 * coalesce(p, 0) / k + 0.5)::BIGINT ELSE 0 END AS pct_protected, CASE WHEN k > 0 THEN floor(100 * coalesce(q, 0) / k + 0.5)::BIGINT ELSE 0 END AS pct_quiet FROM e JOIN g USING (ride_id) WHERE m >= 200", recursive=True))
def ride_class_mix(spark, folder):
    return rides.ride_summaries(grid.fixes(spark, folder)).select("ride_id", "pct_protected", "pct_quiet")


@query("ride_moving_time", grid.sql(f", o AS (SELECT a.ride_id, b.t_s - a.t_s AS dt, {_D.format('b', 'a')} AS d FROM fix a JOIN fix b ON b.ride_id = a.ride_id AND b.seq = a.seq + 1) SELECT f.ride_id, round(coalesce((SELECT sum(dt) FROM o WHERE o.ride_id = f.ride_id AND dt > 0 AND d >= 3 AND d / dt > 0.8), 0), 3) AS moving_s FROM (SELECT DISTINCT ride_id FROM fix) f"))
def ride_moving_time(spark, folder):
    return rides.moving_seconds(grid.fixes(spark, folder)).withColumn("moving_s", F.round("moving_s", 3))


@query("ride_sessions", grid.sql(", o AS (SELECT *, CASE WHEN t_s - lag(t_s) OVER (PARTITION BY ride_id ORDER BY seq) < 600 THEN 0 ELSE 1 END AS fresh FROM fix), p AS (SELECT *, sum(fresh) OVER (PARTITION BY ride_id ORDER BY seq) AS s FROM o) SELECT ride_id, epoch(min(ts))::BIGINT AS started, epoch(max(ts))::BIGINT AS ended, count(*) AS n FROM p GROUP BY ride_id, s"))
def ride_sessions(spark, folder):
    out = rides.sessions(grid.fixes(spark, folder))
    return out.select("ride_id", F.unix_timestamp("started").alias("started"), F.unix_timestamp("ended").alias("ended"), "n")


_RIDE = "ride AS (SELECT o_orderkey AS id, o_totalprice AS meters, (o_orderkey % 4000)::DOUBLE AS moving_s, strftime(o_orderdate, '%Y-%m-%d') AS started_at, o_custkey % 101 AS pct_protected FROM orders)"


@query("ride_totals", f"WITH {_RIDE} SELECT count(*) AS rides, floor(sum(meters) / 100 + 0.5)::BIGINT / 10 AS km, floor(sum(moving_s) / 360 + 0.5)::BIGINT / 10 AS moving_hours, floor(max(meters) / 100 + 0.5)::BIGINT / 10 AS longest_km, floor(coalesce(sum(meters) FILTER (starts_with(started_at, '1995-03')), 0) / 100 + 0.5)::BIGINT / 10 AS month_km, floor(sum(pct_protected * meters) / sum(meters) + 0.5)::BIGINT AS pct_protected FROM ride")
def ride_totals(spark, folder):
    o = grid.table(spark, folder, "orders")
    r = o.select(F.col("o_totalprice").alias("meters"), (F.col("o_orderkey") % 4000).cast("double").alias("moving_s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), (F.col("o_custkey") % 101).alias("pct_protected"))
    return rides.totals(r, "1995-03")


@query("newest_rides", f"WITH {_RIDE}, own AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS day_ FROM orders) SELECT owner, id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY day_ DESC, id) AS rn FROM own) WHERE rn <= 8")
def newest_rides(spark, folder):
    """The newest eight of each owner: the cap is the feature."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = grid.table(spark, folder, "orders").withColumn("_r", F.row_number().over(order))
    return o.where("_r <= 8").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"))


_SNAP = "seg AS (SELECT e.u, e.v, e.k, e.ax, e.ay, e.bx, e.by_ AS b_y, (e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay) AS l2 FROM pedge e WHERE u < v)"


@query("fix_street", grid.sql(f""", {_SNAP}, near AS (SELECT c.crash_id, u, v, k, t, pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (b_y - ay)), 2) AS d2 FROM (SELECT crash_id, x, y, seg.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / l2)) AS t FROM crash JOIN seg ON x BETWEEN least(ax, bx) - 50 AND greatest(ax, bx) + 50 AND y BETWEEN least(ay, b_y) - 50 AND greatest(ay, b_y) + 50) c)
SELECT crash_id, u, v, round(sqrt(d2), 3) AS off_m FROM (SELECT *, row_number() OVER (PARTITION BY crash_id ORDER BY d2, u, v, k) AS rn FROM near WHERE d2 <= 2500) WHERE rn = 1"""))
def fix_street(spark, folder):
    """Points matched to the nearest street within 50 m."""
    points = grid.crashes(spark, folder).select("crash_id", "x", "y")
    streets = grid.placed_edges(spark, folder).where("u < v").select("u", "v", "k", "ax", "ay", "bx", "by")
    best = spatial.points_near_segments(points, streets, 50.0).groupBy("crash_id").agg(F.min(F.struct("d2", "u", "v", "k")).alias("b"))
    return best.select("crash_id", "b.u", "b.v", F.round(F.sqrt("b.d2"), 3).alias("off_m"))


def _worked_off(spark, fixes: DataFrame, streamed, mode: str) -> DataFrame:
    """What a stream of the fixes gives, worked off in one go. Each batch has a folder of its own that a repeated
    batch replaces, so nothing is written twice."""
    at = scratch(spark, f"rides-{uuid.uuid4().hex}")
    fixes.write.parquet(f"{at}/fixes")
    source = spark.readStream.schema(spark.read.parquet(f"{at}/fixes").schema).parquet(f"{at}/fixes")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    run = streamed(source).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_ride_summaries", grid.sql(f", {_SUMMARY}, d AS (SELECT ride_id, floor(max(t_s) FILTER (ok) - min(t_s) + 0.5)::BIGINT AS duration_s FROM st GROUP BY 1), o AS (SELECT ride_id, t_s - lag(t_s) OVER w AS dt, sqrt(pow((lon - lag(lon) OVER w) * cos(radians((lat + lag(lat) OVER w) / 2)) * 111320, 2) + pow((lat - lag(lat) OVER w) * 110540, 2)) AS m FROM st WHERE ok WINDOW w AS (PARTITION BY ride_id ORDER BY seq)), v AS (SELECT ride_id, floor(coalesce(sum(dt) FILTER (dt > 0 AND m >= 3 AND m / dt > 0.8), 0) + 0.5)::BIGINT AS moving_s FROM o GROUP BY 1) SELECT ride_id, floor(m + 0.5)::BIGINT AS meters, duration_s, moving_s, CASE WHEN k > 0 THEN floor(100 * coalesce(p, 0) / k + 0.5)::BIGINT ELSE 0 END AS pct_protected, CASE WHEN k > 0 THEN floor(100 * coalesce(q, 0) / k + 0.5)::BIGINT ELSE 0 END AS pct_quiet FROM e JOIN g USING (ride_id) JOIN d USING (ride_id) JOIN v USING (ride_id) WHERE m >= 200", recursive=True))
def stream_ride_summaries(spark, folder):
    """The fixes as a stream; the newest summary of every ride."""
    out = _worked_off(spark, grid.fixes(spark, folder).drop("event_id"), rides.stream_summaries, "update")
    newest = out.groupBy("ride_id").agg(F.max_by(F.struct("meters", "duration_s", "moving_s", "pct_protected", "pct_quiet"), F.struct("batch", "meters")).alias("s"))
    return newest.select("ride_id", "s.*")


def _guided(spark, folder: str) -> DataFrame:
    """Fixes of rides along a route with turns and hazards."""
    n = F.col("ride_id")
    marks = lambda *at: F.array(*((F.lit(a) + n % 7 * 10).cast("double") for a in at))
    return grid.fixes(spark, folder).drop("event_id").withColumns({"turns": marks(120, 300, 620, 900), "hazards": marks(200, 480, 760)})


#: What is said, one plausible fix after another: idle stops, rerouting with a growing pause, milestones, arrival, turns and hazards.
_SAID = f"""{_STATE},
good AS (SELECT s.ride_id, s.seq, row_number() OVER w AS r, s.t_s, s.speed, f.accuracy, f.along_m AS along, f.off_m > 40 AS off_route, f.off_m <= 40 AS on_route, {{route}} AS route_m, {{turns}} AS turns, {{hazards}} AS hazards,
  s.t_s - lag(s.t_s) OVER w AS dt, sqrt(pow((s.lon - lag(s.lon) OVER w) * cos(radians((s.lat + lag(s.lat) OVER w) / 2)) * 111320, 2) + pow((s.lat - lag(s.lat) OVER w) * 110540, 2)) AS step
  FROM st s JOIN fix f ON f.ride_id = s.ride_id AND f.seq = s.seq WHERE s.ok WINDOW w AS (PARTITION BY s.ride_id ORDER BY s.seq)),
said(ride_id, r, moved_at, stopped, off_n, tries, rerouted_at, spoken_at, next_km, half, arrived, turn, stage, hazard, e) AS (
  SELECT ride_id, 0::BIGINT, 0.0::DOUBLE, true, 0, 0, -1e9::DOUBLE, -1e9::DOUBLE, 1::BIGINT, false, false, 0, 0, 0, []::STRUCT(event VARCHAR, value DOUBLE)[] FROM (SELECT DISTINCT ride_id FROM good)
  UNION ALL SELECT ride_id, r, moved, stopped2, CASE WHEN on_route OR reroute THEN 0 ELSE off2 END, CASE WHEN on_route THEN 0 WHEN reroute THEN tries + 1 ELSE tries END, CASE WHEN reroute THEN t_s ELSE rerouted_at END, CASE WHEN announce THEN t_s ELSE spoken_at END,
    km + new_km::INT, half2 OR new_half, arrived2 OR new_arrived, turn2, CASE WHEN call > 0 THEN call ELSE stage2 END, hazard2 + new_hazard::INT,
    list_filter([CASE WHEN idle THEN {{{{'event': 'idle', 'value': t_s}}}} END, CASE WHEN reroute THEN {{{{'event': 'reroute', 'value': t_s}}}} END, CASE WHEN announce THEN {{{{'event': 'announce', 'value': t_s}}}} END,
      CASE WHEN new_km THEN {{{{'event': 'kilometre', 'value': km::DOUBLE}}}} END, CASE WHEN new_half THEN {{{{'event': 'halfway', 'value': along}}}} END, CASE WHEN new_arrived THEN {{{{'event': 'arrived', 'value': along}}}} END,
      CASE WHEN call > 0 THEN {{{{'event': 'turn_' || call, 'value': turns[turn2 + 1]}}}} END, CASE WHEN new_hazard THEN {{{{'event': 'hazard', 'value': hazards[hazard2 + 1]}}}} END], lambda x: x IS NOT NULL)
  FROM (SELECT *, guided AND hazard2 < len(hazards) AND hazards[hazard2 + 1] - along <= 100 AS new_hazard, CASE WHEN NOT guided OR len(turns) = 0 THEN 0 WHEN stage2 < 3 AND ahead <= greatest(12, least(30, speed * 4)) THEN 3 WHEN stage2 < 2 AND ahead <= greatest(30, least(80, speed * 10)) THEN 2
      WHEN stage2 < 1 AND ahead <= greatest(60, least(200, speed * 25)) THEN 1 ELSE 0 END AS call, reroute AND t_s - spoken_at > 45 AS announce
    FROM (SELECT *, CASE WHEN turn2 = turn THEN stage ELSE 0 END AS stage2, greatest(0, turns[turn2 + 1] - along) AS ahead
      FROM (SELECT *, CASE WHEN guided THEN least(greatest(turn, least(len(turns) - 1, len(list_filter(turns, lambda x: x < along - 20)))), len(list_filter(turns, lambda x: x <= along + 20))) ELSE turn END::INT AS turn2, CASE WHEN guided THEN greatest(hazard, len(list_filter(hazards, lambda x: x < along - 10))) ELSE hazard END::INT AS hazard2
        FROM (SELECT *, on_route AND along IS NOT NULL AND NOT (arrived2 OR new_arrived) AS guided
          FROM (SELECT *, told AND along >= km * 1000 AS new_km, told AND NOT half2 AND route_m > 1500 AND along >= route_m / 2 AS new_half, told AND NOT arrived2 AND rest < 15 AS new_arrived
            FROM (SELECT *, CASE WHEN joined THEN floor(along / 1000)::BIGINT + 1 ELSE next_km END AS km, CASE WHEN joined THEN along >= route_m / 2 ELSE half END AS half2, arrived AND NOT (told AND rest > 80) AS arrived2, started AND NOT stopped1 AND t_s - moved >= 600 AS idle, stopped1 OR t_s - moved >= 600 AS stopped2,
                strike AND off2 >= 3 AND t_s - rerouted_at > 10 * least(pow(2, tries), 6) AS reroute
              FROM (SELECT *, told AND next_km = 1 AND along > 1500 AS joined, CASE WHEN NOT started OR walked THEN t_s ELSE moved_at END AS moved, CASE WHEN NOT started OR walked THEN false ELSE stopped END AS stopped1, off_n + strike::INT AS off2
                FROM (SELECT w.* EXCLUDE (r, e), g.* EXCLUDE (ride_id), g.r > 1 AS started, coalesce(g.dt > 0 AND g.step >= 3 AND g.step / g.dt > 0.8, false) AS walked, coalesce(g.off_route AND g.accuracy <= 50, false) AS strike,
                    coalesce(g.on_route AND g.along IS NOT NULL AND g.route_m IS NOT NULL, false) AS told, greatest(0, g.route_m - g.along) AS rest
                  FROM said w JOIN good g ON g.ride_id = w.ride_id AND g.r = w.r + 1))))))))),
told AS (SELECT g.ride_id, g.seq, unnest(range(len(e)))::INT AS place, unnest(e) AS x FROM said s JOIN good g ON g.ride_id = s.ride_id AND g.r = s.r)
SELECT ride_id, seq, place, x.event AS event, x.value AS value FROM told UNION ALL SELECT ride_id, seq, 0, 'implausible', t_s FROM st WHERE NOT ok"""
_MARKED = grid.sql(", " + _SAID.format(route="1500.0::DOUBLE", turns="list_transform([120, 300, 620, 900], lambda x: (x + s.ride_id % 7 * 10)::DOUBLE)", hazards="list_transform([200, 480, 760], lambda x: (x + s.ride_id % 7 * 10)::DOUBLE)"), recursive=True)


@query("ride_events", _MARKED)
def ride_events(spark, folder):
    """ride_id, seq, place, event, value: all that is said during each ride."""
    return rides.fix_events(_guided(spark, folder))


@query("stream_ride_events", _MARKED)
def stream_ride_events(spark, folder):
    """The same events from a stream of the fixes."""
    out = _worked_off(spark, _guided(spark, folder), rides.stream_events, "append")
    return out.select("ride_id", "seq", "place", "event", "value")


HALFWAY = 12  # fixes of each ride that a stream has seen when it is stopped


@query("rides_in_progress", grid.sql(f", {_STATE} SELECT ride_id, max(seq) AS seq, round(arg_max(banked + CASE WHEN base IS NULL THEN 0 ELSE top - base END, seq), 3) AS total_m, count(*) FILTER (ok) AS n_fixes FROM st WHERE seq <= {HALFWAY} GROUP BY 1", recursive=True))
def rides_in_progress(spark, folder):
    """The rides that a stream holds which was stopped after the first fixes of each."""
    at = scratch(spark, f"rides-{uuid.uuid4().hex}")
    grid.fixes(spark, folder).drop("event_id").where(F.col("seq") <= HALFWAY).write.parquet(f"{at}/fixes")
    source = spark.readStream.schema(spark.read.parquet(f"{at}/fixes").schema).parquet(f"{at}/fixes")
    rides.stream_summaries(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("noop").start().awaitTermination()
    return rides.in_progress(spark, f"{at}/state").select("ride_id", "seq", F.round("total_m", 3).alias("total_m"), "n_fixes")


@query("ride_watcher", grid.sql(f", kept(ride_id, seq, lon, lat, pass) AS (SELECT ride_id, seq, lon, lat, true FROM fix WHERE seq = 1 UNION ALL SELECT n.ride_id, n.seq, CASE WHEN d >= 3 THEN n.lon ELSE k.lon END, CASE WHEN d >= 3 THEN n.lat ELSE k.lat END, d >= 3 FROM (SELECT k.ride_id, k.seq, k.lon, k.lat, n.lon AS nlon, {_D.format('n', 'k')} AS d FROM kept k JOIN fix n ON n.ride_id = k.ride_id AND n.seq = k.seq + 1) k JOIN fix n ON n.ride_id = k.ride_id AND n.seq = k.seq + 1) SELECT ride_id, seq FROM kept WHERE pass", recursive=True))
def ride_watcher(spark, folder):
    """The fixes that lie at least 3 m from the last one passed on."""
    return rides.moved_fixes(grid.fixes(spark, folder))


@query("hazards_newest", grid.sql(" SELECT crash_id AS id, row_number() OVER (PARTITION BY year ORDER BY crash_id DESC) AS place FROM crash"))
def hazards_newest(spark, folder):
    order = Window.partitionBy("year").orderBy(F.desc("crash_id"))
    return grid.crashes(spark, folder).select(F.col("crash_id").alias("id"), F.row_number().over(order).alias("place"))


@query("places_upsert", "WITH p AS (SELECT c_name AS name, c_custkey AS v FROM customer), fresh AS (SELECT c_name AS name, c_custkey + 100000 AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'new ' || c_name, c_custkey FROM customer WHERE c_custkey % 5 = 0) SELECT name, v FROM fresh UNION ALL SELECT p.name, p.v FROM p ANTI JOIN fresh ON fresh.name = p.name")
def places_upsert(spark, folder):
    c = grid.table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("v"))
    fresh = c.where("v % 3 = 0").select("name", (F.col("v") + 100000).alias("v")).unionByName(c.where("v % 5 = 0").select(F.concat(F.lit("new "), "name").alias("name"), "v"))
    return fresh.unionByName(c.join(fresh.select("name"), "name", "left_anti"))
