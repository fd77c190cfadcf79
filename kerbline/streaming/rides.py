"""Rides from position fixes: as a stream with state by ride, or over a finished table in one sorted pass.

Both take fixes (ride_id, seq, t_s, lon, lat, accuracy, speed, heading, along_m, off_m, cls, route_m, and if there are
any turns and hazards: metres along the route, ascending) and run the same step for each fix, in the order of seq. The
table pass streams each sorted partition through and holds one ride's small state at a time, so a ride of any length
needs no more memory. In a stream the fixes of one trigger are put in order; a fix that comes in a later trigger than
one with its number or a higher one is late and dropped, as the state has moved on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.functions.geo import mean_lat_distance, num
from kerbline.functions.text import half_up
from kerbline.streaming.ride_state import IDLE_S, MIN_STEP_M, MOVING_M_S, Ride, advance, metres, summary

FIELDS = ("t_s", "lon", "lat", "accuracy", "speed", "heading", "along_m", "off_m", "cls", "route_m")
MARKS = ("turns", "hazards")
SUMMARY = "ride_id long, meters long, duration_s long, moving_s long, pct_protected long, pct_quiet long, n_points long"
EVENTS = "ride_id long, seq long, place int, event string, value double"
STATE = "ride_id long, seq long, speed double, heading double, total_m double, plausible boolean, events array<string>"


def _known(value):
    return None if value is None or value != value else value


def _steps(ride: Ride, rows: pd.DataFrame) -> Iterator[tuple[int, list]]:
    """(seq, events) of every fix that is not late."""
    columns = [rows[c].tolist() for c in FIELDS]
    marks = [[[] if v is None else list(v) for v in rows[c]] if c in rows else [[]] * len(rows) for c in MARKS]
    for seq, turns, hazards, *values in zip(rows["seq"].tolist(), *marks, *columns):
        if seq > ride.last_seq:
            ride.last_seq = seq
            yield seq, advance(ride, *map(_known, values), turns, hazards)


def _read(blob: str) -> Ride:
    held = json.loads(blob)
    return Ride(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})


def _pass(batches: Iterator[pd.DataFrame], emit) -> Iterator[pd.DataFrame]:
    key, ride, out = None, Ride(), []
    for batch in batches:
        for ride_id, rows in batch.groupby("ride_id", sort=False):
            if ride_id != key:
                if key is not None:
                    out += emit(key, ride, None, None)
                key, ride = ride_id, Ride()
            for seq, events in _steps(ride, rows):
                out += emit(key, ride, seq, events)
        if out:
            yield pd.DataFrame(out)
            out = []
    if key is not None:
        last = emit(key, ride, None, None)
        if last:
            yield pd.DataFrame(last)


def _sorted(fixes: DataFrame) -> DataFrame:
    return fixes.select("ride_id", "seq", *FIELDS, *(c for c in MARKS if c in fixes.columns)).repartition("ride_id").sortWithinPartitions("ride_id", "seq")


def ride_summaries(fixes: DataFrame) -> DataFrame:
    """One row for each ride of 200 m or more."""

    def emit(key, ride, seq, events):
        s = summary(ride) if seq is None else None
        return [] if s is None else [{"ride_id": key, **s}]

    return _sorted(fixes).mapInPandas(lambda it: _pass(it, emit), SUMMARY)


def fix_states(fixes: DataFrame) -> DataFrame:
    """What is known after each fix: smoothed speed, heading, metres so far, and the events it caused."""

    def emit(key, ride, seq, events):
        if seq is None:
            return []
        kinds = [k for k, _ in events]
        return [{"ride_id": key, "seq": seq, "speed": ride.speed, "heading": ride.heading, "total_m": ride.total, "plausible": "implausible" not in kinds, "events": kinds}]

    return _sorted(fixes).mapInPandas(lambda it: _pass(it, emit), STATE)


def fix_events(fixes: DataFrame) -> DataFrame:
    """ride_id, seq, place (among the fix's events), event, value: reroutes, announcements, kilometres, halfway, arrival, turns in three
    stages, hazards, idle stops and implausible fixes."""

    def emit(key, ride, seq, events):
        return [] if seq is None else [{"ride_id": key, "seq": seq, "place": i, "event": kind, "value": float(v)} for i, (kind, v) in enumerate(events)]

    return _sorted(fixes).mapInPandas(lambda it: _pass(it, emit), EVENTS)


def _streamed(fixes: DataFrame, emit, schema: str, mode: str, late: str) -> DataFrame:
    """emit(key, ride, seq or None at the end of a trigger or ride, events) for each ride of each trigger. A ride whose watermark
    has passed its last fix's event time (ts) by the idle time is forgotten."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ride, out = _read(state.get[0]) if state.exists else Ride(), []
        if state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for seq, events in _steps(ride, rows):
                out += emit(key[0], ride, seq, events)
            ride.event_ms = max(ride.event_ms, int(rows["event_ms"].max()))
            state.update((json.dumps(asdict(ride)),))
            state.setTimeoutTimestamp(max(ride.event_ms + int(IDLE_S * 1000), state.getCurrentWatermarkMs() + 1))
        out += emit(key[0], ride, None, None)
        if out:
            yield pd.DataFrame(out)

    timed = fixes.withWatermark("ts", late).withColumn("event_ms", F.unix_millis("ts"))
    return timed.groupBy("ride_id").applyInPandasWithState(step, schema, "ride string", mode, GroupStateTimeout.EventTimeTimeout)


def stream_summaries(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Summaries from a stream of fixes with an event-time column ts: each trigger updates the rides it touched, and a
    ride that is over gives its last summary."""

    def emit(key, ride, seq, events):
        s = summary(ride) if seq is None else None
        return [] if s is None else [{"ride_id": key, **s}]

    return _streamed(fixes, emit, SUMMARY, "update", late)


def stream_events(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The events of fix_events from a stream of fixes with an event-time column ts, as they happen."""

    def emit(key, ride, seq, events):
        return [] if seq is None else [{"ride_id": key, "seq": seq, "place": i, "event": kind, "value": float(v)} for i, (kind, v) in enumerate(events)]

    return _streamed(fixes, emit, EVENTS, "append", late)


_HELD = "start double, last_t double, base double, top double, banked double, last_seq long, n_fixes long, stopped boolean, arrived boolean"


def in_progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ride_id, seq (its last fix), started_s, last_s, total_m, n_fixes and stopped of every ride that a stream holds, read from the state
    that it left in its checkpoint. The stream may be stopped, by whatever cause; started again with the checkpoint it takes these rides up."""
    held = spark.read.format("statestore").load(checkpoint).select("key.ride_id", F.from_json("value.groupState.ride", _HELD).alias("r"))
    total = F.col("r.banked") + F.coalesce(F.col("r.top") - F.col("r.base"), num(0))
    return held.select("ride_id", F.col("r.last_seq").alias("seq"), F.col("r.start").alias("started_s"), F.col("r.last_t").alias("last_s"), total.alias("total_m"), "r.n_fixes", "r.stopped")


def moved_fixes(fixes: DataFrame, least_m: float = MIN_STEP_M) -> DataFrame:
    """ride_id, seq of the fixes that a watcher passes on: the first of a ride, and each that lies at least so far from the last one passed on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            out = []
            for ride_id, seq, lon, lat in zip(batch["ride_id"].tolist(), batch["seq"].tolist(), batch["lon"].tolist(), batch["lat"].tolist()):
                if ride_id != key:
                    key, last = ride_id, None
                if last is None or metres(last, (lon, lat)) >= least_m:
                    last = (lon, lat)
                    out.append((ride_id, seq))
            yield pd.DataFrame(out, columns=["ride_id", "seq"])

    return fixes.select("ride_id", "seq", "lon", "lat").repartition("ride_id").sortWithinPartitions("ride_id", "seq").mapInPandas(run, "ride_id long, seq long")


# What needs no state beyond the fix before is a window.


def moving_seconds(fixes: DataFrame) -> DataFrame:
    """ride_id, moving_s: time of steps of 3 m or more at over 0.8 m/s."""
    order = Window.partitionBy("ride_id").orderBy("seq")
    step = mean_lat_distance(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat"))
    rows = fixes.withColumns({"_d": step, "_dt": F.col("t_s") - F.lag("t_s").over(order)})
    moving = (F.col("_dt") > 0) & (F.col("_d") >= MIN_STEP_M) & (F.col("_d") / F.col("_dt") > MOVING_M_S)
    return rows.groupBy("ride_id").agg(F.sum(F.when(moving, F.col("_dt")).otherwise(num(0))).alias("moving_s"))


def sessions(fixes: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """ride_id, started, ended (the last fix), n: fixes without a pause as long as the gap. Works on streams too."""
    per = fixes.groupBy("ride_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return per.select("ride_id", F.col("w.start").alias("started"), "ended", "n")


def class_mix(steps: DataFrame) -> DataFrame:
    """ride_id, pct_protected, pct_quiet over the metres whose class is known. steps: ride_id, cls, m."""
    known = F.sum(F.when(F.col("cls").isNotNull(), F.col("m")).otherwise(num(0)))
    part = lambda kinds: F.sum(F.when(F.col("cls").isin(*kinds), F.col("m")).otherwise(num(0)))
    per = steps.groupBy("ride_id").agg(known.alias("k"), part(("path", "separated", "buffered")).alias("p"), part(("quiet_street", "service")).alias("q"))
    share = lambda c: F.when(F.col("k") > 0, half_up(F.col(c) * 100 / F.col("k"))).otherwise(F.lit(0).cast("bigint"))
    return per.select("ride_id", share("p").alias("pct_protected"), share("q").alias("pct_quiet"))


def totals(rides: DataFrame, month: str) -> DataFrame:
    """One row over all rides (meters, moving_s, started_at text, pct_protected); month as YYYY-MM."""
    km = lambda m: half_up(m / 100) / 10
    s = rides.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("meters"), F.lit(0)).alias("m"), F.coalesce(F.sum("moving_s"), F.lit(0)).alias("s"), F.coalesce(F.max("meters"), F.lit(0)).alias("top"),
        F.coalesce(F.sum(F.when(F.col("started_at").startswith(month), F.col("meters"))), F.lit(0)).alias("mm"), F.coalesce(F.sum(F.col("pct_protected") * F.col("meters")), F.lit(0)).alias("p"),
    )
    return s.select(F.col("n").alias("rides"), km(F.col("m")).alias("km"), (half_up(F.col("s") / 360) / 10).alias("moving_hours"), km(F.col("top")).alias("longest_km"), km(F.col("mm")).alias("month_km"), F.when(F.col("m") > 0, half_up(F.col("p") / F.col("m"))).otherwise(F.lit(0).cast("bigint")).alias("pct_protected"))
