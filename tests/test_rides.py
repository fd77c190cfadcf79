import datetime
import math
import random
import time

from kerbline.streaming import rides
from kerbline.streaming.ride_state import Guide, Ride, advance, guide, summary

M_LON = 111320 * math.cos(math.radians(42.38))


def ride_east(speed, metres, wander=4.0, seed=1, along=True):
    draw, ride, t, x = random.Random(seed), Ride(), 0.0, 0.0
    while x < metres:
        lon = -71.1 + (x + draw.uniform(-wander, wander)) / M_LON
        lat = 42.38 + draw.uniform(-wander, wander) / 110540
        seen = x + draw.uniform(-wander, wander)
        advance(ride, t, lon, lat, 5.0, None, None, seen if along else None, 1.0 if along else None, "path")
        t, x = t + 1.0, x + speed
    return ride


def test_distance_with_wander():
    assert abs(ride_east(8 / 3.6, 3000).total - 3000) <= 0.15 * 3000
    assert abs(ride_east(16 / 3.6, 5000, along=False).total - 5000) <= 0.10 * 5000


def test_little_drift_while_stopped():
    ride = Ride()
    draw = random.Random(3)
    for t in range(600):
        advance(ride, float(t), -71.1 + draw.uniform(-4, 4) / M_LON, 42.38 + draw.uniform(-4, 4) / 110540, 5.0, None, None, None, None, "path")
    assert ride.total < 60 and summary(ride) is None


def along_of(values):
    ride = Ride()
    for t, along in enumerate(values):  # the first fix only starts the clock
        advance(ride, float(t * 60), -71.1 + t * 0.001, 42.38, 5.0, 3.0, None, along, 1.0, "quiet_street")
    return ride.total


def test_a_new_route_keeps_what_was_ridden():
    assert along_of([0.0, 0.0, 300.0, 280.0, 400.0]) == 400.0, "falling back a little adds nothing"
    assert along_of([0.0, 200.0, 500.0, 100.0, 250.0]) == 450.0


def test_far_jumps_count_from_the_third_on():
    ride = Ride()
    advance(ride, 0.0, -71.1, 42.38, 5.0, None, None, None, None, None)
    got = [advance(ride, float(t), -71.0, 42.38, 5.0, None, None, None, None, None) for t in (1, 2, 3)]
    assert [bool(g) and g[0][0] == "implausible" for g in got] == [True, True, False]


def test_reroutes_back_off():
    ride, said = Ride(), []
    for t in range(0, 200):
        said += [k for k, _ in advance(ride, float(t), -71.1 + t * 1e-5, 42.38, 5.0, 2.0, None, 10.0, 90.0, None, 2000.0)]
    assert 2 <= said.count("reroute") <= 6 and said.count("announce") <= said.count("reroute")
    poor = Ride()
    assert not [e for t in range(60) for e in advance(poor, float(t), -71.1, 42.38, 80.0, 2.0, None, 10.0, 90.0, None, 2000.0) if e[0] == "reroute"]


def test_milestones_and_arrival():
    ride, said = Ride(), []
    for i in range(0, 2500, 10):
        said += [k for k, _ in advance(ride, i / 4.0, -71.1 + i / M_LON, 42.38, 5.0, 4.0, 90.0, float(i), 1.0, "path", 2490.0)]
    assert said == ["kilometre", "halfway", "kilometre", "arrived"]
    late = Ride()
    assert [k for k, _ in advance(late, 0.0, -71.1, 42.38, 5.0, 4.0, 90.0, 20000.0, 1.0, "path", 30000.0)] == []


def test_idle_rides_are_reported_once():
    ride = Ride()
    said = [k for t in range(0, 2000, 50) for k, _ in advance(ride, float(t), -71.1, 42.38, 5.0, 0.0, None, None, None, None)]
    assert said == ["idle"]


def test_turn_calls_and_hazards():
    state, said = Guide(), []
    for along in range(0, 600, 5):
        said += guide(state, float(along), 3.0, [300.0, 580.0], [400.0])
    assert [k for k, _ in said if k != "hazard"] == ["turn_1", "turn_2", "turn_3"] * 2
    assert [v for k, v in said if k == "hazard"] == [400.0]
    assert guide(state, 250.0, 3.0, [300.0, 580.0], [])[0] == ("turn_1", 300.0), "a missed turn is called again"


def test_totals_of_two_rides(spark):
    df = spark.createDataFrame([(5000.0, 1800.0, "2026-07-02", 50), (3000.0, 1800.0, "2026-06-02", 80)], "meters double, moving_s double, started_at string, pct_protected int")
    got = rides.totals(df, "2026-07").first().asDict()
    assert got == {"rides": 2, "km": 8.0, "moving_hours": 1.0, "longest_km": 5.0, "month_km": 5.0, "pct_protected": 61}
    assert rides.totals(df.limit(0), "2026-07").first()["km"] == 0.0


def test_class_mix_counts_known_metres(spark):
    df = spark.createDataFrame([(1, "path", 30.0), (1, None, 1000.0), (1, "service", 10.0)], "ride_id long, cls string, m double")
    assert tuple(rides.class_mix(df).first()) == (1, 75, 25)


def test_pass_over_a_table_and_stream_agree(spark):
    from kerbline.plans import ride_queries

    folder = "/root/testdata/sf0.001"
    a = {tuple(r) for r in ride_queries.ride_high_water(spark, folder).collect()}
    b = {(r["ride_id"], r["meters"]) for r in ride_queries.stream_ride_summaries(spark, folder).collect()}
    assert a and a == b
    said = sorted(map(tuple, ride_queries.ride_events(spark, folder).collect()))
    assert {e[3] for e in said} >= {"turn_1", "hazard", "implausible", "reroute"}
    assert sorted(map(tuple, ride_queries.stream_ride_events(spark, folder).collect())) == said


def fix(ride, seq, at, along):
    return (ride, seq, float(at), datetime.datetime.fromtimestamp(1_700_000_000 + at, datetime.timezone.utc), -71.1 + along / M_LON, 42.38, 5.0, 4.0, 90.0, float(along), 1.0, "path", 5000.0)


def test_a_stream_forgets_rides_that_are_over_and_drops_late_fixes(spark, tmp_path):
    schema = "ride_id long, seq long, t_s double, ts timestamp, lon double, lat double, accuracy double, speed double, heading double, along_m double, off_m double, cls string, route_m double"
    batches = [
        [fix(1, s, s * 60, s * 100) for s in range(5)],  # ride 1, with epoch seconds as event time
        [fix(1, 2, 120, 900)] + [fix(2, s, 3600 + s * 60, s * 100) for s in range(4)],  # a late fix of it, and another ride an hour on
        [fix(3, s, 9000 + s * 60, s * 100) for s in range(4)], [fix(3, 4, 9300, 400)], [fix(3, 5, 9360, 500)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by age
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    run = rides.stream_summaries(source, "1 minute").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    run = run.foreachBatch(lambda batch, n: seen.extend((r["ride_id"], r["meters"]) for r in batch.collect())).start()
    run.awaitTermination()
    assert max(m for ride, m in seen if ride == 1) == 300  # the first fix starts the clock; the late one, 900 m along, adds nothing
    held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert held[-1] == 1, held  # rides 1 and 2 are forgotten
