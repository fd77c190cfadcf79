from pyspark.sql import functions as F

from kerbline.plans import grid
from kerbline.streaming import rides

FOLDER = "/root/testdata/sf0.001"


def run(spark, folder, schema):
    source = spark.readStream.schema(schema).parquet(f"{folder}/fixes")
    stream = rides.stream_summaries(source).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    stream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start().awaitTermination()


def test_a_stopped_stream_is_listed_and_ends_like_an_unbroken_one(spark, tmp_path):
    fixes = grid.fixes(spark, FOLDER).drop("event_id").where("ride_id % 5 = 0 AND seq <= 30").cache()
    first = fixes.where("seq <= 9")
    first.write.parquet(f"{tmp_path}/fixes")
    run(spark, tmp_path, fixes.schema)
    held = {r["ride_id"]: r for r in rides.in_progress(spark, f"{tmp_path}/state").collect()}
    states = rides.fix_states(first).groupBy("ride_id").agg(F.max("seq").alias("seq"), F.max_by("total_m", "seq").alias("m"), F.count_if("plausible").alias("n")).collect()
    assert {r["ride_id"]: (r["seq"], r["m"], r["n"]) for r in states} == {k: (r["seq"], r["total_m"], r["n_fixes"]) for k, r in held.items()}
    fixes.where("seq > 9").write.mode("append").parquet(f"{tmp_path}/fixes")
    run(spark, tmp_path, fixes.schema)
    out = spark.read.parquet(f"{tmp_path}/out")
    newest = out.groupBy("ride_id").agg(F.max_by(F.struct("meters", "duration_s", "moving_s", "n_points"), F.struct("batch", "meters")).alias("s")).select("ride_id", "s.*")
    whole = rides.ride_summaries(fixes).select("ride_id", "meters", "duration_s", "moving_s", "n_points")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, whole.collect())) != []
