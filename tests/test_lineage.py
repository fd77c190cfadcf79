import time

from pyspark.sql import functions as F

from kerbline.plans import lineage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_of_a_cut_table_go_at_once(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, first = spark.conf.get(name, None), shuffle_files(spark)
    df = spark.range(2000).groupBy((F.col("id") % 100).alias("k")).count()
    df.collect()
    before = shuffle_files(spark)
    rows = lineage.cut(df.where("k >= 10"))
    for _ in range(50):  # Spark deletes in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert before - first and before - first <= shuffle_files(spark)  # those of df, which is held, stay
    assert spark.conf.get(name, None) == setting
    assert rows.agg(F.count("*"), F.sum("count")).first() == (90, 1800)
    assert rows.schema == df.schema and len(df.collect()) == 100
