"""Bounded, repeatable samples of labelled rows, and the split that keeps every fifth row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def bounded_sample(rows: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict]:
    """At most per_label rows (doc_id, label) of each label, by the least hash of their ids, and each
    label's number of rows. Only ids and labels are read; few rows are ever ranked."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0), counts
    chance = F.lit(1.0)
    for value, n in counts.items():
        chance = F.when(F.col(label) == value, F.lit(min(1.0, (1.5 * per_label + 50) / n))).otherwise(chance)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / float(1 << 53)
    few = rows.select("doc_id", label).withColumn("_draw", draw).where(F.col("_draw") < chance)
    rank = Window.partitionBy(label).orderBy("_draw", "doc_id")
    return few.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= per_label).drop("_rank", "_draw"), counts
