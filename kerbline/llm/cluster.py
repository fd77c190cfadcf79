"""What the operators need from the cluster: cut lineage, bounded bit sets, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.components import components
from kerbline.plans.lineage import cut

__all__ = ["bit_columns", "bit_set", "components", "cut", "in_bit_set", "small_batches"]

BLOOM_BITS = 1 << 23
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python at most BATCH_ROWS at a time, unless the session sets its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def bit_set(keys: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A set of bits, two for each value of a BIGINT column, as uint64 words.

    Its size is `bits` whatever the number of keys, so it is safe to broadcast: more keys only let
    more non-members through, and every user joins exactly afterwards.
    """
    both = keys.select(F.explode(F.array(*bit_columns(column, bits))).alias("bit"))
    words = both.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64))))").alias("mask")
    )
    out = np.zeros(bits // 64, np.uint64)
    got = words.toPandas()
    out[got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def bit_columns(column: str, bits: int = BLOOM_BITS):
    """The two bit numbers of a value."""
    value = F.col(column).cast("bigint")
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits)).cast("int") for seed in (1, 2)]


def in_bit_set(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
