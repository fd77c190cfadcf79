"""Sharding by Karmarkar-Karp differencing.

Groups of rows that must stay together (here: equal texts) are the items, their bytes the weights. Every item starts as a
partial partition with all its weight in one part; the two partial partitions with the largest
spread are combined again and again, the heaviest parts of one with the lightest of the other, until
one is left.

Over a cluster this is a tree. Groups are dealt by hash into cells of about CELL groups, each cell is
differenced in one task, its partial partition goes on as one unit to its region, and the regions' partial partitions
(REGIONS at most) are differenced on the driver. Nothing but 16 loads for each cell or region
moves up, and each level only turns the order of parts below it, so the spread after each level is
the one that differencing leaves there.

Slots are gapless: rows are numbered within pieces of a shard by a hash of their ids, and pieces are
offset by the counts of those before them (at most PIECES for each shard).

Defined cases: a null text weighs 1 and is grouped with the empty text; repeated rows are rows of
their own in the same shard; a group may weigh more than a shard's share, and then the others share
what is left; an empty table gives an empty table; other columns are ignored; null ids are numbered
like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut

SHARDS, CELL, REGIONS, PIECES = 16, 20_000, 64, 1024


def difference(units: list[tuple[int, ...]]) -> tuple[list[int], list[list[int]]]:
    """Loads of the final parts (ascending), and for each unit the final part of each of its parts.

    A unit is a tuple of k loads; a single item has one load and zeros.
    """
    k = len(units[0])
    heap, order = [], len(units)
    for n, unit in enumerate(units):
        # parts: (load, tree of (unit, part) leaves), ascending by load
        parts = sorted(((load, (n, i)) for i, load in enumerate(unit)), key=lambda x: x[0])
        heap.append((parts[0][0] - parts[-1][0], n, parts))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], (x[1], y[1])) for x, y in zip(a, reversed(b))), key=lambda x: x[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], order, parts))
        order += 1
    final = heap[0][2]
    placed = [[0] * k for _ in units]
    for part, (_, tree) in enumerate(final):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x[0], tuple):
                stack += x
            else:
                placed[x[0]][x[1]] = part
    return [load for load, _ in final], placed


def difference_items(weights: list[int], k: int) -> tuple[list[int], list[int]]:
    """The same for single items: loads of the k parts, and the part of each item."""
    heap = [(-w, n, [(w, n)]) for n, w in enumerate(weights)]  # only parts that hold something, heaviest first
    heapq.heapify(heap)
    order = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        joined = a[:free] if len(b) > free else a
        lone = b
        if len(b) > free:  # the heaviest parts of b stay alone as far as there is room, the others go onto a's lightest
            lone, rest = b[:free], b[free:]
            met = a[k - free - len(rest) :] if len(rest) <= len(a) else a
            joined = a[: len(a) - len(rest)]
            lone = lone + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(met), rest)]
        parts = sorted(joined + lone, key=lambda x: -x[0])
        spread = parts[0][0] - (parts[-1][0] if len(parts) == k else 0)
        heapq.heappush(heap, (-spread, order, parts))
        order += 1
    parts = heap[0][2] if heap else []
    placed = [0] * len(weights)
    loads = [p[0] for p in parts] + [0] * (k - len(parts))
    for part, (_, tree) in enumerate(parts):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                placed[x] = part
    return loads, placed


def _cells(k: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["g1", "g2"], kind="stable")
        _, placed = difference_items(cell["weight"].tolist(), k)
        return cell.assign(part=placed)[["cell", "g1", "g2", "weight", "part"]]

    return run


def _regions(k: int):
    def run(region: pd.DataFrame) -> pd.DataFrame:
        region = region.sort_values("cell")
        _, placed = difference([tuple(x) for x in region["loads"]])
        return pd.DataFrame({"cell": region["cell"].to_numpy(), "region": region["region"].to_numpy(), "turn": placed})

    return run


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """g1, g2 (the group's fingerprint), weight and shard of every group of equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    groups = docs.select(*fingerprint(text), (F.octet_length(text) + 1).cast("bigint").alias("size")).groupBy("g1", "g2").agg(F.sum("size").alias("weight"))
    groups = cut(groups)
    cells = max(1, -(-groups.count() // CELL))
    placed = groups.withColumn("cell", F.pmod(F.xxhash64("g1", "g2"), F.lit(cells)).cast("int")).groupBy("cell").applyInPandas(_cells(shards), "cell int, g1 long, g2 long, weight long, part int")
    placed = cut(placed)
    loads = placed.groupBy("cell", "part").agg(F.sum("weight").alias("w")).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("part", "w"))).alias("w"))
    loads = loads.select("cell", F.pmod("cell", F.lit(REGIONS)).alias("region"), F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("w", i), F.lit(0).cast("bigint"))).alias("loads"))
    turned = cut(loads.groupBy("region").applyInPandas(_regions(shards), "cell int, region int, turn array<int>"))
    flat = loads.join(turned.select("cell", "turn"), "cell").select("region", F.explode(F.arrays_zip("loads", "turn")).alias("x")).groupBy("region", F.col("x.turn").alias("part")).agg(F.sum("x.loads").alias("w"))
    top: dict[int, list[int]] = {}
    for region, part, w in sorted(flat.collect()):  # REGIONS * shards rows at most
        top.setdefault(region, [0] * shards)[part] = w
    last = dict(zip(top, difference([tuple(v) for v in top.values()])[1])) if top else {}
    spark = docs.sparkSession
    last_rows = spark.createDataFrame([(r, v) for r, v in last.items()], "region int, last array<int>")
    where = turned.join(F.broadcast(last_rows), "region").select("cell", F.transform("turn", lambda t: F.get("last", t)).alias("turn"))
    return placed.join(where, "cell").select("g1", "g2", "weight", F.get("turn", F.col("part")).alias("shard"))


def fingerprint(text):
    """128 bits that tell texts apart."""
    return F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text, F.octet_length(text)).alias("g2")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: every document with its shard under the law `bytes`, and its slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), *fingerprint(text))
    placed = rows.join(assign(docs).select("g1", "g2", "shard"), ["g1", "g2"])
    piece = F.pmod(F.xxhash64("doc_id", "g1"), F.lit(PIECES)).cast("int").alias("piece")
    # Equal rows are counted first, so no id or text, null ones included, brings more than one row of each task together.
    once = cut(placed.groupBy("doc_id", "size", "text_crc32", "shard", piece).agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = once.groupBy("shard", "piece").agg(F.sum("n").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "piece", "offset")
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    out = once.join(F.broadcast(counts), ["shard", "piece"]).withColumn("first", first)  # SHARDS * PIECES rows at most
    out = out.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict = {}
