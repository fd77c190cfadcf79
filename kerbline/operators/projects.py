"""Where to build: islands of child-safe street, candidate projects, severance, access and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import num
from kerbline.operators import search
from kerbline.operators.components import components
from kerbline.operators.weights import kid_safe
from kerbline.plans.lineage import cut


def islands(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, island) and (island, metres) of the child-safe undirected network; parallel streets count their shortest."""
    safe = edges.where(kid_safe(F.col("stress_mult"))).groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length").alias("m"))
    safe = cut(safe)
    named = cut(components(safe))
    sizes = safe.join(named.withColumnRenamed("node", "a"), "a").groupBy(F.col("component").alias("island")).agg(F.sum("m").alias("metres")).where("metres > 0")
    return named.join(sizes.select(F.col("island").alias("component")), "component", "left_semi").select(F.col("node").alias("id"), F.col("component").alias("island")), sizes


def candidates(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate rows, their members): connected runs of one street name and class that are not child-safe.

    A run is named by its street, class and least node; cid numbers runs in that order. Parallel streets all
    count. crash figures are null where they are not measured.
    """
    bad = edges.where(~kid_safe(F.col("stress_mult"))).withColumn("street", F.coalesce("name", F.lit(""))).where("u < v")
    bad = cut(bad)
    key = lambda c: F.struct("street", "cls", F.col(c).alias("node"))
    runs = components(bad.select(key("u").alias("a"), key("v").alias("b")))
    members = bad.join(runs.select(F.col("node.street").alias("street"), F.col("node.cls").alias("cls"), F.col("node.node").alias("u"), F.col("component.node").alias("run")), ["street", "cls", "u"])
    members = cut(members)
    rows = members.groupBy("street", "cls", "run").agg(
        F.sum("length").alias("length_m"), F.count("*").alias("n_edges"), F.sum("crash_count").alias("crashes"), F.bool_and(F.col("crash_count").isNotNull()).alias("crashes_known"),
        (F.sum(F.col("length") * F.col("crash_factor")) / F.sum("length")).alias("crash_pressure"),
    ).where(F.col("length_m").between(dims.CROSSING_MIN_M, dims.CANDIDATE_MAX_M))
    return rows, members


def severance(rows: DataFrame, members: DataFrame, nodes_of_island: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates with join_m (the smaller of the two largest real islands they touch), touched and joins_region.

    Of islands with equal metres the least id comes first.
    """
    ends = members.select("street", "cls", "run", F.explode(F.array("u", "v")).alias("id")).distinct()
    real = sizes.where(F.col("metres") >= dims.REAL_ISLAND_M)
    touched = ends.join(nodes_of_island, "id").join(real, "island").select("street", "cls", "run", "island", "metres").distinct()
    order = Window.partitionBy("street", "cls", "run").orderBy(F.desc("metres"), "island")
    two = touched.withColumn("rank", F.row_number().over(order)).groupBy("street", "cls", "run").agg(
        F.count("*").alias("touched"), F.max(F.when(F.col("rank") == 2, F.col("metres"))).alias("join_m"), F.max(F.when(F.col("rank") == 1, F.col("island"))).alias("big"), F.max(F.when(F.col("rank") == 2, F.col("island"))).alias("small"),
    )
    top = real.orderBy(F.desc("metres"), "island").limit(1).select(F.col("island").alias("region"))
    two = two.join(F.broadcast(top), F.lit(True), "left")  # one row
    return rows.join(two, ["street", "cls", "run"], "left").select(
        *rows.columns, F.coalesce("touched", F.lit(0)).alias("touched"), F.coalesce("join_m", num(0)).alias("join_m"), "big", "small", F.coalesce((F.col("join_m") > 0) & (F.col("big") == F.col("region")), F.lit(False)).alias("joins_region"),
    )


def classified(rows: DataFrame, signal_runs: DataFrame) -> DataFrame:
    """Candidates worth keeping, with kind: a short unsignalised one that joins islands is a spot fix."""
    marked = rows.join(signal_runs.select("street", "cls", "run", F.lit(True).alias("signalised")), ["street", "cls", "run"], "left").withColumn("signalised", F.coalesce("signalised", F.lit(False)))
    spot = (F.col("length_m") <= dims.SPOT_FIX_MAX_M) & (F.col("join_m") > 0) & ~F.col("signalised")
    return marked.where((F.col("length_m") >= dims.CANDIDATE_MIN_M) | (F.col("join_m") > 0)).withColumn("kind", F.when(spot, "spot_fix").otherwise("corridor"))


def project_cost(kind: Column, length: Column) -> Column:
    return F.when(kind == "spot_fix", num(dims.UNIT_COST["spot_fix"])).otherwise(length * dims.UNIT_COST["separated"])


def normalised(value: Column, largest: Column) -> Column:
    """0 to 1 on a log scale; all 0 if nothing is above 0."""
    return F.when(largest > 0, F.log1p(F.greatest(value, num(0))) / F.log1p(largest)).otherwise(num(0))


def scored(rows: DataFrame, measures: dict[str, tuple[str, float]], digits: int = 4) -> DataFrame:
    """rows with score: the weighted sum of normalised measures; the largest of each is one aggregate."""
    top = rows.agg(*(F.max(c).alias(f"_top_{n}") for n, (c, _) in measures.items()))
    both = rows.join(F.broadcast(top), F.lit(True))  # one row
    total = None
    for n, (c, w) in measures.items():
        part = normalised(F.col(c), F.col(f"_top_{n}")) * w
        total = part if total is None else total + part
    return both.withColumn("score", F.round(total, digits)).drop(*(f"_top_{n}" for n in measures))


def measured(rows: DataFrame) -> DataFrame:
    """rows with sv (metres joined for each metre built) and cr (crashes a km, or the crash factor where not counted)."""
    sv = F.col("join_m") / F.greatest(F.col("length_m"), num(25))
    per_km = F.col("crashes") / F.greatest(F.col("length_m"), num(50)) * 1000
    return rows.withColumns({"sv": sv, "cr": F.when(F.col("crashes_known"), per_km).otherwise(F.col("crash_pressure"))})


def millionths(value: Column) -> Column:
    """A figure as a whole number of millionths, whose sums are exact in any order."""
    return F.round(value * 1e6).cast("bigint")


def accessibility(members: DataFrame, arcs: DataFrame, base: DataFrame, people: DataFrame, tiles: DataFrame) -> DataFrame:
    """street, cls, run, saved (resident-metres) and gaining (residents) of every candidate, if it were built; both also
    as whole numbers (saved_e12, gaining_e6), summed exactly from millionths of residents and metres.

    members: street, cls, run, u, v, length. arcs: u, v, weight, one each. base: node and its cost to the
    nearest destination now. people: id, pop. tiles: node, tile. Building only lowers costs, so for each candidate only
    the nodes that get cheaper are searched, from its own streets outwards, each candidate a query of one search in tiles.
    """
    far, budget = dims.ACCESS_BUDGET_M * dims.CLAMP, dims.ACCESS_BUDGET_M
    base = cut(tiles.select("node").join(base, "node", "left").select("node", F.least(F.coalesce("cost", num(far)), num(far)).alias("now")))
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")  # from destinations outwards
    named = cut(numbered(members.select("street", "cls", "run").distinct(), [F.col("street"), F.col("cls"), F.col("run")], "n").withColumn("query", F.col("n").cast("bigint")).drop("n"))
    ways = members.join(named, ["street", "cls", "run"]).select("query", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"), "length").select("query", "e.u", "e.v", "length")
    built = cut(ways.groupBy("query", "u", "v").agg(F.min("length").alias("weight")).join(back.select("u", "v"), ["u", "v"], "left_semi").select("query", "u", "v", "weight"))
    offers = built.join(base.withColumnRenamed("node", "u"), "u").where(F.col("now") < far).select("query", F.col("v").alias("node"), (F.col("now") + F.col("weight")).alias("cost"))
    offers = offers.join(base, "node").where(F.col("cost") < F.col("now")).select("query", "node", "cost")
    found = search.improved(back, built, offers, base.select("node", F.col("now").alias("cost")), tiles)
    known = found.join(named, "query").select(F.struct("street", "cls", "run").alias("cand"), "node", "cost")
    gain = known.join(people.select(F.col("id").alias("node"), millionths(F.col("pop")).alias("people")), "node").join(base, "node")
    crossing = F.when((F.col("now") >= budget) & (F.col("cost") < budget), F.col("people")).otherwise(0)
    drop = millionths(F.col("now") - F.col("cost"))
    whole = lambda c: c.cast("decimal(19,0)")
    per = gain.groupBy("cand").agg(F.sum(whole(F.col("people")) * whole(drop)).cast("decimal(38,0)").alias("saved_e12"), F.sum(crossing).alias("gaining_e6"))
    return per.select("cand.street", "cand.cls", "cand.run", (F.col("saved_e12").cast("double") / 1e12).alias("saved"), (F.col("gaining_e6") / 1e6).alias("gaining"), "saved_e12", "gaining_e6")


def slice_for_map(rows: DataFrame, measures: list[str], limit: int) -> DataFrame:
    """limit // 8 leaders of each measure, every spot fix, and the best of the rest up to the limit."""
    quota = limit // (2 * len(measures))
    leaders = None
    for m in measures:
        part = rows.where(F.col(m) > 0).orderBy(F.desc(m), "cid").limit(quota).select("cid")
        leaders = part if leaders is None else leaders.union(part)
    sure = cut(leaders.union(rows.where("kind = 'spot_fix'").select("cid")).distinct())
    room = max(0, limit - sure.count())
    rest = rows.join(sure, "cid", "left_anti").orderBy(F.desc("score"), "cid").limit(room).select("cid")
    return rows.join(sure.union(rest), "cid", "left_semi")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Dense numbers from 1 in an order, without one task seeing all rows: range partitions are counted, then numbered inside."""
    keyed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_offset")
    inside = Window.partitionBy("_part").orderBy(*order)
    return keyed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + F.row_number().over(inside)).drop("_part", "_offset")
