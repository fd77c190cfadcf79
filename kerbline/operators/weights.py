"""Classification of streets and what each costs a rider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions.geo import num


def _any_of(tags: Column, words) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, words)))


def listed(tags: Column) -> Column:
    """A tag list without nulls and empty strings; null becomes an empty list."""
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))


def max_speed(tags: Column) -> Column:
    """The first item whose first word is a number."""
    numbers = F.transform(listed(tags), lambda t: F.split(F.trim(t), r"\s+")[0].try_cast("double"))
    return F.get(F.filter(numbers, lambda x: x.isNotNull()), F.lit(0))


def classify(highway: Column, cycleway: Column, maxspeed: Column) -> tuple[Column, Column]:
    """(class, busy road) from tag lists; the worst road part counts, a facility anywhere counts."""
    roads, lanes = listed(highway), listed(cycleway)
    paths = F.array(*map(F.lit, dims.PATH_TAGS))
    off_street = (F.size(roads) > 0) & F.forall(roads, lambda r: F.array_contains(paths, r))
    busy = _any_of(roads, dims.ROADS_BUSY)
    cls = (
        F.when(off_street, "path").when(_any_of(lanes, ("track", "separate", "separated")), "separated").when(F.array_contains(lanes, "buffered_lane"), "buffered").when(F.array_contains(lanes, "lane"), "lane")
        .when(_any_of(lanes, ("shared_lane", "share_busway")), "sharrow").when(busy, "busy_street").when(_any_of(roads, dims.ROADS_MODERATE), "moderate_street").when(F.array_contains(roads, "service"), "service")
        .when(max_speed(maxspeed) > 30, "moderate_street").otherwise("quiet_street")
    )
    return cls, F.coalesce(busy & ~off_street, F.lit(False))


def lookup(cls: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(cls == name, num(value)).otherwise(out)
    return out


def safer(a: Column, b: Column) -> Column:
    """The class that costs less; the first of equals, the other of a null."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(lookup(a, dims.YOUNG_KIDS) <= lookup(b, dims.YOUNG_KIDS), a).otherwise(b)


def escalated(cls: Column, stress: Column) -> Column:
    """Where the surveyed stress is 3 or 4, quiet streets count as moderate and moderate ones as busy."""
    return F.when(stress >= 3, F.when(cls == "quiet_street", "moderate_street").when(cls == "moderate_street", "busy_street").otherwise(cls)).otherwise(cls)


def stress_mult(cls: Column, road_busy: Column, profile: str = "young_kids") -> Column:
    mult, lane, buffered, _, _, _ = dims.PROFILES[profile]
    return F.when(road_busy & (cls == "lane"), num(lane)).when(road_busy & (cls == "buffered"), num(buffered)).otherwise(lookup(cls, mult))


def kid_safe(mult: Column) -> Column:
    """A missing multiplier is not safe."""
    return F.coalesce(mult, num(99)) <= dims.KID_SAFE_MAX


def crash_factor(count: Column, length: Column, corridor: Column | None = None) -> Column:
    """Grows with crashes on each 100 m, capped; on a high-crash corridor it is raised once more."""
    factor = F.least(num(1) + num(dims.CRASH_WEIGHT) * count / (F.greatest(length, num(20)) / 100), num(dims.CRASH_CAP))
    if corridor is None:
        return factor
    return F.when(corridor, F.least(factor * dims.CORRIDOR_FACTOR, num(dims.CRASH_CAP * dims.CORRIDOR_FACTOR))).otherwise(factor)


def node_penalties(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, penalty: 250 m where a busy street passes without signals, 30 with, else 0."""
    busy = edges.where("cls = 'busy_street' OR road_busy").select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("busy", F.lit(True))
    signal = F.coalesce((F.col("highway") == "traffic_signals") | (F.col("crossing") == "traffic_signals"), (F.col("highway") == "traffic_signals"), (F.col("crossing") == "traffic_signals"), F.lit(False))
    return nodes.join(busy, "id", "left").select("id", F.when(F.col("busy").isNull(), num(0)).when(signal, num(dims.SIGNALISED_CROSSING_M)).otherwise(num(dims.CROSSING_M)).alias("penalty"))


def weigh(edges: DataFrame, nodes: DataFrame, crash_counts: DataFrame) -> DataFrame:
    """Edges with crash_count, crash_factor, stress_mult, xpen, climb, weight and weight_solo."""
    ends = nodes.select("id", "elev").join(node_penalties(edges, nodes), "id")
    u = ends.select(F.col("id").alias("u"), F.col("elev").alias("elev_u"), F.col("penalty").alias("pen_u"))
    v = ends.select(F.col("id").alias("v"), F.col("elev").alias("elev_v"), F.col("penalty").alias("pen_v"))
    out = edges.join(crash_counts, ["u", "v", "k"], "left").join(u, "u").join(v, "v")
    count = F.coalesce("crash_count", F.lit(0))
    factor = crash_factor(count, F.col("length"))
    pen = F.when(F.col("road_busy") | (F.col("cls") == "busy_street"), num(0)).otherwise((F.col("pen_u") + F.col("pen_v")) / 2)
    kids, solo = stress_mult(F.col("cls"), F.col("road_busy")), stress_mult(F.col("cls"), F.col("road_busy"), "solo")
    return out.select(
        *edges.columns, count.cast("bigint").alias("crash_count"), factor.alias("crash_factor"), kids.alias("stress_mult"), F.bround(pen, 1).alias("xpen"), F.bround(F.greatest(num(0), F.col("elev_v") - F.col("elev_u")), 2).alias("climb"),
        (F.col("length") * kids * factor + pen).alias("weight"), (F.col("length") * solo * factor + pen * 0.3).alias("weight_solo"),
    )


def hill_penalty(length: Column, climb: Column) -> Column:
    steep = climb / F.nullif(length, num(0)) > dims.STEEP_GRADE
    return climb * dims.HILL_M_PER_M * F.when(steep, num(dims.STEEP)).otherwise(num(1))


def profile_weight(profile: str | None, prefer_flat: bool = False, avoid: tuple[str, ...] = (), sketchy: Column | None = None, construction: Column | None = None, upgraded: Column | None = None) -> Column:
    """What an edge costs a rider, over length, cls, road_busy, crash_factor, xpen and climb; None is plain length."""
    length, hill = F.col("length"), hill_penalty(F.col("length"), F.col("climb"))
    if profile is None:
        return length
    flat = hill if prefer_flat else num(0)
    scale = dims.PROFILES[profile][4]
    mult = stress_mult(F.col("cls"), F.col("road_busy"), profile)
    if avoid:
        mult = F.when(F.col("cls").isin(*avoid), F.greatest(mult, num(dims.AVOID_FLOOR))).otherwise(mult)
    cost = length * mult * F.col("crash_factor") + F.col("xpen") * scale + flat
    if sketchy is not None:
        cost = F.when(sketchy, cost * dims.SKETCHY).otherwise(cost)
    if construction is not None:
        cost = F.when(construction, cost * dims.CONSTRUCTION).otherwise(cost)
    if upgraded is not None:
        cost = F.when(upgraded, length * dims.PROFILES[profile][0]["separated"] + flat).otherwise(cost)
    return cost
