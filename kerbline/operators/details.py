"""Smaller steps of reports and pages: extents, daylight, sites to look at, snapshots, and what a project changes for a trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import text
from kerbline.functions.geo import num
from kerbline.operators import search
from kerbline.operators.projects import numbered
from kerbline.operators.weights import profile_weight
from kerbline.plans.lineage import cut

#: Where the light is reckoned, and from which margin in minutes on nothing is said.
SUN_LAT, SUN_LON, LIGHT_MIN = 42.383, -71.105, 30
#: Fixed value: the order in which sites are looked at.
SITE_ORDER = ("osm_only", "separated", "buffered", "lane", "path")
PAINTED = ("separated", "buffered", "lane")


def extents(points: DataFrame, *key: str, pad_m: float = 0.0, least: int = 2) -> DataFrame:
    """key, west, south, east, north of the points (lon, lat) of each key, padded by metres; keys with fewer than
    `least` points have none."""
    per = points.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy(*key).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"), F.count("*").alias("points"))
    dlat = num(pad_m) / 110540
    dlon = num(pad_m) / (F.cos(F.radians((F.col("s") + F.col("n")) / 2)) * 111320)
    return per.where(F.col("points") >= least).select(*key, (F.col("w") - dlon).alias("west"), (F.col("s") - dlat).alias("south"), (F.col("e") + dlon).alias("east"), (F.col("n") + dlat).alias("north"))


def daylight(day_of_year: Column, start_minutes: Column, ride_minutes: Column) -> tuple[Column, Column]:
    """Minutes (UTC clock) between arrival and sunset, and what is said of them; null where there is light enough."""
    sunset = text.sunset_minutes(day_of_year, num(SUN_LAT), num(SUN_LON))
    margin = sunset - (start_minutes + ride_minutes)
    late = F.lit("this ride ends after sunset — lights on, and try dark mode")
    soon = F.concat(F.lit("you'd arrive with ~"), text.half_up(margin).cast("string"), F.lit(" min of light"))
    return margin, F.when(margin < 0, late).when(margin < LIGHT_MIN, soon)


def usable(numbers: list[str], booleans: list[str], names: list[str]) -> Column:
    """Whether every figure is a finite number, every flag is set and every name is there; never null."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in numbers]
    there = [F.col(c).isNotNull() for c in booleans] + [F.coalesce(F.col(c), F.lit("")) != "" for c in names]
    return F.coalesce(reduce(lambda a, b: a & b, finite + there), F.lit(False))


def first_in_order(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key in their stored order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def site_bucket(cls: Column, source: Column) -> Column:
    return F.when((source == "osm") & cls.isin(*PAINTED), "osm_only").otherwise(cls)


def sites_to_audit(sites: DataFrame, most: int) -> DataFrame:
    """The first `most` sites (id, cls, source): those that only the map has before those with a record, by class. The cap is the feature."""
    rank = F.array_position(F.array(*map(F.lit, SITE_ORDER)), site_bucket(F.col("cls"), F.col("source")))
    return sites.withColumn("rank", rank).where("rank > 0").orderBy("rank", "id").limit(most)


def image_worklist(streets: DataFrame, photos: DataFrame, most: int = 200, box: float = 0.0004) -> DataFrame:
    """u, v, k, lon, lat, cls, name, photo, captured and viewer of the first `most` places to look at; the cap is the feature.

    streets: u, v, k, cls, name, lon, lat (their middles), those without any record but the map's. Of the streets in a cell of about 100 m the
    first counts. photo is the newest (the least id of equals) in a box of about 35 m about the place, null without any.
    """
    first = Window.partitionBy(F.floor(F.col("lon") / 0.0012), F.floor(F.col("lat") / 0.0009)).orderBy("u", "v", "k")
    held = streets.where(F.col("cls").isin("path", *PAINTED)).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    held = cut(held.orderBy("u", "v", "k").limit(most))
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - box) / (2 * box)), F.floor((F.col(c) + box) / (2 * box))))
    shots = photos.select("photo", "captured", F.col("lon").alias("plon"), F.col("lat").alias("plat")).withColumns({"_cx": F.floor(F.col("plon") / (2 * box)), "_cy": F.floor(F.col("plat") / (2 * box))})
    met = held.withColumn("_cx", cells("lon")).withColumn("_cy", cells("lat")).join(shots, ["_cx", "_cy"])
    near = met.where((F.abs(F.col("plon") - F.col("lon")) <= box) & (F.abs(F.col("plat") - F.col("lat")) <= box))
    newest = near.groupBy("u", "v", "k").agg(F.max(F.struct("captured", (-F.col("photo")).alias("p"))).alias("m")).select("u", "v", "k", (-F.col("m.p")).alias("photo"), "m.captured")
    viewer = F.format_string("lat=%.6f&lng=%.6f&z=17", "lat", "lon")
    return held.join(newest, ["u", "v", "k"], "left").select("u", "v", "k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "cls", "name", "photo", "captured", viewer.alias("viewer"))


def listed_projects(rows: DataFrame, most: int = 20) -> DataFrame:
    """place (from 1) and the columns of the projects (cid, score) that a page lists: the best scores, equal ones by id. The cap is the feature."""
    best = rows.orderBy(F.desc("score"), "cid").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "cid")))  # `most` rows


def flagged(verdicts: DataFrame) -> DataFrame:
    """place (1 is first), name, verdict of the sites with changes or without markings: changed first, then by name. A
    place is its rank among its verdict plus the changed ones before, counted, so no task orders all rows."""
    held = verdicts.where(F.col("verdict").isin("changed", "no_markings"))
    return numbered(held, [F.col("verdict") != "changed", F.col("name"), F.col("id")], "place").select("place", "id", "name", "verdict")


def snapshot_faults(stamps: DataFrame, needed: int) -> DataFrame:
    """fault: what is wrong with a snapshot (file, kind: meta or city, format as JSON text). Only whole numbers are
    stamps, anything else counts as 0; no rows if meta and every city have the needed format and there are cities."""
    stamp = F.when(F.trim("format").rlike(r"^-?\d+$"), F.trim("format").try_cast("bigint"))
    seen = stamps.select("kind", F.coalesce(stamp, F.lit(0)).alias("v")).agg(F.min(F.when(F.col("kind") == "meta", F.col("v"))).alias("meta"), F.min(F.when(F.col("kind") == "city", F.col("v"))).alias("city"))
    said = F.array(
        F.when(F.col("city").isNull(), F.lit("no city pages")), F.when(F.col("city") < needed, F.concat(F.lit("a city page is format "), "city")),
        F.when(F.coalesce("meta", F.lit(0)) < needed, F.concat(F.lit("the snapshot is format "), F.coalesce("meta", F.lit(0)))), F.when(F.col("meta") != F.col("city"), F.lit("the stamps differ")),
    )
    return seen.select(F.explode(F.array_compact(said)).alias("fault"))


def freshness(log: DataFrame) -> DataFrame:
    """name, source, retrieved (newest), n_features (of that run) from the ingest log."""
    return log.groupBy("name").agg(F.max(F.struct("retrieved", "source", "n_features")).alias("m")).select("name", "m.source", "m.retrieved", "m.n_features")


def recategorised(reports: DataFrame, answers: DataFrame) -> DataFrame:
    """Reports (id, category, ...) with the newest answer (id, category, at) to what each was; answers to reports that are gone are ignored."""
    newest = answers.groupBy("id").agg(F.max_by("category", F.struct("at", "category")).alias("said"))
    return reports.join(newest, "id", "left").withColumn("category", F.coalesce("said", "category")).drop("said")


def detours(arcs: DataFrame, riders: DataFrame, places: DataFrame, tiles: DataFrame, mode: str = "kids", together: int | None = None) -> DataFrame:
    """rider, poi_id, cost: the place (poi_id, node) of the wanted kind that each rider (rider, node) gets to most cheaply."""
    starts = riders.select(F.lit(mode).alias("mode"), F.col("rider").alias("query"), "node", num(0).alias("cost"))
    found = search.costs(arcs, starts, tiles, together=together).select(F.col("query").alias("rider"), "node", "cost")
    return found.join(places.select("poi_id", "node"), "node").groupBy("rider").agg(F.min(F.struct("cost", "poi_id")).alias("b")).select("rider", "b.poi_id", "b.cost")


def trip_whatif(edges: DataFrame, trips: DataFrame, tiles: DataFrame, upgraded: Column, profile: str = "young_kids") -> DataFrame:
    """trip, km_change, protected_change (percentage points) of the safest route once the upgraded streets are protected,
    and how many of its streets are. Changes under 0.1 km count as 0."""
    now = edges.withColumns({"mode": F.lit("now"), "weight": profile_weight(profile), "built": F.lit(False)})
    then = edges.withColumns({"mode": F.lit("built"), "weight": profile_weight(profile, upgraded=upgraded), "built": upgraded})
    arcs = cut(now.unionByName(then).select("mode", "u", "v", "k", "weight", "length", "cls", "built"))
    modes = F.explode(F.array(F.lit("now"), F.lit("built"))).alias("mode")
    goals = trips.select(modes, F.col("trip").alias("query"), F.col("target").alias("node"))
    found = search.costs(arcs, trips.select(modes, F.col("trip").alias("query"), F.col("source").alias("node"), num(0).alias("cost")), tiles, targets=goals)
    legs = search.path_edges(search.paths(found, goals), arcs)
    safe = F.col("built") | F.col("cls").isin("path", "separated", "buffered")
    per = legs.groupBy("query").pivot("mode", ["now", "built"]).agg(F.sum("length").alias("m"), F.sum(F.when(safe, F.col("length")).otherwise(num(0))).alias("p"), F.count_if("built").alias("n"))
    share = lambda m: text.half_up(F.col(f"{m}_p") * 100 / F.col(f"{m}_m"))
    km = (F.col("built_m") - F.col("now_m")) / 1000
    return per.select(F.col("query").alias("trip"), F.when(F.abs(km) >= 0.1, F.round(km, 1)).otherwise(num(0)).alias("km_change"), (share("built") - share("now")).alias("protected_change"), F.col("built_n").alias("n_upgraded"))
