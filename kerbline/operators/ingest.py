"""Rules that turn raw layers into tables: casts, place kinds, work zones and permits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.geo import num

# The area covered.
WEST, EAST, SOUTH, NORTH = -71.60, -70.78, 42.00, 42.63
HORIZON_DAYS = 21


def people(raw: Column) -> Column:
    """A count as text; 0 where it is not one."""
    return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


def place_kind(tags: Column) -> Column:
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    amenity = tag("amenity")
    return (
        F.when(tag("leisure") == "playground", "playground").when(amenity.isin("school", "kindergarten"), "school").when((amenity == "ice_cream") | (tag("cuisine") == "ice_cream"), "ice_cream")
        .when(amenity == "library", "library").when(amenity == "drinking_water", "water").when(amenity == "toilets", "restroom")
    )


def places_of(elements: DataFrame) -> DataFrame:
    """Elements (id, tags, lon, lat, center) with a kind and a position; an area stands at its centre. A
    coordinate of 0 counts as missing."""
    here = lambda c: F.coalesce(F.nullif(F.col(c), num(0)), F.col(f"center.{c}"))
    out = elements.select("id", place_kind(F.col("tags")).alias("kind"), F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"), F.round(here("lon"), 6).alias("lon"), F.round(here("lat"), 6).alias("lat"))
    return out.where("kind IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")


def touches_area(parts: Column) -> Column:
    """Any point of a list of lines lies in the area, bounds included."""
    return F.exists(F.flatten(parts), lambda p: p["lon"].between(WEST, EAST) & p["lat"].between(SOUTH, NORTH))


def construction(zones: DataFrame, permits: DataFrame, now: str) -> DataFrame:
    """id, src, starts, ends: work zones neither over nor more than three weeks off, whose dates may be missing or
    malformed, and permits with a position, which are not filtered by date again."""
    at, when = F.lit(now).cast("timestamp"), lambda c: F.try_to_timestamp(F.left(F.col(c), F.lit(19)))
    open_ = (when("ends").isNull() | (when("ends") >= at)) & (when("starts").isNull() | (when("starts") <= at + F.make_dt_interval(F.lit(HORIZON_DAYS))))
    day = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(10)).alias(c)
    z = zones.where(open_ & touches_area(F.col("parts"))).select("id", F.lit("zone").alias("src"), day("starts"), day("ends"))
    placed = permits.where(F.col("longitude").try_cast("double").isNotNull() & F.col("latitude").try_cast("double").isNotNull())
    return z.unionByName(placed.select("id", F.lit("permit").alias("src"), day("starts"), day("ends")))


def distinct_towns(rows: DataFrame) -> DataFrame:
    """The towns of comma lists (towns), without empty ones and dashes."""
    t = rows.select(F.explode(F.split("towns", ",")).alias("t")).select(F.trim("t").alias("town"))
    return t.where("town NOT IN ('', '-')").distinct()


def allowed(stored: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(stored, lambda k, v: k.isin(*keys))
