"""Names, sentences and labels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def title_case(name: Column) -> Column:
    """Capitals after anything that is no letter, apostrophes and hyphens included."""
    letters = F.split(F.lower(name), "")
    spelled = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(True).alias("start")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(s["start"], F.upper(c)).otherwise(c)).alias("out"), (~c.rlike(r"\p{L}")).alias("start")),
        lambda s: s["out"],
    )
    return F.when(name.isNotNull(), spelled)


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def one_decimal(x: Column, ties_up: bool = True) -> Column:
    """A number of 0 or more with one decimal, rounded by its exact binary value as C and JavaScript do (1.65 is
    a little less than that, so 1.6). Of true ties, as 0.25, up, or to even."""
    a, b = x * 8, x * 2
    s = a + b
    lost = (a - (s - (s - a))) + (b - (s - a))  # what rounding took from ten times x
    low = F.floor(s)
    tie = (low + 1 if ties_up else low + low % 2).cast("bigint")
    at_half = F.when(lost > 0, low + 1).when(lost < 0, low).otherwise(tie)
    n = F.when(s - low > 0.5, low + 1).when(s - low < 0.5, low).otherwise(at_half).cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def guide_metres(m: Column) -> Column:
    return F.when(m < 15, F.lit(0)).when(m < 100, half_up(m / 10) * 10).when(m < 500, half_up(m / 50) * 50).otherwise(half_up(m / 100) * 100).cast("bigint")


def guide_distance(m: Column) -> Column:
    r = guide_metres(m)
    km = F.when(r % 1000 == 0, (r / 1000).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", r / 1000))
    return F.when(r == 0, F.lit("now")).when(r < 1000, F.concat(r.cast("string"), F.lit(" m"))).otherwise(F.concat(km, F.lit(" km")))


def guide_voice(m: Column) -> Column:
    r = guide_metres(m)
    km = F.when(r % 1000 == 0, (r / 1000).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", r / 1000))
    unit = F.when(km == "1", F.lit(" kilometer")).otherwise(F.lit(" kilometers"))
    return F.when(r == 0, F.lit("now")).when(r < 1000, F.concat(r.cast("string"), F.lit(" meters"))).otherwise(F.concat(km, unit))


#: Words in a place's name and the sign they get, first match wins.
PLACE_SIGNS = (
    ("home|house", "🏠"), ("work|office", "💼"), ("school|daycare|kinder", "🏫"), ("park|playground", "🛝"), ("grand|savta|saba|oma|opa", "👵"), ("pool|swim", "🏊"), ("library", "📚"), ("friend", "🧑‍🤝‍🧑"),
)


def place_sign(name: Column) -> Column:
    out = F.lit("📍")
    for words, sign in reversed(PLACE_SIGNS):
        out = F.when(F.lower(name).rlike(words), F.lit(sign)).otherwise(out)
    return out


def newer_version(current: Column, latest: Column) -> Column:
    """Both must be tags app-vN; false otherwise."""
    number = lambda v: F.try_to_number(F.nullif(F.regexp_extract(F.trim(v), r"^app-v(\d+)$", 1), F.lit("")), F.lit("999999999999999999")).cast("bigint")
    return F.coalesce(number(latest) > number(current), F.lit(False))


def newer_build(remote: Column, bundled: Column) -> Column:
    """Dates as YYYY-MM-DD text; a malformed one is never newer."""
    good = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    return F.coalesce(remote.rlike(good) & bundled.rlike(good) & (remote > bundled), F.lit(False))


def turn_words(delta: Column) -> Column:
    side = F.when(delta < 0, F.lit("left")).otherwise(F.lit("right"))
    a = F.abs(delta)
    return F.when(a < 25, F.lit(None).cast("string")).when(a < 60, F.concat(F.lit("slight "), side)).when(a < 135, F.concat(F.lit("turn "), side)).otherwise(F.concat(F.lit("sharp "), side))


def compass_point(bearing: Column) -> Column:
    names = F.array(*map(F.lit, ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")))
    return F.element_at(names, (half_up(F.pmod(bearing, F.lit(360.0)) / 45) % 8 + 1).cast("int"))


def sunset_minutes(day_of_year: Column, lat: Column, lon: Column) -> Column:
    """Minutes after midnight UTC of sunset, by the usual solar position series; day 1 is 1 January."""
    g = (day_of_year - 1) * F.lit(2 * math.pi / 365)
    # Coefficients of the equation of time and of the declination.
    eqtime = (F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849) * 229.18
    decl = F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758 + F.sin(g * 2) * 0.000907 - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    cos_ha = F.lit(math.cos(math.radians(90.833))) / (F.cos(F.radians(lat)) * F.cos(decl)) - F.tan(F.radians(lat)) * F.tan(decl)
    ha = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_ha))))
    return F.lit(720.0) - (lon - ha) * 4 - eqtime


def safety_grade(stress: Column) -> Column:
    return F.when(stress <= 1.6, "A").when(stress <= 2.4, "B").when(stress <= 4, "C").when(stress <= 8, "D").otherwise("F")


def place_label(name: Column, house: Column, road: Column, neighbourhood: Column, suburb: Column, city: Column, display: Column) -> Column:
    """What a place is called: its name, else house and road, else the smallest area, else the first part of the
    long form; null if there is nothing."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(name), some(F.concat_ws(" ", house, road)), some(neighbourhood), some(suburb), some(city), some(F.split(display, ",")[0]))
