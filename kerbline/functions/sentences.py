"""Sentences about projects, streets, towns, rides and reports, and the links that carry a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.geo import num
from kerbline.functions.text import half_up, html_escape, one_decimal, safety_grade
from kerbline.operators.weights import lookup
from kerbline import dims

# What a class of street is today; labels and meanings of classes on a street's card.
TODAY = {
    "busy_street": "no bike facility on a busy road", "moderate_street": "no bike facility", "sharrow": "shared-lane markings only", "lane": "a painted bike lane", "buffered": "a buffered lane", "service": "a service road", "quiet_street": "a quiet street",
    "separated": "a separated lane", "path": "an off-street path",
}
LABEL = {
    "path": "off-street path", "separated": "separated lane", "buffered": "buffered lane", "quiet_street": "quiet street", "service": "alley/service", "lane": "painted lane", "sharrow": "sharrow", "moderate_street": "moderate street", "busy_street": "busy street",
}
MEANING = {
    "path": "off-street — no car traffic at all", "separated": "physically protected from car traffic", "buffered": "painted buffer only — no physical protection", "quiet_street": "low-traffic residential street, riding with cars",
    "service": "alley / service way, occasional vehicles", "lane": "paint only, directly beside moving traffic", "sharrow": "shared with car traffic, marking only", "moderate_street": "no bike facility, moderate traffic", "busy_street": "no protection on a busy street",
}
AVOIDABLE = ("lane", "buffered", "sharrow", "moderate_street", "busy_street")


def words_for(key: Column, words: dict[str, str], otherwise: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for k, v in words.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def project_sentence(name: Column, cls: Column, kind: Column, length_m: Column, join_m: Column, crashes: Column, towns: Column | None = None, pressure: Column | None = None, joins_region: Column | None = None, larger_m: Column | None = None, opened: Column | None = None, gaining: Column | None = None, headcount: bool = True) -> Column:
    """Where and what a project is, what it joins, what that opens, and its crash history; crashes are null where not
    measured. larger_m is the larger island's length, opened the destinations on the smaller one, gaining the
    residents (or, without headcount, homes) that gain a safe way; opened and gaining are null where access is not measured."""
    # The wording.
    today = words_for(cls, TODAY, F.regexp_replace(cls, "_", " "))
    place = F.lit("") if towns is None else F.when(F.coalesce(towns, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ("), towns, F.lit(")")))
    metres = F.format_string("%.0f m", F.bround(length_m))
    what = F.when(kind == "spot_fix", F.concat(F.lit("a spot fix on "), name, place, F.lit(" — "), metres, F.lit(" of it, today "), today)).otherwise(F.concat(metres, F.lit(" of "), name, place, F.lit(" — today "), today))
    km = lambda m: F.concat(one_decimal(m / 1000, ties_up=False), F.lit(" km"))
    joins = F.concat(F.lit("unlocks "), km(join_m), F.lit(" of kid-safe streets"))
    if larger_m is not None:
        joins = F.when(larger_m.isNotNull(), F.concat(F.lit("connects "), km(join_m), F.lit(" of kid-safe streets to a "), km(larger_m), F.lit(" network"))).otherwise(joins)
    if joins_region is not None:
        joins = F.when(joins_region, F.concat(F.lit("connects "), km(join_m), F.lit(" of kid-safe streets to the region-wide network"))).otherwise(joins)
    reach = []
    if opened is not None:
        reach.append(F.when(opened > 0, F.concat(F.lit("opens a network with "), opened.cast("string"), F.when(opened == 1, F.lit(" school, playground or library")).otherwise(F.lit(" schools, playgrounds and libraries")), F.lit(" on it"))))
    if gaining is not None:
        reach.append(F.when(gaining > 0, F.concat(F.lit("about "), F.format_number(F.bround(gaining), 0), F.lit(" residents gain a safe route")) if headcount else F.lit("more homes gain a safe route")))
    history = F.when(crashes > 0, F.concat(crashes.cast("string"), F.lit(" bike crash"), F.when(crashes == 1, F.lit("")).otherwise(F.lit("es")), F.lit(" since 2021")))
    if pressure is not None:
        history = F.when(crashes.isNull() & (pressure > 0), F.lit("recorded bike crashes nearby")).otherwise(history)
    return F.concat_ws("; ", what, F.when(join_m > 0, joins), *reach, history)


def class_grade(cls: Column) -> Column:
    """Null for a class that is not known."""
    mult = lookup(cls, dims.YOUNG_KIDS)
    return F.when(mult.isNotNull(), safety_grade(mult))


def street_card(name: Column, cls: Column, crashes: Column) -> Column:
    label, meaning = F.coalesce(words_for(cls, LABEL), F.lit("type unknown")), words_for(cls, MEANING)
    n = F.when(crashes > 0, F.concat(crashes.cast("string"), F.lit(" bike crash"), F.when(crashes > 1, F.lit("es")).otherwise(F.lit("")), F.lit(" recorded nearby")))
    return F.concat_ws(" | ", class_grade(cls), html_escape(F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed"))), label, meaning, n)


def town_sentence(safe_km: Column, pocket_km: Column, pockets: Column, connected_km: Column, budget_km: float) -> Column:
    # The wording.
    start = F.lit(f"Measured as a {budget_km:g} km ride that avoids traffic a child shouldn't be in. ")
    km = lambda c: F.concat(one_decimal(c), F.lit(" km"))
    split = F.concat(F.lit("The streets they can use don't join up: "), km(pocket_km), F.lit(" of them sit in "), pockets.cast("string"), F.lit(" pockets with no safe way out."))
    joined = F.concat(F.lit("Most of the safe network here does join up — "), km(connected_km), F.lit(" of it — so the gaps are specific: "), km(pocket_km), F.lit(" stranded in "), pockets.cast("string"), F.lit(" pockets, and the crossings between them."))
    return F.concat(start, F.when(safe_km <= 0, F.lit("Almost no street here is one a child can ride away from.")).when(pocket_km / safe_km >= 0.3, split).otherwise(joined))


def ride_sentence(day: Column, meters: Column, moving_s: Column, protected: Column, quiet: Column) -> Column:
    # The wording.
    speed = F.when(moving_s > 0, one_decimal(meters / moving_s * 3.6)).otherwise(F.lit("0"))
    return F.concat(F.lit("🚲 Family bike ride, "), day, F.lit(": "), one_decimal(meters / 1000), F.lit(" km in "), half_up(moving_s / 60).cast("string"), F.lit(" min ("), speed, F.lit(" km/h), "), protected.cast("string"), F.lit("% on protected paths + "), quiet.cast("string"), F.lit("% quiet streets."))


def report_sentence(label: Column, note: Column, lat: Column, lon: Column) -> Column:
    # The wording.
    said = F.when(F.trim(F.coalesce(note, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.trim(note), F.lit(".")))
    return F.concat(F.lit("Bike hazard report: "), label, F.lit("."), said, F.lit(" Location: "), F.format_string("%.6f,%.6f", lat, lon), F.lit("."))


def link_fields(fragment: Column) -> dict[str, Column]:
    """Fields of a shared link's fragment (s=lon,lat&e=lon,lat&m=profile&f=1&wk=metres&x=classes&o=option)."""
    p = F.str_to_map(fragment, F.lit("&"), F.lit("="))
    get = lambda k: F.try_element_at(p, F.lit(k))

    def point(k: str) -> Column:
        parts = F.transform(F.split(get(k), ","), lambda v: F.trim(v).try_cast("double"))
        return F.when((F.size(parts) == 2) & F.get(parts, F.lit(0)).isNotNull() & F.get(parts, F.lit(1)).isNotNull(), parts)

    profile = F.when(get("m") == "kids", F.lit("young_kids")).when(get("m").isin(*dims.PROFILES), get("m"))
    walk = F.when(get("wk") == "1", num(500)).when(get("wk").isNotNull(), F.greatest(num(0), F.least(num(2000), F.coalesce(get("wk").try_cast("double"), num(0))))).otherwise(num(0))
    avoid = F.filter(F.split(F.coalesce(get("x"), F.lit("")), ","), lambda t: t.isin(*AVOIDABLE))
    return {"start": point("s"), "end": point("e"), "profile": profile, "flat": F.coalesce(get("f") == "1", F.lit(False)), "walk_m": walk, "avoid": avoid, "option": F.when(get("o").isin("safest", "balanced", "direct"), get("o"))}


def link_of(lon: Column, lat: Column, to_lon: Column, to_lat: Column, profile: Column, flat: Column, walk_m: Column, avoid: Column) -> Column:
    at = lambda x, y: F.format_string("%.6f,%.6f", x, y)
    return F.concat_ws("&", F.concat(F.lit("s="), at(lon, lat)), F.concat(F.lit("m="), profile), F.when(flat, F.lit("f=1")), F.when(walk_m > 0, F.concat(F.lit("wk="), walk_m.cast("int").cast("string"))), F.when(F.size(avoid) > 0, F.concat(F.lit("x="), F.array_join(avoid, ","))), F.concat(F.lit("e="), at(to_lon, to_lat)))
