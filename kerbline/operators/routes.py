"""What is told about routes: summaries, grades, runs, alerts, cues, turns and tracks.

A leg is one street of a route: route_id, seq, u, v, cls, name ('' if none), length, crash_factor, xpen,
climb, road_busy, walk, e0, e1, alon, alat, blon, blat. Every function works on the legs of any number of
routes at once; what depends on order within a route is a window over its legs, and only rules that
depend on what was kept before (merging turns, thinning alerts) fold over a route's short event list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import dims
from kerbline.functions import text
from kerbline.functions.geo import M_LAT, M_LON, compass_bearing, mean_lat_distance, num, turn_angle
from kerbline.operators.weights import stress_mult

WALK_STRESS = 1.3


def _by_seq():
    return Window.partitionBy("route_id").orderBy("seq")


def _running():
    return _by_seq().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _by_seq().rowsBetween(Window.unboundedPreceding, -1)


def metres_text(m: Column) -> Column:
    return F.when(m < 1000, F.concat(text.half_up(m).cast("string"), F.lit(" m"))).otherwise(F.concat(text.one_decimal(m / 1000), F.lit(" km")))


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(num(0)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, text.half_up(part * 100 / whole)).otherwise(F.lit(0).cast("bigint"))


def summaries(legs: DataFrame, pace_kmh: float = dims.PROFILES["young_kids"][3]) -> DataFrame:
    """route_id, meters, minutes, walk_m, climb_m, pct_protected, pct_quiet: every option at the rider's own pace."""
    length, ridden = F.col("length"), ~F.col("walk")
    s = legs.groupBy("route_id").agg(
        F.sum("length").alias("t"), _sum_if(F.col("walk"), length).alias("w"), F.sum("climb").alias("c"),
        _sum_if(ridden & F.col("cls").isin(*dims.PROTECTED_OR_BUFFERED), length).alias("p"), _sum_if(ridden & F.col("cls").isin(*dims.QUIET), length).alias("q"),
    )
    minutes = ((F.col("t") - F.col("w")) / 1000 / pace_kmh + F.col("w") / 1000 / dims.WALK_KMH) * 60
    return s.select("route_id", text.half_up(F.col("t")).alias("meters"), text.half_up(minutes).alias("minutes"), text.half_up(F.col("w")).alias("walk_m"), text.half_up(F.col("c")).alias("climb_m"), _share(F.col("p"), F.col("t")).alias("pct_protected"), _share(F.col("q"), F.col("t")).alias("pct_quiet"))


def metres_by_class(legs: DataFrame) -> DataFrame:
    """route_id, cls, meters, place: ridden metres of each class, most first."""
    per = legs.where(~F.col("walk")).groupBy("route_id", "cls").agg(F.sum("length").alias("m"), F.min("seq").alias("first"))
    order = Window.partitionBy("route_id").orderBy(F.desc("m"), "first")
    return per.select("route_id", "cls", text.half_up(F.col("m")).alias("meters"), F.row_number().over(order).alias("place"))


def grades(legs: DataFrame) -> DataFrame:
    """route_id, grade, reason: mean cost of a metre on the youngest riders' scale; a walked metre is calm."""
    mult = F.when(F.col("walk"), num(WALK_STRESS)).otherwise(stress_mult(F.col("cls"), F.col("road_busy")))
    stressful = ~F.col("walk") & F.col("cls").isin(*dims.CAUTION)
    s = legs.groupBy("route_id").agg(
        F.sum("length").alias("t"), F.sum(F.col("length") * mult * F.col("crash_factor") + F.col("xpen")).alias("c"), _sum_if(stressful, F.col("length")).alias("s"),
        _sum_if(F.col("cls").isin(*dims.PROTECTED_OR_BUFFERED), F.col("length")).alias("p"),
    )
    mean = F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(num(1))
    calm = F.when(F.col("s") < 30, F.lit("no busy/moderate streets")).otherwise(F.concat(metres_text(F.col("s")), F.lit(" on busy/moderate streets")))
    reason = F.concat(F.lit("avg kid-stress "), text.one_decimal(mean), F.lit("× per meter — "), _share(F.col("p"), F.col("t")).cast("string"), F.lit("% protected, "), calm)
    return s.select("route_id", text.safety_grade(mean).alias("grade"), reason.alias("reason"))


def _runs(rows: DataFrame, changed: Column) -> DataFrame:
    """rows with `run`, counting up in each route wherever `changed` holds."""
    return rows.withColumn("_new", F.when(changed, 1).otherwise(0)).withColumn("run", F.sum("_new").over(_running())).drop("_new")


def cautions(legs: DataFrame) -> DataFrame:
    """route_id, seq, name, cls, meters, lon, lat: stressful stretches of 15 m or more. Calm legs in between
    do not break a stretch of one name and class."""
    rows = legs.where(~F.col("walk") & F.col("cls").isin(*dims.CAUTION)).withColumn("name", F.when(F.col("name") == "", F.lit("unnamed")).otherwise(F.col("name")))
    same = (F.lag("name").over(_by_seq()) == F.col("name")) & (F.lag("cls").over(_by_seq()) == F.col("cls"))
    per = _runs(rows, ~F.coalesce(same, F.lit(False))).groupBy("route_id", "run").agg(
        F.min("seq").alias("seq"), F.first("name").alias("name"), F.first("cls").alias("cls"), F.sum("length").alias("m"), F.min_by("alon", "seq").alias("lon"), F.min_by("alat", "seq").alias("lat"),
    )
    return per.where(F.col("m") >= dims.CAUTION_MIN_M).select("route_id", "seq", "name", "cls", text.half_up(F.col("m")).alias("meters"), "lon", "lat")


def protected_runs(legs: DataFrame) -> DataFrame:
    """route_id, seq, name, meters: unbroken protected stretches, named by the street with most metres (the
    first of equals)."""
    safe = F.col("cls").isin(*dims.PROTECTED)
    rows = _runs(legs.withColumn("safe", safe), F.coalesce(F.lag("safe").over(_by_seq()), F.lit(False)) != F.col("safe")).where("safe")
    named = rows.groupBy("route_id", "run", "name").agg(F.sum("length").alias("m"), F.min("seq").alias("first"))
    best = F.max(F.when(F.col("name") != "", F.struct("m", (-F.col("first")).alias("f"), "name")))
    per = named.groupBy("route_id", "run").agg(F.sum("m").alias("meters"), F.min("first").alias("seq"), best.alias("b"))
    return per.where("meters >= 1").select("route_id", "seq", F.coalesce("b.name", F.lit("off-street path")).alias("name"), "meters")


def stress_figures(legs: DataFrame) -> DataFrame:
    """route_id, stress_m, hotspot_m: ridden metres on stressful streets, metres where crashes cluster."""
    stressful = ~F.col("walk") & F.col("cls").isin(*dims.CAUTION)
    return legs.groupBy("route_id").agg(_sum_if(stressful, F.col("length")).alias("stress_m"), _sum_if(F.col("crash_factor") >= dims.HOTSPOT_FACTOR, F.col("length")).alias("hotspot_m"))


def ribbon(legs: DataFrame) -> DataFrame:
    """Each leg with the shares of the route's length where it begins and ends, and whether a crossing is flagged."""
    total = F.sum("length").over(Window.partitionBy("route_id"))
    to = F.sum("length").over(_running())
    return legs.select("route_id", "seq", "cls", F.col("length").alias("m"), "e0", "e1", (~F.col("walk") & (F.col("xpen") > dims.CROSSING_FLAG_M)).alias("crossing"), "walk", ((to - F.col("length")) / total).alias("x0"), (to / total).alias("x1"))


def cues(legs: DataFrame) -> DataFrame:
    """route_id, seq, km, text: a row where the street's name or walking changes, and one for the arrival."""
    name = F.when(F.col("name") == "", F.lit("(unnamed path)")).otherwise(F.col("name"))
    rows = legs.withColumn("name", name).withColumn("done", F.coalesce(F.sum("length").over(_before()), num(0)))
    same = (F.lag("name").over(_by_seq()) == F.col("name")) & (F.lag("walk").over(_by_seq()) == F.col("walk"))
    said = F.when(F.col("walk"), F.concat(F.lit("🚶 walk the bike — "), "name")).otherwise(F.concat(F.col("name"), F.lit(" — "), F.regexp_replace("cls", "_", " ")))
    changed = rows.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same"))
    km = lambda m: text.half_up(m / 100) / 10
    last = rows.groupBy("route_id").agg((F.max("seq") + 1).alias("seq"), km(F.sum("length")).alias("km")).withColumn("text", F.lit("arrive"))
    return changed.select("route_id", "seq", km(F.col("done")).alias("km"), said.alias("text")).unionByName(last)


UNNAMED = {"path": "the bike path", "separated": "the separated lane", "buffered": "the bike lane", "lane": "the bike lane", "service": "the service road"}
NEAR_M, THIN_M, STRETCH_M = 15.0, 30.0, 30.0


def turns(legs: DataFrame) -> DataFrame:
    """route_id, seq, at_m, text, voice before any merging: bends of 25 degrees or more and changes of name."""
    metres = mean_lat_distance(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    heading = compass_bearing(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    rows = legs.withColumns({"_m": metres, "_to": heading}).withColumns({"at_m": F.coalesce(F.sum("_m").over(_before()), num(0)), "_from": F.lag("_to").over(_by_seq()), "_was": F.lag("name").over(_by_seq())})
    word = text.turn_words(turn_angle(F.col("_from"), F.col("_to")))
    unnamed = F.lit("the side street")
    for cls, said in UNNAMED.items():
        unnamed = F.when(F.col("cls") == cls, F.lit(said)).otherwise(unnamed)
    target = F.when(F.col("name") != "", F.col("name")).otherwise(unnamed)
    renamed = (F.col("name") != "") & (F.col("name") != F.col("_was"))
    said = rows.where(F.col("_from").isNotNull()).withColumns({"_word": word, "text": target}).where(F.col("_word").isNotNull() | renamed)
    said = said.select("route_id", "seq", "at_m", "text", F.concat(F.coalesce("_word", F.lit("continue")), F.lit(" onto "), "text").alias("voice"))
    end = rows.groupBy("route_id").agg((F.max("seq") + 1).alias("seq"), F.sum("_m").alias("at_m")).select("route_id", "seq", "at_m", F.lit("destination").alias("text"), F.lit("you have arrived").alias("voice"))
    return said.unionByName(end)


def maneuvers(legs: DataFrame) -> DataFrame:
    """route_id, place, at_m, text, voice: turns less than 15 m after the one kept before are joined to it, once."""
    kind = "array<struct<seq:bigint,at_m:double,text:string,voice:string>>"
    events = turns(legs).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "at_m", "text", "voice"))).alias("e"))

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        joins = F.coalesce((x["at_m"] - last["at_m"] < NEAR_M) & (x["text"] != "destination") & ~last["voice"].contains(", then "), F.lit(False))
        both = F.struct(last["seq"].alias("seq"), last["at_m"].alias("at_m"), x["text"].alias("text"), F.concat(last["voice"], F.lit(", then "), x["voice"]).alias("voice"))
        return F.when(joins, F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(kept, F.array(x))).cast(kind)

    merged = events.select("route_id", F.posexplode(F.aggregate("e", F.array().cast(kind), step)).alias("place", "m"))
    return merged.select("route_id", "place", "m.at_m", "m.text", "m.voice")


ALERT_WORDS = {"sharrow": "a shared lane", "moderate_street": "a moderate street", "busy_street": "a busy street"}


def alert_events(legs: DataFrame) -> DataFrame:
    """route_id, at_m, ord, voice of every alert before thinning: crossings, stressful stretches of 30 m, walks."""
    rows = legs.withColumn("at", F.coalesce(F.sum("length").over(_before()), num(0)))
    tens = lambda m: (text.half_up(m / 10) * 10).cast("string")
    crossing = rows.where(~F.col("walk") & (F.col("xpen") > dims.CROSSING_FLAG_M)).select("route_id", F.col("at").alias("at_m"), F.col("seq").alias("ord"), F.lit("busy street crossing. gather up.").alias("voice"))
    word = F.lit(None).cast("string")
    for cls, said in ALERT_WORDS.items():
        word = F.when(F.col("cls") == cls, F.lit(said)).otherwise(word)
    stretch = _runs(rows, ~F.coalesce(F.lag("cls").over(_by_seq()) == F.col("cls"), F.lit(False))).withColumn("word", word).where("word IS NOT NULL")
    stretch = stretch.groupBy("route_id", "run").agg(F.min("at").alias("at_m"), F.max("seq").alias("ord"), F.sum("length").alias("m"), F.first("word").alias("word")).where(F.col("m") >= STRETCH_M)
    stretch = stretch.select("route_id", "at_m", (F.col("ord") + 0.5).alias("ord"), F.concat(F.lit("entering "), "word", F.lit(" for "), tens(F.col("m")), F.lit(" meters. ride carefully.")).alias("voice"))
    on_foot = _runs(rows, F.coalesce(F.lag("walk").over(_by_seq()), F.lit(False)) != F.col("walk")).where("walk").groupBy("route_id", "run").agg(F.min("at").alias("at_m"), F.max(F.col("at") + F.col("length")).alias("to_m"), F.max("seq").alias("ord"), F.sum("length").alias("m"))
    ends = legs.groupBy("route_id").agg(F.max("seq").alias("last"))
    hop = on_foot.select("route_id", "at_m", (F.col("ord") + 0.6).alias("ord"), F.concat(F.lit("hop off and walk the bike for about "), tens(F.col("m")), F.lit(" meters.")).alias("voice"))
    again = on_foot.join(ends, "route_id").where("ord < last").select("route_id", F.col("to_m").alias("at_m"), (F.col("ord") + 0.7).alias("ord"), F.lit("you can ride again.").alias("voice"))
    return crossing.unionByName(stretch).unionByName(hop).unionByName(again)


def alerts(legs: DataFrame) -> DataFrame:
    """route_id, place, at_m, voice: alerts by position, without those within 30 m of the one kept before."""
    kind = "array<struct<at_m:double,ord:double,voice:string>>"
    events = alert_events(legs).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("at_m", F.col("ord").cast("double").alias("ord"), "voice"))).alias("e"))
    keep = lambda kept, x: F.when(F.coalesce(x["at_m"] - F.try_element_at(kept, F.lit(-1))["at_m"] < THIN_M, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))).cast(kind)
    return events.select("route_id", F.posexplode(F.aggregate("e", F.array().cast(kind), keep)).alias("place", "a")).select("route_id", "place", "a.at_m", "a.voice")


def track(legs: DataFrame) -> DataFrame:
    """route_id, idx, lon, lat, cum_m: the points of a route without repeats, and the metres up to each."""
    first = legs.select("route_id", (F.col("seq") * 2).alias("at"), F.col("alon").alias("lon"), F.col("alat").alias("lat"))
    points = first.unionByName(legs.select("route_id", (F.col("seq") * 2 + 1).alias("at"), F.col("blon").alias("lon"), F.col("blat").alias("lat")))
    order = Window.partitionBy("route_id").orderBy("at")
    again = (F.lag("lon").over(order) == F.col("lon")) & (F.lag("lat").over(order) == F.col("lat"))
    once = points.withColumn("again", F.coalesce(again, F.lit(False))).where("NOT again")
    step = F.coalesce(mean_lat_distance(F.lag("lon").over(order), F.lag("lat").over(order), F.col("lon"), F.col("lat")), num(0))
    once = once.withColumns({"step": step, "idx": F.row_number().over(order).cast("bigint") - 1})
    return once.select("route_id", "idx", "lon", "lat", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum_m"))


def bearing_ahead(points: DataFrame, ahead_m: float = 60.0) -> DataFrame:
    """route_id, idx, bearing: from each point of a track to the first one at least ahead_m further, or the last."""
    order = Window.partitionBy("route_id").orderBy("idx")
    later = F.collect_list(F.struct("cum_m", "lon", "lat")).over(order.rowsBetween(1, 200))  # bounded look-ahead
    far = F.filter(later, lambda p: p["cum_m"] - F.col("cum_m") >= ahead_m)
    at = F.when(F.size(far) > 0, F.get(far, F.lit(0))).otherwise(F.try_element_at(later, F.lit(-1)))
    rows = points.withColumn("to", at).where("to IS NOT NULL")
    return rows.select("route_id", "idx", compass_bearing(F.col("lon"), F.col("lat"), F.col("to.lon"), F.col("to.lat")).alias("bearing"))


def ridden(points: DataFrame, up_to: Column) -> DataFrame:
    """route_id, idx, lon, lat: the track's first up_to metres, its last point interpolated."""
    order = Window.partitionBy("route_id").orderBy("idx")
    p = points.withColumns({"_pm": F.lag("cum_m").over(order), "_plon": F.lag("lon").over(order), "_plat": F.lag("lat").over(order), "_to": up_to})
    p = p.where((F.col("cum_m") < F.col("_to")) | ((F.col("_pm") < F.col("_to")) & (F.col("cum_m") > F.col("_pm"))))
    t = F.when(F.col("cum_m") < F.col("_to"), num(1)).otherwise((F.col("_to") - F.col("_pm")) / (F.col("cum_m") - F.col("_pm")))
    mixed = lambda a, b: F.when(t == 1, F.col(b)).otherwise(F.col(a) + t * (F.col(b) - F.col(a)))
    return p.select("route_id", "idx", mixed("_plon", "lon").alias("lon"), mixed("_plat", "lat").alias("lat"))


def snapped(fixes: DataFrame, points: DataFrame) -> DataFrame:
    """route_id, seq, idx, off_m, along_m: the nearest segment of its own route for every fix, the first of equals."""
    order = Window.partitionBy("route_id").orderBy("idx")
    segments = points.withColumns({"blon": F.lead("lon").over(order), "blat": F.lead("lat").over(order)}).where("blon IS NOT NULL").select("route_id", "idx", F.col("lon").alias("alon"), F.col("lat").alias("alat"), "blon", "blat", "cum_m")
    kx = F.cos(F.radians("lat")) * M_LON
    ax, ay = (F.col("lon") - F.col("alon")) * kx, (F.col("lat") - F.col("alat")) * M_LAT
    bx, by = (F.col("blon") - F.col("alon")) * kx, (F.col("blat") - F.col("alat")) * M_LAT
    long2 = bx * bx + by * by
    t = F.when(long2 > 0, F.greatest(num(0), F.least(num(1), (ax * bx + ay * by) / F.nullif(long2, num(0))))).otherwise(num(0))
    off = F.sqrt(F.pow(ax - t * bx, num(2)) + F.pow(ay - t * by, num(2)))
    near = fixes.select("route_id", "seq", "lon", "lat").join(segments, "route_id").groupBy("route_id", "seq").agg(F.min(F.struct(off.alias("off_m"), "idx", (F.col("cum_m") + t * F.sqrt(long2)).alias("along_m"))).alias("b"))
    return near.select("route_id", "seq", "b.idx", "b.off_m", "b.along_m")


def gpx(points: DataFrame, name: Column, creator: str) -> DataFrame:
    """route_id, gpx: one document for each track."""
    rows = points.groupBy("route_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.concat(F.lit('      <trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('"/>'))), "\n").alias("points"))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <trk>\n    <name>')
    return rows.select("route_id", F.concat(head, F.regexp_replace(name, "[<>&]", ""), F.lit("</name>\n    <trkseg>\n"), "points", F.lit("\n    </trkseg>\n  </trk>\n</gpx>")).alias("gpx"))


def labels(legs: DataFrame) -> DataFrame:
    """route_id, label: the first and the last street with a name."""
    named = legs.where("name <> ''").groupBy("route_id").agg(F.min_by("name", "seq").alias("a"), F.max_by("name", "seq").alias("b"))
    return named.select("route_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit(" → "), "b")).alias("label"))


def explained(legs: DataFrame, direct: DataFrame, busy_cost: float, profile_label: str) -> DataFrame:
    """route_id, reasons: sentences on what a route gains over the direct one of the same route_id."""
    s, d = summaries(legs).join(stress_figures(legs), "route_id"), summaries(direct).join(stress_figures(direct), "route_id")
    both = s.join(d.select("route_id", F.col("meters").alias("d_meters"), F.col("stress_m").alias("d_stress"), F.col("hotspot_m").alias("d_hotspot")), "route_id")
    worst = cautions(direct).groupBy("route_id").agg(F.max_by(F.struct("meters", "name"), F.struct("meters", (-F.col("seq")).alias("s"))).alias("worst"))
    long = protected_runs(legs).where("meters >= 300").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("meters")).alias("m"), "seq", "name"))).alias("runs"))
    left = cautions(legs).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "name", "cls", "meters"))).alias("left"))
    rows = both.join(worst, "route_id", "left").join(long, "route_id", "left").join(left, "route_id", "left")
    detour = F.when(F.col("d_meters") > 0, text.half_up((F.col("meters") / F.col("d_meters") - 1) * 100)).otherwise(0)
    m = metres_text
    gain = F.when(detour >= 3, F.concat(F.lit(f'In {profile_label} weighting an unprotected busy street "costs" {busy_cost:g}× its length, so this route accepts +'), detour.cast("string"), F.lit("% distance ("), m(F.col("meters")), F.lit(" vs "), m(F.col("d_meters")), F.lit(" direct) to cut high-stress riding from "), m(F.col("d_stress")), F.lit(" down to "), m(F.col("stress_m")), F.lit("."))).otherwise(F.lit("The direct route is already the lowest-stress option here — no detour was needed."))
    kept = F.when(F.col("stress_m") < 30, F.lit("avoids all of it.")).otherwise(F.concat(F.lit("keeps that to "), m(F.col("stress_m")), F.lit(".")))
    instead = F.when(F.col("d_stress") - F.col("stress_m") > 100, F.concat(F.lit("The direct route would spend "), m(F.col("d_stress")), F.lit(" on busy or moderate streets — worst stretch: "), m(F.col("worst.meters")), F.lit(" along "), F.col("worst.name"), F.lit(". This route "), kept))
    named = F.array_join(F.transform(F.slice("runs", 1, 3), lambda r: F.concat(r["name"], F.lit(" ("), m(-r["m"]), F.lit(")"))), ", ")
    backbone = F.when(F.size("runs") > 0, F.concat(F.lit("Backbone: "), named, F.lit(" — off-street paths or physically separated lanes ("), F.col("pct_protected").cast("string"), F.lit("% of the ride is protected).")))
    quiet = F.when(F.col("pct_quiet") >= 25, F.concat(F.lit("Connections between protected stretches run on quiet residential streets ("), F.col("pct_quiet").cast("string"), F.lit("% of the ride).")))
    around = F.col("d_hotspot") - F.col("hotspot_m")
    spots = F.when(around > 150, F.concat(F.lit("It also steers around ~"), m(around), F.lit(" of bike-crash hotspots on the direct route.")))
    compromises = F.transform(F.coalesce("left", F.array().cast("array<struct<seq:bigint,name:string,cls:string,meters:bigint>>")), lambda c: F.concat(F.lit("Unavoidable compromise: "), m(c["meters"]), F.lit(" of "), F.regexp_replace(c["cls"], "_", " "), F.lit(" along "), c["name"], F.lit(" — no lower-stress connection exists there.")))
    return rows.select("route_id", F.filter(F.concat(F.array(gain, instead, backbone, quiet, spots), compromises), lambda x: x.isNotNull()).alias("reasons"))
