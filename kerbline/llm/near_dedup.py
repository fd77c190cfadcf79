"""MinHash near-duplicate detection by bottom-k sketches from one hash function.

1. Every document becomes the set of its distinct 5-word shingles, hashed once; equal sets are one
   class, so exact copies meet only in an aggregation.
2. A class keeps the k smallest hashes. Inverted lists of the retained values give overlaps. A
   class enters only the lists of its rarest values: two sketches that overlap in c values share one
   of the first k - c + 1 of each in any common order.
3. A list that is long at k = 40 holds common passages or large groups. Its members are listed again by their
   whole sets, where sizes and positions bound the overlap exactly; so no list is cut.
4. Pairs of one list are compared where it is short. In a long list every member is compared with the most central
   member. Linked members form components; the rest is held against drawn
   members as long as that joins many, then all pairs across components that sizes and positions allow are compared.
   Of the lists that hold both members of a pair, the rarest makes the pair (up to EARLY rarer ones are looked at).
5. Every link is confirmed on full shingle sets.

Links are 100 * |A and B| >= threshold * |A or B|. A pair at exactly the threshold is missed with a chance
under 1e-7 (six standard deviations of the sketch overlap); sets smaller than k are exact.

Defined cases: a null text, or one without words, has no shingles and links with nothing; fewer
words than a shingle count as one shingle; a repeated row is a copy of itself and gets the same
answer; rows without doc_id are copies or links of others but name no component (null if alone, and
kept); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.projects import numbered

from .cluster import BLOOM_BITS, bit_columns, bit_set, components, cut, in_bit_set, small_batches
from .wordhash import NON_SPACE, gram_hashes, mix, words_of

WIDTH, THRESHOLD = 5, 85
STAGE_THRESHOLD = 80  # the pipeline's; THRESHOLD is the contract of op7 alone
SMALL_K, LONG_LIST, EARLY, ENOUGH = 40, 16, 32, 16


def _shingle_sets(column, width):
    for first, stop, at, _, _, hashes in words_of(column, NON_SPACE):
        for i in range(stop - first):
            words = hashes[at[i] : at[i + 1]]
            yield np.unique(gram_hashes(words, width) if len(words) >= width else gram_hashes(words, len(words)) if len(words) else words)


def sketches(docs: DataFrame, width: int = WIDTH, k: int = SMALL_K) -> DataFrame:
    """doc_id, n, h1, h2 (the set's 128-bit fingerprint) and sketch (its k smallest hashes, ascending)."""
    small_batches(docs.sparkSession)

    def kernel(batches):
        for batch in batches:
            n, h1, h2, at, kept = [], [], [], [0], []
            for s in _shingle_sets(batch.column(1), width):
                n.append(len(s))
                h1.append(s.sum(dtype=np.uint64))
                h2.append(np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0))
                kept.append(s[:k])
                at.append(at[-1] + len(kept[-1]))
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))],
                ["doc_id", "n", "h1", "h2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def shingle_sets(docs: DataFrame, wanted: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id and the whole sorted shingle set of documents whose bits are set in `wanted`."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def kernel(batches):
        for batch in batches:
            hit = in_bit_set(bits.value, batch.column(2).to_numpy()) & in_bit_set(bits.value, batch.column(3).to_numpy())
            batch = batch.filter(pa.array(hit))
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sets = list(_shingle_sets(part.column(1), width))
                at = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["doc_id", "shingles"])

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return named.select("doc_id", "text", *bit_columns("doc_id", BLOOM_BITS)).mapInArrow(kernel, "doc_id long, shingles array<long>")


def least_overlap(n, k: int | None, threshold: int):
    """Values that two sketches of linked sets share at least, given one set's size; k is None for whole sets."""
    exact = F.ceil(n * threshold / 100)
    if k is None:
        return exact.cast("int")
    t = threshold / 100
    sure = max(1, math.floor(t * k - 6 * math.sqrt(t * (1 - t) * k)))
    return F.when(n < t * k, exact).otherwise(F.lit(sure)).cast("int")


def prefix_rows(sets: DataFrame, k: int | None, threshold: int) -> DataFrame:
    """Inverted lists over the rarest values of sketches: rows (value, doc, n, rest, short, whole, central, early).

    rest: values of the doc's sketch after this one in rare-first order. short: the value also lies in
    the shorter prefix that is enough for the smaller set of a pair. whole: the sketch is exact. early: the
    doc's first values in the same order, up to EARLY of whole sets and a quarter as many of sketches, before this one.
    """
    early = EARLY if k is None else EARLY // 4
    flat = sets.select("doc", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = cut(flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    per_doc = flat.join(shared, "value").groupBy("doc", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    whole = F.lit(True) if k is None else F.col("n") < threshold / 100 * k
    alone = F.col("kept") - F.size("common")
    long_prefix = F.col("kept") - least_overlap(F.col("n"), k, threshold) + 1 - alone
    per_doc = per_doc.select(
        "doc", "n", whole.alias("whole"), (F.size("common") / F.col("kept")).alias("central"), F.col("common.value").alias("common"), long_prefix.alias("long_prefix"),
        F.when(whole, F.col("n") - F.ceil(F.col("n") * 2 * threshold / (100 + threshold)) + 1 - alone).otherwise(long_prefix).alias("short_prefix"),
    )
    rows = per_doc.where("long_prefix > 0").select("doc", "n", "whole", "central", "short_prefix", F.size("common").alias("listed"), F.slice("common", 1, early).alias("first"), F.posexplode(F.expr("slice(common, 1, long_prefix)")).alias("i", "value"))
    return cut(rows.select("value", "doc", "n", "whole", "central", (F.col("listed") - F.col("i") - 1).alias("rest"), (F.col("i") < F.col("short_prefix")).alias("short"), F.slice("first", 1, F.least("i", F.lit(early))).alias("early")))


def long_lists(rows: DataFrame, long_list: int) -> DataFrame:
    """value and leader (the most central member) of the lists with more than long_list members."""
    heads = rows.groupBy("value").agg(F.count("*").alias("size"), F.max(F.struct("central", (-F.col("doc")).alias("less"))).alias("head"))
    return cut(heads.where(F.col("size") > long_list).select("value", (-F.col("head.less")).alias("leader")))


def _possible(x, y, threshold: int):
    """Whether sizes and positions let x and y, members of one list with (n, doc) of x below y's, be a link, and no earlier list has both."""
    t = threshold
    sizes = x["short"] & (x["n"] * 100 >= y["n"] * t)
    places = ~x["whole"] | ~y["whole"] | ((1 + F.least(x["rest"], y["rest"])) * (100 + t) >= t * (x["n"] + y["n"]))
    return sizes & places & ~F.arrays_overlap(x["early"], y["early"])


def _list_pairs(rows: DataFrame, longs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) within the lists that are not long, so at most long_list of them for each row."""
    held = rows.join(longs.select("value"), "value", "left_anti").groupBy("value").agg(F.sort_array(F.collect_list(F.struct("n", "doc", "rest", "short", "whole", "early"))).alias("m"))

    def later(x, i):
        rest = F.filter(F.slice("m", i + 2, F.size("m")), lambda y: _possible(x, y, threshold))
        return F.transform(rest, lambda y: F.struct(F.least(x["doc"], y["doc"]).alias("a"), F.greatest(x["doc"], y["doc"]).alias("b")))

    return held.where(F.size("m") > 1).select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.*")


def _star_pairs(rows: DataFrame, longs: DataFrame) -> DataFrame:
    """Pairs of the members of long lists with their lists' leaders."""
    each = rows.select("value", "doc").join(longs, "value")
    return each.where("doc <> leader").select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b"))


def _placed(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of long lists that hold several components, with `minor` where a row is not of its list's largest
    component; the number of rows, and of pairs that a comparison of the minor ones with all would make."""
    rows = rows.join(named.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = rows.groupBy("value", "component").agg(F.count("*").alias("held"))
    major = cut(sizes.groupBy("value").agg(F.sum("held").alias("size"), F.max(F.struct("held", "component")).alias("top")).where(F.col("size") > F.col("top.held")))
    rows = rows.join(major.select("value", F.col("top.component").alias("major")), "value").withColumn("minor", F.col("component") != F.col("major")).drop("major")
    n, pairs = major.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum((F.col("size") - F.col("top.held")) * F.col("size")), F.lit(0))).first()
    return rows, n, pairs


def _drawn_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of minor rows with members of their lists, of other components, drawn by hash anew each turn."""
    draw = F.struct(F.xxhash64("value", "doc", F.lit(turn)).alias("draw"), "doc", "component")
    heads = cut(rows.groupBy("value").agg(F.min(draw).alias("lo"), F.max(draw).alias("hi"), F.min(F.when(~F.col("minor"), draw)).alias("main")).select("value", F.array("lo", "hi", "main").alias("leaders")))
    each = rows.where("minor").select("value", "doc", "component").join(heads, "value").select("doc", "component", F.explode("leaders").alias("l"))
    return each.where(F.col("component") != F.col("l.component")).select(F.least("doc", F.col("l.doc")).alias("a"), F.greatest("doc", F.col("l.doc")).alias("b"))


def _cross_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs of one list and different components that sizes and positions still allow. Two rows of a list's
    largest component never meet."""
    names = ("doc", "n", "rest", "short", "whole", "early", "component", "minor")
    a, b = (rows.select("value", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
    x, y = ({c: F.col(f"{c}_{side}") for c in names} for side in "ab")
    below = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["doc"] < y["doc"]))
    fit = F.when(below, _possible(x, y, threshold)).otherwise(_possible(y, x, threshold))
    once = ~y["minor"] | (x["doc"] < y["doc"])
    met = a.where("minor_a").join(b, (a["value"] == b["value"]) & (x["component"] != y["component"]) & once & fit)
    return met.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def _estimate(pairs: DataFrame, sketch: DataFrame, k: int, threshold: int) -> DataFrame:
    """Drops pairs whose union sketch (the k smallest of both) overlaps too little for a link."""
    both = pairs.join(sketch.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    overlap = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where((F.col("na") * 100 >= F.col("nb") * threshold) & (F.col("nb") * 100 >= F.col("na") * threshold) & (overlap >= F.least(least_overlap(F.col("na"), k, threshold), least_overlap(F.col("nb"), k, threshold)))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that are links on their full sets."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * threshold).select("a", "b")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links."""
    ends = links
    for side in "ab":
        ends = ends.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    ends = cut(ends)
    onto = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("top"))
    loose = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(joined.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(joined.union(loose).join(onto, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def _across(rows: DataFrame, joined: DataFrame, tested: DataFrame, first: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Components after the links across components of long lists.

    As long as the pairs left are many for the rows and become fewer, minor rows are held against a few drawn
    members, which leaves most of a linked group in one component; then all pairs left are compared.
    """
    before = None
    for turn in itertools.count():
        mixed, n, pairs = _placed(rows, joined)
        if not n:
            return joined
        last = pairs <= ENOUGH * n or before is not None and pairs > 0.9 * before
        found = _cross_pairs(mixed, threshold) if last else _drawn_pairs(mixed, turn)
        fresh = cut(_estimate(found.distinct().join(tested, ["a", "b"], "left_anti"), first, k, threshold))
        links = cut(_confirmed(fresh, sets, threshold))
        if not links.isEmpty():
            joined = _merged(joined, links)
        if last:
            return joined
        tested, before = cut(tested.union(fresh)), pairs


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, k: int = SMALL_K, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = cut(sketches(docs, width, k))
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"))
    named = classes.where("doc IS NOT NULL")
    kept_rows = rows.where("n > 0").select(F.col("doc_id").alias("doc"), "h1", "h2", "sketch")
    first = cut(kept_rows.join(named, ["doc", "h1", "h2"]).select("doc", "n", "sketch"))
    lists = prefix_rows(first, k, threshold)
    longs = long_lists(lists, long_list)
    likely = cut(_estimate(_list_pairs(lists, longs, threshold).distinct(), first, k, threshold))
    again = cut(lists.select("value", "doc").join(longs.select("value"), "value", "left_semi").select("doc").distinct())
    members = likely.select(F.explode(F.array("a", "b")).alias("doc")).union(again).distinct()
    sets = shingle_sets(docs, bit_set(members, "doc"), width)
    sets = cut(sets.withColumnRenamed("doc_id", "doc").join(members, "doc", "left_semi").groupBy("doc").agg(F.max("shingles").alias("shingles")))
    if longs.isEmpty():
        joined = cut(components(_confirmed(likely, sets, threshold)))
    else:
        wholes = prefix_rows(sets.join(again, "doc", "left_semi").select("doc", F.size("shingles").alias("n"), F.col("shingles").alias("sketch")), None, threshold)
        longer = long_lists(wholes, long_list)
        more = _list_pairs(wholes, longer, threshold).union(_star_pairs(wholes, longer)).distinct()
        likely = cut(likely.union(_estimate(more, first, k, threshold)).distinct())
        joined = cut(components(_confirmed(likely, sets, threshold)))
        joined = _across(wholes.join(longer.select("value"), "value", "left_semi"), joined, likely, first, sets, k, threshold)
    found = classes.join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("h1", "h2", F.coalesce("component", "doc").alias("component"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = rows.where("n > 0").join(found, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of near_duplicates over the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays, the one with the smallest id.

    Groups are of texts, linked from STAGE_THRESHOLD on. Rows of one id and different texts are different documents."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    text = F.col("text").cast("string")
    number, same = ("_".join(["", name, *docs.columns]) for name in ("copy", "text"))  # names that no column has
    named = docs.where("doc_id IS NOT NULL").withColumn(same, F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256)))
    shared = named.groupBy("doc_id").agg(F.min(same).alias("lo"), F.max(same).alias("hi")).where("lo < hi")
    if shared.isEmpty():
        kept = near_duplicates(docs, threshold=STAGE_THRESHOLD).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
        rows = named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi")
    else:  # every id and text gets a number of its own, in the order of ids
        keys = numbered(named.select("doc_id", F.col(same).alias("same")).distinct(), [F.col("doc_id"), F.col("same")], "n")
        keys = cut(keys.select(F.col("doc_id").alias("key_id"), "same", F.col("n").cast("bigint").alias("n")))
        texts = named.select(F.col("doc_id").alias("key_id"), F.col(same).alias("same"), text.alias("text")).join(keys, ["key_id", "same"]).select(F.col("n").alias("doc_id"), "text")
        kept = near_duplicates(texts, threshold=STAGE_THRESHOLD).where("kept").select(F.col("doc_id").alias("n")).distinct()
        kept = keys.join(kept, "n").select("key_id", "same")
        rows = named.join(kept, (named["doc_id"] == kept["key_id"]) & (named[same] == kept["same"]), "left_semi")
    once = Window.partitionBy("doc_id", same).orderBy("doc_id")
    rows = rows.withColumn(number, F.row_number().over(once)).where(F.col(f"`{number}`") == 1).drop(number, same)
    return rows.union(docs.where(F.col("doc_id").isNull()).select(*columns))


ORACLES = {
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS rep FROM (SELECT doc_id, list_sort(list(s)) AS body FROM shingles GROUP BY doc_id)),
held AS (SELECT s.* FROM shingles s JOIN classes c ON c.doc_id = s.doc_id AND c.rep = c.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT rep AS node, rep AS seen FROM classes UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
named AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.node = c.rep
"""
}
QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
