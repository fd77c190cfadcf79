"""Benchmark decontamination by winnowing.

Of every w = 6 consecutive hashes of 5-word grams the smallest is kept (the rightmost of equals), for
documents and for benchmark items alike. A shared span of 10 words holds 6 grams, the same window
on both sides, so both keep the same gram: every shared 10-word window is found. Items of fewer
words are one window; for each such length m the documents' m-word grams are all kept (w = 1).

Documents' fingerprints are first tested against a bit set of the items' fingerprints, whose size is
fixed (see BITS) however many items there are, so only likely hits leave a task. A hit travels with
the words around it; after the join on the fingerprint it is extended by comparing those words with
the item's words, so a hit counts only if all words of a window are equal.

Words: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Defined cases: a null or empty text, document or item, has no words and no hits; a repeated row gets
the same answer again; repeated or equal items all count; null item ids are ignored, null doc ids stay null; an
empty benchmark contaminates nothing; other columns are ignored, and kept by the stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut, small_batches
from .wordhash import ALNUM, gram_hashes, text_buffers, words_of

WINDOW, GRAM = 10, 5
BITS = 24  # the bit set has 2 ** BITS bits, 2 MB
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _selected(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the grams that winnowing keeps."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    if window == 1:
        return np.arange(len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    last = window - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(last + np.arange(len(last)))


_FINGERPRINT = "array<struct<h:bigint,m:int,at:int,words:array<string>>>"


def _bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _member(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for at in _bits_of(h):
        hit &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def digest(text: Column) -> Column:
    """What tells texts apart, null for a null text."""
    return F.unhex(F.md5(text.cast("string")))


def fingerprints(table: DataFrame, key: str, lengths: tuple[int, ...], bits: Broadcast | None, window: int = WINDOW, gram: int = GRAM, items: bool = False) -> DataFrame:
    """key, n_words, digest (of the text, null for a null text) and prints: each with its hash, the window's words m, the word
    it starts at and the words around it (window - gram to either side; '' beyond the text).

    lengths: the lengths below `window` whose grams are all kept. items: a text of fewer words than
    `window` has one window of all its words, and no other. bits: a broadcast bit set of the fingerprints wanted; None: all are.
    """
    side = window - gram

    def kernel(batches):
        held = None if bits is None else bits.value
        for batch in batches:
            n_words, sizes, out = [], [], ([], [], [], [])
            _, data = text_buffers(batch.column(1))
            for first, stop, at, starts, stops, hashes in words_of(batch.column(1), ALNUM):
                for i in range(stop - first):
                    lo, hi = int(at[i]), int(at[i + 1])
                    words, n, found = hashes[lo:hi], hi - lo, 0
                    n_words.append(n)
                    cases = [(window, gram, window - gram + 1, side)] if n >= window else []
                    cases += [(n, n, 1, 0)] if items and 0 < n < window else []
                    cases += [] if items else [(m, m, 1, 0) for m in lengths if n >= m]
                    for m, width, view, pad in cases:
                        grams = gram_hashes(words, width)
                        at_gram = _selected(grams, view)
                        h = grams[at_gram] + np.uint64(m)  # a gram means another thing in each length of window
                        if held is not None:
                            hit = _member(held, h)
                            at_gram, h = at_gram[hit], h[hit]
                        for p, v in zip(at_gram.tolist(), h.view(np.int64).tolist()):
                            around = [bytes(data[starts[lo + j] : stops[lo + j]]).translate(_LOWER).decode() if 0 <= j < n else "" for j in range(p - pad, p + width + pad)]
                            out[0].append(v), out[1].append(m), out[2].append(p), out[3].append(around)
                            found += 1
                    sizes.append(found)
            prints = pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.string()))], ["h", "m", "at", "words"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), batch.column(2), lists], [key, "n_words", "digest", "prints"])

    return table.select(F.col(key).cast("bigint"), F.col("text").cast("string"), digest(F.col("text")).alias("digest")).mapInArrow(kernel, f"{key} long, n_words long, digest binary, prints {_FINGERPRINT}")


def bit_set_of(prints: DataFrame) -> np.ndarray:
    """The items' fingerprints as 2 ** BITS bits; what reaches the driver is bounded by that size."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    bits = prints.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - BITS), low)).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64))))").alias("mask")).toPandas()
    out = np.zeros((1 << BITS) // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): doc_id, n_words and digest of every row; and for each distinct (doc_id, digest)
    with a hit, its hit word positions and item ids, as rows (doc_id, digest, n_hit, items)."""
    small_batches(docs.sparkSession)
    side = window - gram
    named = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    items = fingerprints(named, "item_id", (), None, window, gram, items=True)
    items = cut(items.select("item_id", F.explode("prints").alias("p")).select("item_id", "p.h", "p.m", "p.words"))
    lengths = tuple(sorted(r[0] for r in items.where(F.col("m") < window).select("m").distinct().collect()))  # under `window` values
    bits = docs.sparkSession.sparkContext.broadcast(bit_set_of(items))
    rows = cut(fingerprints(docs, "doc_id", lengths, bits, window, gram))
    bits.destroy()
    prints = rows.where(F.size("prints") > 0).select("doc_id", "digest", "prints").dropDuplicates(["doc_id", "digest"])
    prints = prints.select("doc_id", "digest", F.explode("prints").alias("p")).select("doc_id", "digest", "p.h", "p.m", "p.at", "p.words")
    # Items that share a window are met as one set, and documents that met the same sets as one combination, so a passage of
    # many items and many documents makes no row for each pair of them.
    known = items.groupBy("h", "m", F.col("words").alias("item_words")).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    known = cut(known.withColumn("set", F.md5(F.array_join("item_ids", ","))))
    met = prints.join(known.drop("item_ids"), ["h", "m"])
    # The words around a print that are equal on both sides of it, as far as they run together.
    same = F.transform(F.sequence(F.lit(0), F.lit(side)), lambda s: F.when((F.slice("words", s + 1, window) == F.slice("item_words", s + 1, window)) & ~F.array_contains(F.slice("words", s + 1, window), ""), F.col("at") - side + s))
    starts = F.when(F.col("m") < window, F.when(F.col("words") == F.col("item_words"), F.array("at"))).otherwise(F.filter(same, lambda x: x.isNotNull()))
    hits = met.select("doc_id", "digest", "m", F.explode(starts).alias("start"), "set")
    spread = hits.select("doc_id", "digest", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("word")).distinct()
    counted = spread.groupBy("doc_id", "digest").agg(F.count("*").alias("n_hit"))
    sets = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).agg(F.array_sort(F.collect_set("set")).alias("sets"))
    sets = cut(sets.withColumn("combination", F.md5(F.array_join("sets", ","))))
    listed = sets.select("combination", "sets").dropDuplicates(["combination"]).select("combination", F.explode("sets").alias("set")).join(known.select("set", "item_ids").dropDuplicates(["set"]), "set")
    listed = listed.groupBy("combination").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))
    same_doc = counted["doc_id"].eqNullSafe(sets["hit_id"]) & (counted["digest"] == sets["hit_digest"])
    found = counted.join(sets.select("hit_id", "hit_digest", "combination"), same_doc).select("doc_id", "digest", "n_hit", "combination")
    return rows.select("doc_id", "n_words", "digest"), found.join(listed, "combination").select("doc_id", "digest", "n_hit", "items")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of contamination over the whole documents and benchmark tables."""
    rows, hits = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "n_hit", "items")
    out = rows.join(hits, (F.col("digest") == F.col("hit_digest")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any window of the benchmark stay, with the columns of docs. Rows of one id, null or not,
    are documents of their own: those of a contaminated text go, the others stay."""
    _, hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = hits.select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest"))
    return docs.join(hits, docs["doc_id"].cast("bigint").eqNullSafe(hits["_hit_id"]) & (digest(docs["text"]) == hits["_hit_digest"]), "left_anti")


ORACLES = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m),
hits AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, unnest(range(m)) AS o(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""
}
QUERIES = {"op1_decontamination": op1_decontamination}
