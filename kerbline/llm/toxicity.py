"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and clean labelled documents with an informative Dirichlet prior (the pooled
frequencies); those under SURE standard errors from 0 count as 0. A word is seen as itself and by its first 3 to 6 bytes,
so inflected forms share their stem's score; it scores its most telling feature's log-odds, positive or negative, less
COST, the log-odds of a passage's going on. A linear scan (Ruzzo and Tompa)
finds all maximal-scoring segments of a text, the toxic passages. The best segment's score becomes an
extreme-value statistic E = K n exp(-lambda S) over the text's n words, with lambda from the scores of clean tokens and K
from the best segments of clean documents, and a logistic curve over ln E gives the score.

The model is fitted on at most PER_LABEL labelled rows of each label (a documented bound). Every whole text is scanned.

Defined cases: a null or empty text has no words and gets the score of no passage; a repeated row
gets the same answer; without labelled rows of both labels every score is 0; null labels and null ids
are not learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches
from .sampling import bounded_sample, held_out
from .wordhash import ALNUM, _LOWER, mix, text_buffers, words_of

PER_LABEL, PRIOR, SURE, COST, BIN = 6000, 0.1, 3.0, 1.0, 0.02
STEMS = (3, 4, 5, 6)


def _features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their stems; a word no longer than a stem has 0 there."""
    out = [hashes | np.uint64(1)]
    for n in STEMS:
        long = np.flatnonzero(stops - starts > n)
        h = np.zeros(len(hashes), np.uint64)
        part = np.full(len(long), n, np.uint64)
        for i in range(n):
            part = part * np.uint64(0x100000001B3) ^ _LOWER[data[starts[long] + i]]
        h[long] = mix(part) & ~np.uint64(1)
        out.append(h)
    return out


class Scorer:
    """Scores of words from the features of the model."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Every word's log-odds: of its features the one farthest from 0."""
        out = np.zeros(len(features[0]))
        for f in features:
            at = np.flatnonzero(self.table[(f >> np.uint64(46)).astype(np.int64)])
            if not len(at) or not len(self.keys):
                continue
            where = np.minimum(np.searchsorted(self.keys, f[at]), len(self.keys) - 1)
            odds = np.where(self.keys[where] == f[at], self.odds[where], 0.0)
            out[at] = np.where(np.abs(odds) > np.abs(out[at]), odds, out[at])
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after the last, score) of words with these scores.

    Only runs of positive words are visited. Each candidate links to the nearest earlier one whose left sum is
    smaller; a search that passes others follows these links, so the scan is linear."""
    good = scores > 0
    if not good.any():
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    firsts, afters = edges[::2], edges[1::2]
    found: list[tuple[int, int, float, float, int]] = []  # first, after, sum before the segment, sum at its end, link
    for first, after, left, right in zip(firsts.tolist(), afters.tolist(), sums[firsts].tolist(), sums[afters].tolist()):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, after, left, right, j))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _documents(column: pa.Array):
    """Yields for every row the number of its words and their features."""
    _, data = text_buffers(column)
    for first, stop, at, starts, stops, hashes in words_of(column, ALNUM):
        features = _features(data, starts, stops, hashes)
        for i in range(stop - first):
            yield int(at[i + 1] - at[i]), [f[at[i] : at[i + 1]] for f in features]


def _sampled(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict]:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    chosen, counts = bounded_sample(known, "toxic", per_label)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id"), counts  # 2 * per_label ids at most


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict:
    small_batches(docs.sparkSession)
    texts, counts = _sampled(docs, labels, per_label)

    def count(batches):
        for batch in batches:
            hashes, toxic = [], []
            for (_, features), label in zip(_documents(batch.column(1)), batch.column(2).to_pylist()):
                each = np.unique(np.concatenate(features))
                hashes.append(each[each > 1].view(np.int64))
                toxic.append(np.full(len(hashes[-1]), label, np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(toxic))], ["feature", "toxic"])

    once = texts.groupBy(F.xxhash64("text").alias("copy")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    seen = once.select("doc_id", "text", "toxic").mapInArrow(count, "feature long, toxic int")
    tally = seen.groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    n1, n0 = tally.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return {"fitted": False}
    pooled = (F.col("y1") + F.col("y0")) * PRIOR
    a1, a0 = pooled * (n1 / (n1 + n0)), pooled * (n0 / (n1 + n0))
    odds = F.log((F.col("y1") + a1) / (n1 * (1 + PRIOR))) - F.log((F.col("y0") + a0) / (n0 * (1 + PRIOR)))
    error = F.sqrt(1 / (F.col("y1") + a1) + 1 / (F.col("y0") + a0))
    clear = tally.select("feature", odds.alias("odds"), (F.abs(odds) / error).alias("z")).where(F.col("z") >= SURE).select("feature", "odds").toPandas()
    scorer = Scorer(clear["feature"].to_numpy(np.int64).view(np.uint64), clear["odds"].to_numpy(float))
    model = {"fitted": True, "scorer": scorer}
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches):
        for batch in batches:
            n, best = [], []
            for words, features in _documents(batch.column(1)):
                n.append(words)
                best.append(_best(shared.value, features))
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), pa.array(n, pa.int64()), pa.array(best, pa.float64())], ["toxic", "n", "best"])

    rows = once.select("doc_id", "text", "toxic").mapInArrow(measure, "toxic int, n long, best double").toPandas()  # 2 * per_label rows at most

    def spread(batches):
        for batch in batches:
            each = [shared.value.scores(features) - COST for _, features in _documents(batch.column(1))]
            bins, n = np.unique(np.rint(np.concatenate([np.zeros(0), *each]) / BIN).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], ["bin", "n"])

    tokens = once.where("toxic = 0").select("doc_id", "text").mapInArrow(spread, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # a row for each score, in steps of BIN
    model |= _extremes(tokens["bin"].to_numpy(float) * BIN, tokens["n"].to_numpy(float), rows[rows["toxic"] == 0])
    shared.destroy()
    x = _statistic(model, rows["n"].to_numpy(float), rows["best"].to_numpy(float))
    y = rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, counts.get(1, 0) / max(1, y.sum()), counts.get(0, 0) / max(1, (1 - y).sum()))
    model["curve"] = _logistic(x, y, weight)
    return model


def _best(scorer: Scorer, features: list[np.ndarray]) -> float:
    return max((x[2] for x in segments(scorer.scores(features) - COST)), default=0.0)


def _extremes(scores: np.ndarray, counts: np.ndarray, clean: pd.DataFrame) -> dict:
    """lambda and K of the law P(best segment > s) = 1 - exp(-K n exp(-lambda s)) of clean texts: lambda is the positive
    root of the mean of exp(lambda score) = 1 over clean tokens, K has the law's median at that of the clean documents."""
    p = counts / max(1.0, counts.sum())
    over = lambda x: float(p @ np.exp(np.minimum(x * scores, 600))) - 1
    lo, hi = 0.0, 20.0
    if over(hi) > 0:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if over(mid) < 0 else (lo, mid)
    lam = max(hi, 0.05)
    n, best = np.maximum(1, clean["n"].to_numpy(float)), clean["best"].to_numpy(float)
    return {"lambda": lam, "k": float(np.exp(np.median(lam * best - np.log(n)) + np.log(np.log(2))))}


def _statistic(model: dict, n: np.ndarray, best: np.ndarray) -> np.ndarray:
    return np.clip(np.log(model["k"]) + np.log(np.maximum(n, 1)) - model["lambda"] * best, -40, 40)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, -0.1
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(weight * (y - p)).sum(), (weight * (y - p) * x).sum() - 1e-3 * b])
        h = weight * p * (1 - p)
        m = np.array([[h.sum() + 1e-6, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        size = np.abs(step).max()
        a, b = a + step[0] * min(1, 2 / max(size, 1e-12)), b + step[1] * min(1, 2 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and the toxic passages: array of (first word, word after the last, segment score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        m = shared.value
        for batch in batches:
            n, best, passages = [], [], []
            for words, features in _documents(batch.column(1)):
                found = segments(m["scorer"].scores(features) - COST) if m["fitted"] else []
                n.append(words)
                best.append(max((x[2] for x in found), default=0.0))
                passages.append([{"first": a, "stop": b, "segment": v} for a, b, v in found])
            if m["fitted"]:
                a, b = m["curve"]
                scores = 1 / (1 + np.exp(-np.clip(a + b * _statistic(m, np.array(n, float), np.array(best, float)), -30, 30)))
            else:
                scores = np.zeros(len(n))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("segment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, score double, passages array<struct<first:int,stop:int,segment:double>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's scores for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict = {}
