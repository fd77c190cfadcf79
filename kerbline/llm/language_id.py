"""Language identification by a string kernel.

A text is the set of its byte n-grams of 1 to 4 (blended spectrum), A-Z lower-cased, hashed into SLOTS
places; the kernel of two texts is the number of places both have, over the root of the product of
their sizes. Nystroem: a few training texts of each language are landmarks, and one-versus-rest kernel
ridge regression is solved on the kernel values with them. A batch of texts is scored by two matrix
products: presence by landmarks, and that by the coefficients.

The model is fitted on at most PER_LANGUAGE texts of each language (a documented bound); what reaches the
driver are their presence bits, 2 KB each. Every whole text is scored.

Defined cases: und with score 0 for a null text, one without a letter, or if there is no labelled row; a
repeated row gets the same answer; ties go to the language first in order; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches
from .sampling import bounded_sample, held_out
from .wordhash import _LOWER, SEGMENT, text_buffers

SLOTS, ORDERS = 1 << 14, (1, 2, 3, 4)
PER_LANGUAGE, LANDMARKS, RIDGE, BATCH = 600, 256, 1e-3, 64
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def _slots(part: np.ndarray) -> list[np.ndarray]:
    """For each order, the place of the n-gram at every byte."""
    low = _LOWER[part].astype(np.uint32)
    gram, out = np.zeros(len(low), np.uint32), []
    for order in range(1, max(ORDERS) + 1):
        gram = gram[: len(low) - order + 1] * np.uint32(256) + low[order - 1 :]
        if order in ORDERS:
            out.append((((gram + np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - SLOTS.bit_length() + 1))
    return out


def presence(column: pa.Array):
    """Yields (first row, presence matrix) for up to BATCH rows at a time."""
    at, data = text_buffers(column)
    for first in range(0, len(at) - 1, BATCH):
        stop = min(first + BATCH, len(at) - 1)
        matrix = np.zeros((stop - first, SLOTS), np.float32)
        row = first
        while row < stop:
            end = row + 1
            while end < stop and at[end + 1] - at[row] <= SEGMENT:
                end += 1
            lo, hi = int(at[row]), int(at[end])
            if hi - lo <= SEGMENT:
                for order, slots in zip(ORDERS, _slots(data[lo:hi])):
                    for i in range(row, end):
                        matrix[i - first, slots[at[i] - lo : max(at[i] - lo, at[i + 1] - lo - order + 1)]] = 1
            else:
                for a in range(lo, hi, SEGMENT):
                    for slots in _slots(data[a : min(hi, a + SEGMENT + max(ORDERS) - 1)]):
                        matrix[row - first, slots] = 1
            row = end
        yield first, matrix


def _has_letter(data: np.ndarray) -> bool:
    if _LETTER[data].any():
        return True
    return bool((data >= 128).any()) and any(map(str.isalpha, bytes(data).decode("utf-8", "replace")))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Languages, landmarks' presence and the coefficients."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"))
    chosen, _ = bounded_sample(labelled, "lang", per_language)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")  # per_language ids a language at most

    def kernel(batches):
        for batch in batches:
            packed = [row.tobytes() for _, m in presence(batch.column(1)) for row in np.packbits(m.astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    rows = texts.select(F.col("doc_id").cast("bigint"), "text", "lang").mapInArrow(kernel, "doc_id long, lang string, bits binary").toPandas()
    rows = rows.drop_duplicates(["lang", "bits"]).sort_values(["lang", "doc_id"], kind="stable")
    langs = sorted(set(rows["lang"]))
    if not langs:
        return {"langs": []}
    x = np.unpackbits(np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
    each = max(2, LANDMARKS // len(langs))
    mark = np.concatenate([np.flatnonzero((rows["lang"] == lang).to_numpy())[:each] for lang in langs])
    z = x[mark] / norm[mark, None]
    k_nm = ((x @ z.T) / norm[:, None]).astype(np.float64)
    k_mm = k_nm[mark]
    y = np.where(rows["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    left = k_nm.T @ k_nm + RIDGE * len(rows) * k_mm + 1e-6 * np.eye(len(mark))
    return {"langs": langs, "z": z, "alpha": np.linalg.lstsq(left, k_nm.T @ y, rcond=None)[0].astype(np.float32)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score (half of one plus the winning regression value, within 0 and 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], []
            at, data = text_buffers(batch.column(1))
            if not m["langs"]:
                names, scores = ["und"] * len(batch), [0.0] * len(batch)
            for first, x in presence(batch.column(1)) if m["langs"] else ():
                values = (x @ m["z"].T / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]) @ m["alpha"]
                best = values.argmax(axis=1)
                for i, b in enumerate(best.tolist()):
                    known = _has_letter(data[at[first + i] : at[first + i + 1]])
                    names.append(m["langs"][b] if known else "und")
                    scores.append(float(np.clip((1 + values[i, b]) / 2, 0, 1)) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's predictions for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict = {}
