"""Plain versions of a kernel classifier and of differencing, held against the operators."""

import itertools
import random
import zlib

import numpy as np
import pytest

from kerbline.llm import language_id, sharding

from .helpers import documents

ALPHABETS = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "opqrstuvé"}


def said(lang, seed, n):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randint(2, 6))) for _ in range(n))


def grams(text):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    return {data[i : i + n] for n in language_id.ORDERS for i in range(len(data) - n + 1)}


def test_scores_are_those_of_dense_kernel_ridge_regression(spark):
    ids = list(range(200))
    langs = [sorted(ALPHABETS)[i % 3] for i in ids]
    texts = [said(lang, i, 6 + i % 9) for i, lang in zip(ids, langs)]
    docs = documents(spark, texts, ids, langs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    train = [i for i in ids if zlib.crc32(str(i).encode()) % 5]
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    dense = np.array([[kernel(a, b) for b in train] for a in train])
    y = np.array([[1.0 if langs[a] == lang else -1.0 for lang in sorted(ALPHABETS)] for a in train])
    alpha = np.linalg.solve(dense + language_id.RIDGE * len(train) * np.eye(len(train)), y)
    for i in ids:
        values = np.array([kernel(i, b) for b in train]) @ alpha
        assert got[i]["lang_pred"] == sorted(ALPHABETS)[values.argmax()]
        assert got[i]["score"] == pytest.approx(min(1.0, max(0.0, (1 + values.max()) / 2)), abs=0.03)  # n-grams that share a place


def plain_differencing(weights, k):
    parts = [sorted([w] + [0] * (k - 1)) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts[:2]
        parts = [sorted(x + y for x, y in zip(a, reversed(b))), *parts[2:]]
    return parts[0]


def test_differencing_against_a_plain_version_and_all_groupings():
    draw = random.Random(9)
    for k in (2, 3, 16):
        for n in (1, 2, 5, 40):
            weights = draw.sample(range(1, 10**9), n)
            loads, placed = sharding.difference_items(weights, k)
            assert sorted(loads) == plain_differencing(weights, k)
            assert [sum(w for w, p in zip(weights, placed) if p == part) for part in range(k)] == list(loads)
    for _ in range(8):
        weights = draw.sample(range(1, 1000), 7)
        least = min(max(s) - min(s) for g in itertools.product(range(3), repeat=7) for s in [[sum(w for w, p in zip(weights, g) if p == part) for part in range(3)]])
        loads, _ = sharding.difference_items(weights, 3)
        assert least <= max(loads) - min(loads) <= max(weights)
