"""Large groups of near copies around the threshold, against all pairs of whole sets."""

import random

import pytest

from kerbline.llm import near_dedup

from .helpers import documents


def group(style, n_docs, n_words, rate, seed):
    """Near copies of one text whose words are changed at random, changed to a few others, or whose sentences are left out."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(3000)}" for _ in range(n_words)]
    pool = [(draw.randrange(n_words), f"x{i}") for i in range(30)]
    for _ in range(n_docs):
        words = list(base)
        if style == "random":
            words = [w if draw.random() > rate / 5 else f"e{draw.randrange(10**6)}" for w in base]
        elif style == "pool":
            for at, w in draw.sample(pool, round(rate * n_words / 5)):
                words[at] = w
        else:
            words = [w for i in range(0, n_words, 12) if draw.random() > rate for w in base[i : i + 12]]
        yield " ".join(words)


def plain(texts, threshold):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(texts)))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("threshold", [85, 80])
def test_groups_around_the_threshold_lose_no_link(spark, threshold):
    texts = [*group("random", 110, 260, 0.09, 1), *group("pool", 110, 260, 0.09, 2), *group("left out", 110, 260, 0.08, 3), *group("random", 40, 900, 0.08, 4)]
    texts += texts[:30] + ["one shared line of words that many have " + str(i) for i in range(60)]
    want = plain(texts, threshold)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts), threshold=threshold).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 20 and max(map(want.count, set(want))) > 20  # some are linked, some are not
