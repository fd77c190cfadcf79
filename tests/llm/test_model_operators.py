import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from kerbline.llm import html_extract, language_id, sentencepiece_codec, sharding, toxicity
from kerbline.llm.sampling import held_out

from .helpers import AWKWARD, documents, prose, write


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# SentencePiece


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.codec_path())


def test_encoding_is_exact(reference):
    codec = sentencepiece_codec.load(sentencepiece_codec.codec_path())
    parts = ["a", "the", "ing", " ", "  ", " " * 7, " " * 19, "\n", "\t", "\r", ";\r", "é", "日本", "▁", "\x00", "𝒳", "①", "<s>", "<0x0A>", "//", "==", "tion", "qzx", "　", "x" * 90]
    draw = random.Random(3)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["ab" * 9000, " " * 3000, "thntingtion" * 700]
    for text in texts:
        chunks = codec.encoded(text)
        ids = [int(i) for c in chunks for i in c[0].split(",")]
        assert ids == reference.encode(text)
        decoded = "".join(c[2] for c in chunks)
        assert (decoded[1:] if decoded[:1] == " " else decoded) == reference.decode(ids)


def test_encoding_query_and_round_trip(spark, tmp_path, reference):
    texts = [*AWKWARD, prose(1, 500), "Größe naïve señor", prose(1, 500)]
    d = write(spark, tmp_path, documents=documents(spark, texts))
    for r in sentencepiece_codec.op2_sentencepiece(spark, d).collect():
        ids = reference.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids)))
    encoded = sentencepiece_codec.encode_stage(spark, documents(spark, texts), d)
    for r in sentencepiece_codec.decode(encoded).collect():
        assert r["text"] == (texts[r["doc_id"]] or "")
    assert sentencepiece_codec.encode(documents(spark, [])).count() == 0


# language identification

ALPHABETS = {"aa": "abcdefg", "bb": "defghij", "cc": "ñéüabcd"}


def babble(lang, seed, n):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randint(2, 7))) for _ in range(n))


def test_language_of_held_out_rows(spark, tmp_path):
    langs = [list(ALPHABETS)[i % 3] for i in range(300)]
    texts = [babble(lang, i, 5 + i % 60) for i, lang in enumerate(langs)]
    texts += [None, "", "123 !?", "abc", "x" * 3_000_000]
    d = write(spark, tmp_path, documents=documents(spark, texts, langs=[*langs, "aa", None, None, None, None]))
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, d).collect()}
    test = [i for i in range(300) if got[i]["held_out"]]
    assert len(test) > 30 and sum(got[i]["lang_pred"] == langs[i] for i in test) >= 0.95 * len(test)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[304]["lang_pred"] in ALPHABETS


def test_language_without_labels_and_empty_table(spark, tmp_path):
    d = write(spark, tmp_path, documents=documents(spark, ["abc", None], langs=[None, None]))
    assert {r["lang_pred"] for r in language_id.op4_language_id(spark, d).collect()} == {"und"}
    d = write(spark, tmp_path, documents=documents(spark, []))
    assert language_id.op4_language_id(spark, d).count() == 0


# toxicity


def plain_segments(scores):
    """Ruzzo and Tompa's recursive definition: the best subsequence, then both sides of it."""
    if not scores:
        return []
    best, where = 0.0, None
    for i, j in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[i:j])
        if s > best + 1e-9 or (where and abs(s - best) <= 1e-9 and j - i > where[1] - where[0]):
            best, where = s, (i, j)
    if where is None:
        return []
    i, j = where
    return plain_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(scores[j:])]


def test_segments_match_the_recursive_definition():
    draw = random.Random(5)
    for _ in range(300):
        scores = [draw.uniform(0.5, 3) if draw.random() < 0.3 else draw.uniform(-1.5, -0.1) for _ in range(draw.randint(0, 18))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == plain_segments(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_segments_of_long_texts_take_linear_time():
    """Falling sums, where each candidate is left of all before it, and rising and random ones."""
    for scores in (np.tile([1.0, -1.5], 400_000), np.tile([1.0, -0.5], 400_000), np.random.default_rng(3).normal(-0.2, 1, 800_000)):
        began = time.process_time()
        found = toxicity.segments(scores)
        assert time.process_time() - began < 8  # a quadratic scan takes hours
        assert all(a < b and s > 0 for a, b, s in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert len(toxicity.segments(np.tile([1.0, -1.5], 1000))) == 1000 and len(toxicity.segments(np.tile([1.0, -0.5], 1000))) == 1


def plain_features(text):
    """For each word its own bytes and its stems."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    return [[w, *((n, w[:n]) for n in toxicity.STEMS if len(w) > n)] for w in (re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words)]


def test_passages_against_a_plain_version(spark):
    draw = random.Random(12)
    texts = []
    for i in range(400):
        words, bad = prose(i, draw.randint(5, 60)).split(), i % 3 == 0
        for _ in range(3 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["Vilefoo", "vilebar", "grotty", "grottiest", "üblezz"]))
        for _ in range(0 if bad else 2):
            words.insert(draw.randrange(len(words)), draw.choice(["kindly", "kindest", "thanks"]))
        texts.append(" ".join(words))
    texts += [None, "", "vilefoo kindly grotty", "thanks " * 3 + "vilebar", texts[0]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    learned = {texts[i]: int(i % 3 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    y = {0: Counter(), 1: Counter()}
    for text, label in learned.items():
        y[label].update({f for w in plain_features(text) for f in w})
    n1, n0 = sum(y[1].values()), sum(y[0].values())
    odds = {}
    for f in {*y[0], *y[1]}:
        pooled = (y[1][f] + y[0][f]) * toxicity.PRIOR
        a1, a0 = pooled * n1 / (n1 + n0), pooled * n0 / (n1 + n0)
        d = math.log((y[1][f] + a1) / (n1 * (1 + toxicity.PRIOR))) - math.log((y[0][f] + a0) / (n0 * (1 + toxicity.PRIOR)))
        odds[f] = d if abs(d) >= toxicity.SURE * math.sqrt(1 / (y[1][f] + a1) + 1 / (y[0][f] + a0)) else 0.0
    assert min(odds.values()) < 0 < max(odds.values())
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        scores = [max((odds.get(f, 0.0) for f in w), key=lambda v: (abs(v), 0)) - toxicity.COST for w in plain_features(text)]
        want = [(a, b, sum(scores[a:b])) for a, b in plain_segments(scores)] if len(scores) < 40 else None
        got = [(p["first"], p["stop"], p["segment"]) for p in rows[i]["passages"]]
        if want is not None:
            assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want)), text
        best, n = max((g[2] for g in got), default=0.0), max(1, len(scores))
        a, b = model["curve"]
        extreme = min(40.0, max(-40.0, math.log(model["k"]) + math.log(n) - model["lambda"] * best))
        assert abs(rows[i]["score"] - 1 / (1 + math.exp(-(a + b * extreme)))) < 1e-9


def test_toxicity_of_held_out_rows(spark, tmp_path):
    draw = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        words, bad = prose(i, draw.randint(20, 120)).split(), i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 30):
                words.insert(draw.randrange(len(words)), draw.choice(["vilefoo", "vilebar", "grotty", "grottiest"]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    texts += [None, "", "vilefoo", "12 34"]
    labels += [(None, 1), (601, None), (5, 0)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    d = write(spark, tmp_path, documents=documents(spark, texts), labels=table)
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, d).collect()}
    test = [i for i in range(600) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in test) >= 0.97 * len(test)
    assert got[602]["predicted"] == 1 and got[600]["predicted"] == got[601]["predicted"] == 0
    d = write(spark, tmp_path, documents=documents(spark, texts[:3]), labels=table.limit(0))
    assert {r["score"] for r in toxicity.op6_toxicity(spark, d).collect()} == {0.0}


# pages


def site_page(i, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><head><title>T{i}</title></head><body><div id="header"><p>Site name</p></div><div class="menu"><ul><li>Home<li>News {i}</ul></div><div id="wrap"><div class="sidebar"><p>Popular {i * 7}</p></div><div class="content"><h1>Title {i}</h1><div>Follow our work</div>{body}</div><div id="comments"><p>Nice post number {i} and a long comment</p></div></div><form><button>Go</button></form><div class="footer">end {i}</div></body></html>'


def test_wrapper_takes_varying_slots_and_leaves_the_template(spark, tmp_path):
    pages = [(i, "http://Host.example/x", site_page(i, [prose(100 * i + j, 12) for j in range(1 + i % 4)])) for i in range(20)]
    want = {i: "\n".join([f"Title {i}", *(prose(100 * i + j, 12) for j in range(1 + i % 4))]) for i in range(20)}
    pages += [(20, None, None), (21, "", ""), (22, "http://other/y", "<p>a&amp;b &lt; c&nbsp;d<p>e <b>f"), (23, "http://host.example/z", "no tags"), (24, "http://other/", "<div>" * 3000 + "deep"), (0, "http://Host.example/x", pages[0][2])]
    want |= {20: "", 21: "", 22: "a&b < c d\ne f", 23: "no tags", 24: "deep"}
    d = write(spark, tmp_path, pages=spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = html_extract.op8_html_extraction(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty).count() == 0


def test_tree_matching_counts_aligned_nodes():
    from kerbline.llm.html_tree import parse

    a, b = parse("<div><h1>x</h1><p>a</p><p>b</p></div>"), parse("<div><ul><li>q</ul><h1>y</h1><p>c</p></div>")
    tree = lambda root: html_extract.Slot("#root", [root])
    assert html_extract.align(tree(a), tree(b))[0] == 4  # root, div, h1 and the folded run of p


# sharding


def test_differencing_of_items_is_that_of_units():
    draw = random.Random(1)
    for n in (1, 2, 5, 16, 17, 40, 400):
        weights = [draw.choice([1, 7, draw.randint(1, 3000)]) for _ in range(n)]
        loads, placed = sharding.difference_items(weights, 16)
        sums = [0] * 16
        for w, p in zip(weights, placed):
            sums[p] += w
        assert sums == loads
        other, _ = sharding.difference([(w, *[0] * 15) for w in weights])
        assert max(loads) - min(loads) == other[-1] - other[0]


def test_slots_of_rows_without_ids(spark, tmp_path):
    texts = ["one text"] * 30 + [prose(i, 9) for i in range(50)] + [None] * 5
    d = write(spark, tmp_path, documents=documents(spark, texts, [None] * 40 + [7] * 45))
    rows = sharding.op9_sharding(spark, d).collect()
    assert len(rows) == len(texts)
    for shard in {r["shard"] for r in rows}:
        held = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert held == list(range(len(held)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"one text")}) == 1


def test_shards_are_even_and_slots_gapless(spark, tmp_path):
    texts = [*AWKWARD, *AWKWARD, *(prose(i, 1 + i % 90) for i in range(400)), *["same text"] * 60]
    ids = [*range(len(texts) - 1), None]
    d = write(spark, tmp_path, documents=documents(spark, texts, ids))
    rows = sharding.op9_sharding(spark, d).collect()
    assert len(rows) == len(texts)
    size, slots, home = {}, {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        home.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        if r["doc_id"] is not None:
            assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values())
    assert sorted(size) == list(range(16))
    rest = sorted(size.values())[:-1]  # the very long text has a shard of its own
    assert max(rest) - min(rest) <= 0.02 * max(rest)
    d = write(spark, tmp_path, documents=documents(spark, []))
    assert sharding.op9_sharding(spark, d).count() == 0


def test_held_out_fold_is_crc32_of_the_id(spark):
    import zlib

    from pyspark.sql import functions as F

    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0)
