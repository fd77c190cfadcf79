import hashlib

import corpus_pipeline

from .helpers import AWKWARD, documents, prose, write
from .test_text_operators import mutated, plain_hits, plain_near, plain_quality, plain_secrets


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    import sentencepiece

    from kerbline.llm.sentencepiece_codec import codec_path

    base = [prose(i, 90) for i in range(12)]
    texts = [*AWKWARD, *base, mutated(base[0], 1, 1), base[1], base[2] + " password=abcdefghijklmnop", prose(77, 60) + " " + " ".join(prose(900, 30).split()[4:18]), "junk # $ % " * 40]
    items = [(1, prose(900, 30)), (2, prose(901, 12))]
    d = write(spark, tmp_path, documents=documents(spark, texts), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}

    def good(t):
        m = plain_quality(t)
        return m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"] and 10 * m["n_symbols"] <= 3 * m["n_words"]

    left = {i: t for i, t in enumerate(texts) if good(t)}
    near = plain_near(list(left.values()), list(left))
    left = {i: t for i, t in left.items() if near[i][1] == i}
    left = {i: t for i, t in left.items() if not plain_hits([t], items)[0][1]}
    model = sentencepiece.SentencePieceProcessor(model_file=codec_path())
    for i, t in left.items():
        for start, _, stop in reversed(plain_secrets(t)):
            t = t[:start] + "[secret]" + t[stop:]
        ids = model.encode(t)
        assert got[i]["ids"] == ids and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(left)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, [prose(i, 80) for i in range(4)] + AWKWARD)
    d = write(spark, tmp_path, benchmark=spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).schema.names == docs.schema.names
        assert [f.dataType for f in stage(spark, docs, d).schema] == [f.dataType for f in docs.schema]
    assert len(corpus_pipeline.STAGES) == 5


def test_clean_rows_without_an_id_or_of_a_shared_id_stay(spark, tmp_path):
    from kerbline.llm.decontaminate import decontaminate_stage

    item = prose(900, 30)
    clean = [prose(i, 80) for i in range(6)]
    dirty = [f"{prose(50 + i, 60)} {item} {prose(70 + i, 20)}" for i in range(3)]
    rows = [(None, dirty[0]), (None, clean[0]), (7, dirty[1]), (7, clean[1]), (8, clean[2]), (8, clean[2]), (9, dirty[2]), (9, dirty[2]), (9, clean[3]), (None, None), (9, None)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    d = write(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, item), (None, clean[4])], "item_id long, text string"))
    got = decontaminate_stage(spark, docs, d)
    assert got.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([r for r in rows if r[1] not in dirty], key=str)
    whole = corpus_pipeline.run(spark, d).collect()
    kept = {clean[0]: None, clean[1]: 7, clean[2]: 8, clean[3]: 9}
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in whole), key=str) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for t, i in kept.items()), key=str)


def test_items_of_many_sets_are_listed_once(spark, tmp_path):
    from kerbline.llm.decontaminate import op1_decontamination

    shared, other = prose(901, 14), prose(902, 14)
    items = [(i, shared if i % 2 else f"{shared} {other}") for i in range(40)] + [(100, other), (101, other), (101, shared)]
    texts = [f"{prose(i, 30)} {shared} {prose(i + 9, 8)} {other if i % 3 else ''}" for i in range(30)]
    d = write(spark, tmp_path, documents=documents(spark, texts), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r for r in op1_decontamination(spark, d).collect()}
    for i, want in enumerate(plain_hits(texts, items)):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256")) == want
