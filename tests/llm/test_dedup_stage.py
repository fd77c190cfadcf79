from kerbline.llm import near_dedup

from .helpers import documents, prose


def test_stage_links_from_a_similarity_of_eighty_percent(spark):
    words = prose(5, 104).split()
    near = [*words]
    near[20], near[70] = "other", "another"
    a, b = ({tuple(w[i : i + 5]) for i in range(100)} for w in (words, near))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = documents(spark, [" ".join(words), " ".join(near), prose(6, 104)])
    assert sorted(r["doc_id"] for r in near_dedup.dedup_stage(spark, docs, "").collect()) == [0, 2]


def test_rows_of_one_id_and_different_texts_are_different_documents(spark):
    texts = [prose(i, 40) for i in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (3, texts[0]), (9, texts[1]), (9, texts[2]), (9, None), (None, texts[3]), (None, texts[3])]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = near_dedup.dedup_stage(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, texts[0]), (5, texts[1]), (9, texts[2]), (9, None), (None, texts[3]), (None, texts[3])], key=str)
