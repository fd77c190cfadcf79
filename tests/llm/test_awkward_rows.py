"""Null ids, repeated rows and clashing columns where the operators' own tests have none."""

from kerbline.llm import decontaminate, html_extract, language_id, license_scan, secret_scan

from .helpers import AWKWARD, documents, prose, write


def test_languages_of_repeated_rows_and_null_ids(spark, tmp_path):
    texts = [prose(i, 20) for i in range(8)] * 2 + AWKWARD
    ids = [None, None, *range(6)] * 2 + [None] * len(AWKWARD)
    langs = ["en", "fr"] * 8 + [None] * len(AWKWARD)
    got = language_id.op4_language_id(spark, write(spark, tmp_path, documents=documents(spark, texts, ids, langs))).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    twice: dict = {}
    for r in got:
        twice.setdefault((r["doc_id"], r["lang_pred"], r["score"]), []).append(r)
    assert all(len(v) % 2 == 0 for (i, *_), v in twice.items() if i is not None)


def test_licences_of_null_ids_and_repeated_rows(spark, tmp_path):
    texts = ["Released under the MIT License.", None, "Released under the MIT License.", "plain", "Licensed under CC BY 4.0."]
    got = license_scan.op5_license_scan(spark, write(spark, tmp_path, documents=documents(spark, texts, [None, None, None, 4, 4]))).collect()
    assert sorted((str(r["doc_id"]), r["licenses"]) for r in got) == [("4", ""), ("4", "cc-by-4.0"), ("None", ""), ("None", "mit"), ("None", "mit")]


def test_secrets_of_null_and_repeated_ids_are_masked_row_by_row(spark):
    texts = ["password=abcdefghijklmnop", "nothing here", None, "token: AAAAbbbbCCCC1234", "token: AAAAbbbbCCCC1234", ""]
    docs = documents(spark, texts, [None, None, None, 7, 7, 7])
    got = secret_scan.secret_stage(spark, docs, "")
    assert got.schema == docs.schema and got.count() == len(texts)
    rows = sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
    assert sum("[secret]" in t for _, t in rows) == 3 and ("None", "nothing here") in rows and ("7", "") in rows and ("None", "None") in rows


def test_pages_with_clashing_columns_and_two_pages_a_host(spark, tmp_path):
    rows = [(i, f"http://h{i // 2}/x", f"<body><p>A notice</p><p>{prose(i, 30)}</p></body>", "host", "wrapper", "print", 5) for i in range(4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, print string, n long")
    got = html_extract.op8_html_extraction(spark, write(spark, tmp_path, pages=table))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: f"A notice\n{prose(i, 30)}" for i in range(4)}  # two pages tell no template


def test_an_empty_benchmark_and_items_without_ids_keep_every_row(spark, tmp_path):
    docs = documents(spark, [prose(1, 30), None, prose(1, 30)], [1, None, 1])
    for n, items in enumerate(([], [(None, prose(1, 30))])):
        d = write(spark, tmp_path / str(n), benchmark=spark.createDataFrame(items, "item_id long, text string"))
        assert decontaminate.decontaminate_stage(spark, docs, d).count() == 3
