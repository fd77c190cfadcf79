from kerbline.plans import graph_queries


def test_projects_of_equal_score_and_cut_id_are_ranked_by_their_whole_number(spark, monkeypatch):
    """Beyond 99,999 candidates ids are cut to five digits and no longer tell two of them apart."""
    numbers = [*range(100_009, 99_999, -1), 10_000]
    rows = [(f"c{str(n)[:5]}", n, str(n), "lane", "corridor", 0.25, 80.0, 0.0) for n in numbers]
    table = spark.createDataFrame(rows, "cid string, _n long, street string, cls string, kind string, score double, length_m double, join_m double")
    monkeypatch.setattr(graph_queries, "_scored", lambda *_: table)
    got = graph_queries.priorities_csv(spark, "").collect()
    assert [r["street"] for r in sorted(got, key=lambda r: r["rank"])] == [str(n) for n in sorted(numbers)]
