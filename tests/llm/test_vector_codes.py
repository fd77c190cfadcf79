import hashlib
import math
import random

import numpy as np
import pytest

from kerbline.llm import vector_codes as vc

from .helpers import write

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, `_ints` string, part int"


def plain(rows):
    """The contract by loops over whole distances."""
    good = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return {}
    width = len(good[0][1]) // 16
    seeds = [v for _, v, _ in sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]]
    books = [[v[p * width : (p + 1) * width] for v in seeds] for p in range(16)]

    def assign(v):
        out = []
        for p in range(16):
            x = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p])))
        return out

    for _ in range(2):
        found = [assign(v) for _, v, _ in good]
        for p in range(16):
            for k in range(len(books[p])):
                members = [v[p * width : (p + 1) * width] for (_, v, _), a in zip(good, found) if a[p][1] == k]
                if members:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, l in good:
        a = assign(v)
        out.append((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), l))
    total = {}
    for *_, e, l in out:
        total[l] = total.get(l, 0) + e
    return sorted(((i, c, e, total[l], sha) for i, c, e, l in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 1, "x", 2) for i, v, l in rows], SCHEMA)


def vectors(seed, n, dims=32, values=None):
    draw = random.Random(seed)
    return [[draw.choice(values) if values else float(np.float32(draw.uniform(-2, 2))) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("values", [None, [0.0, 0.25, -0.25]], ids=["spread", "ties"])
def test_query_matches_loops(spark, tmp_path, values):
    rows = [(i * 3 % 211, v, i % 4 or None) for i, v in enumerate(vectors(3, 150, values=values))]
    rows += [(1000, None, 1), (1001, [None] + [0.5] * 31, 1), (1002, [float("nan")] * 32, 2), (1003, [float("inf")] + [0.0] * 31, None), rows[5], rows[5], (None, rows[7][1], 3)]
    folder = write(spark, tmp_path, embeddings=table(spark, rows))
    got = vc.op13_vector_codes(spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_few_rows_one_row_and_none(spark, tmp_path):
    for n in (0, 1, 5):
        rows = [(i, v, 0) for i, v in enumerate(vectors(n, n))]
        folder = write(spark, tmp_path, embeddings=table(spark, rows))
        assert sorted((tuple(r) for r in vc.op13_vector_codes(spark, folder).collect()), key=str) == (plain(rows) or [])


def test_other_lengths_stay_without_a_code(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(1, 20))] + [(90, [1.0] * 7, 0), (91, [], 0), (92, [1.0] * 16, 0)]
    coded, books = vc.compress(table(spark, rows))
    got = {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()}
    assert len(got) == 23 and books.shape == (16, 20, 2)
    assert all(got[i] == (None, None) for i in (90, 91, 92)) and all(len(got[i][0]) == 32 for i in range(20))


def test_huge_components_are_limited_not_wrapped(spark):
    rows = [(0, [3e38] * 32, 0), (1, [-3e38] * 32, 0), (2, [0.0] * 32, 0)]
    coded, books = vc.compress(table(spark, rows), rounds=0)
    assert {r["error"] for r in coded.collect()} == {0} and books.max() == vc.LIMIT and books.min() == -vc.LIMIT


def test_codes_read_back_lie_as_far_off_as_their_error(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(8, 90))]
    coded, books = vc.compress(table(spark, rows))
    ints = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    for r in vc.decompress(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r["vec_id"]], r["approximation"])) == r["error"]


@pytest.mark.parametrize("dims", [1, 2, 5, 8])
def test_partial_distances_find_what_whole_distances_find(dims):
    draw = np.random.default_rng(dims)
    for spread in (2, 300):
        parts, book = draw.integers(-spread, spread, (400, dims)), draw.integers(-spread, spread, (37, dims))
        whole = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        entry, far = vc.nearest(parts, book)
        assert (entry == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
