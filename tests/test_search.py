import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import search
from tests.test_routes import drawn_streets, plain_costs

NODES = 60


def tables(spark, streets, tile):
    arcs = spark.createDataFrame([("m", u, v, w) for u, v, w in streets], "mode string, u long, v long, weight double")
    return arcs, spark.createDataFrame([(i, i // tile) for i in range(NODES)], "node long, tile long")


def starts_of(spark, nodes):
    return spark.createDataFrame([("m", 100 + n, n, 0.0) for n in nodes], "mode string, query long, node long, cost double")


def held(found):
    return {(r["query"], r["node"]): (r["cost"], r["prev"]) for r in found.collect()}


def tree_holds(got, streets):
    """Every node before is one that gives the cost, and the least of those."""
    into = {}
    for u, v, w in streets:
        into.setdefault(v, []).append((u, w))
    for (q, n), (c, prev) in got.items():
        ways = [u for u, w in into.get(n, ()) if (q, u) in got and got[q, u][0] + w == pytest.approx(c, abs=1e-9)]
        assert prev is None and c == 0.0 or prev == min(ways)


@pytest.mark.parametrize("tile", [6, 25])
def test_overlay_finds_what_a_plain_search_finds(spark, tile):
    streets = [(u, v, p) for u, v, _, p in drawn_streets(41, NODES, 110, 0.4)]
    arcs, tiles = tables(spark, streets, tile)
    over = search.overlay(arcs, tiles)
    starts = (0, 7, 33, 59)
    want = {(100 + s, n): c for s in starts for n, c in plain_costs(streets, s).items()}
    got = held(search.overlay_costs(over, starts_of(spark, starts)))
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k]) for k in want)
    tree_holds(got, streets)
    near = held(search.overlay_costs(over, starts_of(spark, starts), budget=900.0))
    assert near.keys() == {k for k, c in want.items() if c <= 900.0}


def test_targets_end_a_search_early_but_not_too_early(spark):
    streets = [(u, v, p) for u, v, _, p in drawn_streets(42, NODES, 120, 0.2)]
    arcs, tiles = tables(spark, streets, 12)
    wanted = {(100 + s, t) for s, t in ((0, 5), (0, 9), (7, 58), (33, 33))}
    targets = spark.createDataFrame([("m", q, t) for q, t in wanted], "mode string, query long, node long")
    for cut_up in (tiles, tiles.withColumn("tile", F.lit(0))):
        got = held(search.costs(arcs, starts_of(spark, (0, 7, 33)), cut_up, targets=targets))
        for s in (0, 7, 33):
            costs = plain_costs(streets, s)
            ends = [costs[t] for q, t in wanted if q == 100 + s and t in costs]
            if len(ends) == sum(q == 100 + s for q, _ in wanted):
                assert all(got[100 + s, n][0] == pytest.approx(c) for n, c in costs.items() if c <= max(ends))
    one_tile = held(search.costs(arcs, starts_of(spark, (0, 7, 33)), tiles.withColumn("tile", F.lit(0)), targets=targets))
    assert len(one_tile) < 3 * NODES / 2


def test_a_tile_is_read_as_often_for_many_queries_as_for_few(spark):
    arcs, tiles = tables(spark, [(u, v, p) for u, v, _, p in drawn_streets(1, NODES, 90, 0.2)], 20)
    placed = search._placed(arcs, search._home(tiles))
    assert search._dealt(placed, 10**3) == search._dealt(placed, 10**6)


@pytest.mark.parametrize("seed", [1, 2])
def test_repaired_trees_equal_fresh_ones(spark, seed):
    draw = random.Random(seed)
    streets = [(u, v, p) for u, v, _, p in drawn_streets(50 + seed, NODES, 130, 0.3)]
    least = {}
    for u, v, w in streets:
        least[u, v] = min(w, least.get((u, v), w))
    arcs, tiles = tables(spark, streets, 10)
    starts = (3, 20, 44)
    found = search.costs(arcs, starts_of(spark, starts), tiles)
    now = {k: w for k, w in least.items()}
    for k in draw.sample(sorted(now), 25):
        now[k] = draw.choice((now[k] * 3, now[k] + 500.0, now[k] / 2, None))
    changed = [(u, v, w) for (u, v), w in now.items() if w is not None] + [(2, 50, 30.0), (51, 1, 40.0)]
    after, _ = tables(spark, changed, 10)
    got = held(search.repaired(found, arcs, after, tiles))
    fresh = held(search.costs(after, starts_of(spark, starts), tiles))
    assert got.keys() == fresh.keys() == {(100 + s, n) for s in starts for n in plain_costs(changed, s)}
    assert all(got[k] == (pytest.approx(fresh[k][0]), fresh[k][1]) for k in fresh)
    back = held(search.repaired(search.repaired(found, arcs, after, tiles), after, arcs, tiles))
    first = held(found)
    assert back.keys() == first.keys() and all(back[k][0] == pytest.approx(first[k][0]) for k in first)


def test_nothing_changed_opens_nothing(spark):
    arcs, tiles = tables(spark, [(u, v, p) for u, v, _, p in drawn_streets(60, NODES, 90, 0.2)], 10)
    found = search.costs(arcs, starts_of(spark, (0,)), tiles)
    assert held(search.repaired(found, arcs, arcs, tiles)) == held(found)
