import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import projects, routes, search, trips
from kerbline.plans import grid, route_queries
from kerbline.plans.graph_queries import tiles_of
from kerbline.plans.network_queries import weighed

FOLDER = "/root/testdata/sf0.001"
LEG = "route_id long, seq long, u long, v long, cls string, name string, length double, crash_factor double, xpen double, climb double, road_busy boolean, walk boolean, e0 double, e1 double, alon double, alat double, blon double, blat double"


def leg(seq, name, cls="quiet_street", length=100.0, a=(0.0, 0.0), b=(0.0, 0.0), walk=False, xpen=0.0, route=1):
    return (route, seq, seq, seq + 1, cls, name, length, 1.0, xpen, 0.0, False, walk, 0.0, 0.0, a[0], a[1], b[0], b[1])


def legs_of(spark, rows):
    return spark.createDataFrame(rows, LEG)


LON, LAT = -71.1, 42.38
EAST, NORTH = 100 / (111320 * 0.7387), 100 / 110540


def test_turns_of_a_zigzag(spark):
    """North, sharply back south-east, then straight on under another name and slightly left at the end."""
    points = [(LON, LAT), (LON, LAT + 3 * NORTH), (LON + 2 * EAST, LAT + NORTH), (LON + 4 * EAST, LAT - NORTH), (LON + 7 * EAST, LAT - 2 * NORTH)]
    rows = [leg(i, name, a=points[i], b=points[i + 1]) for i, name in enumerate(("Mill Lane", "Tannery Row", "Quay", "Weir Walk"))]
    said = [r["voice"] for r in routes.maneuvers(legs_of(spark, rows)).orderBy("place").collect()]
    assert "right onto Tannery Row" in said[0]
    assert "left onto Weir Walk" in said[-2] and said[-1] == "you have arrived"


def brute_maneuvers(turns):
    kept = []
    for t in turns:
        if kept and t["at_m"] - kept[-1]["at_m"] < 15 and t["text"] != "destination" and ", then " not in kept[-1]["voice"]:
            kept[-1] = {"at_m": kept[-1]["at_m"], "text": t["text"], "voice": kept[-1]["voice"] + ", then " + t["voice"]}
        else:
            kept.append(dict(t))
    return [(round(k["at_m"], 6), k["text"], k["voice"]) for k in kept]


def test_close_turns_are_joined_once(spark):
    step, at, rows = EAST / 10, (LON, LAT), []
    for i in range(12):
        to = (at[0] + step, at[1]) if i % 2 else (at[0], at[1] + step)
        rows.append(leg(i, f"S{i}", a=at, b=to))
        at = to
    legs = legs_of(spark, rows)
    turns = [r.asDict() for r in routes.turns(legs).orderBy("seq").collect()]
    got = [(round(r["at_m"], 6), r["text"], r["voice"]) for r in routes.maneuvers(legs).orderBy("place").collect()]
    assert got == brute_maneuvers(turns)
    assert sum(", then " in g[2] for g in got) >= 2


def test_alerts_are_thinned(spark):
    rows = [leg(0, "a", length=50.0, xpen=250.0), leg(1, "b", "busy_street", 20.0), leg(2, "b", "busy_street", 40.0, xpen=250.0), leg(3, "c", "lane", 80.0, walk=True), leg(4, "d", "sharrow", 31.0)]
    legs = legs_of(spark, rows)
    every = sorted(((r["at_m"], float(r["ord"]), r["voice"]) for r in routes.alert_events(legs).collect()))
    kept = []
    for a in every:
        if not kept or a[0] - kept[-1][0] >= 30:
            kept.append(a)
    got = [(r["at_m"], r["voice"]) for r in routes.alerts(legs).orderBy("place").collect()]
    assert got == [(a, v) for a, _, v in kept]
    assert "hop off and walk the bike for about 80 meters." in [v for _, v in got]
    assert {v for _, _, v in every} >= {"entering a busy street for 60 meters. ride carefully.", "you can ride again.", "busy street crossing. gather up."}


def test_grade_of_toy_routes(spark):
    calm, busy = [leg(0, "q", "path", 120.0)], [leg(0, "b", "busy_street", 110.0, route=2)]
    got = {r["route_id"]: r["grade"] for r in routes.grades(legs_of(spark, calm + busy)).collect()}
    assert got == {1: "A", 2: "F"}


def test_explanations(spark):
    safe = legs_of(spark, [leg(0, "Path", "path", 900.0), leg(1, "Elm", "quiet_street", 500.0)])
    direct = legs_of(spark, [leg(0, "Broadway", "busy_street", 1000.0)])
    reasons = routes.explained(safe, direct, 25.0, "young kids").first()["reasons"]
    assert "accepts +40% distance (1.4 km vs 1.0 km direct)" in reasons[0]
    assert "worst stretch: 1.0 km along Broadway. This route avoids all of it." in reasons[1]
    assert reasons[2].startswith("Backbone: Path (900 m)")


def graph_of(rows):
    out = {}
    for u, v, w in rows:
        out.setdefault(u, {})
        out[u][v] = min(w, out[u].get(v, 1e18))
    return out


def dijkstra(graph, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in graph.get(u, {}).items():
            if d + w < best.get(v, 1e18):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def test_options_against_dijkstra(spark):
    edges = weighed(spark, FOLDER).persist()
    od = route_queries._trips(spark, FOLDER)
    legs = trips.options(edges, grid.nodes(spark, FOLDER), od, tiles_of(spark, FOLDER, side=10), "young_kids").persist()
    rows = edges.select("u", "v", "length", "crash_factor", "xpen", "stress_mult").collect()
    prices = {"direct": graph_of((r["u"], r["v"], r["length"]) for r in rows), "safest": graph_of((r["u"], r["v"], r["length"] * r["stress_mult"] * r["crash_factor"] + r["xpen"]) for r in rows)}
    ends = {r["trip"]: (r["source"], r["target"]) for r in od.collect()}
    seen = 0
    for (trip, option), part in _grouped(legs).items():
        assert [p[0] for p in part] == list(range(len(part))), "a path without gaps"
        assert part[0][1] == ends[trip][0] and part[-1][2] == ends[trip][1]
        assert all(a[2] == b[1] for a, b in zip(part, part[1:]))
        if option in prices:
            cost = sum(prices[option][u][v] for _, u, v in part)
            assert cost == pytest.approx(dijkstra(prices[option], ends[trip][0])[ends[trip][1]])
            seen += 1
    assert seen >= len(ends)
    told = {(r["trip"], r["option"]): r for r in trips.described(legs, "young_kids").collect()}
    assert all(r["detour_pct"] >= 0 and r["grade"] in "ABCDF" for r in told.values())


def _grouped(legs):
    out = {}
    for r in legs.select("trip", "option", "seq", "u", "v").orderBy("trip", "option", "seq").collect():
        out.setdefault((r["trip"], r["option"]), []).append((r["seq"], r["u"], r["v"]))
    return out


def drawn_streets(seed, n, streets, one_way):
    """(u, v, metres, riding price) of random streets; some can be used one way only."""
    draw, out = random.Random(seed), []
    for _ in range(streets):
        u, v = draw.sample(range(n), 2)
        metres = draw.randint(20, 400)
        price = metres * draw.choice((1.0, 1.4, 3.0, 8.0, 25.0))
        out += [(u, v, float(metres), price)] + ([] if draw.random() < one_way else [(v, u, float(metres), price)])
    return out


def plain_costs(streets, start):
    """Bellman's relaxation until nothing changes."""
    cost, changed = {start: 0.0}, True
    while changed:
        changed = False
        for u, v, w in streets:
            if u in cost and cost[u] + w < cost.get(v, float("inf")):
                cost[v], changed = cost[u] + w, True
    return cost


def plain_walk(streets, source, target, budget):
    """(factor, cost) of the first price of walking at which what is walked keeps the budget; states (node, on foot)."""
    for turn in range(6):
        factor = 2.4 * 2**turn
        best = {(source, False): (0.0, 0.0)}  # price, metres walked
        changed = True
        while changed:
            changed = False
            for state, (c, m) in list(best.items()):
                node, walking = state
                ways = [((node, not walking), 40.0 if walking else 90.0, 0.0)]
                ways += [((v, True), metres * factor, metres) if walking else ((v, False), price, 0.0) for u, v, metres, price in streets if u == node]
                for to, w, walked in ways:
                    if (c + w, m + walked) < best.get(to, (float("inf"), 0.0)):
                        best[to], changed = (c + w, m + walked), True
        ends = [(c + (40.0 if walking else 0.0), m) for (node, walking), (c, m) in best.items() if node == target]
        if not ends:
            return None
        if min(ends)[1] <= budget:
            return factor, min(ends)[0]
    return None, plain_costs([(u, v, p) for u, v, _, p in streets], source).get(target)


@pytest.mark.parametrize("budget", [350.0])
def test_walking_keeps_a_budget_on_a_random_network(spark, budget):
    streets = drawn_streets(11, 26, 40, 0.3)
    arcs = spark.createDataFrame([(u, v, i, p, m) for i, (u, v, m, p) in enumerate(streets)], "u long, v long, k int, ride double, length double")
    tiles = spark.createDataFrame([(i, i % 4) for i in range(26)], "node long, tile long")
    od = [(100 + i, i, (i * 7 + 3) % 26) for i in range(0, 26, 4)]
    got = {r["trip"]: (r["factor"], r["cost"], r["walked_m"]) for r in trips.walk_within(arcs, spark.createDataFrame(od, "trip long, source long, target long"), tiles, budget).collect()}
    for trip, source, target in od:
        want = plain_walk(streets, source, target, budget)
        if want is None:
            assert trip not in got
        else:
            assert got[trip][0] == want[0] and got[trip][1] == pytest.approx(want[1]) and got[trip][2] <= budget


def test_loops_return_another_way(spark):
    square = [(0, 1), (1, 2), (2, 3), (3, 0)]
    both = square + [(b, a) for a, b in square]
    rows = [(u, v, 0, "quiet_street", False, 500.0, 1.0, 0.0, 0.0, "s") for u, v in both]
    edges = spark.createDataFrame(rows, "u long, v long, k int, cls string, road_busy boolean, length double, crash_factor double, xpen double, climb double, name string")
    tiles = spark.createDataFrame([(i, i // 2) for i in range(4)], "node long, tile long")
    homes = spark.createDataFrame([(1, 0, 0.0, 0.0)], "trip long, id long, x double, y double")
    stops = spark.createDataFrame([(9, 500.0, 500.0, 2)], "poi_id long, px double, py double, node long")
    got = trips.loops(edges, homes, stops, tiles, 2000.0).first()
    assert (got["poi_id"], got["total_m"]) == (9, 2000.0)


def harbour(spark):
    """Three pieces of calm street around a dual road: a mole of 150 m, a quarter of 900 m, and a stub of 90 m. Two bridges cross
    between the mole and the quarter under one name but apart; a ring road touches the quarter twice."""
    def both(u, v, length, cls, name, mult):
        return [(a, b, 0, length, name, cls, mult, 0, 1.0) for a, b in ((u, v), (v, u))]

    rows = both(10, 11, 250.0, "path", "Mole", 1.0)
    for i in range(20, 23):
        rows += both(i, i + 1, 300.0, "service", "Rope Walk", 2.0)
    rows += both(40, 41, 90.0, "quiet_street", "Stub", 1.4)
    rows += both(11, 20, 75.0, "sharrow", "Swing Bridge", 6.0) + both(10, 23, 80.0, "sharrow", "Swing Bridge", 6.0)
    rows += both(21, 30, 400.0, "busy_street", "Ring", 25.0) + both(30, 22, 410.0, "busy_street", "Ring", 25.0) + both(30, 40, 50.0, "moderate_street", "Cut", 8.0)
    return spark.createDataFrame(rows, "u long, v long, k int, length double, name string, cls string, stress_mult double, crash_count long, crash_factor double")


def test_severance_of_a_harbour(spark):
    edges = harbour(spark)
    nodes_of, sizes = projects.islands(edges)
    assert sorted(r["metres"] for r in sizes.collect()) == [90.0, 250.0, 900.0]
    rows, members = projects.candidates(edges)
    got = sorted((r["street"], r["length_m"], r["join_m"]) for r in projects.severance(rows, members, nodes_of, sizes).collect())
    # each bridge is a run of its own; the ring meets one island alone, and what the stub's cut joins is too short to count
    assert got == [("Cut", 50.0, 0.0), ("Ring", 810.0, 0.0), ("Swing Bridge", 75.0, 250.0), ("Swing Bridge", 80.0, 250.0)]


@pytest.mark.parametrize("tile", [5])
def test_searches_back_from_a_goal_go_against_one_way_streets(spark, tile):
    streets = [(u, v, p) for u, v, _, p in drawn_streets(23, 30, 55, 0.8)]
    arcs = spark.createDataFrame([("m", u, v, w) for u, v, w in streets], "mode string, u long, v long, weight double")
    tiles = spark.createDataFrame([(i, i // tile) for i in range(30)], "node long, tile long")
    goals = (4, 17, 29)
    starts = spark.createDataFrame([("m", g, g, 0.0) for g in goals], "mode string, query long, node long, cost double")
    back = arcs.select("mode", F.col("v").alias("u"), F.col("u").alias("v"), "weight")
    got = {(r["query"], r["node"]): r["cost"] for r in search.costs(back, starts, tiles).collect()}
    want = {(g, n): c for n in range(30) for g, c in plain_costs(streets, n).items() if g in goals}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    forth = {g: plain_costs(streets, g) for g in goals}
    assert any(forth[g].get(n) != c for (g, n), c in want.items())  # the direction matters on this network


def test_normalised_scores_follow_their_formula(spark):
    draw = random.Random(5)
    for size in (1, 2, 9):
        values = [draw.choice((-3.0, 0.0, draw.uniform(0, 5000))) for _ in range(size)]
        top = max(values)
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r[0] for r in df.select(projects.normalised(F.col("v"), F.lit(top))).collect()]
        want = [math.log1p(max(0.0, v)) / math.log1p(top) if top > 0 else 0.0 for v in values]
        assert got == pytest.approx(want)
