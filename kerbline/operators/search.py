"""Shortest paths as rounds of work inside tiles and exchange between them.

Every node belongs to one tile. In a round each tile settles, for every query that reached it, all it
can reach inside the tile with a heap, from its arcs and the costs known so far; offers to nodes of other
tiles are shuffled and start the next round, in which only the tiles and queries that got offers take part.
A task reads a tile's arcs once and streams the queries past them, one at a time, so it holds one tile and one query whatever their
number is. A tile's arcs are dealt to as many tasks as keep the cluster busy, not to more for more queries.
Where a query names its targets, it stops at the dearest of them. Costs do not decrease along an arc. A network that fits one tile is settled in one round.

For networks of many tiles there is an overlay: the exact costs from every node where a tile is entered to every node where the next one is. It
is made once, rounds then are joins on these border nodes alone, and each query opens each tile only once, at the end.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import num
from kerbline.plans.lineage import BROADCAST_ROWS, cut, small

_STATE = "tile long, mode string, bucket int, query long, role int, nodes array<long>, prevs array<long>, costs array<double>"
_ARROW = pa.schema([("tile", pa.int64()), ("mode", pa.string()), ("bucket", pa.int32()), ("query", pa.int64()), ("role", pa.int32()), ("nodes", pa.list_(pa.int64())), ("prevs", pa.list_(pa.int64())), ("costs", pa.list_(pa.float64()))])
_COLUMNS = _ARROW.names
_KEY = ["tile", "mode", "bucket"]
#: Rows go in and out of tasks by tile and query, with a list of nodes (prevs, costs). Roles: offered costs, settled ones, prices (cost, as a
#: factor) of the streets node - prev for one query, nodes that the query wants to reach (cost: how many it wants), and arcs of the tile
#: (node - prev at a cost; homes: the tile each leads to, vias: what is told as the node before).
OFFER, SETTLED, PRICE, TARGET, ARC = 0, 1, 2, 3, 4
#: An arc's weight for one query where that is less, and a cost of a node that every query of a tile must stay below.
OWN, CEILING = 5, 6
#: Parts into which a tile's arcs are packed.
PARTS = 64


def _settled(tile: int, out_of: dict, away: dict, rows: list[tuple], limit: float, ceiling: dict | None = None) -> tuple[dict, dict, dict]:
    """One query in one tile; out_of: (v, weight, via) from each node, away: the tile of each v that lies in another; rows: (role, nodes, prevs,
    costs), prices, targets and settled costs before offers. Gives the cost of each node, the node before it, and offers to other tiles.

    Nodes of other tiles whose arcs are here too are searched like the tile's own, so that ways out and back in are found at once."""
    own: dict[tuple[int, int], float] = {}
    best: dict[int, float] = {}
    prev: dict[int, int] = {}
    heap, offers, prices, wanted, all_here, foreign = [], {}, {}, set(), False, set()
    for role, nodes, prevs, costs_ in rows:
        if role == SETTLED and not best and not ceiling:
            best, prev = dict(zip(nodes, costs_)), dict(zip(nodes, prevs))
            continue
        for node, before, cost in zip(nodes, prevs, costs_):
            if role == PRICE:
                prices[node, before] = cost
            elif role == OWN:
                own[node, before] = cost
            elif ceiling and cost >= ceiling.get(node, cost + 1):
                continue
            elif role == TARGET:
                wanted.add(node)
                all_here = len(wanted) == cost
            elif node not in best or (cost, before) < (best[node], prev[node]):
                if role == OFFER and (node not in best or cost < best[node]):
                    heap.append((cost, node))
                best[node], prev[node] = cost, before
    heapq.heapify(heap)
    open_ = wanted if all_here else None
    while heap:
        cost, u = heapq.heappop(heap)
        if cost > best[u]:
            continue
        if cost > limit:
            break
        if open_ is not None and u in open_:
            open_.discard(u)
            if not open_:
                limit = min(limit, cost)
        for v, w, via in out_of.get(u, ()):
            if own and own.get((u, v), w) < w:
                w = own[u, v]
            total = cost + (w * prices.get((u, v), 1.0) if prices else w)
            if total > limit or ceiling and total >= ceiling.get(v, total + 1):
                continue
            if v in away:
                if u not in foreign and (v not in offers or (total, via) < offers[v]):
                    offers[v] = total, via
                if v not in out_of:
                    continue
                foreign.add(v)
            if v not in best or total < best[v]:
                best[v], prev[v] = total, via
                heapq.heappush(heap, (total, v))
            elif total == best[v] and via < prev[v]:
                prev[v] = via
    return {n: c for n, c in best.items() if c <= limit and n not in foreign}, prev, offers


def _lists(column: pa.ListArray):
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return lambda i: values[at[i] : at[i + 1]].tolist()


def _settle(limit_of_all: float, with_offers: bool = True):
    """Rows sorted by tile, mode, bucket, arcs first, then query and role -> settled costs and offers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out_of, away, ceiling, asked, rows, limit = None, {}, {}, {}, None, [], limit_of_all
        out: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal rows, held
            if asked is None or not any(r[0] == OFFER for r in rows):
                rows = []
                return
            tile, mode, bucket = place
            best, prev, offers = _settled(tile, out_of, away, rows, limit, ceiling)
            out.append((tile, mode, bucket, asked, SETTLED, list(best), [prev[n] for n in best], list(best.values())))
            homes: dict[int, list[int]] = {}
            for v in offers if with_offers else ():
                homes.setdefault(away[v], []).append(v)
            out.extend((home, mode, bucket, asked, OFFER, to, [offers[v][1] for v in to], [offers[v][0] for v in to]) for home, to in homes.items())
            held += len(best) + len(offers)
            rows = []

        def made() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            nodes_of, prevs_of, costs_of, homes_of, vias_of = (_lists(batch.column(c)) for c in ("nodes", "prevs", "costs", "homes", "vias"))
            for i, (tile, mode, bucket, query, role, bound) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_KEY, "query", "role", "bound")))):
                if (tile, mode, bucket) != place:
                    flush()
                    place, out_of, away, ceiling, asked = (tile, mode, bucket), {}, {}, {}, None
                if role == ARC:
                    for u, v, w, home, via in zip(nodes_of(i), prevs_of(i), costs_of(i), homes_of(i), vias_of(i)):
                        out_of.setdefault(u, []).append((v, w, via))
                        if home != tile:
                            away[v] = home
                    continue
                if role == CEILING:
                    ceiling.update(zip(nodes_of(i), costs_of(i)))
                    continue
                if query != asked:
                    flush()
                    asked, limit = query, limit_of_all if bound is None else min(bound, limit_of_all)
                rows.append((role, nodes_of(i), prevs_of(i), costs_of(i)))
                if held > 500_000:
                    yield made()
        flush()
        if out:
            yield made()

    return run


def _home(tiles: DataFrame, together: int | None = None) -> DataFrame:
    """node, spot (its tile), tile: its own, or the one of neighbouring tiles, by their numbers, that have so many nodes together."""
    spots = tiles.select("node", F.col("tile").cast("bigint").alias("spot"))
    if together is None:
        return cut(spots.withColumn("tile", F.col("spot")))
    parts = -(-spots.count() // together)
    ends = sorted(set(spots.agg(F.percentile_approx("spot", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col("spot"))) if ends else F.lit(0)
    return cut(spots.withColumn("tile", part.cast("bigint")))


def _placed(arcs: DataFrame, home: DataFrame) -> DataFrame:
    """tile, mode, u, v, weight, to_tile of the cheapest arc between each two nodes, and the spots it leads from and to."""
    least = arcs.groupBy("mode", "u", "v").agg(F.min("weight").alias("weight"))
    placed = least.join(home.withColumnRenamed("node", "u"), "u").join(home.withColumnsRenamed({"node": "v", "tile": "to_tile", "spot": "to_spot"}), "v")
    return cut(placed.select("tile", "mode", "u", "v", "weight", "to_tile", "spot", "to_spot"))


def _packed(placed: DataFrame, beyond: bool = False) -> DataFrame:
    """The arcs of each tile in rows of many; beyond: with those of the neighbouring tiles (spots) that it leads to."""
    columns = ["tile", "mode", "u", "v", "weight", "to_tile", F.col("via") if "via" in placed.columns else F.col("u").alias("via")]
    rows = placed.select(*columns)
    if beyond:
        rim = placed.where("tile <> to_tile").select(F.col("tile").alias("into"), F.col("to_spot").alias("spot")).distinct()
        rows = rows.unionByName(placed.join(rim, "spot").drop("tile").withColumnRenamed("into", "tile").select(*columns))
    names = {"nodes": "u", "prevs": "v", "costs": "weight", "homes": "to_tile", "vias": "via"}
    return cut(rows.groupBy("tile", "mode", F.pmod(F.xxhash64("u"), F.lit(PARTS)).alias("part")).agg(*(F.collect_list(c).alias(n) for n, c in names.items())).drop("part"))


def _gathered(rows: DataFrame, role: int) -> DataFrame:
    """_COLUMNS, a row for each tile and query, of rows _KEY, query, node, prev, cost."""
    return rows.groupBy(*_KEY, "query").agg(F.lit(role).alias("role"), F.collect_list("node").alias("nodes"), F.collect_list("prev").alias("prevs"), F.collect_list("cost").alias("costs"))


def _scattered(rows: DataFrame) -> DataFrame:
    """_KEY, query, node, prev, cost of rows of _COLUMNS."""
    return rows.select(*_KEY, "query", F.inline(F.arrays_zip("nodes", "prevs", "costs"))).withColumnsRenamed({"nodes": "node", "prevs": "prev", "costs": "cost"})


def _least(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(F.struct("cost", "prev")).alias("b")).select(*key, "b.cost", "b.prev")


def _worked(packed: DataFrame, work: DataFrame, limit: float, with_offers: bool = True, ceilings: DataFrame | None = None) -> DataFrame:
    """What the tiles of `work` (_COLUMNS and bound) make of it, beside their arcs."""
    none = F.array().cast("array<long>")
    busy = work.where(F.col("role") == OFFER).select(*_KEY).distinct()
    fixed = lambda rows, role: rows.join(busy, ["tile", "mode"]).select(*_KEY, F.lit(0).cast("bigint").alias("query"), F.lit(role).alias("role"), "nodes", "prevs", "costs", F.lit(None).cast("double").alias("bound"), "homes", "vias")
    both = fixed(packed, ARC).unionByName(work.select(*_COLUMNS, "bound", none.alias("homes"), none.alias("vias")))
    if ceilings is not None:
        both = both.unionByName(fixed(ceilings.groupBy("tile", "mode").agg(F.collect_list("node").alias("nodes"), F.collect_list("cost").alias("costs")).withColumns({c: none for c in ("prevs", "homes", "vias")}), CEILING))
    first = F.when(F.col("role").isin(ARC, CEILING), 0).otherwise(1)
    return both.repartition(*_KEY).sortWithinPartitions(*_KEY, first, "query", F.desc("role")).mapInArrow(_settle(limit, with_offers), _STATE)


def _dealt(placed: DataFrame, asked: int) -> int:
    """Tasks among which a tile's queries are dealt: as many as keep all cores busy, whatever the number of queries."""
    places = placed.select("tile", "mode").distinct().count()
    return max(1, min(asked, -(-2 * placed.sparkSession.sparkContext.defaultParallelism // max(1, places))))


def _asked(starts: DataFrame) -> int:
    return starts.groupBy("mode").agg(F.count_distinct("query").alias("n")).agg(F.max("n")).first()[0] or 0


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("query"), F.lit(buckets)).cast("int").alias("bucket")


def _bounds(known: DataFrame, targets: DataFrame) -> DataFrame:
    """mode, query, bound: the dearest of a query's targets as reached so far, null until all are reached."""
    reached = targets.join(_scattered(known).select("mode", "query", "node", "cost"), ["mode", "query", "node"], "left")
    return reached.groupBy("mode", "query").agg(F.when(F.count("*") == F.count("cost"), F.max("cost")).alias("bound"))


def _told(known: DataFrame) -> DataFrame:
    return _scattered(known).select("mode", "query", "node", "cost", F.when(F.col("prev") >= 0, F.col("prev")).alias("prev"))


def costs(arcs: DataFrame, starts: DataFrame, tiles: DataFrame, budget: float | None = None, most_rounds: int | None = None, prices: DataFrame | None = None, targets: DataFrame | None = None, together: int | None = None) -> DataFrame:
    """mode, query, node, cost, prev of every node reached.

    arcs: mode, u, v, weight. starts: mode, query, node, cost. tiles: node, tile. prices: mode, query, u, v, factor of
    streets that cost one query more or less than the others. targets: mode, query, node; nodes dearer than a query's dearest target may then be
    missing. prev is the node before on a
    cheapest path, the least of equals, and null at a start. Rounds go on until nothing is left to settle; where
    most_rounds is given and met before, this is an error. together: so many nodes of neighbouring tiles are settled in one task.
    """
    home = _home(tiles, together)
    placed = _placed(arcs, home)
    first = cut(starts.groupBy("mode", "query", "node").agg(F.min("cost").alias("cost")).join(home, "node"))
    asked = _asked(first)
    dealt = _bucket(_dealt(placed.join(first.select("tile").distinct(), "tile", "left_semi"), asked))
    front = cut(_gathered(first.select("tile", "mode", dealt, "query", "node", F.lit(-1).cast("bigint").alias("prev"), "cost"), OFFER))
    known = front.limit(0)
    beside = None
    if prices is not None:
        own = prices.join(home.withColumnRenamed("node", "u"), "u")
        beside = cut(_gathered(own.select("tile", "mode", dealt, "query", F.col("u").alias("node"), F.col("v").alias("prev"), F.col("factor").alias("cost")), PRICE))
    if targets is not None:
        targets = cut(targets.select("mode", "query", "node").distinct())
        wanted = targets.withColumn("cost", F.count("*").over(Window.partitionBy("mode", "query")).cast("double")).join(home, "node")
        wanted = cut(_gathered(wanted.select("tile", "mode", dealt, "query", "node", F.lit(-1).cast("bigint").alias("prev"), "cost"), TARGET))
        beside = wanted if beside is None else beside.unionByName(wanted)
    return _told(_rounds(placed, front, known, beside, targets, budget, most_rounds, beyond=prices is None))


def _rounds(placed: DataFrame, front: DataFrame, known: DataFrame, beside: DataFrame | None = None, targets: DataFrame | None = None, budget: float | None = None, most_rounds: int | None = None, ceilings: DataFrame | None = None, beyond: bool = False) -> DataFrame:
    """Settles the offers of front, and what follows from them, beside the settled rows of known; all are rows of _COLUMNS.

    Of the offers only those start the next round that are better than what is known of their nodes."""
    limit = float("inf") if budget is None else float(budget)
    packed = _packed(placed, beyond)
    entries = small(cut(placed.where("tile <> to_tile").select("mode", F.col("v").alias("node")).distinct()))
    alone = entries.isEmpty()
    rim = lambda rows: _scattered(rows).join(entries, ["mode", "node"], "left_semi").select("mode", "query", "node", "cost", "prev")
    fresh = known.isEmpty()
    known, borders = known.withColumn("round", F.lit(-1)), None if fresh else cut(rim(known))
    if targets is not None:
        targets = small(targets)
    for done in itertools.count():
        n = front.count()
        if not n:
            break
        if done == most_rounds:
            raise RuntimeError(f"nodes are left to settle after {done} rounds")
        busy = front.select(*_KEY, "query").distinct()
        busy = F.broadcast(busy) if n <= BROADCAST_ROWS else busy
        held = ([] if fresh and done == 0 else [known.drop("round")]) + ([] if beside is None else [beside])
        work = reduce(DataFrame.unionByName, (part.join(busy, [*_KEY, "query"], "left_semi") for part in held), front)
        work = work.withColumn("bound", F.lit(None).cast("double")) if targets is None or done == 0 else work.join(_bounds(known, targets), ["mode", "query"], "left")
        made = cut(_worked(packed, work, limit, ceilings=ceilings))
        now = made.where(F.col("role") == SETTLED)
        known = now.withColumn("round", F.lit(done)) if fresh and done == 0 else known.unionByName(now.withColumn("round", F.lit(done)))
        if alone:
            break
        if done % 8 == 7:
            known = cut(_latest(known))
        borders = cut(rim(now) if borders is None else _least(borders.unionByName(rim(now)), "mode", "query", "node"))
        had = borders.withColumnsRenamed({"cost": "had", "prev": "had_prev"})
        offers = _least(_scattered(made.where(F.col("role") == OFFER)), *_KEY, "query", "node").join(had, ["mode", "query", "node"], "left")
        front = cut(_gathered(offers.where("had IS NULL OR cost < had OR (cost = had AND prev < had_prev)"), OFFER))
    return _latest(known)


def _latest(known: DataFrame) -> DataFrame:
    """Of the rows of each tile and query those of the last round, which have all that were before."""
    last = known.groupBy(*_KEY, "query").agg(F.max("round").alias("round"))
    return known.join(last, [*_KEY, "query", "round"], "left_semi")


def repaired(found: DataFrame, before: DataFrame, after: DataFrame, tiles: DataFrame) -> DataFrame:
    """What `costs` would find with the arcs `after`, from what it found (all nodes, without budget) with the arcs `before`.

    Where a street of a query's tree is dearer now or gone, the subtree that hangs on it is cut; cut nodes get offers from the nodes around them
    that stay, and streets that are cheaper or new make offers of their own. Only tiles with offers are opened; the rest of every tree stays.
    """
    least = lambda arcs, name: arcs.groupBy("mode", "u", "v").agg(F.min("weight").alias(name))
    changed = least(before, "old").join(least(after, "new"), ["mode", "u", "v"], "full").where("NOT old <=> new")
    changed = cut(changed)
    raised = changed.where("new IS NULL OR new > old").select("mode", F.col("u").alias("prev"), F.col("v").alias("node"))
    broken = cut(found.join(raised, ["mode", "prev", "node"], "left_semi").select("mode", "query", "node"))
    if broken.isEmpty():
        gone = broken
    else:  # every node points twice as far up its tree each round, and learns whether a broken node lies on the way
        trees = found.join(broken.select("mode", "query").distinct(), ["mode", "query"], "left_semi").select("mode", "query", "node", F.col("prev").alias("up"))
        trees = cut(trees.join(broken.withColumn("cut", F.lit(True)), ["mode", "query", "node"], "left").withColumn("cut", F.coalesce("cut", F.lit(False))))
        while not trees.where("up IS NOT NULL AND NOT cut").isEmpty():
            above = trees.select("mode", "query", F.col("node").alias("up"), F.col("up").alias("further"), F.col("cut").alias("cut_above"))
            trees = trees.join(above, ["mode", "query", "up"], "left").select("mode", "query", "node", F.col("further").alias("up"), (F.col("cut") | F.coalesce("cut_above", F.lit(False))).alias("cut"))
            trees = cut(trees)
        gone = cut(trees.where("cut").select("mode", "query", "node"))
    stay = cut(found.join(gone, ["mode", "query", "node"], "left_anti"))
    home = _home(tiles)
    placed = _placed(after, home)
    arcs = placed.select("mode", "u", "v", "weight")
    rim = gone.withColumnRenamed("node", "v").join(arcs, ["mode", "v"])
    rim = rim.join(stay.select("mode", "query", F.col("node").alias("u"), F.col("cost").alias("so_far")), ["mode", "query", "u"]).select("mode", "query", F.col("v").alias("node"), (F.col("so_far") + F.col("weight")).alias("cost"), F.col("u").alias("prev"))
    cheaper = changed.where("old IS NULL OR new < old").select("mode", "u", "v", F.col("new").alias("weight"))
    news = stay.select("mode", "query", F.col("node").alias("u"), F.col("cost").alias("so_far")).join(cheaper, ["mode", "u"]).select("mode", "query", F.col("v").alias("node"), (F.col("so_far") + F.col("weight")).alias("cost"), F.col("u").alias("prev"))
    had = stay.select("mode", "query", "node", F.col("cost").alias("had"), F.coalesce("prev", F.lit(-1)).alias("had_prev"))
    news = news.join(had, ["mode", "query", "node"], "left").where("had IS NULL OR cost < had OR (cost = had AND prev < had_prev)").select("mode", "query", "node", "cost", "prev")
    offers = rim.unionByName(news).groupBy("mode", "query", "node").agg(F.min(F.struct("cost", "prev")).alias("b")).select("mode", "query", "node", "b.cost", "b.prev")
    offers = cut(offers)
    dealt = _bucket(_dealt(placed, _asked(found)))
    rows = lambda part, role: _gathered(part.join(home, "node").select("tile", "mode", dealt, "query", "node", F.coalesce("prev", F.lit(-1)).alias("prev"), "cost"), role)
    return _told(_rounds(placed, cut(rows(offers, OFFER)), cut(rows(stay, SETTLED)), beyond=True))


def improved(arcs: DataFrame, own: DataFrame, offers: DataFrame, ceilings: DataFrame, tiles: DataFrame) -> DataFrame:
    """query, node, cost of the nodes that get cheaper than the ceilings (node, cost) for each query, from its offers (query, node, cost)
    outwards over the arcs (u, v, weight), of which some cost a query less (own: query, u, v, weight)."""
    home = _home(tiles)
    placed = _placed(arcs.select(F.lit("").alias("mode"), "u", "v", "weight"), home)
    dealt = _bucket(_dealt(placed, 1 << 30))
    rows = lambda part, prev, role: cut(_gathered(part.join(home, "node").select("tile", F.lit("").alias("mode"), dealt, "query", "node", prev.alias("prev"), "cost"), role))
    beside = rows(own.select("query", F.col("u").alias("node"), F.col("weight").alias("cost"), "v"), F.col("v"), OWN)
    front = rows(offers.groupBy("query", "node").agg(F.min("cost").alias("cost")), F.lit(-1).cast("bigint"), OFFER)
    high = cut(ceilings.join(home, "node").select("tile", F.lit("").alias("mode"), "node", "cost"))
    return _told(_rounds(placed, front, front.limit(0), beside, ceilings=high)).select("query", "node", "cost")


@dataclass
class Overlay:
    """A network cut into tiles: home (node, tile), placed arcs, and hops (mode, entry, next, via, cost): the exact cost from a node where a
    tile is entered to one where the next tile is, the last street from `via`."""

    home: DataFrame
    placed: DataFrame
    hops: DataFrame


def overlay(arcs: DataFrame, tiles: DataFrame) -> Overlay:
    """Made once for a network; a search of all a tile's entries stays inside the tile, so tiles should be of some thousand nodes."""
    home = _home(tiles)
    placed = _placed(arcs, home)
    crossing = placed.where("tile <> to_tile")
    entries = crossing.select(F.col("to_tile").alias("tile"), "mode", F.col("v").alias("node")).distinct()
    spread = F.pmod(F.xxhash64("node"), F.lit(_dealt(placed, 1 << 30))).cast("int").alias("bucket")
    work = _gathered(entries.select("tile", "mode", spread, F.col("node").alias("query"), "node", F.lit(-1).cast("bigint").alias("prev"), num(0).alias("cost")), OFFER).withColumn("bound", F.lit(None).cast("double"))
    offers = _scattered(_worked(_packed(placed), work, float("inf")).where(F.col("role") == OFFER))
    hops = offers.select("mode", F.col("query").alias("entry"), F.col("node").alias("next"), F.col("prev").alias("via"), "cost")
    return Overlay(home, placed, cut(hops))


def overlay_costs(over: Overlay, starts: DataFrame, budget: float | None = None, together: int | None = None) -> DataFrame:
    """mode, query, node, cost, prev of every node reached, as by `costs`.

    The starts' tiles are opened, a search over the hops then carries costs from border to border, and at the end every tile that a
    query entered is opened once for it. What is shuffled of the streets does not depend on the number of queries. together: the hops of tiles that
    have so many nodes are searched in one task.
    """
    limit = float("inf") if budget is None else float(budget)
    first = cut(starts.groupBy("mode", "query", "node").agg(F.min("cost").alias("cost")).withColumn("prev", F.lit(-1).cast("bigint")))
    asked = _asked(first)

    def work(rows: DataFrame, home: DataFrame, bucket: Column) -> DataFrame:
        return _gathered(rows.join(home, "node").select("tile", "mode", bucket, "query", "node", "prev", "cost"), OFFER)

    unbounded = lambda rows: rows.withColumn("bound", F.lit(None).cast("double"))
    dealt = _bucket(_dealt(over.placed, asked))
    opened = _worked(_packed(over.placed), unbounded(work(first, over.home, dealt)), limit).where(F.col("role") == OFFER)
    front = cut(_least(_scattered(opened), "mode", "query", "node"))
    wide = _home(over.home.select("node", F.col("spot").alias("tile")), together)
    places = wide.drop("spot")
    hops = over.hops.join(places.withColumnRenamed("node", "entry"), "entry").join(places.withColumnsRenamed({"node": "next", "tile": "to_tile"}), "next")
    hops = cut(hops.select("tile", "mode", F.col("entry").alias("u"), F.col("next").alias("v"), F.col("cost").alias("weight"), "to_tile", "via"))
    dealt_hops = _bucket(_dealt(hops.join(front.join(places, "node").select("tile").distinct(), "tile", "left_semi"), asked))
    offers = cut(work(front, places, dealt_hops))
    known = _scattered(_rounds(hops, offers, offers.limit(0), budget=budget)).select("mode", "query", "node", "cost", "prev")
    inside = _packed(over.placed.where("tile = to_tile"))
    return _told(cut(_worked(inside, unbounded(work(_least(first.unionByName(known), "mode", "query", "node"), over.home, dealt)), limit, with_offers=False)))


def paths(found: DataFrame, targets: DataFrame) -> DataFrame:
    """mode, query, seq (0 at the start), node: the nodes of the cheapest path to each target (mode, query, node).

    Every node doubles how far back it points each round, so a path of n streets takes log n joins.
    """
    limit = targets.select("mode", "query", "node").join(found.select("mode", "query", "node", "cost"), ["mode", "query", "node"]).groupBy("mode", "query").agg(F.max("cost").alias("most"))
    tree = cut(found.join(limit, ["mode", "query"]).where("cost <= most").select("mode", "query", "node", "prev"))  # no path goes through dearer nodes
    on_path = cut(targets.select("mode", "query", "node", F.lit(0).cast("bigint").alias("back")).join(tree.select("mode", "query", "node"), ["mode", "query", "node"], "left_semi"))
    jump = tree.where("prev IS NOT NULL").select("mode", "query", "node", F.col("prev").alias("to"))
    length = 1
    while True:
        further = on_path.join(jump, ["mode", "query", "node"]).select("mode", "query", F.col("to").alias("node"), (F.col("back") + length).alias("back"))
        fresh = cut(further)
        if fresh.isEmpty():
            break
        on_path = cut(on_path.union(fresh))
        jump = cut(jump.join(jump.select("mode", "query", F.col("node").alias("to"), F.col("to").alias("next")), ["mode", "query", "to"]).select("mode", "query", "node", F.col("next").alias("to")))
        length *= 2
    last = on_path.groupBy("mode", "query").agg(F.max("back").alias("n"))
    return on_path.join(last, ["mode", "query"]).select("mode", "query", (F.col("n") - F.col("back")).alias("seq"), "node")


def path_edges(steps: DataFrame, arcs: DataFrame) -> DataFrame:
    """mode, query, seq, u, v of each street of the paths, with the columns of its cheapest arc (least k of equals)."""
    following = steps.select("mode", "query", (F.col("seq") - 1).alias("seq"), F.col("node").alias("v"))
    legs = steps.withColumnRenamed("node", "u").join(following, ["mode", "query", "seq"])
    rest = [c for c in arcs.columns if c not in ("mode", "u", "v", "weight", "k")]
    best = arcs.groupBy("mode", "u", "v").agg(F.min(F.struct("weight", "k", *rest)).alias("a"))
    return legs.join(best, ["mode", "u", "v"]).select("mode", "query", "seq", "u", "v", "a.*")
