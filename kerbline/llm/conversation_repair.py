"""Repair of conversations whose turns are missing, empty, cut off, said twice or given to the wrong speaker.

The cheapest edits give each conversation roles of the form (s?(ua)+)?, by initials: Keep (free), Rerole to user or assistant
(3), Delete (4; a must for blank and duplicate turns), Insert an empty turn of either (3); a truncated turn that stays adds 3. Of
equally cheap edits the least in ASCII is taken.

Method: a layer for each turn, four states (nothing yet, after s, after u, after a). A macro edit is a run of up to two
inserts and then the turn's own edit. The macros' strings are prefix-free, so two audits of as many turns compare by their
first different macro: instead of audit strings a layer keeps the rank of each state's audit among them, and a parent
pointer with the macro's number. Of equal costs the lower (rank before, macro) wins. Audits are spelt out afterwards, from the last layer backwards.

A conversation may hold any share of all rows. Equal turns are counted first; turns, without their texts, are sorted by range over the
cluster and cut into blocks of BLOCK turns. Whatever lies within a block is done there. A stretch that touches a block's edge
is solved from each of the four states it may be entered in, with ranks over all sixteen results; these
summaries are folded in order of the blocks, which fixes each stretch's first and last state, and it is spelt out from its own
pointers. Texts are sorted once by conversation and streamed past the audit: nothing is held of a
conversation there but its audit, as a hash over a whole conversation is a chain that no split can shorten.

Defined cases: null roles and texts, and null ids and turns within the key that damages, are one space, so a null text is
blank; null ids are one conversation, null turns come first and count in no gap. Turns of one number are ordered by role, then by the SHA-256 of
their text; repeated rows are duplicates. Roles with other initials can only be reroled or deleted. A conversation that
loses every turn has zeros, an empty audit and the hash of nothing. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kerbline.plans.lineage import small

from .cluster import cut, small_batches

BLOCK = 1 << 12
REROLE, DELETE, INSERT, STAYS_CUT = 3, 4, 3, 3
S, U, A, OTHER = range(4)  # initials
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # what an insert or a rerole makes of a state
MACROS = sorted(["D"] + ["I" * run + own for run in range(3) for own in "KR"])
CLOSING = {START: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}
LEGAL = {(S, U), (U, A), (A, U)}
STATS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _steps(initial: int, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """For each state after a turn the ways there: (state before, cost, number of the macro), the best of each state before."""
    ways: list[dict[int, tuple[int, int]]] = [{} for _ in range(4)]
    for before in range(4):
        ways[before][before] = (DELETE, MACROS.index("D"))
    for before in range(4):
        state, cost = before, STAYS_CUT * truncated
        for run in range(3):
            after = NEXT[state]
            found = [(after, cost + REROLE, "R")]
            if initial == S and state == START:
                found.append((AFTER_S, cost, "K"))
            elif (initial, after) in ((U, AFTER_U), (A, AFTER_A)):
                found.append((after, cost, "K"))
            for end, price, own in found:
                way = (price, MACROS.index("I" * run + own))
                ways[end][before] = min(ways[end].get(before, way), way)
            state, cost = after, cost + INSERT
    return [[(before, *way) for before, way in ends.items()] for ends in ways]


STEPS = {(initial, truncated): _steps(initial, truncated) for initial in range(4) for truncated in (False, True)}
_DELETED = bytes(MACROS.index("D") << 2 | state for state in range(4))


def solve(turns: list[tuple[int, bool, bool, int]], entries: tuple[int, ...]) -> tuple[list[tuple[int, int] | None], bytes]:
    """turns: (initial, truncated, must go, copies). For each entry and each state after the last turn its (cost, rank) or None;
    and for each turn the parent pointers of all of these, a byte each: macro * 4 + state before."""
    width = 4 * len(entries)
    cells: list[tuple[int, int] | None] = [None] * width
    for e, state in enumerate(entries):
        cells[4 * e + state] = (0, 0)
    back = bytearray()
    for initial, truncated, gone, copies in turns:
        extra = DELETE * (copies - 1)
        if gone:
            back += _DELETED * len(entries)
            cells = [c and (c[0] + DELETE + extra, c[1]) for c in cells]
            continue
        steps, found = STEPS[initial, truncated], []
        for base in range(0, width, 4):
            for ways in steps:
                best = None
                for before, price, macro in ways:
                    c = cells[base + before]
                    if c is not None:
                        way = (c[0] + price, c[1], macro, before)
                        if best is None or way < best:
                            best = way
                found.append(best)
        ranks = {key: rank for rank, key in enumerate(sorted({(f[1], f[2]) for f in found if f}))}
        back += bytes(f[2] << 2 | f[3] if f else 0 for f in found)
        cells = [f and (f[0] + extra, ranks[f[1], f[2]]) for f in found]
    return cells, bytes(back)


def spelt(back: bytes, copies: list[int], width: int, entry: int, state: int) -> tuple[str, int]:
    """The audit that the pointers of an entry (its number) and a last state give, and the state it began in."""
    out = []
    for i in range(len(copies) - 1, -1, -1):
        pointer = back[width * i + 4 * entry + state]
        out.append(MACROS[pointer >> 2] + "D" * (copies[i] - 1))
        state = pointer & 3
    return "".join(reversed(out)), state


def closed(cells: list[tuple[int, int] | None]) -> tuple[int, int]:
    """(cost, last state) of the best end of a conversation among the four states."""
    cost, _, state = min((c[0] + CLOSING[s][0], c[1], s) for s, c in enumerate(cells) if c)
    return cost, state


def _counts(turns: list[tuple], numbers: list[int | None]) -> dict:
    """turns: (initial, truncated, late, blank, copies)."""
    out = dict.fromkeys(STATS, 0)
    before = None
    for (initial, truncated, late, blank, copies), number in zip(turns, numbers):
        out["blank"] += copies * blank
        out["duplicate"] += 0 if blank else copies - 1 + late
        out["truncated"] += truncated and not late
        out["illegal"] += copies - 1 + (before is not None and (before, initial) not in LEGAL)
        before = initial
    told = [x for x in numbers if x is not None]
    out["turns"] = len(set(told))
    return out | {"low": told[0] if told else None, "high": told[-1] if told else None, "first": turns[0][0], "last": turns[-1][0]}


def _joined(a: dict | None, b: dict) -> dict:
    """Counts of two stretches of one conversation, one after the other."""
    if a is None:
        return dict(b)
    out = {k: a[k] + b[k] for k in STATS}
    out["illegal"] += (a["last"], b["first"]) not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"]}


_NUMBERS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first int, last int"
_STRETCH = f"conv_id long, block long, open boolean, cost long, audit string, cells array<struct<cost:long,rank:int>>, back binary, copies array<long>, {_NUMBERS}"
_CHOICE = f"conv_id long, block long, entry int, state int, whole long, {_NUMBERS}"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _block_rows(rows: list[tuple]) -> Iterator[dict]:
    """The stretches of a block; rows: (conv_id, block, turn, initial, truncated, blank, late, copies)."""
    at = 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and rows[stop][0] == rows[at][0]:
            stop += 1
        mine = rows[at:stop]
        opens, ends = at > 0, stop < len(rows)  # for sure
        turns = [(r[3], r[4], r[5] or r[6], r[7]) for r in mine]
        cells, back = solve(turns, (START,) if opens else (START, AFTER_S, AFTER_U, AFTER_A))
        out = {"conv_id": mine[0][0], "block": mine[0][1], "open": not (opens and ends)} | _counts([(r[3], r[4], r[6], r[5], r[7]) for r in mine], [r[2] for r in mine])
        copies = [r[7] for r in mine]
        if opens and ends:
            cost, state = closed(cells)
            out |= {"cost": cost, "audit": spelt(back, copies, 4, 0, state)[0] + CLOSING[state][1]}
        else:
            out |= {"cells": [c and {"cost": c[0], "rank": c[1]} for c in cells], "back": back, "copies": copies}
        yield out
        at = stop


def _blocks(schema: pa.Schema):
    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[dict] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][1] != row[1]:
                    out += _block_rows(held)
                    held = []
                held.append(row)
            if out:
                yield _batch(out, schema)
        if held:
            yield _batch(list(_block_rows(held)), schema)

    return run


def _fold(schema: pa.Schema):
    """Stretches of a conversation in order -> the state each is entered and left in; the last one carries cost and counts."""

    def ended(conv, blocks: list[int], parents: list[bytes], cells, counts: dict) -> list[dict]:
        whole, state = closed(cells)
        out = []
        for block, pointers in zip(reversed(blocks), reversed(parents)):
            entry = pointers[state]
            out.append({"conv_id": conv, "block": block, "entry": entry, "state": state})
            state = entry
        return [out[0] | {"whole": whole} | counts, *out[1:]]

    def run(batches):
        conv, blocks, parents, cells, counts = None, [], [], [], None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if blocks and row["conv_id"] != conv:
                    out += ended(conv, blocks, parents, cells, counts)
                    blocks, parents, counts = [], [], None
                if not blocks:
                    conv, cells = row["conv_id"], [(0, 0), None, None, None]
                found = []
                for state in range(4):
                    ways = [(cells[e][0] + c["cost"], cells[e][1], c["rank"], e) for e in range(len(row["cells"]) // 4) if cells[e] and (c := row["cells"][4 * e + state])]
                    found.append(min(ways, default=None))
                ranks = {key: rank for rank, key in enumerate(sorted({f[1:3] for f in found if f}))}
                cells = [f and (f[0], ranks[f[1:3]]) for f in found]
                blocks.append(row["block"])
                parents.append(bytes(f[3] if f else 0 for f in found))
                counts = _joined(counts, row)
            if out:
                yield _batch(out, schema)
        if blocks:
            yield _batch(ended(conv, blocks, parents, cells, counts), schema)

    return run


def _spell(batches):
    for batch in batches:
        audits = []
        for back, copies, cells, entry, state, whole in zip(*(batch.column(c).to_pylist() for c in ("back", "copies", "cells", "entry", "state", "whole"))):
            audits.append(spelt(back, copies, cells, entry, state)[0] + (CLOSING[state][1] if whole is not None else ""))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(audits, pa.string())], ["conv_id", "block", "audit"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, how often the row is there after damage (0, 1 or 2)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.when(draw == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(draw.isin(0, 1), F.lit("")).when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys))


def audited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows as of `damaged` -> conv_id, cost, audit and the counts, for conversations that have a row."""
    small_batches(rows.sparkSession)
    stretch, choice = _arrow(_STRETCH), _arrow(_CHOICE)
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    key = ["conv_id", "turn", "role", "digest"]
    told = rows.where("n > 0").select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "n",
        F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER).alias("initial"), (end == "").alias("blank"), ((end != "") & ~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    told = told.groupBy(*key, "initial", "blank", "truncated").agg(F.sum("n").alias("copies"))
    told = cut(_sorted_by(told.repartitionByRange(*(F.col(k).asc_nulls_first() for k in key)), *key).withColumn("pos", F.monotonically_increasing_id()))
    said = told.where("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("pos").alias("earliest"), F.count("*").alias("times")).where("times > 1")
    told = told.join(small(said), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    told = told.select("conv_id", F.expr(f"pos DIV {block}").alias("block"), "pos", "turn", "initial", "truncated", "blank", F.coalesce((F.col("pos") > F.col("earliest")) & ~F.col("blank"), F.lit(False)).alias("late"), "copies")
    stretches = told.repartition("block").sortWithinPartitions("pos").drop("pos").mapInArrow(_blocks(stretch), _STRETCH)
    stretches = cut(stretches)
    numbers = [c.split()[0] for c in _NUMBERS.split(", ")]
    done = stretches.where("NOT open").select("conv_id", "cost", "audit", *numbers)
    open_ = stretches.where("open")
    folded = cut(_sorted_by(open_.select("conv_id", "block", "cells", *numbers).repartition("conv_id"), "conv_id", "block").mapInArrow(_fold(choice), _CHOICE))
    chosen = folded.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "state", "whole")
    met = open_.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "back", "copies", F.size("cells").alias("cells"), "entry", "state", "whole")
    pieces = met.mapInArrow(_spell, "conv_id long, block long, audit string").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("p"))
    pieces = pieces.select(F.col("conv_id").alias("c"), F.array_join("p.audit", "").alias("audit"))
    rest = folded.where("whole IS NOT NULL").join(pieces, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.col("whole").alias("cost"), "audit", *numbers)
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    return done.unionByName(rest).select("conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


class Reader:
    """Follows an audit turn by turn; gives the repaired turns as (edit, role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = self._role()
            self.last = role[0]
            yield "I", role, ""

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        if not copies:
            return
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += copies  # further copies go
        if edit != "D":
            role = self._role() if edit == "R" else role
            self.last = role[:1]
            yield edit, role, text

    def close(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()


def _streamed(batches) -> Iterator[tuple]:
    """('begin', conv_id, the audit's row), ('turn', edit, role, text)... and ('end',) for each conversation of rows sorted
    by conversation, the audit first; ('batch',) after each batch."""
    reader, conv, begun = None, None, False
    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != conv:
                if begun:
                    yield from (("turn", *t) for t in reader.close())
                    yield ("end",)
                conv, begun, reader = row["conv_id"], True, Reader(row["audit"] or "")
                yield "begin", conv, row
            if row["audit"] is None:
                yield from (("turn", *t) for t in reader.turn(row["role"], row["text"], row["n"]))
        yield ("batch",)
    if begun:
        yield from (("turn", *t) for t in reader.close())
        yield ("end",)
        yield ("batch",)


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _reports(schema: pa.Schema):
    def run(batches):
        out: list[dict] = []
        for what, *rest in _streamed(batches):
            if what == "begin":
                now = {"conv_id": rest[0]} | {c: rest[1][c] or 0 for c in _REPORT} | {"audit": rest[1]["audit"] or ""}
                sha, turns = hashlib.sha256(), 0
            elif what == "turn":
                sha.update(("\n" if turns else "").encode() + f"{rest[1]}:{rest[2]}".encode())
                turns += 1
            elif what == "end":
                out.append(now | {"repaired_sha256": sha.hexdigest()})
            elif out:
                yield _batch(out, schema)
                out = []

    return run


def _turns(schema: pa.Schema):
    def run(batches):
        out: list[dict] = []
        for what, *rest in _streamed(batches):
            if what == "begin":
                conv, n = rest[0], 0
            elif what == "turn":
                out.append({"conv_id": conv, "place": n, "edit": rest[0], "role": rest[1], "text": rest[2]})
                n += 1
            elif what == "batch" and out:
                yield _batch(out, schema)
                out = []

    return run


def _beside(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one partition."""
    texts = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    both = audits.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return _sorted_by(both.repartition("conv_id"), "conv_id", "kind", "turn", "role", "digest").select("conv_id", *_REPORT, "audit", "role", "text", "n")


def reports(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """A row for each conversation of rows: its counts, cost, audit and the hash of what is repaired."""
    schema = "conv_id long, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string"
    return _beside(rows, audits).mapInArrow(_reports(_arrow(schema)), schema)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role and text."""
    schema = "conv_id long, place long, edit string, role string, text string"
    return _beside(rows, audits).mapInArrow(_turns(_arrow(schema)), schema)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every original conversation after damage and repair."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return reports(rows, audited(rows))


def _sql() -> str:
    """Whole audits and repaired lines for each state, turn by turn in a recursive query."""

    def way(state: int, cost: str, letters: str, *lines: str) -> str:
        return f"CASE WHEN s{state} IS NOT NULL THEN {{'c': s{state}.c + {cost}, 'a': s{state}.a || '{letters}', 'r': s{state}.r || {'[' + ', '.join(lines) + ']' if lines else '[]::VARCHAR[]'}}} END"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"

    user, assistant, stays, own = "'user:'", "'assistant:'", "cutoff", "role || ':' || text"
    keep = lambda initial, found: f"CASE WHEN initial = '{initial}' THEN {found} END"
    to_user, to_assistant = "'user:' || text", "'assistant:' || text"
    before_user = [x for p in (0, 1, 3) for x in (keep("u", way(p, stays, "K", own)), way(p, f"{stays} + 3", "R", to_user), keep("u", way(p, f"{stays} + 6", "IIK", user, assistant, own)), way(p, f"{stays} + 9", "IIR", user, assistant, to_user))]
    before_user += [keep("u", way(2, f"{stays} + 3", "IK", assistant, own)), way(2, f"{stays} + 6", "IR", assistant, to_user)]
    before_assistant = [x for p in (0, 1, 3) for x in (keep("a", way(p, f"{stays} + 3", "IK", user, own)), way(p, f"{stays} + 6", "IR", user, to_assistant))]
    before_assistant += [keep("a", way(2, stays, "K", own)), way(2, f"{stays} + 3", "R", to_assistant), keep("a", way(2, f"{stays} + 6", "IIK", assistant, user, own)), way(2, f"{stays} + 9", "IIR", assistant, user, to_assistant)]
    ends = {0: [], 1: [keep("s", way(0, stays, "K", own))], 2: before_user, 3: before_assistant}
    states = ", ".join(f"CASE WHEN gone THEN {way(n, '4', 'D')} ELSE {least(way(n, '4', 'D'), *ends[n])} END AS s{n}" for n in range(4))
    last = least(way(0, "0", ""), way(1, "6", "II", user, assistant), way(2, "3", "I", assistant), way(3, "0", ""))
    return f"""
WITH RECURSIVE polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tab),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (SELECT named.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS k FROM named, polynomial),
rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM numbered),
faults AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND time > 1 AS late, body = '' OR time > 1 AS gone, body <> '' AND time = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cutoff, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s3 FROM conversations
  UNION ALL SELECT f.conv_id, f.i, {states} FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
best AS (SELECT conv_id, {last} AS b FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (late) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(array_to_string(b.b.r, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLES = {"op11_conversation_repair": _sql()}
QUERIES = {"op11_conversation_repair": op11_conversation_repair}
