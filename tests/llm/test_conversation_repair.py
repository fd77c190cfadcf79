import hashlib
import itertools
import random
import re
import zlib

import pytest

from kerbline.llm import conversation_repair as cr

from .helpers import write

SCHEMA = "conv_id long, turn long, role string, text string, n long, digest string, audit string, block int"
WORDS = r"[^\x20\x09-\x0D]"


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 9, "d", "a", 1) for c, t, r, x in rows], SCHEMA)


def hurt(rows):
    """Damage as the contract words it; rows of one conversation in order."""
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    out, seen = [], set()
    for _, _, r, x in rows:
        said = re.findall(WORDS, x)
        out.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, found):
    """Every sequence of edits, with up to two inserts in a place, of which the result has the right form."""
    best = None
    inserts = [seq for n in range(3) for seq in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, lines):
        nonlocal best
        shape = "".join(line[0][:1] or " " for line in lines)
        if not re.fullmatch("s?(ua)*u?", shape) or best and cost > best[0]:
            return
        for seq in inserts:
            c, a, out = cost + 3 * len(seq), audit + "I" * len(seq), [*lines, *((r, "") for r in seq)]
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in out)):
                    best = min(best or (c, a, out), (c, a, out))
                continue
            _, _, r, x = rows[i]
            go(i + 1, c + 4, a + "D", out)
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                if r[:1] in ("s", "u", "a"):
                    go(i + 1, c + extra, a + "K", [*out, (r, x)])
                for other in ("user", "assistant"):
                    go(i + 1, c + extra + 3, a + "R", [*out, (other, x)])

    go(0, 0, "", [])
    return best


def by_strings(rows, found):
    """The same by whole audits and lines for each state, turn by turn, for longer conversations."""
    after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    now = {0: (0, "", ())}

    def grown(states):
        for _ in range(2):
            for s, (c, a, out) in list(states.items()):
                role, t = after[s]
                way = (c + 3, a + "I", (*out, (role, "")))
                states[t] = min(states.get(t, way), way)
        return states

    for (_, _, r, x), fault in zip(rows, found):
        ways = {s: (c + 4, a + "D", out) for s, (c, a, out) in now.items()}
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            for s, (c, a, out) in grown(dict(now)).items():
                role, t = after[s]
                new = [(t, (c + extra + 3, a + "R", (*out, (role, x))))]
                if r[:1] == role[0]:
                    new.append((t, (c + extra, a + "K", (*out, (r, x)))))
                if s == 0 and r[:1] == "s":
                    new.append((1, (c + extra, a + "K", (*out, (r, x)))))
                for t, way in new:
                    ways[t] = min(ways.get(t, way), way)
        now = ways
    return min(way for s, way in grown(now).items() if s in (0, 3))


def plain(rows, solver=by_strings):
    out = []
    for conv in {r[0] for r in rows}:
        mine = hurt([r for r in rows if r[0] == conv])
        found = faults(mine)
        told = [t for _, t, _, _ in mine if t is not None]
        shape = [r[:1] for _, _, r, _ in mine]
        cost, audit, lines = solver(mine, found) if mine else (0, "", [])
        out.append((conv, max(told) - min(told) + 1 - len(set(told)) if told else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(shape, shape[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, conversations, longest, roles=("user", "assistant", "system", "tool", "", None)):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ends. \r\n", "é日.", "dots...", "."]
    return [(c if c else None, draw.choice([t, t, t, None]) if t else None, draw.choice(roles), draw.choice(texts)) for c in range(conversations) for t in range(draw.randint(1, longest))]


def test_short_conversations_against_every_sequence_of_edits(spark, tmp_path):
    rows = drawn(1, 60, 3) + drawn(2, 60, 4, ("user", "assistant", "system"))
    rows = [(None if c is None else c + (100 if i > len(rows) // 2 else 0), *rest) for i, (c, *rest) in enumerate(rows)]
    few = [r for r in rows if r[0] is not None and len(hurt([x for x in rows if x[0] == r[0]])) <= 4]
    got = cr.op11_conversation_repair(spark, write(spark, tmp_path, conversations=table(spark, few)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(few, cheapest)


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_blocks_of_any_size_give_the_same_audits(spark, block):
    rows = drawn(3, 12, 9) + drawn(4, 3, 150, ("user", "assistant")) + [(77, 1, "user", "Same.")] * 9 + [(78, t, "user", "Go on.") for t in range(40)]
    hot = cr.damaged(table(spark, rows))
    got = cr.reports(hot, cr.audited(hot, block))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_repaired_turns_hash_to_the_report(spark):
    rows = cr.damaged(table(spark, drawn(5, 30, 8)))
    audits = cr.audited(rows)
    turns: dict = {}
    for r in cr.repaired(rows, audits).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for r in cr.reports(rows, audits).collect():
        mine = turns.get(r["conv_id"], [])
        assert [t["place"] for t in mine] == list(range(len(mine))) and "".join(t["edit"] for t in mine) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in mine).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in mine))


def test_empty_table_and_a_conversation_that_loses_all(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    for n, rows in enumerate(([], [(lost, 0, "user", "Gone.")])):
        got = cr.op11_conversation_repair(spark, write(spark, tmp_path / str(n), conversations=table(spark, rows))).collect()
        assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * len(rows)


def test_a_very_long_turn_and_long_white_space(spark, tmp_path):
    rows = [(1, 5, "user", "word " * 200_000 + "."), (1, 6, "assistant", " " * 500_000), (1, 7, "assistant", "x" + "\n" * 300_000)]
    got = cr.op11_conversation_repair(spark, write(spark, tmp_path, conversations=table(spark, rows)))
    assert [tuple(r) for r in got.collect()] == plain(rows)
