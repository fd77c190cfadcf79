import gzip
import hashlib
from pathlib import Path

import pytest

from kerbline.llm import warc

from .helpers import write

SCHEMA = "page_id long, url string, html string, type string, record_id string, bytes long, value string"
LONG = "<p>" + "ä long page " * 120 + "</p>"
HOSTILE = [f"{LONG}\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", f"WARC/1.1\r\n{LONG}\r\n\r\n", f"{LONG}\r\n\r\nWARC/1.1", "\r\n\r\n", "\r\n", f"\n{LONG}\r", f"﻿{LONG}\x00\x85"]


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 3, "z") for i, u, h in rows], SCHEMA)


def plain(rows):
    rows = [(i, (h or "").encode()) for i, _, h in rows]
    out, used = [], set()
    for i, h in rows:
        same = [j for j, other in rows if other == h]
        top = max(same, key=lambda j: (j is not None, j or 0))
        first = len(h) < 1000 or (i == top and h not in used)
        if i == top and len(h) >= 1000:
            used.add(h)
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def by_hand(folder):
    """Records as Content-Length alone delimits them: (fields, block)."""
    out = []
    for file in sorted(Path(folder).glob("part-*")):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            lines = data[at:stop].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = data[stop + 4 : stop + 4 + int(fields["Content-Length"])]
            at = stop + 4 + len(block)
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            out.append((fields, block))
    return out


def test_query_matches_a_plain_version(spark, tmp_path):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "u", "short"), (7, "u", "short"), (8, "a\r\nb", "x" * 1000), (9, "u", "x" * 1000), (10, "u", "x" * 999), (11, "u", "x" * 999)]
    rows += [(3, None, LONG), (None, "n", LONG), (None, "n", "y" * 2000), (None, "n", "y" * 2000), (12, "u", "é" * 500), (13, "v", "é" * 500)]
    rows += [(20 + i, "h", h) for i, h in enumerate(HOSTILE)] + [(40 + i, "h", h) for i, h in enumerate(HOSTILE)]
    folder = write(spark, tmp_path, pages=table(spark, rows))
    got = warc.op12_warc(spark, folder)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_lines_that_a_url_seems_to_hold_are_no_fields(spark, tmp_path):
    rows = [(i, f"http://a/{i}{end}Page-ID: 99{end}WARC-Payload-Digest: sha1:{'0' * 40}", LONG if i < 3 else f"page {i}") for i, end in enumerate("\u2028\u2029\x85\u2028\x85")]
    assert sorted((tuple(r) for r in warc.op12_warc(spark, write(spark, tmp_path, pages=table(spark, rows))).collect()), key=str) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert warc.op12_warc(spark, write(spark, tmp_path, pages=table(spark, []))).collect() == []


def test_archives_hold_what_the_format_asks_for(spark, tmp_path):
    rows = [(i, f"http://h/{i}", LONG if i % 3 else f"{LONG}{i}") for i in range(12)] + [(30 + i, "http://x", h) for i, h in enumerate(HOSTILE)]
    warc.write_archive(warc.capture(table(spark, rows)), f"{tmp_path}/a", "a" * 32)
    warc.deduplicate(warc.read_archive(spark, f"{tmp_path}/a", "a" * 32), f"{tmp_path}/b", "b" * 32)
    first, second = by_hand(f"{tmp_path}/a"), by_hand(f"{tmp_path}/b")
    assert len(first) == len(second) == len(rows) + 1
    assert [f["WARC-Type"] for f, _ in first].count("response") == len(rows)
    pages = {int(f["Page-ID"]): (f, b) for f, b in second if f["WARC-Type"] != "warcinfo"}
    ids = {f["WARC-Record-ID"]: f for f, _ in second}
    assert len(ids) == len(second) and not set(ids) & {f["WARC-Record-ID"] for f, _ in first}
    for i, url, html in rows:
        fields, block = pages[i]
        assert fields["WARC-Target-URI"] == url and fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(html.encode()).hexdigest()
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response":
            assert payload == html.encode()
        else:
            assert payload == b"" and fields["WARC-Profile"] == warc.PROFILE
            there = ids[fields["WARC-Refers-To"]]
            assert there["WARC-Type"] == "response" and there["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] and there["Page-ID"] == "11"
            assert fields["WARC-Refers-To-Target-URI"] == there["WARC-Target-URI"]
    assert sum(f["WARC-Type"] == "revisit" for f, _ in second) == 7


def test_revisits_of_earlier_archives_join_their_originals_or_stay(spark, tmp_path):
    """An archive deduplicated once more: nothing is left to do, but references follow the fresh ids."""
    rows = [(i, "u", LONG) for i in range(4)]
    warc.write_archive(warc.capture(table(spark, rows)), f"{tmp_path}/a", "a" * 32)
    warc.deduplicate(warc.read_archive(spark, f"{tmp_path}/a", "a" * 32), f"{tmp_path}/b", "b" * 32)
    records = warc.read_archive(spark, f"{tmp_path}/b", "b" * 32)
    warc.deduplicate(records, f"{tmp_path}/c", "c" * 32)
    again = {r["record_id"]: r for r in warc.read_archive(spark, f"{tmp_path}/c", "c" * 32).collect()}
    assert sorted(r["type"] for r in again.values()) == ["response"] + ["revisit"] * 3
    assert all(again[r["refers_id"]]["page_id"] == 3 for r in again.values() if r["type"] == "revisit")
    warc.deduplicate(records.where("type = 'revisit'"), f"{tmp_path}/d", "d" * 32)
    lone = warc.read_archive(spark, f"{tmp_path}/d", "d" * 32).collect()
    assert {r["refers_id"] for r in lone} == {r["refers_id"] for r in records.where("type = 'revisit'").collect()} and len(lone) == 3


def test_a_cut_record_is_an_error(spark, tmp_path):
    warc.write_archive(warc.capture(table(spark, [(1, "u", LONG), (2, "u", LONG)])), f"{tmp_path}/a", "a" * 32)
    file = max(Path(f"{tmp_path}/a").glob("part-*"), key=lambda p: p.stat().st_size)
    data = gzip.decompress(file.read_bytes())
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part-0.gz").write_bytes(gzip.compress(data[:-100]))
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_archive(spark, f"{tmp_path}/cut", "a" * 32).collect()
