"""Small tables with every awkward case, and plain versions of the operators to hold them against."""

from __future__ import annotations

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, spans string, `_row` string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 40)) for _ in range(n))


def documents(spark, texts: list[str | None], ids: list[int | None] | None = None, langs: list[str | None] | None = None):
    """A documents table with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "s", None if t is None else len(t), "x", 7, "y", "z") for i, t, lang in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " ", "\n\n", "word", "one two three", "é " * 9, "\x00\x01", "a b　c", "𝒳 日本語 text", "x" * 5000]


def write(spark, folder, **tables) -> str:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
