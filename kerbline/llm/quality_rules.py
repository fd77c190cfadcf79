"""Quality rules as a ledger: each rule is evaluated once, its failure kept as one bit of a mask.

The ledger holds the measurements and the mask of every document. A policy is a named, versioned set
of rules; applying one is a bitwise AND, so any number of policies, and the ablation of each rule
from each policy, are read off the same ledger by bitwise aggregation without touching a text again.
Only DataFrame functions are used: everything is measured inside the row, nothing is shuffled.

Words are runs of anything but white space (0x20, 0x09-0x0D). n_repeat_words counts the words that lie in
a 3-word window found at least twice in the text.

Defined cases: a null text has no words, all measures 0, and fails the base rules; an empty text
likewise; a repeated row gets the same answer twice; other columns are ignored by the ledger and
kept by the stage; null ids stay null. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: (bit, name, failure as SQL over the measurements). Bits are never given to another rule again.
RULES = (
    (0, "too_few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols_per_word", "10 * n_symbols > 3 * n_words"),
    (3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    (4, "mean_word_length", "word_chars < 2 * n_words or word_chars > 40 * n_words"),
    (5, "mostly_without_letters", "100 * n_letters < 50 * word_chars"),
    (6, "longest_word", "longest_word > 1000"),
    (7, "too_many_words", "n_words > 1000000"),
)

#: Versioned policies: the rules each one applies. The base policy is the contract's base_failed.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "mean_word_length", "mostly_without_letters"),
    "v2": ("too_few_words", "repeated_windows", "symbols_per_word", "repeated_lines", "mean_word_length", "mostly_without_letters", "longest_word"),
}
CURRENT = "v2"


def policy_mask(policy: str) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _java_class(chars: str) -> str:
    return "[" + "".join(f"\\x{ord(c):02X}" for c in chars) + "]"


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the array holds at least twice.

    A text whose windows all have hashes of their own has none, which most texts show at once. In the others windows are
    sorted by hash and then by their words, so equal ones are neighbours: n log n in the length of the text, and exact.
    """

    def window(w: Column, h: Column, i: Column) -> Column:
        return F.struct(F.get(h, i).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def marked(s: Column) -> Column:
        twin = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        spread = lambda h: F.sort_array(F.transform(places, lambda i: window(w, h, i)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(spread(h), marked)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, counted)).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measurements that the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    filled = F.filter(lines, lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    out = docs.withColumn("_words", F.array_remove(F.split(text, f"{_java_class(SPACES)}+", -1), ""))
    solid = F.translate(text, SPACES, "")
    return out.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(filled).cast("bigint").alias("n_lines"),
        F.length(F.translate(solid, "0123456789.,;:!?()[]{}\"'`-_/\\=+~^@" + SYMBOLS, "")).cast("bigint").alias("n_letters"),
        F.coalesce(F.aggregate("_words", F.lit(0), lambda m, w: F.greatest(m, F.length(w))), F.lit(0)).cast("bigint").alias("longest_word"),
    )


def marked(docs: DataFrame) -> DataFrame:
    """docs with the measurements and fail_mask."""
    mask = None
    for bit, _, failure in RULES:
        one = F.when(F.expr(failure), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        mask = one if mask is None else mask.bitwiseOR(one)
    return measured(docs).withColumn("fail_mask", mask)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_mask: one row for each row of docs."""
    return marked(docs.select("doc_id", "text")).drop("text")


def passes(policy: str) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """policy, rule, rejected (by the policy), rejected_without (the rule), only_by (it alone): counts over a ledger."""
    wanted = [(policy, name, policy_mask(policy), 1 << bit) for policy in POLICIES for bit, name, _ in RULES if name in POLICIES[policy]]
    by_mask = entries.groupBy("fail_mask").agg(F.count("*").alias("n"))  # at most 2 ** rules rows from here on
    spark = entries.sparkSession
    rules = spark.createDataFrame(wanted, "policy string, rule string, policy_mask long, rule_bit long")
    hit = F.col("fail_mask").bitwiseAND(F.col("policy_mask"))
    rest = hit.bitwiseAND(F.bitwise_not(F.col("rule_bit")))
    crossed = by_mask.select("n", "fail_mask").withColumn("_one", F.lit(1)).join(F.broadcast(rules.withColumn("_one", F.lit(1))), "_one")
    return crossed.groupBy("policy", "rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(rest != 0, F.col("n")).otherwise(0)).alias("rejected_without"),
        F.sum(F.when((hit != 0) & (rest == 0), F.col("n")).otherwise(0)).alias("only_by"),
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of the whole documents table with the base verdict and that of the current policy."""
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(CURRENT)).alias("kept"), "n_lines", "n_letters", "longest_word", "fail_mask",
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the current policy keeps, with the columns of docs."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    return marked(rows).where(passes(CURRENT)).select("_row.*")


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """How many documents of the whole table each policy rejects, would reject without one of its rules, and rejects by that rule alone."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLES = {
    "op3_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM base, unnest(range(1, len(w) - 1)) AS r(i)
), twins AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twins, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(translate(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'), '0123456789.,;:!?()[]{}"''`-_/\=+~^@#*$%&|<>', ''))::BIGINT AS n_letters,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word
  FROM base b LEFT JOIN repeats r ON r.doc_id = b.doc_id
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_letters < 50 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN longest_word > 1000 THEN 64 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 128 ELSE 0 END)::BIGINT AS fail_mask FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & 3 <> 0 AS base_failed, fail_mask & 127 = 0 AS kept,
  n_lines, n_letters, longest_word, fail_mask FROM f
"""
}


def _ablation_oracle() -> str:
    listed = ", ".join(f"('{policy}', '{name}', {policy_mask(policy)}, {1 << bit})" for policy in POLICIES for bit, name, _ in RULES if name in POLICIES[policy])
    return f"""
WITH ledger AS ({ORACLES["op3_quality_rules"]}), rules(policy, rule, policy_mask, rule_bit) AS (VALUES {listed})
SELECT policy, rule, count(*) FILTER (fail_mask & policy_mask <> 0)::BIGINT AS rejected,
  count(*) FILTER (fail_mask & policy_mask & ~rule_bit <> 0)::BIGINT AS rejected_without,
  count(*) FILTER (fail_mask & policy_mask <> 0 AND fail_mask & policy_mask & ~rule_bit = 0)::BIGINT AS only_by
FROM ledger, rules GROUP BY policy, rule
"""


ORACLES["quality_ablations"] = _ablation_oracle()
QUERIES = {"op3_quality_rules": op3_quality_rules, "quality_ablations": quality_ablations}
