"""Secret scans over an incremental ledger of blobs.

Every version of a text is content-addressed by its SHA-256. The ledger has rows (blob, scanned, spans): the
rule versions ("name:version") that a run applied to a blob, and what they found. Only pairs of a blob and a
rule version that no row holds are scanned, one text standing for all rows with that content; the findings are
joined back to every path. Only DataFrame functions are used.

Java's regular expressions give no positions, so a rule splits the text by its own pattern: the
pieces between matches and the matches, taken in turn, add up to the positions. Positions are code
points, ends exclusive. A text is first tested for the rule's necessary substring or run, so most
texts are never split. Patterns repeat single characters only, never groups, and none starts anew within a run
that it has read before, so time is linear in the text and the stack is never deep.

Defined cases: a null text is scanned as an empty one and has no spans; repeated rows and copies
share one scan and get the same findings; an empty table gives an empty table; other columns are kept by
the stage and ignored by the query; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
_LEAD = _NAMES + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"

#: kind, version, place among equal starts, pattern, a literal and a pattern that any text with a match
#: has (each None if there is none better), least characters, and what they count: the match, its value after the
#: assignment, or the match if it has the form given.
BASE_RULES = (
    ("assign", 1, 0, f"{_LEAD}{_VALUE}", None, f"{_NAMES}[\"']?\\x20*[:=]", 12, "value"),
    ("access", 1, 1, "AKIA[A-Z0-9]+", "AKIA", None, 18, "match"),
    ("hex", 1, 2, "[0-9a-f]+", None, "[0-9a-f]{16}", 16, "match"),
)
_KEY = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM = "(?:\\r?\\nProc-Type: [^\\r\\n-]*\\r?\\nDEK-Info: [A-Za-z0-9,-]*\\r?\\n)?(?:\\r?\\n(?:Version|Comment): [^\\r\\n-]*\\r?\\n)?"
_PART = "[A-Za-z0-9_-]"
ADDED_RULES = (
    ("private_key", 2, 3, f"-----BEGIN {_KEY}{_PEM}[A-Za-z0-9+/=\\s]+-----END {_KEY}", "PRIVATE KEY", None, 60, "match"),
    ("bearer", 1, 4, "[Bb]earer\\x20+[A-Za-z0-9._~+/-]{20,}=*", "earer ", None, 27, "match"),
    ("json_web_token", 2, 5, "[A-Za-z0-9_.-]+", "eyJ", None, 24, f"^eyJ{_PART}{{8,}}\\.{_PART}{{8,}}\\.{_PART}"),
    ("url_password", 2, 6, "[a-z][a-z0-9+.-]{1,20}://[^\\s/:@]+:[^\\s/:@]{4,}@", "://", None, 12, "match"),
)
RULES = BASE_RULES + ADDED_RULES
FINDING = "array<struct<start:int,place:int,kind:string,stop:int>>"
MASK, BLOCK = "[secret]", 128


def _may_match(text: Column, rule: tuple) -> Column:
    literal, test = rule[4], rule[5]
    return text.contains(literal) if test is None else text.rlike(test)


def may_hold_secrets(text: Column, rules: tuple = RULES) -> Column:
    out = None
    for rule in rules:
        out = _may_match(text, rule) if out is None else out | _may_match(text, rule)
    return out


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _good(found: Column, rule: tuple) -> Column:
    """Whether a match is a finding."""
    least, of = rule[6:]
    size = F.length(F.regexp_replace(found, f"^{_LEAD}", "") if of == "value" else found) >= least
    return size if of in ("match", "value") else size & found.rlike(of)


def spans_of(text: Column, rule: tuple) -> Column:
    """The rule's findings in a text, by start.

    Positions are running sums, taken block by block of BLOCK matches, so a text with very many matches is not
    copied for each."""
    kind, _, place, pattern = rule[:4]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.filter(F.arrays_zip(matches.alias("found"), gaps.alias("gap")), lambda x: x["found"].isNotNull())
    steps = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), F.length(p["found"]).alias("size"), _good(p["found"], rule).alias("good")))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), (start + s["size"]).alias("stop")))
        return F.struct((start + s["size"]).alias("at"), F.when(s["good"], F.concat(state["spans"], one)).otherwise(state["spans"]).cast(FINDING).alias("spans"))

    def placed(block: Column, before: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), F.array().cast(FINDING).alias("spans")), step, lambda s: s["spans"])

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(all_, at + 1, BLOCK))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda block: total(F.transform(block, lambda s: s["gap"] + s["size"])))
        return _let(sums, lambda n: F.flatten(F.transform(parts, lambda block, i: placed(block, total(F.slice(n, 1, i))))))

    return F.when(_may_match(text, rule), _let(_let(steps, blocks), joined)).otherwise(F.array().cast(FINDING))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def version_of(rule: tuple) -> str:
    return f"{rule[0]}:{rule[1]}"


def new_entries(versions: DataFrame, known: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """Ledger rows (blob, scanned, spans) of every blob with a rule version that the ledger `known` doesn't have for it.

    Texts that cannot match any rule travel as their hash alone; of the others, one for each blob.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = versions.select(blob_of(F.col("text")).alias("blob"), F.when(may_hold_secrets(text, rules), text).alias("text"))
    blobs = held.groupBy("blob").agg(F.max("text").alias("text"))
    todo = F.array(*(F.lit(version_of(r)) for r in rules))
    if known is None:
        blobs = blobs.withColumn("scanned", todo)
    else:
        seen = known.select("blob", F.explode("scanned").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("scanned", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>"))))
    spans = F.flatten(F.array(*(F.when(F.array_contains("scanned", version_of(r)), spans_of(F.col("text"), r)).otherwise(F.array().cast(FINDING)) for r in rules)))
    return blobs.where(F.size("scanned") > 0).select("blob", "scanned", F.when(F.col("text").isNull(), F.array().cast(FINDING)).otherwise(F.sort_array(spans)).alias("spans"))


def ledger(docs: DataFrame, known: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """The ledger brought up to date with the blobs of docs: known rows and new ones, written to the shared
    checkpoint folder. Append the rows that `known` lacks to your table to scan only what is unseen the next time."""
    fresh = cut(new_entries(docs, known, rules))
    return fresh if known is None else known.select("blob", "scanned", "spans").union(fresh)


def findings(entries: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(blob, spans) of every blob with a finding of these rules, those of all runs together and in order.

    A finding counts under the newest version of its rule alone, which is the one in `rules`."""
    current = F.array(*(F.lit(version_of(r)) for r in rules))
    of = F.create_map(*(F.lit(x) for r in rules for x in (r[0], version_of(r))))
    valid = F.filter("spans", lambda s: F.array_contains(F.array_intersect("scanned", current), of[s["kind"]]))
    held = entries.select("blob", valid.alias("spans")).where(F.size("spans") > 0)
    return held.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan(docs: DataFrame, known: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """Every row's doc_id and blob with the spans of its content, or null if there are none."""
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(cut(findings(ledger(docs, known, rules), rules)), "blob", "left")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of scan over the whole documents table."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.coalesce("spans", F.array().cast(FINDING))
    base = F.filter(spans, lambda s: s["place"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by MASK."""

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(apart, F.concat(state["out"], between, F.lit(MASK))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays; secrets in its text are masked and n_chars follows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns, suspect = docs.columns, may_hold_secrets(text)
    held = docs.where(suspect).select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), "text", blob_of(F.col("text")).alias("blob"))
    held = held.join(cut(findings(ledger(docs.where(suspect)))), "blob", "left")
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    row = {c: F.col(f"_row.`{c}`") for c in columns} | {"text": F.col("_masked")}
    if "n_chars" in columns:
        row["n_chars"] = F.when(F.col("spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_masked").cast(docs.schema["n_chars"].dataType))
    return docs.where(~suspect).union(held.withColumn("_masked", masked).select(*(v.alias(c) for c, v in row.items())))


def _oracle_spans(kind: str, place: int, pattern: str, keep: str) -> str:
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, k, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(string_split_regex(t, '{pattern}')[:-2]) AS g,
      unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS k FROM texts WHERE regexp_matches(t, '{pattern}'))
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE {keep}"""


def _oracle() -> str:
    sql = lambda p: p.replace("'", "''")
    parts = []
    for kind, _, place, pattern, _, _, least, of in RULES:
        keep = f"length(regexp_replace(m, '^{sql(_LEAD)}', '')) >= {least}" if of == "value" else f"length(m) >= {least}"
        keep += "" if of in ("match", "value") else f" AND regexp_matches(m, '{of}')"
        parts.append(_oracle_spans(kind, place, sql(pattern), keep))
    listed = lambda w: f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){w}"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}), named AS (
  SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop, kind, place FROM found), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {listed(' FILTER (place < 3)')} AS base, {listed('')} AS spans FROM named GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN per p ON p.doc_id = t.doc_id"""


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES = {"op10_secret_scan": _oracle()}
