"""Vector code compression: product codebooks of integers, searched by partial distances.

A component x becomes floor(SCALE * x); a vector is cut into PARTS equal parts, and each part position has a
codebook that starts as that part of the ENTRIES vectors of the smallest ids. A round gives every part its nearest entry and
replaces each entry by the floored mean of its parts. The search goes through the dimensions of a part
in descending variance of its codebook. The entry that is nearest after the first dimension is measured to its end, and from
then on a mask drops every entry whose sum so far strictly exceeds the best complete distance, so an entry as near as the best
is never dropped and ties go to the lower index.

Each round is one scan without a shuffle of vectors: a task adds up its own parts, and PARTS x ENTRIES sums a task
are added up on the way to the driver, which holds the codebooks alone (ENTRIES vectors).

Defined cases: rows whose vector is null or has a null or non-finite component are left out. A table of vectors of
several lengths is coded by its commonest length that PARTS divides (the longest of equals); other rows stay, with a null code
and error. Scaled components beyond +-LIMIT count as +-LIMIT. Null ids come after all others, equal ids are ordered by
their vectors; repeated rows are rows of their own, and take places of their own among the first entries. Fewer than ENTRIES vectors give as many entries.
Null labels are one label. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.plans.lineage import small

from .cluster import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26  # squared distances of up to 512 dimensions fit into 63 bits
ROWS = 2048  # vectors searched at once in a task


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book (entries x dims) and its squared distance, for each row of parts (rows x dims)."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    parts, book = parts[:, order], book[:, order]
    first = (parts[:, :1] - book[None, :, 0]) ** 2
    lead = first.argmin(axis=1)
    best = ((parts - book[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for dim in range(1, parts.shape[1]):
        so_far = so_far + (parts[row, dim] - book[entry, dim]) ** 2
        left = so_far <= best[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    # Every row still has an entry: the one that was measured first, or a nearer one.
    starts = np.searchsorted(row, np.arange(len(parts)))
    least = np.minimum.reduceat(so_far, starts) if len(parts) else so_far
    at = np.nonzero(so_far == least[row])[0]
    _, lowest = np.unique(row[at], return_index=True)  # entries of a row are in ascending order
    return entry[at[lowest]], least


def search(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and distances (rows x parts) of whole vectors; books is parts x entries x dims."""
    cut_up = vectors.reshape(len(vectors), len(books), -1)
    found = [nearest(cut_up[:, p], books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def kept(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a whole vector, which is `_ints` then."""
    value = F.col(vector).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(value, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("bigint"))
    return table.where(value.isNotNull() & ~bad).withColumn("_ints", scaled)


def length_of(rows: DataFrame, parts: int) -> int | None:
    """The commonest length that `parts` divides."""
    sizes = rows.groupBy(F.size("_ints").alias("n")).count().where(f"n > 0 AND n % {parts} = 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return sizes[0][0] if sizes else None


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(books: np.ndarray):
    parts, entries, dims = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * dims)
            for at in range(0, len(vectors), ROWS):
                some = vectors[at : at + ROWS]
                codes, _ = search(some, books)
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], some[:, p * dims : (p + 1) * dims])
        p, e = np.nonzero(counts)
        flat = pa.array(sums[p, e].ravel(), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * dims, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), lists], ["part", "entry", "n", "total"])

    return run


def codebooks(rows: DataFrame, dims: int, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x dims after the given number of rounds; what reaches the driver is of that size."""
    vectors = rows.where(F.size("_ints") == dims)
    seeds = vectors.orderBy(F.col(key).asc_nulls_last(), "_ints").select("_ints").limit(entries).collect()
    books = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(seeds) else 0):
        sums = vectors.select("_ints").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        whole = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at")
        whole = whole.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for part, entry, at, n, x in whole.collect():  # one row for each number in the codebooks
            books[part, entry, at] = int(x) // int(n)
    return books


def _codes(books: np.ndarray):
    dims = books.shape[0] * books.shape[2]

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("_ints").offsets.to_numpy())
            fits = np.nonzero(sizes == dims)[0]
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for at in range(0, len(fits), ROWS):
                some = fits[at : at + ROWS]
                found, far = search(_matrix(batch.column("_ints").take(pa.array(some)), dims), books)
                for i, code, error in zip(some.tolist(), found.astype(np.uint8), far.sum(axis=1).tolist()):
                    codes[i], errors[i] = code.tobytes().hex(), error
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names) if name != "_ints"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*(n for n in batch.schema.names if n != "_ints"), "code", "error"])

    return run


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ("label",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(codes, codebooks): key, the columns to carry, code and error of every row with a whole vector; the codebooks, or None without any."""
    if not 0 < entries <= 256:
        raise ValueError("a code byte tells at most 256 entries apart")
    rows = kept(table.select(key, vector, *carry), vector).select(key, *carry, "_ints")
    dims = length_of(rows, parts)
    if dims is None:
        return rows.select(key, *carry, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), None
    books = codebooks(rows, dims, key, parts, entries, rounds)
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *carry)) + ", code string, error long"
    return rows.mapInArrow(_codes(books), schema), books


def decompress(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """codes with `approximation`, the scaled integer vector that each code stands for, by lookups in the codebooks."""
    table = F.lit([int(x) for x in books.reshape(-1)])
    parts, entries, dims = books.shape

    def entry(p: Column) -> Column:
        at = F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.slice(table, (p * entries + at) * dims + 1, dims)

    return codes.withColumn("approximation", F.when(F.col(code).isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), entry))))


def fingerprint(books: np.ndarray | None) -> str:
    listed = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    return hashlib.sha256(listed.encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: every vector's code and error, the error of its label, the codebooks' hash."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = cut(coded)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(small(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {ENTRIES} + c.entry)::BIGINT AS m FROM parts p JOIN c{n} c ON c.part = p.part GROUP BY p.vec_id, p.part)"
        )
        if n < ROUNDS:
            steps.append(
                f"s{n} AS (SELECT part, entry, pos, floor_div(sum(x), count(*)) AS x FROM (SELECT p.part, a.m % {ENTRIES} AS entry, unnest(range(1, len(p.v) + 1)) AS pos, unnest(p.v) AS x FROM parts p JOIN a{n} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY ALL)"
            )
            steps.append(
                f"n{n} AS (SELECT part, entry, list(x::BIGINT ORDER BY pos) AS v FROM s{n} GROUP BY part, entry), c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{n} c LEFT JOIN n{n} n ON n.part = c.part AND n.entry = c.entry)"
            )
    return ",\n".join(steps).replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")


ORACLES = {
    "op13_vector_codes": f"""
WITH ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v FROM ok, unnest(range({PARTS})) AS r(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ok QUALIFY entry < {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN seeds USING (vec_id)),
{_rounds_sql()},
coded AS (SELECT a.vec_id, ok.label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} a JOIN ok ON ok.vec_id = a.vec_id GROUP BY a.vec_id, ok.label),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, book
"""
}
QUERIES = {"op13_vector_codes": op13_vector_codes}
