"""WARC archives: writing, reading, and deduplication by revisit records.

Pages are written as response records, one each (capture). Deduplication then reads an archive's headers alone, shuffles them
by payload digest, takes of each group of equal payloads the record of the largest page as the original, and joins the others, and
revisit records that were there before, to it. A new archive gets the originals with their payloads and the rest as revisit
records (profile identical-payload-digest), all with fresh headers: new record ids, which both sides of a reference derive
from the old ones, dates, lengths and block digests. Payloads are not shuffled while the revisits are few enough to broadcast;
beyond that the payloads' records meet the revisits' ids once, by record id, of which none is hot.

An archive is a folder of gzip text files that Spark's own writer commits, so it may lie in any store, and a lost task leaves nothing half
written. Records end in two line ends, and every record begins with the version line and the id of its archive's
warcinfo record, a random one drawn after the payloads were there. That id splits records exactly, whatever payloads hold, and
each is checked against its Content-Length.

Defined cases: a null html is an empty payload; payloads of fewer than LEAST bytes are never revisits; equal
rows are captures of their own, so of a page that is there twice one record revisits the other; a null page is smaller
than any other and reads back as null; a null url gives no target, line ends in a url are percent-encoded; a revisit record whose payload no response of
the archive has stays as it is; an empty table gives an archive of the warcinfo record alone; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.plans.lineage import remove, scratch, small

from .cluster import cut

LEAST = 1000
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ("type", "record_id", "page_id", "url", "date", "digest", "bytes", "refers_id", "refers_url", "refers_date")


def _now() -> Column:
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _opening(archive: str) -> str:
    return f"WARC/1.1{END}WARC-Warcinfo-ID: <urn:uuid:{archive}>{END}"


def _line(name: str, value: Column, before: str = "", after: str = "") -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: {before}"), value.cast("string"), F.lit(f"{after}{END}")), F.lit(""))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def capture(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A response record for every row, with its payload."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    return pages.select(
        F.lit("response").alias("type"), F.uuid().alias("record_id"), F.col(key).cast("bigint").alias("page_id"), _uri(F.col(url).cast("string")).alias("url"), _now().alias("date"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"), none.alias("refers_id"), none.alias("refers_url"), none.alias("refers_date"), payload.alias("payload"),
    )


def _text(archive: str) -> Column:
    """A record's text without the two line ends that close it."""
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(_opening(archive)), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", F.col("record_id"), "<urn:uuid:", ">"), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.col("digest"), "sha1:"), _line("WARC-Block-Digest", F.sha1(block), "sha1:"), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("WARC-Refers-To", F.col("refers_id"), "<urn:uuid:", ">"),
        _line("WARC-Refers-To-Target-URI", F.col("refers_url")), _line("WARC-Refers-To-Date", F.col("refers_date")), _line("Page-ID", F.col("page_id")), F.lit(f"Content-Type: application/http;msgtype=response{END}"),
        _line("Content-Length", F.octet_length(block)), F.lit(END), block,
    )


def write_archive(records: DataFrame, folder: str, archive: str) -> None:
    """Writes records (FIELDS and payload) and a warcinfo record."""
    about = f"software: kerbline{END}format: WARC File Format 1.1{END}"
    head = F.concat(F.lit(f"{_opening(archive)}WARC-Type: warcinfo{END}WARC-Record-ID: <urn:uuid:{archive}>{END}WARC-Date: "), _now(), F.lit(f"{END}Content-Type: application/warc-fields{END}Content-Length: {len(about)}{END}{END}{about}"))
    info = records.sparkSession.range(1, numPartitions=1).select(head.alias("value"))
    info.unionByName(records.select(_text(archive).alias("value"))).write.option("lineSep", END * 2).option("compression", "gzip").text(folder)


def read_archive(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """The response and revisit records of an archive: FIELDS and payload (null for revisits). A record that is not as long as
    its Content-Length is an error."""
    opening = _opening(archive)
    rows = spark.read.option("lineSep", END * 2 + opening).text(folder)
    rows = rows.select(F.when(F.col("value").startswith(opening), F.substring("value", len(opening) + 1, 1 << 30)).otherwise(F.col("value")).alias("value"))
    rows = rows.withColumn("head", F.substring_index("value", END * 2, 1))

    def field(name: str, before: str = "", after: str = "", head: str = "lines") -> Column:
        """What a line of a head holds, or null; a head starts and ends with a line end, and no value has one inside."""
        begin, close = f"{END}{name}: {before}", after + END
        found = F.substring_index(F.substring_index(head, begin, -1), close, 1)
        return F.when(F.contains(head, F.lit(begin)) & ~F.contains(head, F.lit(begin + close)), found)

    rows = rows.withColumn("lines", F.concat(F.lit(END), "head", F.lit(END))).withColumn("size", field("Content-Length").cast("int")).withColumn("type", field("WARC-Type"))
    past = F.octet_length("head") + 4 + F.col("size")
    left = F.octet_length("value") - past  # the last record of a file still has its two line ends
    rows = rows.withColumn("block", F.when(left.isin(0, 4), F.substr(F.col("value").cast("binary"), F.octet_length("head") + 5, F.col("size"))).otherwise(F.raise_error(F.lit("a record is not as long as its Content-Length"))))
    rows = rows.where("type IN ('response', 'revisit')").withColumn("http", F.substring_index(F.col("block").cast("string"), END * 2, 1)).withColumn("http_lines", F.concat(F.lit(END), "http", F.lit(END)))
    return rows.select(
        "type", field("WARC-Record-ID", "<urn:uuid:", ">").alias("record_id"), field("Page-ID").cast("bigint").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("date"),
        field("WARC-Payload-Digest", "sha1:").alias("digest"), field("Content-Length", head="http_lines").cast("bigint").alias("bytes"), field("WARC-Refers-To", "<urn:uuid:", ">").alias("refers_id"),
        field("WARC-Refers-To-Target-URI").alias("refers_url"), field("WARC-Refers-To-Date").alias("refers_date"),
        F.when(F.col("type") == "response", F.substr("block", F.octet_length("http") + 5, F.octet_length("block")).cast("string")).alias("payload"),
    )


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """The headers (FIELDS) that become revisits, or are and have an original here, with that original as `o`."""
    fields = F.struct("page_id", "record_id", "url", "date")
    groups = heads.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max(F.when(F.col("type") == "response", fields)).alias("o")).where("n > 1 AND o IS NOT NULL")
    met = heads.join(groups.drop("n"), ["digest", "bytes"]).select(*FIELDS, "o")
    return met.where((F.col("record_id") != F.col("o.record_id")) & ((F.col("type") == "revisit") | (F.col("bytes") >= least)))


def deduplicate(records: DataFrame, folder: str, archive: str, least: int = LEAST) -> None:
    """Writes records (as read_archive gives them) as an archive in which equal payloads are there once."""
    revisits = cut(resolve(cut(records.select(*FIELDS)), least))
    fresh = lambda c: F.regexp_replace(F.md5(F.concat(F.lit(archive), c)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    stay = records.join(small(revisits.select("record_id")), "record_id", "left_anti").withColumns({"record_id": fresh(F.col("record_id")), "date": _now()})
    turned = revisits.select(
        F.lit("revisit").alias("type"), fresh(F.col("record_id")).alias("record_id"), "page_id", "url", _now().alias("date"), "digest", "bytes",
        fresh(F.col("o.record_id")).alias("refers_id"), F.col("o.url").alias("refers_url"), F.col("o.date").alias("refers_date"), F.lit(None).cast("string").alias("payload"),
    )
    write_archive(stay.select(*FIELDS, "payload").unionByName(turned), folder, archive)


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, of the deduplicated archive as it reads back; revisits get length and digest from the response they refer to."""
    first, second = uuid.uuid4().hex, uuid.uuid4().hex
    folders = [scratch(spark, f"warc-{a}") for a in (first, second)]
    write_archive(capture(spark.read.parquet(f"{sf_dir}/pages.parquet")), folders[0], first)
    deduplicate(read_archive(spark, folders[0], first), folders[1], second)
    remove(spark, folders[0])
    back = read_archive(spark, folders[1], second)
    heads = cut(back.select("type", "record_id", "page_id", "refers_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")))
    responses = heads.where("type = 'response'")
    there = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = heads.where("type = 'revisit'").select("page_id", "refers_id").join(there, "refers_id", "left")
    out = ["page_id", "payload_bytes", "payload_digest"]
    return responses.select(*out, F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits.select(*out, F.lit("revisit").alias("record_type"), "refers_to"))


ORACLES = {
    "op12_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> last THEN last END AS refers_to FROM d
"""
}
QUERIES = {"op12_warc": op12_warc}
