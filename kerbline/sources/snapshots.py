"""Folders that change in one step: every version is written beside the others, and a pointer names the one that counts.

A version is whole before the pointer moves to it, so whoever reads meanwhile, or after a failed write, has the old one. Two
kinds of versions share the layout, for one writer of a folder at a time (what a failed write leaves behind goes at the next one's end): tables that Spark writes, and sets of files, one for each row, that the data source
`file_snapshot` writes in its tasks with an index at commit.

    <folder>/CURRENT            the name of the version that counts
    <folder>/v-<id>/...         its Parquet files, or its files and index.json
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

POINTER, INDEX = "CURRENT", "index.json"
KEPT = 2  # versions: the one that counts and the one before, which someone may still read


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that counts, None without any."""
    try:
        named = spark.read.text(f"{folder.rstrip('/')}/{POINTER}").first()
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if named is None else f"{folder.rstrip('/')}/{named[0].strip()}"


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    at = current(spark, folder)
    if at is None:
        raise FileNotFoundError(f"nothing was published in {folder}")
    return spark.read.parquet(at)


def write_table(rows: DataFrame, folder: str) -> int:
    """Publishes rows as the version that counts and returns their number; if writing fails the old version stays."""
    spark, folder = rows.sparkSession, folder.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{folder}/{version}")
        n = spark.read.parquet(f"{folder}/{version}").count()
        _point(spark, folder, version)
    except BaseException:
        _hadoop(spark, folder)[0].delete(_path(spark, f"{folder}/{version}"), True)
        raise
    return n


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _hadoop(spark: SparkSession, folder: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return _path(spark, folder).getFileSystem(conf), conf


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Moves the pointer in one rename, then drops versions that nobody can have begun to read since the last move."""
    jvm = spark.sparkContext._jvm
    fs, conf = _hadoop(spark, folder)
    before = current(spark, folder)
    fresh = _path(spark, f"{folder}/{POINTER}.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(_path(spark, f"{folder}/{POINTER}")), overwrite)
    keep = {version, posixpath.basename(before or "")}
    for status in fs.listStatus(_path(spark, folder)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in keep:
            fs.delete(status.getPath(), True)


# sets of files


def check_name(name: str | None) -> str:
    """A relative path of letters, digits and ._- only, none of its parts empty or of dots; anything else would write elsewhere."""
    parts = (name or "").split("/")
    if not all(p.strip(".") and all(c.isascii() and (c.isalnum() or c in "._-") for c in p) for p in parts):
        raise ValueError(f"refusing to write a file named {name!r}")
    if name == INDEX:
        raise ValueError(f"{INDEX} is written at commit")
    return name


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int, str | None]]  # name, bytes, CRC-32, entry


class SnapshotWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.version = folder.rstrip("/"), f"v-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, at = _store(self.folder)
        files = []
        for row in rows:
            name, content = check_name(row["name"]), row["content"]
            content = b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)
            target = f"{at}/{self.version}/{name}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target) as out:
                out.write(content)
            files.append((name, len(content), zlib.crc32(content), row["entry"] if "entry" in row else None))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Only names, sizes and index entries come here, not the files."""
        from pyarrow import fs

        files = sorted(f for m in messages if m is not None for f in m.files)
        twice = {a[0] for a, b in zip(files, files[1:]) if a[0] == b[0]}
        if twice:
            raise ValueError(f"two rows are named {sorted(twice)[0]!r}")
        store, at = _store(self.folder)
        store.create_dir(f"{at}/{self.version}", recursive=True)
        entries = [{"file": n, "bytes": size, "crc": crc, **(json.loads(entry) if entry else {})} for n, size, crc, entry in files]
        with store.open_output_stream(f"{at}/{self.version}/{INDEX}") as out:
            out.write(json.dumps(entries, indent=1).encode())
        before = ""
        if store.get_file_info(f"{at}/{POINTER}").type == fs.FileType.File:
            with store.open_input_stream(f"{at}/{POINTER}") as held:
                before = held.read().decode().strip()
        with store.open_output_stream(f"{at}/{POINTER}.{self.version}") as out:
            out.write(self.version.encode())
        store.move(f"{at}/{POINTER}.{self.version}", f"{at}/{POINTER}")
        for info in store.get_file_info(fs.FileSelector(at)):
            if info.base_name.startswith("v-") and info.base_name not in (self.version, before):
                store.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.folder)
        if store.get_file_info(f"{at}/{self.version}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.version}")


class FileSnapshot(DataSource):
    """Rows (name, content, and if there is one an index entry as JSON text) become the files of a new version of a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_snapshot"

    def schema(self) -> str:
        return "name string, content binary, entry string"

    def writer(self, schema, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Publishes rows (name, content as text or bytes, optionally entry) as the files of the version that counts."""
    rows.sparkSession.dataSource.register(FileSnapshot)
    entry = F.col("entry").cast("string") if "entry" in rows.columns else F.lit(None).cast("string")
    held = rows.select("name", F.col("content").cast("binary").alias("content"), entry.alias("entry"))
    held.write.format("file_snapshot").mode("append").save(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of every file of the version that counts, without its index."""
    at = current(spark, folder)
    if at is None:
        raise FileNotFoundError(f"nothing was published in {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    version = posixpath.basename(at)
    return files.select(F.element_at(F.split("path", f"/{version}/"), -1).alias("name"), "content").where(F.col("name") != INDEX)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(f"{current(spark, folder)}/{INDEX}")


def escaped(text: Column) -> Column:
    """Text that is safe inside HTML and in its attributes."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def city_files(cities: DataFrame, figures: list[str]) -> DataFrame:
    """Rows for write_files: <slug>.json and <slug>/index.html of every city (slug, name and the figures), and an index entry with the figures."""
    held = F.to_json(F.struct("slug", "name", *figures), {"ignoreNullFields": "false"})
    safe = escaped(F.col("name"))
    lines = [F.concat(F.lit(f"<li>{f.replace('_', ' ')}: "), F.coalesce(escaped(F.col(f).cast("string")), F.lit("not measured")), F.lit("</li>")) for f in figures]
    page = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), safe, F.lit("</title></head><body><h1>"), safe, F.lit("</h1><ul>"), *lines, F.lit("</ul></body></html>"))
    data = cities.select(F.concat("slug", F.lit(".json")).alias("name"), held.alias("content"), held.alias("entry"), F.col("slug").alias("slug"))
    pages = cities.select(F.concat("slug", F.lit("/index.html")).alias("name"), page.alias("content"), F.lit(None).cast("string").alias("entry"), F.col("slug").alias("slug"))
    named = F.when(F.coalesce(F.col("slug"), F.lit("")) == "", F.raise_error(F.lit("a city has no usable slug: refusing to write its page"))).otherwise(F.col("name"))
    return data.unionByName(pages).select(named.alias("name"), "content", "entry")


def crop_files(crops: DataFrame) -> DataFrame:
    """Rows for write_files: <place>_<vintage>.png of every crop (place, vintage, image) that has an image."""
    name = F.concat_ws("_", F.col("place").cast("string"), F.col("vintage").cast("string"))
    return crops.where("image IS NOT NULL").select(F.concat(name, F.lit(".png")).alias("name"), F.col("image").alias("content"), F.to_json(F.struct("place", "vintage")).alias("entry"))
