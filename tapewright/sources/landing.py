"""Files as they land: format, hash and whether their bytes are already known.

A file is read by the task that got it in pieces of fixed size, straight from its own address, and its hash grows piece by
piece: memory stays the same however large the file is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: names whose manifest entry is known to be out of date
STALE_NAMES = ["README.md", "dataset.json"]
#: Bytes read at once.
PIECE = 8 << 20
HEAD = 1 << 14
#: Tasks that share the files, each about the same number of bytes.
TASKS_PER_CORE = 4
#: Schemes that tasks can open themselves, as Arrow names them; others go through Spark's own reader, up to 2 GB a file.
OPENED = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Address, name and size of every file below ``path``; nothing of their content is read. Spark lists no empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_bytes"))


def dealt(files: DataFrame, tasks: int) -> DataFrame:
    """Files over tasks in order of size, forth and back, so that sums of bytes differ by one file at most."""
    nth = F.row_number().over(Window.orderBy(F.desc("file_bytes"), "path")) - 1
    turn, place = F.floor(nth / tasks), nth % tasks
    slot = F.when(turn % 2 == 0, place).otherwise(tasks - 1 - place)
    return files.withColumn("slot", slot.cast("int")).repartitionByRange(tasks, "slot")


def _by_address(files: DataFrame, piece: int) -> DataFrame:
    """Hash and first bytes of files that tasks open by their address."""
    schemes = dict(OPENED)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re as patterns
        from urllib.parse import quote

        from pyarrow import fs

        for frame in frames:
            hashes, magic = [], []
            for address in frame["path"]:
                scheme, rest = patterns.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", address).groups()
                scheme = schemes[(scheme or "").lower()]
                if scheme == "file":
                    store, where = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    store, where = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
                total, head = hashlib.sha256(), b""
                with store.open_input_stream(where) as stream:
                    while part := stream.read(piece):
                        head = (head + part)[:4] if len(head) < 4 else head
                        total.update(part)
                hashes.append(total.hexdigest())
                magic.append(head)
            yield frame.assign(file_hash=hashes, head=magic)[["path", "filename", "file_bytes", "file_hash", "head"]]

    return files.mapInPandas(read, "path string, filename string, file_bytes bigint, file_hash string, head binary").select(
        "path", "filename", "file_bytes", "file_hash", F.col("head").cast("string").alias("magic"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, header)``: the first line of every file below ``path``, of which a task reads no more than it needs."""
    schemes, piece = dict(OPENED), HEAD

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re as patterns
        from urllib.parse import quote

        from pyarrow import fs

        for frame in frames:
            lines = []
            for address in frame["path"]:
                scheme, rest = patterns.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", address).groups()
                scheme = schemes[(scheme or "").lower()]
                if scheme == "file":
                    store, where = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    store, where = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
                held = b""
                with store.open_input_stream(where) as stream:
                    while b"\n" not in held and (part := stream.read(piece)):
                        held += part
                lines.append(held.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace"))
            yield frame.assign(header=lines)[["path", "header"]]

    files = listed(spark, path)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    return dealt(files, tasks).select("path").mapInPandas(read, "path string, header string")


def hashed(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """``(path, filename, file_bytes, file_hash, magic)`` of every file below ``path``."""
    files = listed(spark, path)
    scheme = F.lower(F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    open_here = scheme.isin(*OPENED)
    tasks = max(1, spark.sparkContext.defaultParallelism * TASKS_PER_CORE)
    own = _by_address(dealt(files.filter(open_here).select("path", "filename", "file_bytes"), tasks), piece)
    if files.filter(~open_here).isEmpty():
        return own
    rest = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(~open_here)
    return own.unionByName(rest.select(
        F.col("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_bytes"),
        F.sha2("content", 256).alias("file_hash"), F.substring("content", 1, 4).cast("string").alias("magic")))


def file_format(magic: Column, filename: Column) -> Column:
    """PAR1 magic first, suffix second; a .parquet name without the magic is refused."""
    return F.when(magic == "PAR1", "parquet").when(F.lower(filename).rlike(r"\.(csv|txt)$"), "csv").otherwise("refused")


def landing_check(spark: SparkSession, path: str, batches: DataFrame) -> DataFrame:
    """Per file: format, size, hash, and the duplicate verdict.

    Bytes already loaded, or repeated under a later path of the same drop, are duplicates.
    """
    files = hashed(spark, path)
    first = files.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    held = batches.filter("file_hash is not null").select("file_hash", F.lit(True).alias("held")).distinct()
    return files.join(first, "file_hash").join(held, "file_hash", "left").select(
        "filename", "file_bytes", "file_hash", file_format(F.col("magic"), F.col("filename")).alias("file_format"),
        F.col("held").isNotNull().alias("already_ingested"),
        (F.col("path") != F.col("first_path")).alias("repeated_in_drop"),
    ).withColumn("duplicate", F.col("already_ingested") | F.col("repeated_in_drop"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Hash of every file below ``path`` under its name relative to it."""
    below = rf"{re.escape(path.rstrip('/'))}/(.*)$"
    return hashed(spark, path).select(F.regexp_extract("path", below, 1).alias("name"), "file_hash")


def verify_checksums(spark: SparkSession, path: str, manifest: DataFrame, stale: list[str] | None = None) -> DataFrame:
    """Files whose hash differs from the manifest's; ``manifest``: relative name, sha256."""
    skip = STALE_NAMES if stale is None else stale
    return file_hashes(spark, path).join(manifest, "name").filter(
        (F.col("file_hash") != F.col("sha256")) & ~F.col("name").isin(skip)).select("name", "file_hash", "sha256")
