"""Writes: tapes as CSV, replaceable results, append-only records."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

#: What a replacement has decided; readers pass over names that begin so.
MANIFEST = "_manifest.json"
DATE_FORMAT, TIMESTAMP_FORMAT = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def tape_to_csv(df: DataFrame, path: str) -> None:
    """CSV that reloads to the same records: fixed date and wall-clock formats, no zone."""
    (
        df.write.mode("errorifexists").option("header", True)
        .option("dateFormat", DATE_FORMAT).option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path)
    )


def _files(spark: SparkSession, path: str):
    """Hadoop's folder object of ``path`` and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _below(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition folders ``depth`` levels below ``path``, relative to it."""
    folder, files = _files(spark, path)
    if depth == 0 or not files.exists(folder):
        return [""] if depth == 0 else []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    return [f"{name}/{rest}".rstrip("/") for name in names if not name.startswith(("_", ".")) for rest in _below(spark, f"{path}/{name}", depth - 1)]


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a replacement that was decided but not carried through; returns whether there was one.

    The manifest names what moves in and what goes. Each step can be repeated: a staged partition that is gone has moved.
    """
    _, files = _files(spark, path)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    manifest = paths(f"{path}/{MANIFEST}")
    if not files.exists(manifest):
        return False
    stream = files.open(manifest)
    plan = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    for name in plan["replace"]:
        staged, final = paths(f"{path}/{plan['staged']}/{name}"), paths(f"{path}/{name}")
        if files.exists(staged):
            files.delete(final, True)
            files.mkdirs(final.getParent())
            if not files.rename(staged, final):
                raise OSError(f"could not move {staged} to {final}")
    for name in plan["remove"]:
        files.delete(paths(f"{path}/{name}"), True)
    files.delete(paths(f"{path}/{plan['staged']}"), True)
    files.delete(manifest, False)
    return True


def _decide(spark: SparkSession, path: str, staged: str, keys: list[str], remove: list[str]) -> None:
    """Switch to the staged partitions: from the moment the manifest bears its name they are the table's."""
    _, files = _files(spark, path)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    plan = {"staged": staged, "replace": _below(spark, f"{path}/{staged}", len(keys)), "remove": remove}
    draft = paths(f"{path}/{staged}.manifest")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(plan).encode()))
    stream.close()
    if not files.rename(draft, paths(f"{path}/{MANIFEST}")):
        raise OSError(f"could not switch {path} to {staged}")


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last decided replacement."""
    recover(spark, path)
    return spark.read.parquet(path)


def write_replacing(df: DataFrame, path: str, keys: list[str], scope: DataFrame) -> None:
    """Idempotent write: the rows that ``scope`` names give way to ``df``, all others stay.

    ``scope`` holds values of any columns of the table, partition columns among them or not; nulls match
    nulls. A row of ``df`` outside it is refused. Only partitions that hold rows of the scope are rewritten;
    one left without rows is removed, so nothing stale stays. A large partition is spread over several tasks and files.

    New partitions are written beside the old ones, under a name that readers pass over; a manifest that names them is switched
    last, and only then they move in. A run that breaks off before leaves the table as it was, one that breaks off
    later is finished by ``recover``, which the next write and ``read_replaced`` call. One writer at a time.
    """
    spark = df.sparkSession
    scope = scope.distinct()

    def matching(left: DataFrame, columns: list[str], how: str) -> DataFrame:
        wanted = scope.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
        return left.join(wanted, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]), how)

    fresh = settle(df, "fresh")
    if not matching(fresh, scope.columns, "left_anti").isEmpty():
        raise ValueError("rows to write lie outside the scope they replace")
    recover(spark, path)
    out, emptied = fresh, []
    if _below(spark, path, len(keys)):
        kinds = dict(fresh.dtypes)
        old = spark.read.parquet(path)
        held = old.select(*[F.col(c).cast(kinds[c]).alias(c) for c in fresh.columns],
                          F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("_folder"))
        shared = [c for c in keys if c in scope.columns]
        touched = settle(matching(held, shared, "left_semi") if shared else held, "touched")
        out = settle(matching(touched, scope.columns, "left_anti").drop("_folder").unionByName(fresh), "replaced")
        left = out.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        # one row per partition that has lost all its rows
        gone = touched.select(*keys, "_folder").distinct().join(left, same, "left_anti").select("_folder").collect()
        emptied = ["/".join(spark._jvm.java.net.URI(r[0]).getPath().split("/")[-len(keys):]) for r in gone]
    staged = f"_staged-{uuid.uuid4().hex}"
    out.hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{path}/{staged}")
    _decide(spark, path, staged, keys, emptied)
    recover(spark, path)


def append_records(df: DataFrame, path: str, keys: tuple[str, ...] = ("frequency", "trade_date")) -> None:
    """Append-only write; a batch lands as new files under its partitions.

    Rows are rebalanced by the partition columns first, so that a partition gets files of even size rather
    than one from every task.
    """
    df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)
