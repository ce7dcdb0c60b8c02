"""Vendor files as text, with their row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small

BROKEN = "_broken_line"
FILE, ROW = "source_file", "source_row"
#: Rows in the files before this one, by path: with the row number it makes an id over several files.
BASE = "_rows_before_file"


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column text; a line of the wrong width is kept whole in ``_broken_line``.

    Adds the source file, the 1-based data row in it, broken lines counted, and the rows of earlier files.
    Cells are taken by position, so all files of a folder need the header of the first; another one is
    refused when it is read.
    """
    names = spark.read.option("header", True).csv(path).columns
    return with_source_row(text_lines(spark, path, names, header=True))


def text_lines(spark: SparkSession, path: str | list[str], names: list[str], header: bool) -> DataFrame:
    """CSV cells as text under agreed names, with the split each line was read from.

    Pruning is off in the parser: with it, a line is only as wide as the columns a query asks
    for, and a short line would pass or fail depending on the query.
    """
    schema = ", ".join(f"`{name}` STRING" for name in [*names, BROKEN])
    return (
        spark.read.schema(schema)
        .option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        .option("columnPruning", False).option("enforceSchema", False)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"))
    )


def read_parquet_text(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with every column cast to text, so both formats take one reject path."""
    df = spark.read.parquet(path)
    return with_file_base(df.select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns],
        F.lit(None).cast("string").alias(BROKEN),
        F.col("_metadata.file_path").alias(FILE), (F.col("_metadata.row_index") + 1).alias(ROW)))


def with_file_base(df: DataFrame) -> DataFrame:
    """Add the rows of earlier files; only one count per file is ever put in order."""
    files = df.groupBy(FILE).agg(F.max(ROW).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(FILE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(small(files.select(FILE, before.cast("bigint").alias(BASE))), FILE)


def with_source_row(df: DataFrame) -> DataFrame:
    """Number rows of each file in file order without gathering a file in one task.

    A split is read in order by one task, so a row's number is its position in the split plus
    the rows of the file's earlier splits; only the per-split counts are ever put in order.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    return marked.join(small(split_offsets(marked)), [FILE, "_block"]).withColumn(
        ROW, F.col("_id") - F.col("_first") + F.col("_offset") + 1
    ).drop("_id", "_first", "_offset", "_block")


def split_offsets(marked: DataFrame) -> DataFrame:
    """Per split of rows ``(file, _block, _id)``: its first id, the rows of the file's earlier splits and of earlier files."""
    splits = marked.groupBy(FILE, "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(FILE).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    overall = W.orderBy(FILE, "_block").rowsBetween(W.unboundedPreceding, -1)
    return splits.select(
        FILE, "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_n").over(overall), F.lit(0)).alias("_before")
    ).withColumn(BASE, F.col("_before") - F.col("_offset")).drop("_before")
