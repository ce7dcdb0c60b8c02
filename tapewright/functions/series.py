"""Order-dependent work on long series without one task per series.

A series is cut into contiguous chunks: a UTC day each, and a day that holds too many rows is
cut further by timestamp and record block. Work inside a chunk is an ordinary window; what
crosses a chunk border travels in a table of one row per chunk. Records are laid out by chunk once,
as a bucketed table: every window or aggregate within chunks then reads them where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path, small

#: Rows of one series and UTC day above which the day is cut further.
HOT_DAY_ROWS = 1 << 20
BLOCK_BITS = 20
MOST_BUCKETS = 100_000
CHUNK = ["chunk_day", "chunk_ts", "chunk_block"]


def hot_days(day_load: DataFrame, keys: list[str], limit: int = HOT_DAY_ROWS) -> DataFrame | None:
    """Series days above the limit, or None when a cheap look finds there are none."""
    hot = day_load.groupBy(*keys, "utc_day").agg(F.sum("records").alias("n")).filter(F.col("n") > limit)
    hot = hot.select(*keys, "utc_day")
    return None if hot.isEmpty() else hot


def with_chunks(df: DataFrame, keys: list[str], hot: DataFrame | None, block: str = "record_id") -> DataFrame:
    """Add the chunk columns for an order by ``ts_utc`` then ``block``."""
    day = F.to_date("ts_utc")
    if hot is None:
        return df.select("*", day.alias("chunk_day"), F.lit(0).cast("bigint").alias("chunk_ts"),
                         F.lit(0).cast("bigint").alias("chunk_block"))
    marked = df.withColumn("utc_day", day).join(
        small(hot.withColumn("is_hot", F.lit(True))), [*keys, "utc_day"], "left"
    )
    is_hot = F.col("is_hot").isNotNull()
    return marked.select(
        *df.columns,
        F.col("utc_day").alias("chunk_day"),
        F.when(is_hot, F.unix_micros("ts_utc")).otherwise(0).alias("chunk_ts"),
        F.when(is_hot, F.shiftright(F.col(block).cast("bigint"), BLOCK_BITS)).otherwise(0).alias("chunk_block"),
    )


def lay_out(df: DataFrame, keys: list[str], hot: DataFrame | None, label: str) -> DataFrame:
    """``df`` with its chunk columns, exchanged once and written in buckets of whole chunks.

    Spark knows the buckets: partitioning by series and chunk, with any further column, needs no exchange any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    name = "tapewright_" + path.rsplit("/", 1)[1].replace("-", "_")
    by = [*keys, *CHUNK]
    with_chunks(df, keys, hot).repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def borders(
    rows: DataFrame, keys: list[str], at: Column, last: dict[str, Column], carried: dict[str, Column] | None = None,
    chunk: list[str] = CHUNK,
) -> DataFrame:
    """One row per chunk: what it inherits from the chunks before it, records ordered by the number ``at``.

    ``last``: values of the last record before the chunk; ``carried``: the last ones that are not null.
    """
    carried = carried or {}
    tails = rows.groupBy(*keys, *chunk).agg(
        *[F.max_by(value, at).alias(name) for name, value in last.items()],
        *[F.max_by(value, F.when(value.isNotNull(), at)).alias(name) for name, value in carried.items()])
    before = W.partitionBy(*keys).orderBy(*chunk)
    return tails.select(
        *keys, *chunk, *[F.lag(name).over(before).alias(name) for name in last],
        *[F.last(name, ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)).alias(name) for name in carried])


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: list[str] = CHUNK,
    name: str = "prev",
) -> DataFrame:
    """Exact ``lag(value)`` along each series; ``value`` is a struct, null only on a first row."""
    inside = W.partitionBy(*keys, *chunk).orderBy(*order)
    tails = df.groupBy(*keys, *chunk).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy(*chunk)))
    return (
        df.withColumn("_inside", F.lag(value).over(inside))
        .join(carried.drop("_tail"), [*keys, *chunk])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_inside", "_carry")
    )


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunk: list[str] = CHUNK
) -> DataFrame:
    """Exact running sum of ``value`` along each series."""
    inside = W.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, *chunk).agg(F.sum(value).alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets.drop("_total"), [*keys, *chunk])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )
