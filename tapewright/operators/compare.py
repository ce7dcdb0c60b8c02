"""Two views of one series side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import BAR, bar_struct

POINT = ["contract_id", "trade_date", "ts_utc"]
#: Two sums of the same ticks in another order stay within this.
SAME_VWAP = 1e-9


def compare_vwap(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Both lines on each timestamp, their difference and whether it is more than float noise."""
    def line(points: DataFrame, name: str) -> DataFrame:
        # points of one timestamp share one value
        return points.groupBy(*POINT).agg(F.max("vwap_15m").alias(name))

    delta = F.col("clean_vwap") - F.col("raw_vwap")
    return line(raw, "raw_vwap").join(line(clean, "clean_vwap"), POINT, "full_outer").withColumn(
        "delta", delta).withColumn("differs", F.coalesce(F.abs("delta") > SAME_VWAP, F.lit(False)))


def _pair(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    x = left.select(*BAR, bar_struct().alias(a))
    y = right.select(*BAR, bar_struct().alias(b))
    return x.join(y, BAR, "full_outer")


def compare_bars(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw against clean bars; a bar absent on one side differs."""
    return _pair(raw, clean, "raw", "clean").withColumn("differs", ~F.col("raw").eqNullSafe(F.col("clean")))


def compare_frequency(derived: DataFrame, vendor: DataFrame) -> DataFrame:
    """Derived against supplied bars, and whether both sides are there to compare."""
    both = F.col("derived").isNotNull() & F.col("supplied").isNotNull()
    return _pair(derived, vendor, "derived", "supplied").withColumn(
        "status", F.when(both, "compared").otherwise("not_comparable")
    ).withColumn("differs", ~F.col("derived").eqNullSafe(F.col("supplied")))


def attach_supplied(derived: DataFrame, vendor: DataFrame) -> DataFrame:
    """Supplied close and volume beside each derived bar, with the close gap and volume ratio."""
    side = vendor.select(*BAR, F.col("close").alias("supplied_close"), F.col("volume").alias("supplied_volume"),
                         F.lit(True).alias("held"))
    return derived.join(side, BAR, "left").withColumns({
        "status": F.when(F.col("held"), "compared").otherwise("not_comparable"),
        "close_diff": F.round(F.col("close") - F.col("supplied_close"), 6),
        "volume_ratio": F.bround(F.col("volume") / F.nullif("supplied_volume", F.lit(0)), 4),
    }).drop("held")
