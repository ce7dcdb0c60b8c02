"""Rolling fifteen-minute volume-weighted price, one point per minute record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, small
from .bars import basis_records

SESSION = ["contract_id", "trade_date"]
#: Points repeated from one tick in one go; a tick with more copies is spread over tasks.
COPIES_PER_BLOCK = 1 << 16
WINDOW = 15 * 60 * 1_000_000
#: Microseconds of a block of ticks that one task orders.
BLOCK = 60 * 60 * 1_000_000


def vwap_15m(
    records: DataFrame, basis: str = "clean", actions: DataFrame | None = None, price_basis: str = "typical"
) -> DataFrame:
    """Trailing window, inclusive of a record exactly fifteen minutes old, per session.

    Records on one timestamp share their window, so they are summed into one tick before
    anything is ordered. Ticks are ordered in blocks of an hour, each with the ticks of the fifteen minutes before it,
    so a dense session is spread over tasks. Ticks become points again afterwards, one per record.
    """
    prices = {"typical": (F.col("high") + F.col("low") + F.col("close")) / 3.0, "close": F.col("close")}
    if price_basis not in prices:
        raise ValueError(f"unknown price_basis {price_basis!r}")
    rows = basis_records(records, basis, actions).filter(
        "frequency = 'minute' and high is not null and low is not null and close is not null and volume is not null")
    ticks = rows.groupBy(*SESSION, "ts_utc").agg(
        F.sum(prices[price_basis] * F.col("volume")).alias("pv"), F.sum("volume").alias("v"),
        F.count("*").alias("n"))
    at = F.unix_micros("ts_utc")

    def block(instant: Column) -> Column:
        return ((instant - F.pmod(instant, F.lit(BLOCK))) / BLOCK).cast("bigint")

    timed = ticks.withColumn("at", at)
    starts = small(settle(timed.groupBy(*SESSION).agg(F.min("at").alias("start")), "session-starts"))
    # a tick counts in its own block and, within reach of it, in the next one, where it makes no point
    seats = F.array_distinct(F.array(block(F.col("at")), block(F.col("at") + WINDOW)))
    placed = timed.withColumn("own", block(F.col("at"))).withColumn("seat", F.explode(seats))
    trailing = W.partitionBy(*SESSION, "seat").orderBy("at").rangeBetween(-WINDOW, 0)
    points = placed.select(
        *SESSION, "ts_utc", "n", "at", "own", "seat",
        F.sum("pv").over(trailing).alias("pv"), F.sum("v").over(trailing).alias("window_volume"),
        F.sum("n").over(trailing).alias("window_records"),
    ).filter("own = seat").join(starts, SESSION).withColumn("is_warmup", F.col("at") - F.col("start") < WINDOW).withColumn(
        "vwap_15m", F.col("pv") / F.nullif("window_volume", F.lit(0)))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES_PER_BLOCK))
    spread = points.withColumn("block", F.explode(blocks)).repartition(*SESSION, "ts_utc", "block")
    copies = F.least(F.lit(COPIES_PER_BLOCK), F.col("n") - F.col("block") * COPIES_PER_BLOCK)
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(
        *SESSION, "ts_utc", "vwap_15m", "window_volume", "window_records", "is_warmup")
