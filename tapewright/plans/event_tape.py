"""Tape derived from the ``events`` table, with known defects planted by ``event_id``.

Everything is integer arithmetic on the event id, so the same tape can be stated in any SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import lookup
from ..functions import clock
from ..sources.reference import contracts_from_symbols, open_second
from ..session import literal_table

CONTRACT_OF = {"click": "ESH24", "error": "ZCH24", "purchase": "SR3H24", "signup": "SBH24", "view": "CLH24"}
ROOT_OF = {"ESH24": "ES", "ZCH24": "ZC", "SR3H24": "SR3", "SBH24": "SB", "CLH24": "CL"}
ORDINAL = {name: i for i, name in enumerate(CONTRACT_OF.values(), 1)}
INGESTED_AT = "2024-01-29 12:00:00"
LISTING = {"ESH24": ("2024-01-04", "2024-01-26"), "ZCH24": (None, "2024-01-25"), "CLH24": ("2024-01-03", None)}

COLUMNS = [
    "record_id", "batch_id", "source_row", "contract_id", "frequency", "ts_source", "ts_exchange", "ts_utc",
    "trade_date", "open", "high", "low", "close", "volume", "volume_source", "open_interest", "ingested_at",
]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undamaged minute bars, one per event."""
    e = F.col("event_id")
    value = F.col("value")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        lookup(CONTRACT_OF, F.col("event_type")).alias("contract_id"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts_exchange"),
        value.alias("close"),
        (value + (e % 5 - 2) * 0.25).alias("open"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
    )
    return events.withColumn(
        "high", F.greatest("open", "close") + (e % 3) * 0.25
    ).withColumn(
        "low", F.least("open", "close") - (e % 4) * 0.25
    ).withColumn(
        "trade_date",
        clock.trade_date(F.col("ts_exchange"), open_second(lookup(ROOT_OF, F.col("contract_id")))),
    )


def _finish(df: DataFrame, frequency: str) -> DataFrame:
    return df.select(
        "record_id", "batch_id", F.col("record_id").alias("source_row"), "contract_id",
        F.lit(frequency).alias("frequency"),
        F.date_format("ts_exchange", "yyyy-MM-dd HH:mm:ss").alias("ts_source"), "ts_exchange",
        F.to_utc_timestamp("ts_exchange", clock.CHICAGO).alias("ts_utc"),
        "trade_date", "open", "high", "low", "close", "volume", "volume_source", "open_interest",
        F.lit(INGESTED_AT).cast("timestamp").alias("ingested_at"),
    )


def minute_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute rows with repeats, conflicts, nulls, inverted ranges and shuffled source rows."""
    e, n = F.col("event_id"), F.col("copy")
    copies = F.filter(
        F.array(F.lit(0), F.when(e % 107 == 0, 1), F.when(e % 109 == 0, 2)), lambda c: c.isNotNull()
    )
    swap = e % 101 == 0
    close = (
        F.when(n == 2, F.col("close") + 1.25)
        .when(e % 97 == 0, F.lit(None))
        .when(e % 113 == 0, F.col("high") + 5.0)
        .otherwise(F.col("close"))
    )
    return _finish(
        _events(spark, sf_dir).withColumn("copy", F.explode(copies)).select(
            (e * 10 + F.when(e % 127 == 0, 503).otherwise(0) + n).cast("bigint").alias("record_id"),
            F.when(n == 2, F.lit("b-resend"))
            .otherwise(F.concat(F.lit("b-"), F.lower("contract_id"))).alias("batch_id"),
            "contract_id",
            F.when(e % 139 == 0, F.col("ts_exchange") + F.expr("interval 30 seconds"))
            .otherwise(F.col("ts_exchange")).alias("ts_exchange"),
            "trade_date",
            F.when(e % 137 == 0, F.col("high") + 2.0).otherwise(F.col("open")).alias("open"),
            F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"),
            F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"),
            close.alias("close"),
            F.when(e % 103 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
            F.when(e % 131 == 0, F.concat(F.col("volume").cast("string"), F.lit(".5"))).alias("volume_source"),
            F.lit(None).cast("bigint").alias("open_interest"),
        ),
        "minute",
    )


def daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied daily rows: bars of the undamaged minutes, disagreeing on chosen days."""
    day = F.dayofmonth("trade_date")
    order = F.struct("ts_exchange", "event_id")
    gap = F.abs(clock.second_of_day(F.col("ts_exchange")) - 54_000)
    bars = _events(spark, sf_dir).groupBy("contract_id", "trade_date").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("last"), F.sum("volume").alias("total"),
        F.min_by("close", F.struct(gap, "ts_exchange", "event_id")).alias("mark"),
    ).filter(day % 11 != 0)
    close = (
        F.when(day % 4 == 0, F.col("high") + 1.0)
        .when(day % 3 == 0, F.col("mark"))
        .when(day % 13 == 0, F.col("last") + 0.75)
        .otherwise(F.col("last"))
    )
    ident = F.lit(9_000_000_000) + lookup(ORDINAL, F.col("contract_id")) * 100_000 + F.datediff(
        "trade_date", F.lit("2020-01-01").cast("date")
    )
    return _finish(
        bars.select(
            ident.cast("bigint").alias("record_id"), F.lit("b-daily").alias("batch_id"), "contract_id",
            F.col("trade_date").cast("timestamp_ntz").alias("ts_exchange"), "trade_date", "open",
            F.when(day % 7 == 0, F.col("high") + 0.25).otherwise(F.col("high")).alias("high"), "low",
            close.alias("close"),
            F.when(day % 5 == 0, F.col("total") * 2).otherwise(F.col("total")).cast("bigint").alias("volume"),
            F.lit(None).cast("string").alias("volume_source"),
            (F.col("total") + 10).cast("bigint").alias("open_interest"),
        ),
        "daily",
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both grains, laid out by contract and session in evenly sized parts however skewed they are."""
    both = minute_records(spark, sf_dir).unionByName(daily_records(spark, sf_dir))
    return both.hint("rebalance", "contract_id", "trade_date")


def weekday(records: DataFrame) -> DataFrame:
    return records.filter(F.dayofweek("trade_date").between(2, 6))


def event_contracts(records: DataFrame) -> DataFrame:
    """Contract dimension of the tape with a few listing bounds set."""
    def bound(i: int) -> Column:
        return lookup({k: v[i] for k, v in LISTING.items() if v[i]}, F.col("contract_id")).cast("date")

    return contracts_from_symbols(records.select("contract_id")).withColumn(
        "first_trade_date", bound(0)
    ).withColumn("last_trade_date", bound(1))


def event_batches(spark: SparkSession) -> DataFrame:
    rows = [
        (f"b-{c.lower()}", f"{c.lower()}_minute.csv", "upload", "succeeded", "minute", "1 minute")
        for c in ORDINAL
    ] + [
        ("b-resend", "resend.csv", "injected", "succeeded", "minute", "1 minute"),
        ("b-daily", "daily.parquet", "upload", "succeeded", "daily", "1 day"),
    ]
    return literal_table(
        spark,
        "batch_id string, filename string, origin string, status string, frequency string, bar_interval string",
        rows,
    ).withColumn("inferred_interval", F.col("bar_interval")).withColumn(
        "source_timezone", F.lit(clock.CHICAGO)
    )
