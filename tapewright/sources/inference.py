"""What a file's own timestamps say about its interval and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import INTERVAL_SECONDS, lookup
from ..functions import clock, series
from .ingest import PROFILES, Layout
from ..functions.symbols import parse_symbol
from .reference import KNOWN_ROOTS

LABELS = {seconds: label for label, seconds in INTERVAL_SECONDS.items()}


def infer_interval(df: DataFrame) -> DataFrame:
    """One row: modal step between consecutive timestamps, how regular it is, and the grain.

    ``df``: contract_id, ts (wall clock). Steps are taken along each contract over distinct
    timestamps in day chunks, so a long contract or many copies of a row stay spread out.
    """
    stamps = df.filter("ts is not null").groupBy("contract_id", "ts").agg(F.lit(1).alias("one"))
    stamps = stamps.select("contract_id", "ts", F.to_date("ts").alias("chunk_day"))
    steps = series.with_previous(
        stamps, ["contract_id"], ["ts"], F.struct(F.col("ts").alias("ts")), chunk=["chunk_day"])
    step = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("prev.ts").cast("timestamp"))
    counts = steps.withColumn("step", step).filter("step > 0").groupBy("step").agg(F.count("*").alias("n"))
    modal = counts.agg(F.max_by("step", F.struct(F.col("n"), (-F.col("step")).alias("s")))).scalar()
    graded = counts.withColumn("modal", modal).agg(
        F.max("modal").alias("modal"), F.sum("n").alias("deltas"),
        F.sum(F.when(F.col("step") == F.col("modal"), F.col("n")).otherwise(0)).alias("at_mode"),
        F.sum(F.when(F.col("step") % F.col("modal") != 0, F.col("n")).otherwise(0)).alias("off_grid"))
    intraday = df.agg(F.count_if(clock.second_of_day(F.col("ts")) != 0)).scalar()
    row = graded.withColumn("intraday", intraday)
    known = lookup(LABELS, F.col("modal").cast("int"))
    timed = F.col("intraday") > 0
    none = F.col("modal").isNull()
    return row.select(
        F.col("modal").alias("modal_seconds"), F.coalesce("deltas", F.lit(0)).alias("deltas"),
        F.coalesce("at_mode", F.lit(0)).alias("at_mode"), F.coalesce("off_grid", F.lit(0)).alias("off_grid"),
        "intraday",
        F.when(none & timed, "1 minute").when(none, "1 day").when(known.isNotNull(), known)
        .otherwise(F.concat(F.col("modal").cast("string"), F.lit(" seconds"))).alias("label"),
        F.when(~timed, "daily").when(known == "1 day", "daily").otherwise("minute").alias("frequency"),
        F.when(none, 0.3).when(known.isNotNull() & (F.col("off_grid") == 0), 1.0)
        .when(known.isNotNull(), 0.5).otherwise(0.2).alias("confidence"),
        F.coalesce(F.col("at_mode") / F.nullif("deltas", F.lit(0)), F.lit(0.0)).alias("modal_share"))


def infer_timezone(df: DataFrame, frequency: str, layout: Layout | None = None) -> DataFrame:
    """One row: zone, how it was reached and how far to trust it. ``df``: ts (wall clock)."""
    if layout is not None and layout.profile:
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(clock.CHICAGO).alias("timezone"), F.lit("profile").alias("method"), F.lit(1.0).alias("confidence"),
            F.lit(None).cast("int").alias("empty_hours"))
    if frequency == "daily":
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(clock.CHICAGO).alias("timezone"), F.lit("daily").alias("method"), F.lit(0.3).alias("confidence"),
            F.lit(None).cast("int").alias("empty_hours"))
    seen = df.filter("ts is not null").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    silent = seen.agg(F.collect_set("hour").alias("hours")).select(
        F.array_except(F.sequence(F.lit(0), F.lit(23)), "hours").alias("silent"))
    one = F.size("silent") == 1
    at_break = one & (F.try_element_at("silent", F.lit(1)) == 16)
    return silent.select(
        F.lit(clock.CHICAGO).alias("timezone"),
        F.when(at_break, "maintenance break").when(one, "single empty hour").otherwise("vendor default").alias("method"),
        F.when(at_break, 0.9).when(one, 0.4).otherwise(0.2).alias("confidence"),
        F.size("silent").alias("empty_hours"))


def profile_file(df: DataFrame, frequency: str, held: DataFrame) -> DataFrame:
    """One row: size, span, contracts, unparsed symbols and what the upload makes possible.

    ``df``: contract_id, ts; ``held``: records already loaded (contract_id, frequency).
    """
    other = "daily" if frequency == "minute" else "minute"
    per = df.groupBy("contract_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    present = held.filter(F.col("frequency") == other).select("contract_id").distinct().withColumn("other", F.lit(True))
    parsed = parse_symbol(F.col("contract_id"), KNOWN_ROOTS)["root"].isNotNull()
    row = per.join(present, "contract_id", "left").agg(
        F.sum("n").alias("row_count"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        F.sort_array(F.collect_set("contract_id")).alias("contracts"),
        F.sort_array(F.collect_set(F.when(~parsed, F.col("contract_id")))).alias("unparsed"),
        F.coalesce(F.bool_or("other"), F.lit(False)).alias("other"))
    minute = F.lit(frequency == "minute") | F.col("other")
    daily = F.lit(frequency == "daily") | F.col("other")
    return row.select(
        "row_count", "first_ts", "last_ts", "contracts", "unparsed", F.lit(True).alias("daily_bars"),
        F.when(minute, "derived from the minute tape").otherwise("ingested as supplied").alias("daily_bars_reason"),
        minute.alias("vwap_15m"), (minute & daily).alias("reconciliation"))


def bar_interval(layout: Layout, inferred_label: str) -> str:
    return PROFILES[layout.profile]["bar_interval"] if layout.profile else inferred_label
