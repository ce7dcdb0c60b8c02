"""Where findings concentrate beyond the records they sit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..catalogue import RULES_BY_ID, lookup
from ..functions.clock import CHICAGO
from ..session import small

# fixed values: thresholds, dimensions, narrative phrases
LIFT, MIN_SUPPORT, MIN_PERIODS = 3.0, 20, 3
DIMENSIONS = ["hour_of_day", "day_of_week", "trade_date", "contract", "frequency", "batch"]
ONE_DAY_DIMENSIONS = ["trade_date"]
PHRASES = {
    "hour_of_day": "fall in the %s hour",
    "day_of_week": "fall on %ss",
    "trade_date": "fall on %s",
    "contract": "sit on %s",
    "frequency": "sit in the %s config",
    "batch": "came from %s",
}


def _buckets(instant: str) -> Column:
    """Dimension and bucket pairs of a row that has contract, grain, date, file and an instant."""
    local = F.from_utc_timestamp(instant, CHICAGO)
    hour = F.concat(F.date_format(local, "HH:00"), F.lit("-"),
                    F.date_format(local + F.expr("interval 1 hour"), "HH:00"), F.lit(f" {CHICAGO}"))
    values = {
        "hour_of_day": hour,
        "day_of_week": F.date_format("trade_date", "EEEE"),
        "trade_date": F.col("trade_date").cast("string"),
        "contract": F.col("contract_id"),
        "frequency": F.col("frequency"),
        "batch": F.col("filename"),
    }
    return F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), values[d].alias("bucket")) for d in DIMENSIONS]))


def _narrow(df: DataFrame, contract_ids, start, end, frequency) -> DataFrame:
    if contract_ids:
        df = df.filter(F.col("contract_id").isin(contract_ids))
    if start is not None:
        df = df.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    if frequency is not None:
        df = df.filter(F.col("frequency") == frequency)
    return df


def record_exposure(
    records: DataFrame, batches: DataFrame, keys: tuple[str, ...] = (), contract_ids=None, start=None, end=None,
    frequency=None,
) -> DataFrame:
    """Records per bucket of all six dimensions from one scan.

    Rows are counted at their finest common grain first, so the six-fold unpivot works on
    counts and not on records. ``keys`` computes the exposure per slice.
    """
    narrowed = _narrow(records, contract_ids, start, end, frequency)
    hourly = narrowed.groupBy(
        "contract_id", "frequency", "trade_date", "batch_id", F.date_trunc("hour", "ts_utc").alias("hour")
    ).agg(F.count("*").alias("n")).join(small(batches.select("batch_id", "filename")), "batch_id", "left")
    return hourly.select(*[F.col(k).alias(f"slice_{k}") for k in keys], "n", _buckets("hour")).filter(
        "bucket is not null").groupBy(*[F.col(f"slice_{k}").alias(k) for k in keys], "dimension", "bucket").agg(
        F.sum("n").alias("records"))


def finding_tallies(
    findings: DataFrame, records: DataFrame, batches: DataFrame, keys: tuple[str, ...] = (), contract_ids=None,
    start=None, end=None, frequency=None,
) -> DataFrame:
    """Open findings and distinct days per rule and bucket, with the rule's total."""
    opened = _narrow(findings.filter("status = 'open'"), contract_ids, start, end, frequency)
    pinned = opened.filter("record_id is not null").join(records.select("record_id", "batch_id"), "record_id", "left")
    loose = opened.filter("record_id is null").withColumn("batch_id", F.lit(None).cast("string"))
    cols = ["rule_id", "contract_id", "frequency", "trade_date", "ts_start_utc", "batch_id"]
    rows = pinned.select(*cols).unionByName(loose.select(*cols)).groupBy(
        "rule_id", "contract_id", "frequency", "trade_date", "batch_id",
        F.date_trunc("hour", "ts_start_utc").alias("hour")).agg(F.count("*").alias("n"))
    rows = rows.join(small(batches.select("batch_id", "filename")), "batch_id", "left")
    totals = rows.groupBy("rule_id", *keys).agg(F.sum("n").alias("rule_total"))
    tallies = rows.select(
        "rule_id", *[F.col(k).alias(f"slice_{k}") for k in keys], "n", F.col("trade_date").alias("day"),
        _buckets("hour")
    ).filter("bucket is not null").groupBy(
        "rule_id", *[F.col(f"slice_{k}").alias(k) for k in keys], "dimension", "bucket"
    ).agg(F.sum("n").alias("support"), F.count_distinct("day").alias("distinct_days"))
    return tallies.join(totals, ["rule_id", *keys])


def pattern_id(rule_id: Column, dimension: Column, bucket: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha1(F.concat_ws("|", rule_id, dimension, bucket)), 1, 16))


def find_patterns(
    exposure: DataFrame, tallies: DataFrame, keys: tuple[str, ...] = (), lift: float = LIFT,
    min_support: int = MIN_SUPPORT, min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """Rule and bucket pairs whose share of findings outgrows their share of records.

    Buckets that hold findings and no records are not a concentration and fall out of the join.
    """
    group = [*keys, "dimension"]
    totals = exposure.groupBy(*group).agg(F.sum("records").alias("record_total"))
    joined = tallies.join(exposure, [*group, "bucket"]).join(totals, group)
    of_findings = F.col("support") / F.col("rule_total")
    of_records = F.col("records") / F.col("record_total")
    rows = joined.withColumns({"f": of_findings, "r": of_records}).withColumn("raw_lift", F.col("f") / F.col("r"))
    days = F.col("distinct_days")
    rows = rows.filter((F.col("raw_lift") >= lift) & (F.col("support") >= min_support) & (
        F.col("dimension").isin(ONE_DAY_DIMENSIONS) | (days >= min_periods)))
    label = lookup({r: r.split(".", 1)[1].replace("_", " ").lower() for r in RULES_BY_ID}, F.col("rule_id"))
    phrase = F.lit(None).cast("string")
    for name, text in PHRASES.items():
        phrase = F.when(F.col("dimension") == name, F.format_string(text, F.col("bucket"))).otherwise(phrase)
    narrative = F.concat(
        F.bround(100 * F.col("f"), 0).cast("int").cast("string"), F.lit("% of "), label, F.lit(" findings "), phrase,
        F.lit(", across "), days.cast("string"), F.when(days == 1, " session.").otherwise(" sessions."))
    strong = (F.col("raw_lift") >= 10) & (F.col("support") >= 100) & (days >= 10)
    medium = (F.col("raw_lift") >= 5) & (F.col("support") >= 50)
    return rows.select(
        *keys, pattern_id(F.col("rule_id"), F.col("dimension"), F.col("bucket")).alias("pattern_id"), "rule_id",
        "dimension", "bucket", rounded("f", 4).alias("share_of_findings"),
        rounded("r", 4).alias("share_of_records"), rounded("raw_lift", 2).alias("lift"), "support", "distinct_days",
        narrative.alias("narrative"),
        F.when(strong, "high").when(medium, "medium").otherwise("low").alias("confidence"))


def ordered(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("lift"), F.desc("support"), "pattern_id")
