"""The one schema every rule emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import RULES_BY_ID

FINDING_COLUMNS = [
    "finding_id", "rule_id", "severity", "contract_id", "frequency", "compare_frequency", "trade_date",
    "ts_start_utc", "ts_end_utc", "record_id", "affected_rows", "details",
]

#: A finding as a run stores it.
FINDING_SCHEMA = (
    "finding_id string, rule_id string, severity string, contract_id string, frequency string, "
    "compare_frequency string, trade_date date, ts_start_utc timestamp, ts_end_utc timestamp, record_id bigint, "
    "affected_rows bigint, details string, run_id string, status string, detected_at timestamp"
)


def finding_id(subject: Column) -> Column:
    """Deterministic id, so that a re-run writes the same findings."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    epoch = F.coalesce(F.unix_seconds("ts_start_utc").cast("string"), F.lit(""))
    return F.sha1(F.concat_ws(
        "|", "rule_id", text("contract_id"), text("frequency"), text("trade_date"), epoch,
        text("record_id"), F.coalesce(subject, F.lit("")),
    ))


def findings(
    df: DataFrame, rule_id: str, details: dict[str, Column], *, severity: Column | str | None = None,
    frequency: Column | str | None = None, compare: str | Column | None = None,
    contract: Column | None = None, trade_date: Column | None = None, start: Column | None = None,
    end: Column | None = None, record: Column | None = None, affected: Column | None = None,
    subject: Column | None = None,
) -> DataFrame:
    """Project a rule's rows onto the finding schema; record rules pass ``record``."""
    def lit(value: Column | str | None, default: Column) -> Column:
        if value is None:
            return default
        return F.lit(value) if isinstance(value, str) else value

    point = F.col("ts_utc") if record is not None else F.lit(None).cast("timestamp")
    shaped = df.select(
        F.lit(rule_id).alias("rule_id"),
        lit(severity, F.lit(RULES_BY_ID[rule_id].severity)).alias("severity"),
        (F.col("contract_id") if contract is None else contract).cast("string").alias("contract_id"),
        lit(frequency, F.col("frequency") if "frequency" in df.columns else F.lit(None)).cast("string")
        .alias("frequency"),
        lit(compare, F.lit(None)).cast("string").alias("compare_frequency"),
        (F.col("trade_date") if trade_date is None else trade_date).cast("date").alias("trade_date"),
        (point if start is None else start).alias("ts_start_utc"),
        (point if end is None else end).alias("ts_end_utc"),
        (F.lit(None) if record is None else record).cast("bigint").alias("record_id"),
        (F.lit(1) if affected is None else affected).cast("bigint").alias("affected_rows"),
        F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])).alias("details"),
        (F.lit("") if subject is None else subject).alias("_subject"),
    )
    return shaped.withColumn("finding_id", finding_id(F.col("_subject"))).select(*FINDING_COLUMNS)
