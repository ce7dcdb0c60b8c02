"""What the minute tape says about a daily range finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..catalogue import CORROBORATED_RULES

SESSION = ["contract_id", "trade_date"]


def _number(name: str) -> Column:
    return F.get_json_object("details", f"$.{name}").try_cast("double")


def corroborate(findings: DataFrame, cross_metrics: DataFrame, records: DataFrame, min_coverage: float) -> DataFrame:
    """State per daily range finding: not_comparable, disputed or confirmed, with its evidence.

    Evidence comes from the finding's own run; findings the question does not apply to are
    absent from the result.
    """
    run = ["run_id", *SESSION]
    asked = findings.filter(
        F.col("rule_id").isin(CORROBORATED_RULES) & (F.col("frequency") == "daily")
        & F.col("contract_id").isNotNull() & F.col("trade_date").isNotNull()
    ).select("finding_id", "rule_id", *run)
    grains = records.groupBy("contract_id").agg(F.sort_array(F.collect_set("frequency")).alias("frequencies_held"))
    compared = cross_metrics.filter("frequency = 'cross'").select(
        *SESSION, F.lit(True).alias("compared"), F.col("actual_records").alias("minute_records"),
        F.col("expected_records").alias("expected_slots"),
        (F.col("actual_records") / F.nullif("expected_records", F.lit(0))).alias("coverage"))
    ranged = findings.filter("rule_id = 'REC.OHLC_DISAGREE'").withColumn(
        "field", F.get_json_object("details", "$.field")).filter("field in ('high', 'low')")
    size = F.abs(F.coalesce(_number("difference"), F.lit(0.0)))
    disputes = ranged.groupBy(*run).agg(
        F.max(F.struct(size.alias("size"), "field", _number("difference_ticks").alias("ticks"),
                       _number("difference").alias("difference"))).alias("worst"),
        F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))
    conventions = findings.filter("rule_id = 'REC.CLOSE_CONVENTION'").groupBy(*run).agg(
        F.max(F.struct(_number("close_gap_ticks").alias("close_gap_ticks"),
                       _number("close_at_mark").alias("close_at_mark"))).alias("gap"))
    joined = asked.join(grains, "contract_id", "left").join(compared, SESSION, "left").join(
        disputes, run, "left").join(conventions, run, "left")
    one_grain = F.coalesce(F.size("frequencies_held"), F.lit(0)) < 2
    outside = F.col("compared").isNull()
    thin = F.coalesce(F.col("coverage") < min_coverage, F.lit(True))
    comparable = ~one_grain & ~outside & ~thin
    disputed, confirmed = comparable & F.col("worst").isNotNull(), comparable & F.col("worst").isNull()
    return joined.select(
        "finding_id", "rule_id", *run,
        F.when(~comparable, "not_comparable").when(disputed, "disputed").otherwise("confirmed").alias("state"),
        F.when(one_grain, "only one granularity is held for this contract")
        .when(outside, "the session lies outside the window both granularities cover")
        .when(thin, "the minute tape covers too little of the session to measure its range")
        .when(disputed, "the minute tape measures another range for this session")
        .otherwise("the minute tape measures the stated range").alias("reason"),
        F.when(~one_grain & ~outside, rounded(100.0 * F.col("coverage"), 2)).alias("minute_coverage_pct"),
        F.when(disputed, F.col("worst.field")).alias("field"),
        F.when(disputed, F.col("worst.ticks")).alias("ticks"),
        F.when(disputed, F.col("worst.difference")).alias("difference"),
        F.when(disputed, F.col("finding_ids")).alias("finding_ids"),
        F.when(confirmed, F.col("gap.close_gap_ticks")).alias("close_gap_ticks"),
        F.when(confirmed, F.col("gap.close_at_mark")).alias("close_at_mark"))
