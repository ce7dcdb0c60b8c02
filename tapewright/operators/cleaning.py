"""Cleaning decisions, the clean basis and what cleaning took away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import DEDUPE_DROP_RULES, EXCLUDING_SEVERITIES, NEVER_EXCLUDE_RULES
from ..session import small

REMOVING = ["exclude", "dedupe_drop"]


def cleaning_actions(findings: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Default decisions for findings pinned to a record, none of them decided before.

    A decision is its record, rule and action; two findings that lead to the same decision
    make one.
    """
    dedupe = F.col("rule_id").isin(DEDUPE_DROP_RULES)
    excluding = F.col("severity").isin(*EXCLUDING_SEVERITIES) & ~F.col("rule_id").isin(NEVER_EXCLUDE_RULES)
    decided = findings.filter(F.col("record_id").isNotNull() & (dedupe | excluding)).select(
        "record_id", "rule_id", F.when(dedupe, "dedupe_drop").otherwise("exclude").alias("action"), "severity",
    ).groupBy("record_id", "rule_id", "action").agg(F.min("severity").alias("severity"))
    rationale = F.concat(F.lit("default cleaning policy for "), "severity", F.lit(" finding on "), "rule_id")
    decided = decided.withColumn("rationale", rationale).drop("severity")
    if prior is not None:
        decided = decided.join(prior, ["record_id", "rule_id", "action"], "left_anti")
    return decided


def removed_ids(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("action").isin(REMOVING)).select("record_id").distinct()


def marked_removed(actions: DataFrame) -> DataFrame:
    """``removed_ids`` marked ``gone``, hinted for broadcast by a count of the decisions: distinct ids are sought in the join alone."""
    return small(removed_ids(actions).withColumn("gone", F.lit(True)), counted=actions.filter(F.col("action").isin(REMOVING)))


def clean_records(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Records no decision removed; few decisions are broadcast, so the records stay in place."""
    return records.join(marked_removed(actions), "record_id", "left_anti")


def exclusion_rate(records: DataFrame, contracts: DataFrame, actions: DataFrame) -> DataFrame:
    """Share of records removed: overall, per rule and action, per root and grain."""
    gone = F.count_if(F.col("gone").isNotNull())
    marked = records.select("record_id", "contract_id", "frequency").join(
        marked_removed(actions), "record_id", "left")
    per_slice = marked.groupBy("contract_id", "frequency").agg(
        gone.alias("excluded"), F.count("*").alias("records"))
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, view: str, key1, key2) -> DataFrame:
        return df.select(
            F.lit(view).alias("view"), key1.alias("key"), key2.alias("subkey"), "excluded", "records",
            F.when(F.col("records") > 0, F.round(100.0 * F.col("excluded") / F.col("records"), 6))
            .otherwise(0.0).alias("excluded_pct"))

    totals = F.sum("excluded").alias("excluded"), F.sum("records").alias("records")
    by_root = per_slice.join(small(contracts.select("contract_id", "root")), "contract_id", "left").groupBy(
        "root", "frequency").agg(*totals)
    by_rule = actions.filter(F.col("action").isin(REMOVING)).groupBy("rule_id", "action").agg(
        F.count_distinct("record_id").alias("excluded")).withColumn("records", F.lit(None).cast("bigint"))
    return shape(per_slice.agg(*totals), "overall", none, none).unionByName(
        shape(by_root, "root", F.col("root"), F.col("frequency"))
    ).unionByName(by_rule.select(
        F.lit("rule").alias("view"), F.col("rule_id").alias("key"), F.col("action").alias("subkey"),
        "excluded", "records", F.lit(None).cast("double").alias("excluded_pct")))


def changelog(
    actions: DataFrame, records: DataFrame, rules: DataFrame, contract_ids: list[str] | None = None,
    start=None, end=None,
) -> DataFrame:
    """Decisions counted per contract, session, grain, rule and action; one row each."""
    keyed = records.select("record_id", "contract_id", "trade_date", "frequency")
    if contract_ids:
        keyed = keyed.filter(F.col("contract_id").isin(contract_ids))
    if start is not None:
        keyed = keyed.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        keyed = keyed.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    labels = rules.select("rule_id", F.col("name").alias("label"))
    return keyed.join(small(actions), "record_id").groupBy(
        "contract_id", "trade_date", "frequency", "rule_id", "action"
    ).agg(F.count("*").alias("records")).join(F.broadcast(labels), "rule_id", "left")


def changelog_page(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page, newest session first; the caller counts ``log`` for the total."""
    return log.orderBy(F.desc("trade_date"), "contract_id", "rule_id", "action", "frequency").offset(
        offset).limit(limit)
