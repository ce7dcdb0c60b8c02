"""Tables a reader of a run asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..catalogue import (
    RULES_BY_ID, SETTLEMENT_RULES, SUBJECT_FIELD, lookup, rule_dimension, severity_rank,
)
from ..session import settle, small

GROUPINGS = {"day": "trade_date", "contract": "contract_id", "dimension": "dimension", "frequency": "frequency"}


def list_findings(
    findings: DataFrame, *, contract_ids=None, start=None, end=None, frequency=None, rule_id=None, severity=None,
    status=None,
) -> DataFrame:
    """Findings that match the filters; count it for the total, page it to read."""
    for name, value in (("frequency", frequency), ("rule_id", rule_id), ("severity", severity), ("status", status)):
        if value is not None:
            findings = findings.filter(F.col(name) == value)
    if contract_ids:
        findings = findings.filter(F.col("contract_id").isin(contract_ids))
    if start is not None:
        findings = findings.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        findings = findings.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return findings


def findings_page(
    listed: DataFrame, records: DataFrame, batches: DataFrame, corroboration: DataFrame | None = None,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page, newest first, with the file and row of each finding and its corroboration.

    The page is cut before anything is looked up, so the records are only scanned for the
    few ids on it. The page is written first: its rows are read three times.
    """
    page = settle(listed.orderBy(F.desc("detected_at"), "finding_id").offset(offset).limit(limit), "findings-page")
    sources = records.select("record_id", "batch_id", "source_row").join(
        small(page.filter("record_id is not null").select("record_id").distinct()), "record_id", "left_semi")
    out = page.join(sources, "record_id", "left").join(small(batches.select("batch_id", "filename")), "batch_id", "left")
    if corroboration is not None:
        states = corroboration.select("finding_id", F.col("state").alias("corroboration"))
        out = out.join(states, "finding_id", "left")
    return out


def top_issues(findings: DataFrame, limit: int = 10) -> DataFrame:
    declared = lookup({r: RULES_BY_ID[r].severity for r in RULES_BY_ID}, F.col("rule_id"))
    return findings.groupBy("rule_id").agg(
        F.count("*").alias("findings"), F.sum("affected_rows").alias("affected_rows")
    ).withColumn("severity", declared).orderBy(F.desc("findings"), "rule_id").limit(limit)


def record_counts(records: DataFrame, rejects: DataFrame | None, batches: DataFrame) -> DataFrame:
    """Records in total, per grain and in live injected batches, and rows rejected at load."""
    live = batches.filter("origin = 'injected' and status <> 'purged'").select("batch_id", F.lit(True).alias("planted"))
    per = records.groupBy("frequency", "batch_id").agg(F.count("*").alias("n")).join(small(live), "batch_id", "left")
    rows = per.select(F.explode(F.array(
        F.struct(F.lit("total").alias("measure"), F.lit("all").alias("key"), F.col("n").alias("n")),
        F.struct(F.lit("frequency").alias("measure"), F.col("frequency").alias("key"), F.col("n").alias("n")),
        F.struct(F.lit("injected").alias("measure"), F.lit("all").alias("key"),
                 F.when(F.col("planted"), F.col("n")).otherwise(0).alias("n")),
    )).alias("c")).select("c.*")
    if rejects is not None:
        rows = rows.unionByName(rejects.agg(F.count("*").alias("n")).select(
            F.lit("rejected").alias("measure"), F.lit("all").alias("key"), "n"))
    return rows.groupBy("measure", "key").agg(F.sum("n").alias("records"))


def metrics_by(metrics: DataFrame, group: str, dimension: str | None = None) -> DataFrame:
    if dimension is not None:
        metrics = metrics.filter(F.col("dimension") == dimension)
    sums = ["expected_records", "actual_records", "affected_records", "finding_count"]
    return metrics.groupBy(F.col(GROUPINGS[group]).alias(group)).agg(
        *[F.sum(name).alias(name) for name in sums], rounded(F.avg("dimension_score"), 2).alias("dimension_score"))


def metrics_by_rule(findings: DataFrame) -> DataFrame:
    declared = lookup({r: RULES_BY_ID[r].severity for r in RULES_BY_ID}, F.col("rule_id"))
    return findings.groupBy("rule_id").agg(
        F.count("*").alias("finding_count"), F.sum("affected_rows").alias("affected_rows")
    ).withColumns({"dimension": rule_dimension(F.col("rule_id")), "severity": declared})


def _tallies(findings: DataFrame) -> DataFrame:
    """Open findings per contract, rule, grain and severity fired at."""
    name = lookup({r: RULES_BY_ID[r].name for r in RULES_BY_ID}, F.col("rule_id"))
    return findings.filter("status = 'open' and contract_id is not null").groupBy(
        "contract_id", "rule_id", "frequency", "severity").agg(F.count("*").alias("n")).withColumns(
        {"label": name, "rank": severity_rank(F.col("severity"))})


def contract_issues(findings: DataFrame) -> DataFrame:
    """Worst issue of each contract, and its worst settlement issue at daily grain."""
    settlement = F.col("rule_id").isin(SETTLEMENT_RULES) & (F.col("frequency") == "daily")
    issue = F.struct("rule_id", "label", "severity", F.col("n").alias("findings"))
    order = F.struct("rank", "n", "rule_id", "frequency")
    return _tallies(findings).groupBy("contract_id").agg(
        F.max_by(issue, order).alias("top_issue"),
        F.max_by(issue, F.when(settlement, order)).alias("settlement_issue"),
        F.sum("n").alias("finding_count"),
        F.bool_or(F.col("severity").isin("error", "critical")).alias("attention"))


def contract_rows(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per contract: worst slice score, attention flag, grains and issues."""
    rolled = scores.groupBy("contract_id").agg(
        F.min("overall").alias("score"), F.sort_array(F.collect_set("frequency")).alias("frequencies"))
    return rolled.join(contract_issues(findings), "contract_id", "left").select(
        "contract_id", "score", F.when(F.col("attention"), "ATTN").otherwise("OK").alias("status"), "frequencies",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"), "top_issue", "settlement_issue")


def worst_field(findings: DataFrame) -> DataFrame:
    """The field most findings accuse, with how many were considered and how many are open."""
    opened = findings.filter("status = 'open' and contract_id is not null")
    fields = opened.groupBy(lookup(SUBJECT_FIELD, F.col("rule_id")).alias("field")).agg(F.count("*").alias("n"))
    named = F.when(F.col("field").isNotNull(), F.struct("n", "field"))
    return fields.agg(
        F.max(named).alias("worst"), F.sum(F.when(F.col("field").isNotNull(), F.col("n"))).alias("considered"),
        F.sum("n").alias("total")
    ).filter("worst is not null").select(
        F.col("worst.field").alias("field"), F.col("worst.n").alias("findings"), "considered", "total")


def summary(scores: DataFrame, findings: DataFrame, records: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    """The relations of a dashboard page, each small."""
    return {
        "overall": scores.agg(rounded(F.avg("overall"), 1).alias("overall_score"),
                              F.count("*").alias("slices"), F.count("overall").alias("scored")),
        "slices": scores,
        "contracts": contract_rows(scores, findings),
        "worst_field": worst_field(findings),
        "records": record_counts(records, None, batches),
        "top_issues": top_issues(findings),
    }
