"""A rule pass, and the full assessment built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import ENGINE_RULES, MIN_RECORDS, RULES, RULES_BY_ID, SEVERITY_RANK
from ..operators.cleaning import cleaning_actions
from ..operators.findings import FINDING_SCHEMA
from ..operators.reconcile import RECONCILIATION_RULES
from ..operators.record_rules import RECORD_RULES, record_findings
from ..operators.scope import Scope
from ..operators.scoring import all_metrics, dimension_scores, overall_score
from ..operators.series_rules import OUTLIER_RULES, SERIES_RULES, outliers
from ..operators.session_rules import SESSION_RULES, RuleRefused
from ..session import literal_table, scratch_path, together

SET_RULES = {**SERIES_RULES, **SESSION_RULES, **RECONCILIATION_RULES}


def graded(found: DataFrame, scope: Scope, rule_ids: list[str]) -> DataFrame:
    """Findings under the severities a deployment has set: ``severity`` among a rule's overrides replaces the declared one."""
    for rule_id in rule_ids:
        wanted = scope.params(rule_id).get("severity")
        declared = RULES_BY_ID[rule_id].severity
        if wanted is not None and wanted != declared:
            if wanted not in SEVERITY_RANK:
                raise ValueError(f"unknown severity {wanted!r} of {rule_id}")
            own = (F.col("rule_id") == rule_id) & (F.col("severity") == declared)
            found = found.withColumn("severity", F.when(own, wanted).otherwise(F.col("severity")))
    return found


def rule_findings(scope: Scope, rule_id: str) -> DataFrame:
    """Findings of one rule; raises RuleRefused when an input it needs is absent."""
    if rule_id in RECORD_RULES:
        found = record_findings(scope, [rule_id])
    elif rule_id in OUTLIER_RULES:
        found = outliers(scope, [rule_id])
    else:
        found = SET_RULES[rule_id](scope)
    return graded(found, scope, [rule_id])


def run_rules(
    scope: Scope, rule_ids: list[str] | None = None, run_id: str = "run-1",
    detected_at: str = "1970-01-01 00:00:00",
) -> tuple[DataFrame, DataFrame]:
    """Write the findings of every enabled rule; return them and the refusals, which are not zero findings.

    All record rules share one scan and the outlier rules their medians; each other rule adds
    its own aggregate or window. The parts are independent writes under one folder, so none of
    them waits for, or is planned together with, another.
    """
    wanted = [
        rule for rule in ENGINE_RULES
        if (rule_ids is None or rule in rule_ids) and scope.params(rule).get("enabled", True)
    ]
    builds: dict[str, Callable[[], DataFrame]] = {}
    for name, family, evaluate in (("outlier", OUTLIER_RULES, outliers), ("record", RECORD_RULES, record_findings)):
        members = [rule for rule in wanted if rule in family]
        if members:
            builds[name] = lambda evaluate=evaluate, members=members: graded(evaluate(scope, members), scope, members)
    for rule in wanted:
        if rule in SET_RULES:
            builds[rule] = lambda rule=rule: graded(SET_RULES[rule](scope), scope, [rule])
    path = scratch_path(scope.spark, "findings")
    stamp = {"run_id": F.lit(run_id), "status": F.lit("open"), "detected_at": F.lit(detected_at).cast("timestamp")}

    def write(name: str) -> tuple[str, str] | None:
        try:
            builds[name]().withColumns(stamp).write.parquet(f"{path}/part={name}")
        except RuleRefused as reason:
            return name, str(reason)
        return None

    refused = [outcome for outcome in together([lambda name=name: write(name) for name in builds]) if outcome]
    if len(refused) == len(builds):
        found = scope.spark.createDataFrame([], FINDING_SCHEMA)
    else:
        found = scope.spark.read.schema(FINDING_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    return found, literal_table(scope.spark, "rule_id string, reason string", refused)


def rule_counts(findings: DataFrame, refusals: DataFrame) -> DataFrame:
    """Findings per evaluated rule and severity, refusals told apart."""
    order = literal_table(findings.sparkSession, "rule_id string, position int",
                          [(rule.rule_id, i) for i, rule in enumerate(RULES) if rule.rule_id in ENGINE_RULES])
    counts = findings.groupBy("rule_id").agg(
        F.count("*").alias("findings"), F.sum("affected_rows").alias("affected_rows"))
    return order.join(counts, "rule_id", "left").join(refusals, "rule_id", "left").select(
        "rule_id", "position",
        F.when(F.col("reason").isNotNull(), "refused").otherwise("evaluated").alias("outcome"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"), "reason")


@dataclass
class Assessment:
    scope: Scope
    findings: DataFrame
    refusals: DataFrame
    metrics: DataFrame
    dimensions: DataFrame
    scores: DataFrame
    actions: DataFrame


def assess(
    scope: Scope, run_id: str = "run-1", detected_at: str = "1970-01-01 00:00:00",
    min_records: int = MIN_RECORDS,
) -> Assessment:
    """Rules, metrics, scores and cleaning over one scope; findings are written once."""
    found, refusals = run_rules(scope, run_id=run_id, detected_at=detected_at)
    dimensions = dimension_scores(scope, found)
    return Assessment(
        scope, found, refusals, all_metrics(scope, found), dimensions,
        overall_score(scope, dimensions, min_records), cleaning_actions(found, scope.tables.actions))
