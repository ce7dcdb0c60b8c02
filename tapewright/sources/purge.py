"""Take back what one batch brought in."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BatchNotFound(LookupError):
    """No such batch."""


class BatchAlreadyPurged(ValueError):
    """The batch was purged before."""


@dataclass(frozen=True)
class Store:
    records: DataFrame
    rejects: DataFrame
    findings: DataFrame
    bars: DataFrame
    batches: DataFrame
    runs: DataFrame


def purge_batch(store: Store, batch_id: str) -> tuple[Store, DataFrame]:
    """The store without the batch, and one row of counts; the batch row stays as purged.

    Findings go when their run was scoped to the batch or their record was the batch's; bars
    go for the sessions it fed, at its own grain. An unknown batch and one purged before are
    refused, each by name.
    """
    held = store.batches.filter(F.col("batch_id") == batch_id).select("status").first()
    if held is None:
        raise BatchNotFound(batch_id)
    if held["status"] == "purged":
        raise BatchAlreadyPurged(batch_id)
    mine = store.records.filter(F.col("batch_id") == batch_id)
    ids = mine.select("record_id")
    runs = store.runs.filter(F.col("batch_id") == batch_id).select("run_id")
    fed = mine.select("contract_id", "trade_date", F.col("frequency").alias("source_frequency")).distinct()
    key = ["contract_id", "trade_date", "source_frequency"]
    kept_findings = store.findings.join(runs, "run_id", "left_anti").join(ids, "record_id", "left_anti")
    kept_bars = store.bars.join(fed, key, "left_anti")
    rejects = F.col("batch_id") == batch_id

    def n(df: DataFrame, name: str, sign: int = 1) -> DataFrame:
        return df.agg((F.count("*") * sign).alias("n")).select(F.lit(name).alias("measure"), "n")

    counts = n(mine, "records_deleted").unionByName(n(store.rejects.filter(rejects), "rejects_deleted"))
    for part in (
        n(store.findings, "findings_deleted"), n(kept_findings, "findings_deleted", -1),
        n(store.bars, "bars_deleted"), n(kept_bars, "bars_deleted", -1), n(fed, "sessions_affected"),
    ):
        counts = counts.unionByName(part)
    names = ["records_deleted", "rejects_deleted", "findings_deleted", "bars_deleted", "sessions_affected"]
    row = counts.agg(*[F.sum(F.when(F.col("measure") == m, F.col("n"))).alias(m) for m in names])
    status = F.when(F.col("batch_id") == batch_id, "purged").otherwise(F.col("status"))
    return replace(
        store, records=store.records.filter(F.col("batch_id") != batch_id), rejects=store.rejects.filter(~rejects),
        findings=kept_findings, bars=kept_bars, batches=store.batches.withColumn("status", status)), row
