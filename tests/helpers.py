"""Small tapes written as text, taken through the real ingest path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.scope import Scope, Tables, build_scope
from tapewright.plans.assess import rule_findings
from tapewright.sources import ingest
from tapewright.sources.readers import BROKEN, FILE, ROW
from tapewright.sources.reference import contracts_from_symbols

MINUTE = ["contract", "timestamp", "open", "high", "low", "close", "volume"]
DAILY = ["contract", "date", "open", "high", "low", "close", "volume"]


def text_frame(spark: SparkSession, csv: str, header: list[str], name: str) -> DataFrame:
    rows = []
    for number, line in enumerate([x.strip() for x in csv.strip().splitlines() if x.strip()], 1):
        cells = [c.strip() or None for c in line.split(",")]
        rows.append((*cells, name, number, None))
    schema = ", ".join(f"{c} string" for c in [*header]) + f", {FILE} string, {ROW} bigint, {BROKEN} string"
    return spark.createDataFrame(rows, schema)


def records(spark: SparkSession, csv: str, frequency: str = "minute", batch: str = "b1",
            ingested_at: str = "2030-01-01") -> DataFrame:
    df = text_frame(spark, csv, MINUTE if frequency == "minute" else DAILY, batch)
    rows = ingest.to_targets(df, ingest.resolve_columns(df.columns))
    return ingest.type_records(rows, F.lit(batch), frequency, ingested_at=F.lit(ingested_at).cast("timestamp"),
                               first_id=int(batch.strip("b") or 0) * 1_000_000)


def tables(spark: SparkSession, tape: DataFrame, listing: dict[str, tuple] | None = None, **extra) -> Tables:
    contracts = contracts_from_symbols(tape.select("contract_id"))
    for contract, (first, last) in (listing or {}).items():
        mine = F.col("contract_id") == contract
        contracts = contracts.withColumn(
            "first_trade_date", F.when(mine, F.lit(first).cast("date")).otherwise(F.col("first_trade_date"))
        ).withColumn("last_trade_date", F.when(mine, F.lit(last).cast("date")).otherwise(F.col("last_trade_date")))
    batches = tape.select("batch_id", "frequency").distinct().withColumns({
        "filename": F.concat("batch_id", F.lit(".csv")), "origin": F.lit("upload"), "status": F.lit("succeeded"),
        "bar_interval": F.when(F.col("frequency") == "minute", "1 minute").otherwise("1 day"),
        "source_timezone": F.lit("America/Chicago")}).withColumn("inferred_interval", F.col("bar_interval"))
    return Tables(tape, contracts, batches, **extra)


def scope(spark: SparkSession, tape: DataFrame, overrides: dict | None = None, listing=None, **extra) -> Scope:
    return build_scope(spark, tables(spark, tape, listing, **extra), overrides=overrides or {})


def fire(sc: Scope, rule_id: str) -> list[dict]:
    """Findings of one rule with details parsed and the source row beside them, in row order."""
    rows = sc.tables.records.select("record_id", "source_row")
    found = rule_findings(sc, rule_id).join(rows, "record_id", "left").collect()
    out = [{**r.asDict(), "details": json.loads(r["details"])} for r in found]
    return sorted(out, key=lambda r: (r["source_row"] or 0, str(r["trade_date"]), str(r["ts_start_utc"])))


def minutes(contract: str, day: str, start: str, closes: list[float], volume: int = 100) -> str:
    """Consecutive one-minute bars, flat around each close."""
    hour, minute = (int(x) for x in start.split(":"))
    lines = []
    for i, close in enumerate(closes):
        at = hour * 60 + minute + i
        lines.append(f"{contract},{day} {at // 60:02d}:{at % 60:02d}:00,{close},{close + 1},{close - 1},{close},{volume}")
    return "\n".join(lines)

