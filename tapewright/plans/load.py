"""From vendor files to typed records, rejects and a batch row, in one call and one scan.

Every line is parsed once. What it became, record or reject, is written once, with its place in its split; row numbers and
ids follow from the counts per split of what was written, so nothing is read twice to number it.
"""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..session import scratch_path, settle, small
from ..sources import ingest, landing
from ..sources.readers import BASE, BROKEN, FILE, ROW, split_offsets, text_lines


@dataclass
class Loaded:
    """``records`` and ``rejects`` as ``type_records`` and ``route_rejects`` give them, and one row per batch."""

    records: DataFrame
    rejects: DataFrame
    batch: DataFrame
    layouts: list[ingest.Layout]


def load_lines(
    parts: list[DataFrame], batch_id: str, frequency: str, *, timezone: str = clock.CHICAGO, ingested_at: str | None = None,
    first_id: int = 0, profiles: dict[str, dict] | None = None,
) -> Loaded:
    """Load text rows as ``text_lines`` reads them; every part has columns, and so a layout, of its own."""
    spark = parts[0].sparkSession
    at = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp")
    layouts, judged = [], []
    for lines in parts:
        layout = ingest.resolve_columns([c for c in lines.columns if c != "_block"], profiles)
        layouts.append(layout)
        data = [c for c in lines.columns if c not in (FILE, BROKEN, "_block")]
        placed = lines.select(*data, BROKEN, F.struct(FILE, "_block").alias(FILE), F.monotonically_increasing_id().alias(ROW))
        rows = ingest.to_targets(placed, layout).withColumn("reason_code", ingest.reject_reason())
        judged.append(rows.select(
            F.col(f"{FILE}.{FILE}").alias(FILE), F.col(f"{FILE}._block").alias("_block"), F.col(ROW).alias("_id"), "reason_code",
            F.when(F.col("reason_code").isNotNull(), ingest.reject_detail()).alias("reason_detail"),
            F.when(F.col("reason_code").isNotNull(), F.col("raw_payload")).alias("raw_payload"),
            *ingest.typed_columns(frequency, timezone, at),
            F.when(F.col("reason_code").isNull(), "record").otherwise("reject").alias("kind")))
    whole = reduce(DataFrame.unionByName, judged)
    path = scratch_path(spark, "load")
    whole.write.partitionBy("kind").parquet(path)
    written = spark.read.schema(whole.schema).parquet(path)
    offsets = small(settle(split_offsets(written.select(FILE, "_block", "_id")), "splits"))
    numbered = written.join(offsets, [FILE, "_block"]).withColumn(ROW, F.col("_id") - F.col("_first") + F.col("_offset") + 1)
    fields = [c for c in whole.columns if c not in (FILE, "_block", "_id", "reason_code", "reason_detail", "raw_payload", "kind")]
    batch = F.lit(batch_id).alias("batch_id")
    records = numbered.filter("kind = 'record'").select(
        (F.lit(first_id) + F.col(BASE) + F.col(ROW)).cast("bigint").alias("record_id"), batch, F.col(ROW).cast("bigint").alias(ROW), *fields)
    rejects = numbered.filter("kind = 'reject'").select(
        batch, F.col(ROW).cast("bigint").alias(ROW), "reason_code", "reason_detail", "raw_payload")
    opened = spark.range(1).select(
        batch, F.lit(frequency).alias("frequency"), F.lit("running").alias("status"), F.lit(timezone).alias("source_timezone"),
        F.lit(json.dumps([{"profile": x.profile, "columns": x.mapping, "declined": x.declined} for x in layouts])).alias("column_mapping"),
        at.alias("ingested_at"))
    return Loaded(records, rejects, ingest.batch_summary(records, rejects, opened), layouts)


def load_csv(spark: SparkSession, path: str, batch_id: str, frequency: str, **options) -> Loaded:
    """Load every CSV file below ``path``; files of one header are read together, each header under its own layout.

    The headers are a table of a row per file, read ahead of the scan from the first bytes of each file. A folder without
    files, or a header that lacks required fields, is refused.
    """
    heads = landing.headers(spark, path).filter(F.col("path").rlike(r"(?i)[.](csv|txt)$"))
    found = heads.groupBy("header").agg(F.count("*").alias("files")).orderBy("header").collect()
    if not found:
        raise FileNotFoundError(f"no CSV files below {path}")
    parts = []
    for row in found:
        names = next(csv.reader([row["header"]]))
        mine = path if len(found) == 1 else [r["path"] for r in heads.filter(F.col("header") == row["header"]).select("path").collect()]
        parts.append(text_lines(spark, mine, names, header=True))
    return load_lines(parts, batch_id, frequency, **options)
