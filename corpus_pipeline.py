"""Documents to training sequences: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage gets what the one before kept and returns the columns of ``documents``; the last returns the pieces
of packed sequences. Stages are written as Parquet and read again, so a lost executor costs one stage at
most. Null texts pass through as the operators define; empty tables give empty results. A row is judged by its own
text whatever its id: where ids are null or repeated, rows get keys in the order of id (null last) and text, and no row goes
because another of the same id does. Of rows that are near duplicates, equal ones among them, the first in that order stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import decontaminate, minhash, packing, quality, queries, substring_dedup
from tapewright.session import settle, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours speak for label 1 (score 0.5 or more)."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).where("score >= 0.5").drop("score")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``key``: doc_id, or if some are null or repeated, a number of its own for every row.

    Numbers follow doc_id, then the text's hash; copies of a row are parted by their place, so no partition takes them all.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
    placed = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.drop("place").withColumn("key", F.monotonically_increasing_id()), "keyed")


def without(rows: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """``rows`` whose key is not among the doc_id of ``gone``."""
    keys = small(settle(gone.select(F.col("doc_id").alias("id")).distinct(), label))
    return rows.join(keys, F.col("key") == F.col("id"), "left_anti").select(COLUMNS)


def by_key(rows: DataFrame) -> DataFrame:
    """What an operator judges: the text under its key."""
    return rows.select(F.col("key").alias("doc_id"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of every group of near duplicates: links from a similarity of 0.8."""
    rows = keyed(docs.select(COLUMNS))
    return without(rows, minhash.near_duplicates(by_key(rows), percent=80).where("not kept"), "copies")


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus; n_chars follows the text."""
    rows = keyed(docs.select(COLUMNS)).withColumnsRenamed({"doc_id": "own_id", "key": "doc_id"})
    kept = substring_dedup.deduplicate(rows)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(F.col("own_id").alias("doc_id"), *COLUMNS[1:])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = keyed(docs.select(COLUMNS))
    return without(rows, decontaminate.contained(by_key(rows), queries.table(spark, sf_dir, "benchmark")), "leaks")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", first_passages),
    ("decontamination", without_leaks),
    ("packing", sequences),
]

#: Trained models, automata and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
