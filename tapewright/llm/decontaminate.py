"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles. An item with n shingles of which a share t must
appear can miss at most n - ceil(t n) of them, so its n - ceil(t n) + 1 smallest shingle hashes, its bottom
MinHash sketch, cannot all be missing: the sketch size follows the partition, and no contained item is lost
however long the document is. Documents that hold a sketch hash are candidates; containment is then
counted on full shingle sets. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import settle, small

WIDTH = 5
THRESHOLD = 0.8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda an expression would run for every element."""
    return F.transform(F.array(value), body)[0]


def hashes(words: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, in text order; none if there are fewer words."""
    def runs(own: Column) -> Column:
        count = F.size(own) - (width - 1)
        return F.when(count > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, width))
        )).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), runs)


def item_sets(items: DataFrame) -> DataFrame:
    """``(item_id, width, n, need, shingles)``: distinct shingle hashes in ascending order.

    An item with fewer words than ``WIDTH`` is one shingle of that many words; one without words is left out.
    """
    words = items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    cases = F.lit(None).cast("array<bigint>")
    for width in range(1, WIDTH + 1):
        cases = F.when(F.col("width") == width, hashes(F.col("w"), width)).otherwise(cases)
    sets = sized.select("item_id", "width", F.array_sort(F.array_distinct(cases)).alias("shingles"))
    n = F.size("shingles")
    return sets.select("item_id", "width", n.alias("n"), F.ceil(n * F.lit(THRESHOLD) - 1e-9).cast("int").alias("need"), "shingles")


def sketches(sets: DataFrame) -> DataFrame:
    """``(width, h, item_id)``: the bottom sketch of every item, as large as its size partition asks.

    The partition of n is the power of two at or above it; all its items get the sketch of its largest size,
    bounded by their own number of shingles.
    """
    edge = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    depth = F.least(F.col("n"), (edge - F.ceil(edge * THRESHOLD - 1e-9) + 1).cast("int"))
    own = F.greatest(depth, F.col("n") - F.col("need") + 1)
    return sets.select("width", "item_id", F.explode(F.slice("shingles", F.lit(1), own)).alias("h"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, shared, n_shingles, containment)`` for every document that holds an item.

    An item is held if at least ``THRESHOLD`` of its distinct shingles occur in the document. Null or empty
    texts hold nothing; null ids match themselves; of repeated ids the best document counts; repeated items
    each count for their id; other columns are not read; empty tables give no rows. Sketches and candidates
    are broadcast only after they were counted, beyond that the joins shuffle.
    """
    sets = settle(item_sets(items), "items")
    probes = small(settle(sketches(sets), "sketches"))
    widths = [r[0] for r in sets.select("width").distinct().collect()]
    read = docs.select("doc_id", "text")
    words = read.select("doc_id", tokens(F.col("text")).alias("w"))
    found = None
    for width in sorted(widths):
        runs = words.select("doc_id", F.lit(width).alias("width"), F.explode(hashes(F.col("w"), width)).alias("h"))
        hit = runs.join(probes, ["width", "h"]).select("doc_id", "item_id")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = read.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0)
    pairs = settle(found.distinct(), "pairs")
    wanted = small(pairs.select(F.col("doc_id").alias("id")).distinct())
    texts = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    runs = F.array(*[F.struct(F.lit(width).alias("width"), hashes(F.col("w"), width).alias("h")) for width in sorted(widths)]) \
        if widths else F.array().cast("array<struct<width:int,h:array<bigint>>>")
    full = texts.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.explode(runs).alias("r")).select(
        F.col("doc_id").alias("id"), F.col("r.width").alias("w"), F.array_distinct("r.h").alias("in_doc"))
    items_of = small(sets.select(F.col("item_id").alias("item"), "width", "n", "need", "shingles"))
    checked = pairs.join(items_of, F.col("item_id").eqNullSafe(F.col("item"))).join(
        full, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("width") == F.col("w"))).select(
        "doc_id", "item_id", F.size(F.array_intersect("shingles", "in_doc")).alias("shared"), "n", "need")
    return checked.where("shared >= need").groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("shared") / F.col("n")).alias("containment"), "shared", F.col("n").alias("n_shingles"))).alias("best")).select(
        "doc_id", "item_id", F.col("best.shared").cast("long").alias("shared"),
        F.col("best.n_shingles").cast("long").alias("n_shingles"), F.col("best.containment").alias("containment"))
