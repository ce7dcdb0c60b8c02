"""Connected components of a link table, and rows of one key in Python tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.session import settle


def key_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first column (long, sorted) at a time, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def forest(links: Iterable[tuple[int, int]], nodes: int) -> list[tuple[int, int]]:
    """Links that join two parts not yet joined, in the order given."""
    root = list(range(nodes))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join the same nodes as ``links``: each node with the smallest one reachable."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in root if top(x) != x]


def link_batches(found: Iterable[list[tuple[int, int]]], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Links of one task as ``(a, b)``; what meets in the task is joined there, ``most`` links and one list more at a time."""
    held: list[tuple[int, int]] = []

    def batch() -> pa.RecordBatch:
        joined = stars(held)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in joined], pa.int64()) for i in (0, 1)], ["a", "b"])

    for links in found:
        held += links
        if len(held) > most:
            yield batch()
            held = []
    if held:
        yield batch()


def all_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges (a, b)`` hangs on one other that hangs on none."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("n").agg((F.sum("up") + F.max("down")).alias("ends"), F.max("up").alias("up")).where("up = 1 and ends > 1")
    return odd.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``links (a, b)``; comp is the smallest node reachable.

    Alternating large and small stars: every step hangs the neighbours of a node on its smallest neighbour,
    which needs one minimum and one join per step and a number of steps that grows with the logarithm of
    the longest chain. Every step is written, so nothing is recomputed from the start.
    """
    a, b = F.col("a"), F.col("b")
    edges = settle(links.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while not all_stars(edges):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        wide = both.join(least, a == F.col("n")).where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        wide = settle(wide.where("a <> b"), "large-star")
        lowest = wide.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        near = wide.join(lowest, a == F.col("n"))
        edges = settle(
            near.select(b.alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("n").alias("a"), F.col("m").alias("b")))
            .where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "small-star")
    return edges.select(a.alias("node"), b.alias("comp")).unionByName(edges.select(b.alias("node"), b.alias("comp")).distinct())
