"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample and indexes every vector. A query walks all trees through one
priority queue, ordered by the squares of its distances from the splits it crosses, until it has met enough leaves. How
many are enough is measured on the sample, where the true neighbours are known: clustered vectors need few leaves, vectors
without structure many, but never so many that the cosines would outnumber those of an exact search.
Neighbouring leaves make a cell. Vectors and queries of a cell meet in blocks of bounded size, where a query is compared,
exactly, with the leaves it chose; each block gives its best few, and the best of all blocks are ranked. Equal vectors are one candidate that lists its smallest ids, since only those can be
among the nearest. Vectors of every length have a forest of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.session import settle, small

#: Bound of the sample on which splits are fitted.
SAMPLE = 20_000
TREES = 4
#: Vectors in a leaf, about, while ``MAX_DEPTH`` allows; a table that fits ``ONE_LEAF`` is not split.
LEAF = 125
ONE_LEAF = 500
MAX_DEPTH = 20
#: Recall that the share of leaves is chosen for, on so many vectors of the sample.
TARGET = 0.95
ASKED = 150
#: Largest sum over the trees of the shares of leaves that a query meets: below an exact search.
MOST = 0.98
#: Levels of a tree that one cell spans: 32 leaves at most.
CELL_LEVELS = 5
#: Vectors of one cell that one block holds; a fuller cell is cut into several.
BLOCK = 4096
#: Query vectors that one block holds; more are cut likewise.
QUERY_BLOCK = 4096


@dataclass
class Forest:
    """``planes[tree, level]`` is a direction; ``cuts[tree][level][node]`` splits the node at that level."""

    planes: np.ndarray
    cuts: list[list[np.ndarray]]
    spread: np.ndarray

    @property
    def depth(self) -> int:
        return self.planes.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for tree, planes in enumerate(self.planes):
            side = x @ planes.T
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = 2 * node + (side[:, level] > self.cuts[tree][level][node])
            out[:, tree] = node
        return out

    def search(self, x: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` of the first ``probes`` leaves that one queue over all trees yields."""
        side = np.einsum("tld,d->tl", self.planes, x)
        heap = [(0.0, tree, 0, 0) for tree in range(len(self.planes))]
        found: list[tuple[int, int]] = []
        while heap and len(found) < probes:
            cost, tree, level, node = heapq.heappop(heap)
            while level < self.depth:
                gap = (side[tree, level] - self.cuts[tree][level][node]) / self.spread[tree, level]
                heapq.heappush(heap, (cost + gap * gap, tree, level + 1, 2 * node + (gap <= 0)))
                node, level = 2 * node + int(gap > 0), level + 1
            found.append((tree, node))
        return found


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, *, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Median splits along random directions; the depth follows the number of rows to be indexed.

    A node that holds fewer than eight vectors of the sample splits at the median of its level.
    """
    rng = np.random.default_rng(seed)
    depth = 0 if rows <= ONE_LEAF else int(min(MAX_DEPTH, np.ceil(np.log2(rows / leaf))))
    x = unit(sample)
    planes = rng.normal(size=(trees, depth, sample.shape[1]))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    cuts, spread = [], np.ones((trees, depth))
    for tree in range(trees):
        side = x @ planes[tree].T
        node = np.zeros(len(x), dtype=np.int64)
        levels = []
        for level in range(depth):
            along = side[:, level]
            spread[tree, level] = max(float(along.std()), 1e-12)
            cut = np.full(1 << level, float(np.median(along)))
            order = np.lexsort((along, node))
            held = np.bincount(node, minlength=1 << level)
            first = np.cumsum(held) - held
            for n in np.flatnonzero(held >= 8):
                cut[n] = float(np.median(along[order[first[n]:first[n] + held[n]]]))
            levels.append(cut)
            node = 2 * node + (along > cut[node])
        cuts.append(levels)
    return Forest(planes, cuts, spread)


def share_for(sample: np.ndarray, k: int, *, trees: int = TREES, target: float = TARGET, asked: int = ASKED) -> float:
    """Share of all leaves a query must meet so that ``target`` of the k nearest of the sample are found, by its own forest.

    In a larger table neighbours lie nearer than in its sample, so the share rather errs upwards. ``MOST`` bounds it.
    """
    x = unit(sample)
    forest = fit(sample, len(sample), trees=trees)
    leaf, total = forest.leaves(x), trees * 2 ** forest.depth
    met = []
    for i in np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int):
        cosine = x @ x[i]
        cosine[i] = -2
        near = np.argsort(-cosine, kind="stable")[:min(k, len(x) - 1)]
        place = np.zeros((trees, 2 ** forest.depth), np.int64)
        for n, (tree, node) in enumerate(forest.search(x[i], total)):
            place[tree, node] = n
        met += [min(place[t, leaf[j, t]] for t in range(trees)) + 1 for j in near]
    if not met:
        return 1 / trees
    return float(min(MOST / trees, np.sort(met)[int(np.ceil(target * len(met))) - 1] / total))


def usable(vector: Column) -> Column:
    """Not null or zero, no null, NaN or infinite component."""
    fine = F.forall(vector, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, share: float | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows found for every query row, itself left out.

    ``vectors``: vec_id and embedding; ``is_query`` is a condition on vec_id; ``share`` of the leaves, measured if not given. Rows that ``usable`` refuses and
    rows without an id take no part; neighbours are of the query's own length. Ties go to the smaller
    id; repeated ids are rows of their own but never neighbours of their own id. An empty table gives no rows; fewer candidates than k give
    as many rows as there are. Other columns are not read.
    """
    real = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = real.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    found = [of_length(real.where(F.size("v") == d), is_query, k, share, rows) for d, rows in sizes if rows > 1]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def of_length(real: DataFrame, is_query: Column, k: int, share: float | None, rows: int) -> DataFrame:
    """``search`` among ``rows`` usable vectors of one length."""
    spark = real.sparkSession
    rank = Window.partitionBy("v").orderBy("vec_id")
    few = real.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1)
    classes = settle(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "ids", "v"), "classes")
    asked = settle(real.where(is_query), "asked")
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toPandas()
    points = matrix(sample.v)
    forest = spark.sparkContext.broadcast(fit(points, rows))
    trees = len(forest.value.planes)
    probes = max(1, int((share_for(points, k) if share is None else share) * trees * 2 ** forest.value.depth))

    shift = min(CELL_LEVELS, forest.value.depth)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            leaf = forest.value.leaves(unit(matrix(f.v))) if len(f) else np.zeros((0, trees), np.int64)
            yield pd.DataFrame({
                "tree": np.tile(np.arange(trees), len(f)), "cell": leaf.ravel() >> shift, "leaf": leaf.ravel(),
                "rep": np.repeat(f.rep.to_numpy(), trees)})

    placed = settle(classes.select("rep", "v").mapInPandas(place, "tree int, cell long, leaf long, rep long"), "placed")
    order = small(settle(placed.groupBy("tree", "cell").count().select(
        "tree", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "cells"))
    index = placed.join(order, ["tree", "cell"]).join(classes.select("rep", "ids", "v"), "rep").select(
        "tree", "cell", "leaf", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "ids", "v")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rep, v in zip(f.rep, matrix(f.v), strict=True):
                chosen: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in forest.value.search(v / np.linalg.norm(v), probes):
                    chosen.setdefault((tree, leaf >> shift), []).append(leaf)
                yield pd.DataFrame({"tree": [c[0] for c in chosen], "cell": [c[1] for c in chosen], "leaves": list(chosen.values()), "q": rep})

    questions = classes.select("rep", "ids", "v").join(
        asked.select("v").distinct().withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left_semi").select("rep", "v")
    walked = settle(questions.mapInPandas(walk, "tree int, cell long, leaves array<long>, q long"), "walked")
    wide = small(settle(walked.groupBy("tree", "cell").count().select(
        F.col("tree").alias("t"), F.col("cell").alias("l"), F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("parts")), "asked-cells"))
    probesets = walked.join(order, ["tree", "cell"]).join(
        wide, (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("l"))).join(
        questions.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q").select(
        "tree", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), "leaves", "q", "qv")
    spread = index.join(wide, (F.col("tree") == F.col("t")) & (F.col("cell") == F.col("l"))).select(
        "tree", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "rep", "ids", "v")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"q": [], "rep": [], "score": []}
        if len(left) and len(right):
            right = right.sort_values("leaf", kind="stable")
            b = unit(matrix(right.v))
            reps, leaf = right.rep.to_numpy(), right.leaf.to_numpy()
            for i in range(0, len(left), 256):
                part = left.iloc[i:i + 256]
                a = unit(matrix(part.qv))
                asks = np.repeat(np.arange(len(part)), part.leaves.map(len))
                wanted = np.concatenate(part.leaves.to_list())
                cosine = np.full((len(part), len(b)), -np.inf)
                for node in np.unique(wanted):
                    x, y = np.searchsorted(leaf, (node, node + 1))
                    rows = asks[wanted == node]
                    cosine[rows, x:y] = a[rows] @ b[x:y].T
                for q, row in zip(part.q, cosine, strict=True):
                    best = top(row, reps, k + 1)
                    best = best[row[best] > -np.inf]
                    columns["q"] += [q] * len(best)
                    columns["rep"] += reps[best].tolist()
                    columns["score"] += row[best].tolist()
        return pd.DataFrame(columns)

    keys = ["tree", "cell", "block", "part"]
    met = probesets.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(meet, "q long, rep long, score double")
    best = met.groupBy("q", "rep").agg(F.max("score").alias("score"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    answers = ranked.join(classes.select("rep", "ids", "v"), "rep").groupBy("q").agg(
        F.collect_list(F.struct("score", "ids", "v")).alias("near"))
    reps = classes.select(F.col("rep").alias("q"), F.col("v").alias("w"))
    final = asked.join(reps, F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), "q", "v").join(answers, "q")
    exact = final.select("query_id", F.explode("near").alias("c"), F.col("v").alias("a")).select(
        "query_id", cosine_of(F.col("a"), F.col("c.v")).alias("score"), F.explode("c.ids").alias("vec_id")).where("vec_id <> query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine in double precision, summed in component order."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top(row: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """The k largest, ties to the smaller id."""
    if len(row) > k:
        floor = np.partition(row, len(row) - k)[len(row) - k]
        keep = np.flatnonzero(row >= floor)
    else:
        keep = np.arange(len(row))
    return keep[np.lexsort((reps[keep], -row[keep]))][:k]
