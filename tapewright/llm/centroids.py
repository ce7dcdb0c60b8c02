"""Centroid clustering over blocks of vectors in the order of a space-filling curve.

Vectors are taken as integers ``floor(256 x)``. Sorted along a Hilbert curve they are written once in blocks of neighbours,
one row a block, with the smallest and largest value of every component beside them: a zone map. In every round the
distances of the box to all centroids bound those of its vectors; a centroid whose least distance exceeds another's
largest can be nearest to none, and the vectors are compared with the remaining candidates alone, exactly. Tasks give back
sums per centroid, which Spark adds up; the new centroids, k rows, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.whitening import finite, rows_of
from tapewright.session import settle

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
#: Vectors of a block.
BLOCK = 256
#: Bits of every component that the curve looks at.
BITS = 3
#: Integers beyond this are taken as this.
LARGEST = 1 << 62
#: Up to this size all products of 64 components are exact in doubles.
EXACT = 1 << 22
LONG = (1 << 63) - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of every row of cell numbers below ``2 ** bits``, as big-endian bytes in rows.

    Skilling's transform, on all rows at once: undo the turns from the highest bit down, then Gray-code.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            up = (x[i] & np.uint32(q)) != 0
            swap = np.where(up, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    levels = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    return np.packbits(levels.reshape(bits * n, -1).T.astype(np.uint8), axis=1)


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of a box to every centroid."""
    low, high, c = low.astype(float), high.astype(float), centroids.astype(float)
    near = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(high - c))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box; doubles get a margin for their rounding."""
    near, far = box_bounds(low, high, centroids)
    return np.flatnonzero(near * (1 - 1e-9) <= far.min() * (1 + 1e-9))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances: by one product in doubles while all of it is below 2^53, else in Python integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and x.shape[1] <= WIDTH:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    c = centroids.astype(object)
    return np.array([[int(((row - own) ** 2).sum()) for own in c] for row in x.astype(object)], dtype=object).reshape(len(x), len(c))


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of every row; ties go to the smaller number."""
    own = candidates(low, high, centroids)
    found = distances(x, centroids[own])
    best = found.argmin(axis=1)
    return own[best], found[np.arange(len(x)), best]


def blocks_of(rows: DataFrame) -> DataFrame:
    """``(low, high, ids, raw, wide)`` of the rows ``(vec_id, x)``: blocks of neighbours along the curve.

    The curve's cells divide the range of every component evenly. Equal vectors are parted by their place in the
    input, so that a large group of copies fills many blocks and no single task.
    """
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ends = rows.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(WIDTH) for name, f in (("low", F.min), ("high", F.max))]).first()
    low = np.array([ends[f"low{i}"] or 0 for i in range(WIDTH)], dtype=float)
    span = np.maximum(np.array([ends[f"high{i}"] or 0 for i in range(WIDTH)], dtype=float) - low, 1) / (1 - 1e-12)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), WIDTH)
            cells = np.clip((x - low) / span * (1 << BITS), 0, (1 << BITS) - 1)
            key = [row.tobytes() for row in hilbert(cells)] if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], [*batch.schema.names, "key"])

    ordered = placed.select("vec_id", "x", "place").mapInArrow(keys, "vec_id long, x array<long>, place long, key binary").repartitionByRange(
        "key", "place").sortWithinPartitions("key", "place").select("vec_id", "x")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = rows_of(part.column(1), WIDTH)
                wide = bool(np.abs(x).max() >= 2**31)
                yield pa.RecordBatch.from_pydict({
                    "low": pa.array([x.min(axis=0)], pa.list_(pa.int64())), "high": pa.array([x.max(axis=0)], pa.list_(pa.int64())),
                    "ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    "raw": pa.array([x.astype("<i8" if wide else "<i4").tobytes()], pa.binary()), "wide": pa.array([wide])})

    return settle(ordered.mapInArrow(gather, "low array<long>, high array<long>, ids array<long>, raw binary, wide boolean"), "blocks")


def met(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors, nearest centroids and distances of every block."""
    for batch in batches:
        for block in batch.to_pylist():
            x = np.frombuffer(block["raw"], "<i8" if block["wide"] else "<i4").reshape(-1, WIDTH).astype(np.int64)
            yield block["ids"], x, *nearest(x, np.array(block["low"]), np.array(block["high"]), centroids)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means, empty ones as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), dtype=object)
        for _, x, cluster, _ in met(batches, centroids):
            for c in np.unique(cluster):
                own = x[cluster == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0) if np.abs(own).max() < 2**50 else own.astype(object).sum(axis=0)
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(np.repeat(held, WIDTH), pa.int32()), "at": pa.array(np.tile(np.arange(WIDTH), len(held)), pa.int32()),
                "n": pa.array(np.repeat(count[held], WIDTH)),
                "total": pa.array([int(v) for v in total[held].ravel()]).cast(pa.decimal128(38, 0))})

    sums = blocks.mapInArrow(run, "cluster int, at int, n long, total decimal(38,0)").groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose id has the smallest hash, in that order; equal ids by their vector."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.where(F.col("vec_id").isNotNull()).orderBy(order, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(-1, WIDTH)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    ``vectors``: vec_id and embedding. Vectors that are null, not of ``WIDTH`` components, or hold null or non-finite
    ones take no part. The first centroids are the ``k`` vectors with the smallest hash of ``salt`` and id, all if
    there are fewer; a null id has no hash, but its vector is assigned like any other. Repeated rows count as often
    as they occur. An empty table, or one without any id, gives no rows. Integers are cut at 2^62 and distances at 2^63 - 1.
    Other columns are not read.
    """
    usable = vectors.where(F.coalesce(F.size("embedding") == WIDTH, F.lit(False)) & finite(F.col("embedding")))
    edge = F.lit(float(LARGEST))
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
        "embedding", lambda c: F.greatest(-edge, F.least(edge, F.floor(c.cast("double") * 256).cast("double"))).cast("long")).alias("x"))
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    blocks = blocks_of(rows)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in met(batches, centroids):
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(number, pa.int32()),
                "distance": pa.array([min(int(d), LONG) for d in distance], pa.int64())})

    assigned = settle(blocks.select("low", "high", "ids", "raw", "wide").mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    own = {r["cluster"]: int(r["inertia"]) for r in total}
    named = [(c, min(v, LONG), min(sum(own.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, v in own.items()]
    facts = vectors.sparkSession.createDataFrame(named, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
