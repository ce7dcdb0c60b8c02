"""b-bit MinHash near-duplicates with exact confirmation.

Of every document's shingle set ``HASHES`` minima are taken. Bands of whole minima make buckets; inside a
bucket two bits of every minimum, mixed first so that they follow no class of shingles, are packed in 64
bytes and give a similarity estimate by bit counts, corrected for chance agreement. A bucket yields a
spanning forest of the pairs that may be similar, never all of them. The resulting groups hold every link;
their full sets then meet in square blocks of bounded size, where exact intersections come from one matrix
product, and each block again yields a spanning forest, now of true links. Texts with equal sets are one
node throughout.

The miss probability of a pair at the threshold is (1 - 0.85^5)^40 = 7e-11 for the bands and 4.4e-9 for the
estimate: the binomial tail below the floor of ``SIGMAS``, with minima taken as independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.graph import components, forest, key_runs, link_batches
from tapewright.llm.words import mix, shingles, slices, utf8, words_of
from tapewright.session import settle, small

HASHES = 256
BANDS = 40
ROWS = 5
BITS = 2
#: Nodes of one bucket or group in one block.
BLOCK = 2048
EXACT_BLOCK = 256
#: Deviations that the estimate of a pair at the threshold may fall short of it.
SIGMAS = 6.5
#: Shingles in one matrix product.
COLUMNS = 4096
_random = np.random.default_rng(20_231)
_SCALE = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = np.uint64(0x5555555555555555)


def set_hash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, whatever its order."""
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(mix(sets + np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    size = np.diff(offsets).astype(np.uint64)
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size * np.uint64(0x9E3779B97F4A7C15))


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x HASHES minima; rows of empty sets are all ones."""
    real = np.flatnonzero(np.diff(offsets) > 0)
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(real):
        x = (mix(sets) >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[real, k] = np.minimum.reduceat(x * _SCALE[k] + _SHIFT[k], offsets[:-1][real])
    return out


def packed(signatures: np.ndarray) -> np.ndarray:
    """Bits of all mixed minima in 64-bit words."""
    low = (mix(signatures.astype(np.uint64)) >> np.uint64(64 - BITS)).reshape(len(signatures), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every row of ``a`` with every row of ``b`` from equal bit pairs, less chance agreement."""
    other = np.zeros((len(a), len(b)), np.uint32)
    for word in range(a.shape[1]):
        x = a[:, word, None] ^ b[None, :, word]
        other += np.bitwise_count((x | (x >> np.uint64(1))) & _ODD)
    chance = 1 / 2 ** BITS
    return ((HASHES - other) / HASHES - chance) / (1 - chance)


def floor_of(percent: int) -> float:
    """The least estimate of a pair that is checked exactly for ``percent``."""
    chance = 1 / 2 ** BITS
    same = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * (same * (1 - same) / HASHES) ** 0.5 / (1 - chance)


def sign(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, node, low, bands)`` of every row: set size, set hash (null if empty), packed bits, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, offsets = utf8(batch.column(1).slice(a, b - a))
                sets, first = shingles(words_of(data, offsets, lower=True))
                m = minima(sets, first)
                n = np.diff(first)
                key = np.zeros((b - a, BANDS), np.uint64)
                for row in range(ROWS):
                    key = mix(key + m[:, row:BANDS * ROWS:ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
                empty = n == 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(np.where(empty, 0, BANDS)))).astype(np.int32)),
                    pa.array(key[~empty].ravel().view(np.int64)))
                low = packed(m).astype("<u8")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n), pa.array(set_hash(sets, first).view(np.int64), mask=empty),
                    pa.array([row.tobytes() for row in low], pa.binary()), lists], ["doc_id", "n", "node", "low", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, node long, low binary, bands array<long>")


def blocks(rows: DataFrame, key: str, size: str, width: int) -> DataFrame:
    """Rows with ``k`` and ``side`` for every block pair of their key: a key of more than ``width`` rows is cut.

    Rows of one block meet each other in pair (i, i); rows of two blocks meet in pair (i, j), sides 0 and 1.
    """
    cut = F.ceil(F.col(size) / width).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), cut).cast("int")
    cells = F.transform(F.sequence(F.lit(0), cut - 1), lambda j: F.struct(
        F.xxhash64(F.col(key), F.least(own, j), F.greatest(own, j)).alias("k"), (own > j).cast("int").alias("side"),
        (own != j).alias("cross")))
    return rows.withColumn("cell", F.explode(cells)).select("cell.k", "cell.side", "cell.cross", *rows.columns)


def candidates(nodes: DataFrame, bands: DataFrame, floor: float) -> DataFrame:
    """``(a, b)`` that connect all nodes sharing a bucket whose estimate is ``floor`` or more."""
    exploded = bands.select("node", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").count().where(F.col("count") > 1)
    shared = exploded.join(buckets.withColumnRenamed("band", "bucket"), F.col("band") == F.col("bucket")).select("node", "band", "count")
    rows = shared.join(nodes.select(F.col("node").alias("n"), "low"), F.col("node") == F.col("n")).select("node", "band", "count", "low")
    met = blocks(rows, "band", "count", BLOCK).select("k", "side", "cross", "node", "low")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
        for t in key_runs(batches):
            node = t.column("node").to_numpy()
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), "<u8").reshape(len(node), -1)
            side = t.column("side").to_numpy()
            cross = t.column("cross").to_numpy()
            left = np.flatnonzero(~cross | (side == 0))
            right = np.flatnonzero(~cross | (side == 1))
            pairs: list[tuple[int, int]] = []
            for i in range(0, len(left), 256):
                rows, cols = np.nonzero(estimate(low[left[i:i + 256]], low[right]) >= floor)
                a, b = left[rows + i], right[cols]
                real = (a != b) & ((a < b) | cross[a])
                pairs = forest(chain_pairs(pairs, a[real], b[real]), len(node))
            yield [(int(node[a]), int(node[b])) for a, b in pairs]

    return met.repartition("k").sortWithinPartitions("k").mapInArrow(lambda batches: link_batches(found(batches)), "a long, b long")


def chain_pairs(kept: list[tuple[int, int]], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from kept
    yield from zip(a.tolist(), b.tolist(), strict=True)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Intersection sizes of all sets of ``left`` with all of ``right`` (or of ``left``)."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = often[which] > 1
    column = (np.cumsum(often > 1) - 1)[which[common]]
    owner = owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(left)
    total = np.zeros((n, len(right) if right else n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        total += m[:n] @ (m[n:] if right else m).T
    return total.astype(np.int64)


def confirmed(docs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` that connect what true links connect inside ``groups (doc_id, node, comp, size)``."""
    wanted = small(settle(groups.select(F.col("doc_id").alias("id"), "node", "comp", "size"), "groups"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select(
        "text", "node", "comp", "size")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                data, offsets = utf8(part.column(0))
                sets, first = shingles(words_of(data, offsets, lower=True))
                same = set_hash(sets, first).view(np.int64) == part.column(1).to_numpy()
                raw = pa.array([sets[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], raw], ["node", "comp", "size", "members"]).filter(pa.array(same))

    held = texts.mapInArrow(sets_of, "node long, comp long, size long, members binary").dropDuplicates(["node"])
    met = blocks(held, "comp", "size", EXACT_BLOCK).select("k", "side", "cross", "node", "members")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
        for t in key_runs(batches):
            node = t.column("node").to_numpy()
            members = [np.frombuffer(m, np.uint64) for m in t.column("members").to_pylist()]
            size = np.array([len(m) for m in members])
            cross = bool(t.column("cross")[0].as_py())
            side = t.column("side").to_numpy()
            left = np.flatnonzero(side == 0) if cross else np.arange(len(node))
            right = np.flatnonzero(side == 1) if cross else left
            if not len(left) or not len(right) or len(node) < 2:
                continue
            both = shared_counts([members[i] for i in left], [members[i] for i in right] if cross else None)
            rows, cols = np.nonzero(100 * both >= percent * (size[left][:, None] + size[right][None, :] - both))
            a, b = left[rows], right[cols]
            real = (a != b) if cross else (a < b)
            links = forest(zip(a[real].tolist(), b[real].tolist(), strict=True), len(node))
            yield [(int(node[x]), int(node[y])) for x, y in links]

    return met.repartition("k").sortWithinPartitions("k").mapInArrow(lambda batches: link_batches(found(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Linked: 100 * intersection >= percent * union of the sets of five-word shingles (A-Z lower-cased; a shorter
    text is one shingle). ``component_id`` is the smallest id reachable over links; the row that bears it is
    kept. Null texts and texts without words have an empty set and stand alone, as ``component_id`` of themselves. Rows with equal sets are
    linked whatever their ids; a null id never is a ``component_id`` unless all ids of the group are null,
    which are kept. Other columns are not read; an empty table gives no rows.
    """
    signed = settle(sign(docs), "signed")
    nodes = settle(signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("low").alias("low"), F.first("bands").alias("bands")), "nodes")
    maybe = components(candidates(nodes, nodes, floor_of(percent)))
    maybe = settle(maybe, "maybe")
    sized = maybe.join(maybe.groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("size")), F.col("comp") == F.col("c"))
    groups = sized.select(F.col("node").alias("n"), "comp", "size").join(nodes, F.col("n") == F.col("node")).select(
        F.col("rep").alias("doc_id"), "node", "comp", "size")
    linked = settle(components(confirmed(docs, groups, percent)), "linked")
    ids = nodes.select("node", "rep").join(linked.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(
        "node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = ids.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("component_id"))
    named = ids.join(least, F.col("comp") == F.col("c")).select(F.col("node").alias("m"), "component_id")
    rows = signed.select("doc_id", "n", "node").join(named, F.col("node") == F.col("m"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
