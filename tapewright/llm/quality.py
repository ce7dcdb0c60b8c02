"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: its words, the outer shapes of its words, and words that repeat the one
before. Weighted by inverse document frequency and projected on the leading singular vectors of the
labelled sample it becomes a short vector. The labelled vectors are broadcast (their number is a
parameter); the cosines of every document with all of them are one matrix product per block, and the
nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.sampling import smallest_hashes
from tapewright.llm.words import Words, mix, slices, utf8, words_of

TERMS = 8192
RANK = 48
NEIGHBOURS = 15
#: Bound of the labelled sample: so many rows of each label, so many characters of each row.
PER_LABEL = 800
SAMPLE_CHARS = 6000
BLOCK = 256
_CLASS = np.full(256, 1, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
_CLASS[list(b"0123456789")] = 4
_CLASS[128:] = 5


def term_counts(words: Words) -> np.ndarray:
    """Documents x hashed terms, as square roots of shares so that length does not matter."""
    n = len(words.first) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(words.hash):
        return out
    data, s, e = words.data, words.start, words.end
    tail = data[e - 1].astype(np.uint64)
    shape = (_CLASS[data[s]].astype(np.uint64) + np.uint64(8) * _CLASS[data[np.minimum(s + 1, e - 1)]].astype(np.uint64)
             + np.uint64(64) * np.where(_CLASS[data[e - 1]] == 1, tail, np.uint64(0))
             + np.uint64(1 << 14) * np.where(_CLASS[data[np.maximum(e - 2, s)]] == 1, np.uint64(1), np.uint64(0)))
    again = np.zeros(len(s), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][words.first[:-1] < len(s)]] = False
    half = np.uint64(TERMS // 2)
    common = (words.hash % half).astype(np.int64)
    kind = (mix(shape + again.astype(np.uint64) * np.uint64(1 << 20)) % half + half).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    out += np.bincount(owner * TERMS + common, minlength=n * TERMS).reshape(n, TERMS)
    out += np.bincount(owner * TERMS + kind, minlength=n * TERMS).reshape(n, TERMS)
    return np.sqrt(out / np.maximum(1, np.diff(words.first))[:, None])


@dataclass
class Neighbours:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    balance: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.weight) @ self.basis
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by cosine to the eighth power and by how rare a label is."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        x = self.latent(counts)
        near = x @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        pull = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 8
        mark = self.labels[top]
        pull *= self.balance[mark]
        total = pull.sum(axis=1)
        vote = np.divide((pull * mark).sum(axis=1) + 0.02 * self.prior, total + 0.02)
        return np.clip(vote, 0.0, 1.0)


def fit(texts: list[str], labels: list[int], shares: tuple[float, float]) -> Neighbours:
    """Singular vectors from the Gram matrix of the sample; ``shares``: how frequent labels 0 and 1 are."""
    prior = shares[1] / sum(shares) if sum(shares) else 0.5
    if not texts:
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32),
                          np.zeros(0, np.int64), prior, np.ones(2))
    data, offsets = utf8(pa.array(texts, pa.string()))
    counts = term_counts(words_of(data, offsets))
    seen = (counts > 0).sum(axis=0)
    weight = np.where(seen > 0, np.log((1 + len(texts)) / (1 + seen)) + 0.2, 0).astype(np.float32)
    x = counts * weight
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = np.argsort(values)[::-1][:RANK]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    basis = (x.T @ (left[:, keep] / np.sqrt(values[keep])).astype(np.float32)).astype(np.float32)
    marks = np.array(labels, np.int64)
    held = np.bincount(marks, minlength=2)[:2] / len(marks)
    balance = np.array([s / sum(shares) / h if h else 1.0 for s, h in zip(shares, held, strict=True)]) ** 0.5
    model = Neighbours(weight, basis, np.zeros((0, 1), np.float32), marks, prior, balance)
    model.vectors = model.latent(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Neighbours:
    """Fit on ``docs (doc_id, text)`` and ``labels (doc_id, quality)``: of each label ``per_label`` rows at most.

    The labelled ids with the smallest hash are chosen first, so only the texts of the sample travel. Of each
    text a stretch of ``SAMPLE_CHARS`` characters at a place its id decides. Rows without an id, a text or a
    label of 0 or 1 teach nothing.
    """
    real = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r[0]: r[1] for r in real.groupBy("quality").count().collect()}
    picked = [smallest_hashes(real.where(F.col("quality") == label), "doc_id", per_label) for label in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).distinct().withColumnRenamed("doc_id", "id")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
        "doc_id", "quality", F.col("text").substr(at, F.lit(SAMPLE_CHARS)).alias("text")
    ).orderBy("doc_id", "quality", "text").limit(2 * per_label).collect()
    return fit([r.text for r in sample], [r.quality for r in sample], (shares.get(0, 0), shares.get(1, 0)))


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``docs`` with a column ``score`` more (0 to 1, higher: label 1 likelier); all columns are kept.

    Null, empty and wordless texts get what lies nearest to nothing: the share of label 1. Repeated rows
    are scored alike, an empty table gives no rows. A column ``score`` of the input is refused.
    """
    if "score" in docs.columns:
        raise ValueError("there is a column score already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(where)
            parts = [np.zeros(0)]
            for a, b in slices(column, 1 << 20):
                for i in range(a, b, BLOCK):
                    data, offsets = utf8(column.slice(i, min(BLOCK, b - i)))
                    parts.append(model.scores(term_counts(words_of(data, offsets))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts), pa.float64())], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
