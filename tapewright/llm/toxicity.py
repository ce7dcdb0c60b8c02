"""Toxicity by non-negative positive-unlabelled learning.

A text is a bag of hashed terms: its words and their beginnings of four to six bytes, A-Z lower-cased, as shares of its
words. Confirmed toxic texts are the positives; texts drawn from the whole learnable corpus, whatever their
label, are the unlabelled ones, of which a share ``prior`` is toxic. With the sigmoid loss l the risk is

    prior * E_p[l(+z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]).

Its second part estimates the loss on clean texts, which cannot be negative; a batch in which it is gets a step
that raises it again, so that the positives among the unlabelled texts are not learned by heart. Only terms that toxic
texts have clearly more often take part. The sigmoid loss is flat far from nought and has minima that give up a
language or every text, so a fit starts where the sum of the shares of those terms parts off ``prior`` of the
unlabelled texts. Some linear classifiers, fitted from different starts, vote with their mean margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapewright.llm.sampling import smallest_hashes
from tapewright.llm.words import Words, mix, slices, utf8, words_of

TERMS = 1 << 16
PREFIXES = (4, 5, 6)
#: Bound of the sample: so many rows of confirmed toxic texts, so many unlabelled ones; their whole texts count.
POSITIVES = 1500
UNLABELLED = 3000
MEMBERS = 3
EPOCHS = 30
BATCH = 256
RATE = 0.02
DECAY = 1e-5
#: A term takes part if its document frequencies differ by so many standard errors and so many texts have it.
DEVIATIONS = 3.0
SEEN = 4
#: And if toxic texts have it so many times as often as clean ones.
LIFT = 4.0
#: A start varies the weights by so much (standard deviation of their logarithm).
SPREAD = 0.2
#: Shares are small: a word in a hundred is worth this much.
SCALE = 100.0


@dataclass
class Sparse:
    """Rows of ``(term, value)``: ``first[i]:first[i + 1]`` are those of row i."""

    term: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner(), weights=self.value * weight[self.term], minlength=len(self))

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.first)[rows]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], size)
        return Sparse(self.term[at], self.value[at], first)

    def only(self, wanted: np.ndarray) -> Sparse:
        """Rows reduced to the terms that ``wanted`` marks."""
        held = wanted[self.term]
        return Sparse(self.term[held], self.value[held], np.concatenate(([0], np.cumsum(held)))[self.first])


def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and hashed term of every word and of every beginning a word is long enough for."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    size = words.end - words.start
    padded = np.concatenate((words.data, np.zeros(max(PREFIXES), np.uint8)))
    begin = np.zeros(len(size), np.uint64)
    keys, owners = [mix(words.hash + np.uint64(1))], [owner]
    for j in range(max(PREFIXES)):
        begin |= padded[words.start + j].astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in PREFIXES:
            long = size > j
            keys.append(mix(begin[long] + (np.uint64(j + 1) << np.uint64(56))))
            owners.append(owner[long])
    return np.concatenate(owners), (np.concatenate(keys) % np.uint64(TERMS)).astype(np.int64)


def terms_of(words: Words) -> Sparse:
    """Distinct hashed terms of every document and their shares of its words, times ``SCALE``."""
    n = len(words.first) - 1
    owner, term = occurrences(words)
    code, times = np.unique(owner * TERMS + term, return_counts=True)
    row = code // TERMS
    value = SCALE * times / np.maximum(1, np.diff(words.first))[row]
    return Sparse(code % TERMS, value.astype(np.float32), np.searchsorted(row, np.arange(n + 1)))


def telling(positive: Sparse, unlabelled: Sparse, prior: float) -> np.ndarray:
    """Marks of the terms of toxic texts: their share of texts is larger among the positives by ``DEVIATIONS`` standard errors,
    and ``LIFT`` times that of clean texts, which is what the unlabelled share leaves once ``prior`` of the positive one is taken off."""
    p, u = (np.bincount(x.term, minlength=TERMS) for x in (positive, unlabelled))
    both = (p + u + 0.5) / (len(positive) + len(unlabelled) + 1)
    error = np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)))
    p_share, u_share = p / len(positive), u / len(unlabelled)
    lifted = (1 - prior) * p_share >= LIFT * (u_share - prior * p_share)
    return (p_share - u_share > DEVIATIONS * error) & lifted & (p + u >= SEEN)


@dataclass
class Classifiers:
    """One row of ``weight`` and one ``bias`` per member."""

    weight: np.ndarray
    bias: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """0.5 where the mean margin is nought; shares are linear in the occurrences, so those are added up as they come."""
        n = len(words.first) - 1
        if not len(self.bias):
            return np.zeros(n)
        owner, term = occurrences(words)
        pull = np.bincount(owner, weights=self.weight.mean(axis=0)[term], minlength=n)
        z = SCALE * pull / np.maximum(1, np.diff(words.first)) + self.bias.mean()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slope(z: np.ndarray) -> np.ndarray:
    """Derivative of the sigmoid loss l(z) = 1 / (1 + exp(z)); that of l(-z) is its negative."""
    s = 1 / (1 + np.exp(np.clip(z, -30, 30)))
    return -s * (1 - s)


def gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk of one batch by the margins of its positives and its unlabelled rows."""
    def loss(z: np.ndarray) -> float:
        return float((1 / (1 + np.exp(np.clip(z, -30, 30)))).mean()) if len(z) else 0.0

    clean = loss(-z_u) - prior * loss(-z_p)
    on_p, on_u = slope(z_p) / max(1, len(z_p)), slope(z_u) / max(1, len(z_u))
    if clean < 0:
        return -prior * on_p, on_u
    return 2 * prior * on_p, -on_u


def fit(positive: Sparse, unlabelled: Sparse, prior: float, *, members: int = MEMBERS, epochs: int = EPOCHS, seed: int = 5) -> Classifiers:
    """Adam on the non-negative risk over batches that mix both kinds; no positives: a classifier that finds nothing."""
    if not len(positive) or not len(unlabelled):
        return Classifiers(np.zeros((0, TERMS), np.float32), np.zeros(0))
    wanted = telling(positive, unlabelled, prior)
    positive, unlabelled = positive.only(wanted), unlabelled.only(wanted)
    weights, biases = [], []
    steps = max(1, len(unlabelled) // BATCH)
    for member in range(members):
        rng = np.random.default_rng(seed + member)
        start, step = np.exp(rng.normal(0, SPREAD, TERMS)) * wanted, 0
        w = np.append(start, -max(1.0, np.quantile(unlabelled.dot(start), 1 - prior)))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            parts_p = np.array_split(rng.permutation(len(positive)), min(steps, len(positive)))
            for i, at in enumerate(np.array_split(rng.permutation(len(unlabelled)), steps)):
                step += 1
                p, u = positive.take(parts_p[i % len(parts_p)]), unlabelled.take(at)
                on_p, on_u = gradient(p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1], prior)
                g = DECAY * w
                g[-1] = on_p.sum() + on_u.sum()
                for rows, on in ((p, on_p), (u, on_u)):
                    g[:-1] += np.bincount(rows.term, weights=rows.value * on[rows.owner()], minlength=TERMS)
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
        weights.append(w[:-1].astype(np.float32))
        biases.append(w[-1])
    return Classifiers(np.array(weights), np.array(biases))


def collected(rows: DataFrame) -> Sparse:
    """Terms of the whole texts of a bounded sample ``(doc_id, text)``, counted in tasks and gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                x = terms_of(words_of(*utf8(batch.column(1).slice(a, b - a)), lower=True, cut=True))
                cuts = list(zip(x.first[:-1], x.first[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.term[i:j].astype("<u2").tobytes() for i, j in cuts], pa.binary()),
                     pa.array([x.value[i:j].astype("<f4").tobytes() for i, j in cuts], pa.binary())], ["doc_id", "term", "value"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, term binary, value binary").orderBy("doc_id", "term", "value").collect()
    term = [np.frombuffer(r.term, "<u2") for r in found]
    first = np.concatenate(([0], np.cumsum([len(t) for t in term]))).astype(np.int64)
    empty = np.zeros(0, np.int64)
    return Sparse(np.concatenate([empty, *term]).astype(np.int64),
                  np.concatenate([empty, *(np.frombuffer(r.value, "<f4") for r in found)]).astype(np.float32), first)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifiers:
    """Fit on ``docs (doc_id, text)``, all of them learnable, and ``labels (doc_id, toxic)``.

    The prior is the share of toxic rows among labels of 0 or 1 whose id is not null. Positives are ``positives`` toxic ids at
    most, unlabelled texts ``unlabelled`` rows at most, both those of the smallest hash of their id. Rows without an id or
    text teach nothing. Without a toxic text nothing is learned, and every score is 0.
    """
    real = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    seen = {r[0]: r[1] for r in real.groupBy("toxic").count().collect()}
    prior = seen.get(1, 0) / max(1, sum(seen.values()))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")

    def sample(ids: DataFrame, most: int) -> DataFrame:
        chosen = smallest_hashes(ids.select("doc_id"), "doc_id", most).distinct().withColumnRenamed("doc_id", "id")
        met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left_semi")
        return met.orderBy(F.xxhash64("doc_id"), "text").limit(most)

    return fit(collected(sample(real.where("toxic = 1"), positives)), collected(sample(texts, unlabelled)), prior)


def score(docs: DataFrame, model: Classifiers) -> DataFrame:
    """``docs`` with a column ``score`` more (0 to 1, higher: toxic likelier); all columns are kept.

    Texts are scored whole, in rows of bounded bytes. Null, empty and wordless texts get the score of no terms at all.
    Repeated rows are scored alike, an empty table gives no rows. A column ``score`` of the input is refused.
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
                parts.append(model.scores(words_of(*utf8(column.slice(a, b - a)), lower=True, cut=True)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
