"""Language ID by a byte convolutional network in numpy.

Bytes are embedded, filters of three widths slide over a fixed window, each keeps its maximum, and a
softmax reads the maxima. A text is cut into windows from end to end; the log probabilities of its windows
are averaged, so every byte counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.sampling import smallest_hashes
from tapewright.llm.words import utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
WIDEST = max(WIDTHS)
#: Bound of the training sample: so many rows, so many characters of each.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 1200
#: Windows in one matrix product; keeps the product in cache.
BLOCK = 24


@dataclass
class Network:
    """``filters``: (WIDEST * embedding, filters), rows beyond a filter's width are zero."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        n, length, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - WIDEST + 1, WIDEST * d), (s[0], s[1], s[2]))

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), BLOCK):
            x = self.columns(windows[i:i + BLOCK])
            n, p, k = x.shape
            top = (x.reshape(n * p, k) @ self.filters).reshape(n, p, -1).max(axis=1)
            z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(parts)


def windows_of(data: np.ndarray) -> np.ndarray:
    """All of a text's bytes in rows of ``WINDOW``; the last row is filled up with zero bytes."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[:len(data)] = data
    return out.reshape(rows, WINDOW)


def fit(texts: list[str], labels: list[str], *, embedding: int = 8, per_width: int = 16, epochs: int = 6,
        batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross entropy of single windows."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    rows, marks = [], []
    for text, label in zip(texts, labels, strict=True):
        w = windows_of(np.frombuffer(text.encode(), np.uint8))
        rows.append(w)
        marks.append(np.full(len(w), languages.index(label)))
    x_all = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
    y_all = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    count = per_width * len(WIDTHS)
    mask = np.zeros((WIDEST, embedding, count), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * per_width:(i + 1) * per_width] = 1
    mask = mask.reshape(WIDEST * embedding, count)
    net = Network(
        languages, rng.normal(0, 0.5, (256, embedding)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(count, np.float32),
        rng.normal(0, 0.3, (count, max(1, len(languages)))).astype(np.float32),
        np.zeros(max(1, len(languages)), np.float32))
    names = ["embed", "filters", "bias", "out", "out_bias"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x_all)), max(1, len(x_all) // batch)):
            step += 1
            grads = gradients(net, x_all[at], y_all[at], mask)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                change = (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def gradients(net: Network, windows: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    x = net.columns(windows)
    n, p, k = x.shape
    score = (x.reshape(n * p, k) @ net.filters).reshape(n, p, -1)
    where = score.argmax(axis=1)
    top = np.take_along_axis(score, where[:, None, :], axis=1)[:, 0] + net.bias
    hidden = np.maximum(top, 0)
    z = hidden @ net.out + net.out_bias
    prob = np.exp(z - z.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    prob[np.arange(n), y] -= 1
    prob /= n
    back = (prob @ net.out.T) * (top > 0)
    picked = x[np.arange(n)[:, None], where]
    d_filters = np.einsum("nfk,nf->kf", picked, back) * mask
    d_picked = back[:, :, None] * net.filters.T[None]
    d = net.embed.shape[1]
    d_embed = np.zeros_like(net.embed)
    for j in range(WIDEST):
        np.add.at(d_embed, windows[np.arange(n)[:, None], where + j], d_picked[:, :, j * d:(j + 1) * d])
    return {"embed": d_embed, "filters": d_filters, "bias": back.sum(axis=0), "out": hidden.T @ prob,
            "out_bias": prob.sum(axis=0)}


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on ``(doc_id, text, lang)``: the ``sample_rows`` rows with the smallest hash of their id.

    The ids are chosen first, so only the texts of the sample travel. Of each a stretch of ``SAMPLE_CHARS`` characters at a place its id decides; nothing else is collected.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    real = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    ids = smallest_hashes(real.select("doc_id"), "doc_id", sample_rows).distinct().withColumnRenamed("doc_id", "id")
    sample = real.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").select(
        "doc_id", F.col("text").substr(at, F.lit(SAMPLE_CHARS)).alias("text"), "lang").orderBy("doc_id", "text").limit(sample_rows).collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` reduced to doc_id, lang_pred and score, the probability of that language.

    Null texts and texts without a letter get ``und`` and 0, as does everything if nothing was learned.
    Repeated rows are kept, other columns are not read, an empty table gives no rows. The network is some
    tens of kilobytes whatever the data, so it travels with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            real = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            tags: list[str] = []
            scores = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                if not real[i] or not net.languages:
                    tags.append("und")
                    continue
                text = data[offsets[i]:offsets[i + 1]]
                total, n = np.zeros(len(net.languages)), 0
                for j in range(0, len(text), 4096 * WINDOW):
                    part = net.log_probs(windows_of(text[j:j + 4096 * WINDOW]))
                    total += part.sum(axis=0, dtype=np.float64)
                    n += len(part)
                prob = np.exp((total - total.max()) / n)
                best = int(prob.argmax())
                tags.append(net.languages[best])
                scores[i] = prob[best] / prob.sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tags, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("real")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
