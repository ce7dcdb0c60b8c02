"""Removal of passages that occur earlier in the corpus, by suffix automata of reference shards.

An automaton of the whole corpus fits no task, and sending every shard's automaton past every document costs
the square of the corpus. Both are avoided by shards that are cut by content. Each window of ``WINDOW`` words
belongs to the word triple with the smallest hash in it, its anchor, so equal windows lie at equal places
around equal anchors. The stretch of windows that one anchor owns is a context; contexts of one anchor form
a shard. A shard whose contexts are all equal is settled by its first one. In every other shard the contexts
are streamed in corpus order through a suffix automaton of those before: a matching statistic of ``WINDOW`` words
or more marks a window that starts earlier, and the automaton then takes in the context. Adjacent marked
windows make maximal spans.

An anchor with more than ``HOT`` occurrences is dealt out: first by whole contexts, then the different ones
by single windows. First occurrences are minima with map-side combine, so no passage, however common, meets
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.graph import key_runs
from tapewright.llm.words import Words, _powers, mix, rolling, slices, utf8, words_of
from tapewright.session import settle

WINDOW = 20
GRAM = 3
#: Occurrences of an anchor above which its windows are dealt out one by one.
HOT = 2000


class SuffixAutomaton:
    """Suffix automaton of several word sequences; a matching statistic never crosses their borders."""

    def __init__(self):
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list[bytes]) -> None:
        step, link, size = self.step, self.link, self.size
        last = 0
        for word in words:
            if word in step[last]:
                q = step[last][word]
                last = q if size[q] == size[last] + 1 else self._clone(last, q, word)
                continue
            new = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            if p >= 0:
                q = step[p][word]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, word)
            last = new

    def _clone(self, p: int, q: int, word: bytes) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For every word the length of the longest known run that ends there."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            out.append(length)
        return out


def anchors(words: Words) -> tuple[np.ndarray, ...]:
    """``(lo, n, gram, context)`` of every anchor: first window, number of windows, gram hash, context hash."""
    none = np.zeros(0, np.int64)
    total = len(words.hash)
    if total < WINDOW:
        return none, none, none, none
    grams = rolling(words.hash, GRAM)
    span = WINDOW - GRAM + 1
    key = ((grams >> np.uint64(32)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
    real = np.zeros(total + 1, np.int64)
    first, last = words.first[:-1], words.first[1:] - WINDOW + 1
    long = last > first
    np.add.at(real, first[long], 1)
    np.add.at(real, last[long], -1)
    start = np.flatnonzero(np.cumsum(real)[:total])
    if not len(start):
        return none, none, none, none
    at = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    lo, place = start[cut], at[cut]
    n = np.diff(np.concatenate((cut, [len(start)])))
    context = mix(stretch_hash(words, lo, n) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return lo, n, grams[place].view(np.int64), (context >> np.uint64(16)).astype(np.int64)


def stretch_hash(words: Words, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of all words of the ``n`` windows from ``lo`` on."""
    total = len(words.hash)
    power, inverse = _powers(1 << (total + 1).bit_length())
    run = np.zeros(total + 1, np.uint64)
    np.cumsum(words.hash * power[:total], out=run[1:])
    return mix((run[lo + n + WINDOW - 1] - run[lo]) * inverse[lo] + n.astype(np.uint64))


def occurrences(docs: DataFrame) -> DataFrame:
    """``(h, c, doc_id, lo, n)``: anchors of every document, places counted in its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = words_of(*utf8(batch.column(1).slice(a, b - a)))
                lo, n, gram, context = anchors(words)
                doc = np.searchsorted(words.first, lo, side="right") - 1
                ids = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(context), ids, pa.array((lo - words.first[doc]).astype(np.int32)),
                     pa.array(n.astype(np.int32))], ["h", "c", "doc_id", "lo", "n"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, lo int, n int")


def contexts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Words around the anchors in ``runs (id, at)``: ``(k, hot, again, c, doc_id, lo, n, words)``.

    ``c`` is the hash of the words. A context that its document has had before is marked ``again`` and
    comes without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words = words_of(*utf8(part.column(1)))
                lists = part.column(2)
                owner = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                lo, n, h = (flat.field(i).to_numpy() for i in range(3))
                begin = words.first[owner] + lo
                c = stretch_hash(words, begin, n)
                order = np.lexsort((lo, c, h, owner))
                same = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
                again = np.zeros(len(lo), bool)
                again[order[1:]] = same
                raw = words.data.tobytes()
                stop = words.end[begin + n + WINDOW - 2].tolist()
                texts = [None if old else raw[x:y] for old, x, y in zip(again.tolist(), words.start[begin].tolist(), stop, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), flat.field(3), pa.array(again), pa.array(c.view(np.int64)), part.column(0).take(pa.array(owner)),
                     pa.array(lo), pa.array(n), pa.array(texts, pa.binary())], names)

    names = ["k", "hot", "again", "c", "doc_id", "lo", "n", "words"]
    joined = docs.select("doc_id", "text").join(runs, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "at")
    return joined.mapInArrow(run, "k long, hot boolean, again boolean, c long, doc_id long, lo int, n int, words binary")


def windows(contexts: DataFrame) -> DataFrame:
    """``(k, doc_id, lo)``: every window of the contexts ``(doc_id, lo, n, words)`` by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy()
            words = words_of(*utf8(batch.column(3)))
            each = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            window = rolling(words.hash, WINDOW)[words.first[each] + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), batch.column(0).take(pa.array(each)),
                 pa.array((batch.column(1).to_numpy()[each] + step).astype(np.int32))], ["k", "doc_id", "lo"])

    text = F.decode("words", "UTF-8")
    return contexts.select("doc_id", "lo", "n", text.alias("words")).mapInArrow(run, "k long, doc_id long, lo int")


def later(rows: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, doc_id, lo, …)`` whose key also has an earlier place.

    First places are written before the join: a common key on plain exchanges can be split at run time.
    """
    first = rows.groupBy(F.col(key).alias("g")).agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "lo")).alias("first")).where("times > 1")
    first = settle(first, "first")
    return rows.join(first, F.col(key) == F.col("g")).where(~F.struct("doc_id", "lo").eqNullSafe(F.col("first")))


def matched(shards: DataFrame) -> DataFrame:
    """``(doc_id, lo, n)``: windows of the contexts ``(k, doc_id, lo, n, words)`` found in an earlier context of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches):
            automaton, seen, out = SuffixAutomaton(), set(), []
            for i, (lo, n, text) in enumerate(zip(*(t.column(c).to_pylist() for c in ("lo", "n", "words")), strict=True)):
                words = text.split()
                whole = b" ".join(words)
                if whole in seen:
                    out.append((i, lo, n))
                    continue
                seen.add(whole)
                found = [m >= WINDOW for m in automaton.statistics(words)[WINDOW - 1:]]
                automaton.add(words)
                j = 0
                while j < n:
                    stop = j
                    while stop < n and found[stop]:
                        stop += 1
                    if stop > j:
                        out.append((i, lo + j, stop - j))
                    j = stop + 1
            if out:
                i, lo, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [t.column("doc_id").combine_chunks().take(pa.array(i)), pa.array(lo, pa.int32()), pa.array(n, pa.int32())],
                    ["doc_id", "lo", "n"])

    dealt = shards.select("k", "doc_id", "lo", "n", "words").repartition("k").sortWithinPartitions("k", "doc_id", "lo")
    return dealt.mapInArrow(run, "doc_id long, lo int, n int")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, lo, n)``: runs of windows whose words also start earlier in the corpus."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = occurrences(ids)
    first = F.min(F.struct("doc_id", "lo"))
    shared = settle(rows.groupBy(F.col("h").alias("g")).agg(
        F.count("*").alias("times"), F.min("c").alias("c0"), F.max("c").alias("c1"), first.alias("first")).where("times > 1").select(
        "g", "first", (F.col("c0") == F.col("c1")).alias("alike"), (F.col("times") > HOT).alias("hot")), "shared")
    met = settle(rows.select("h", "doc_id", "lo", "n").join(shared, F.col("h") == F.col("g")).select(
        "h", "doc_id", "lo", "n", "alike", "hot", F.struct("doc_id", "lo").eqNullSafe(F.col("first")).alias("leads")), "anchors")
    plain = met.where("alike and not leads").select("doc_id", "lo", "n")
    runs = met.where("not alike").groupBy(F.col("doc_id").alias("id")).agg(
        F.collect_list(F.struct("lo", "n", "h", "hot")).alias("at"))
    around = settle(contexts(ids, runs), "contexts")
    again = around.where("again").select("doc_id", "lo", "n")
    fresh = around.where("not again")
    cold = matched(fresh.where("not hot"))
    hot = fresh.where("hot")
    copies = later(hot.select("c", "doc_id", "lo", "n"), "c").select("doc_id", "lo", "n")
    distinct = hot.groupBy("c").agg(F.min(F.struct("doc_id", "lo", "n", "words")).alias("x")).select("x.*")
    common = later(windows(distinct), "k").select("doc_id", "lo", F.lit(1).alias("n"))
    return plain.unionByName(again).unionByName(cold).unionByName(copies).unionByName(common)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as ``text``, and ``n_words``, ``n_removed`` and ``spans`` more.

    A word goes if a window of ``WINDOW`` words that covers it also starts earlier: in a smaller doc_id, or at an
    earlier place of the same document. Windows are judged on the input. Kept words are joined by one space;
    ``spans`` lists the maximal removed runs as (start, length) in words. Null texts have no words and become
    empty. Rows of equal id count as one document: repeated rows are cut alike, and where texts of one id
    differ, each loses the places found in any. A null id comes before all others. Other columns are kept; columns named like the new ones are
    refused; an empty table gives no rows.
    """
    if clash := {"n_words", "n_removed", "spans"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    gone = repeated_windows(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("lo", "n")).alias("_gone"))
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    where = docs.columns.index("text")
    names = [*docs.columns, "n_words", "n_removed", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(where)):
                part = batch.slice(a, b - a)
                words = words_of(*utf8(part.column(where)))
                count = np.diff(words.first)
                lists = part.column(batch.num_columns - 1)
                held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(b - a), held)
                flat = lists.flatten()
                begin = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.minimum(begin + flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + WINDOW - 1, count[owner])
                begin = np.minimum(begin, end)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, words.first[owner] + begin, 1)
                np.add.at(cover, words.first[owner] + end, -1)
                keep = np.cumsum(cover)[:len(words.hash)] == 0
                texts, removed = kept_texts(words, keep)
                spans = spans_of(words, ~keep)
                yield pa.RecordBatch.from_arrays(
                    [texts if i == where else c for i, c in enumerate(part.columns[:-1])]
                    + [pa.array(count), pa.array(removed), spans], names)

    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, n_removed long, spans array<struct<start:long,length:long>>").fields])
    return rows.mapInArrow(run, schema)


def kept_texts(words: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts of the kept words joined by one space, and how many words each lost."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[keep]
    start, length = words.start[keep], (words.end - words.start)[keep] + 1
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)
    out = np.append(words.data, np.uint8(0x20))[np.minimum(at, len(words.data))]
    out[ends - 1] = 0x20
    size = np.bincount(owner, weights=length, minlength=len(words.first) - 1).astype(np.int64)
    stop = np.cumsum(size)
    raw = out.tobytes()
    texts = [raw[max(0, e - s):e - 1].decode() if s else "" for s, e in zip(size.tolist(), stop.tolist(), strict=True)]
    kept = np.bincount(owner, minlength=len(words.first) - 1)
    return pa.array(texts, pa.string()), np.diff(words.first) - kept


def spans_of(words: Words, gone: np.ndarray) -> pa.Array:
    n = len(words.first) - 1
    owner = np.repeat(np.arange(n), np.diff(words.first))
    edge = np.ones(len(gone), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(gone)))
    real = gone[begin]
    begin, length = begin[real], length[real]
    of = owner[begin]
    values = pa.StructArray.from_arrays([pa.array(begin - words.first[of]), pa.array(length)], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)), values)
