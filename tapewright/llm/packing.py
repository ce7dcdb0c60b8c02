"""Vector bin packing of tokenized examples under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its own input partition, so nothing is shuffled and no key can be hot. A
pool of remainders is held; the open sequence takes the remainder with the largest dot product of what it
needs and what the sequence has left, both relative to the limits. When none fits whole, the best one is
cut to fill the gap. The last sequences of a partition stay short, and so does every sequence that reaches its
limit of segments first: where all documents average fewer than 16 tokens, 256 of them do not fill 4096.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapewright.llm.shipping import give_back
from tapewright.llm.words import slices, utf8, words_of

SCHEMA = ("doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, "
          "sequence_id long, offset long")
#: Remainders from which the next one is chosen; each is shorter than a sequence.
POOL = 256
#: Distinct words whose ids a worker remembers, and the bytes of text that it encodes at once.
REMEMBERED = 150_000
SLICE = 1 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


class WordTokens:
    """Ids of whole texts from a lower-casing tokenizer that treats runs of letters one by one.

    True of tokenizers whose normalizer folds case and whose pre-tokenizer drops white space and parts
    letters from marks and digits. The distinct runs of a batch are encoded once and remembered; equality
    with the tokenizer on whole texts is tested. A text with ``<|`` may hold a special token and is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spell = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids_of(self, word: str) -> list[int]:
        if PLAIN(word):
            return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.spell))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Keep ``ids`` of new words in the sorted table, as many as it has room for."""
        room = REMEMBERED - len(self.known)
        hashes, ids = hashes[:room], ids[:room]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column; null counts as empty.

        Words are remembered until half the room is taken, then only those that come more than once in a slice; others are
        encoded anew each time.
        """
        data, offsets = utf8(column)
        words = words_of(data, offsets, lower=True, cut=True)
        distinct, first, which, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        begin, length, flat = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.flat
        begin[~new], length[~new] = self.begin[at[~new]], self.length[at[~new]]
        if new.any():
            raw = data.tobytes()
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            ids = [self.ids_of(raw[a:b].decode()) for a, b in spans]
            length[new] = [len(own) for own in ids]
            begin[new] = len(flat) + np.cumsum(length[new]) - length[new]
            flat = np.concatenate((flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length[new].sum()))))
            again = (times[new] > 1) | (len(self.known) < REMEMBERED // 2)
            self.remember(distinct[new][again], [own for own, keep in zip(ids, again.tolist(), strict=True) if keep])
        begin, length = begin[which], length[which]
        ends = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)]
        out = [ids[a:b] for a, b in zip(ends[words.first[:-1]], ends[words.first[1:]], strict=True)]
        for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)):
            whole = self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids
            out[int(i)] = np.array(whole, np.uint32)
        return out


#: Words of these letters are one pre-token that normalization leaves alone but for case.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def byte_letters() -> dict[int, int]:
    """Byte to letter as byte-level tokenizers spell it: printable Latin-1 as itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


@dataclass
class Part:
    doc_id: int | None
    start: int
    ids: np.ndarray
    prompt: int
    doc_tokens: int

    @property
    def loss(self) -> int:
        return len(self.ids) - min(len(self.ids), max(0, self.prompt - self.start))

    def cut(self, at: int) -> tuple[Part, Part]:
        return (Part(self.doc_id, self.start, self.ids[:at], self.prompt, self.doc_tokens),
                Part(self.doc_id, self.start + at, self.ids[at:], self.prompt, self.doc_tokens))


class Packer:
    """Fills one sequence at a time from a bounded pool of parts."""

    def __init__(self, limits: Limits, base: int):
        self.limits, self.next_id = limits, base
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
        self.pool: list[Part] = []
        self.need = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def emit(self, parts: list[Part]) -> None:
        offset = 0
        for p in parts:
            self.rows.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.loss,
                              p.doc_tokens, self.next_id, offset))
            offset += len(p.ids)
        self.next_id += 1

    def add(self, part: Part) -> None:
        whole = min(self.limits.tokens, self.limits.loss_tokens)
        while len(part.ids) > whole:
            head, part = part.cut(whole)
            self.emit([head])
        self.pool.append(part)
        self.need = np.vstack((self.need, [len(part.ids), 1, part.loss]))
        if len(self.pool) >= POOL:
            while len(self.pool) > POOL // 2:
                self.fill()

    def take(self, i: int) -> Part:
        self.need = np.delete(self.need, i, axis=0)
        return self.pool.pop(i)

    def fill(self) -> None:
        left, parts = self.cap.copy(), []
        while self.pool and left[1] >= 1 and left[0] >= 1:
            gain = (self.need / self.cap) @ (left / self.cap)
            fits = (self.need <= left).all(axis=1)
            if fits.any():
                part = self.take(int(np.where(fits, gain, -1.0).argmax()))
            else:
                i = int(gain.argmax())
                free = max(0, self.pool[i].prompt - self.pool[i].start) if left[2] < left[0] else 0
                at = int(min(left[0], left[2] + free))
                if at < 1 or at >= len(self.pool[i].ids):
                    break
                part, rest = self.pool[i].cut(at)
                self.pool[i], self.need[i] = rest, (len(rest.ids), 1, rest.loss)
            parts.append(part)
            left -= (len(part.ids), 1, part.loss)
        self.emit(parts)

    def finish(self) -> None:
        while self.pool:
            self.fill()


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, limits: Limits = Limits(),
         prompt: str | None = None) -> DataFrame:
    """Pieces of every document in sequences that keep all three limits.

    A document is the ids of its ``prompt`` column (if named; these bear no loss), of ``text``, then
    ``end_id``. Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32 bit), loss_tokens, doc_tokens, sequence_id (unique, not gapless), offset (in the sequence,
    gapless). Null text counts as empty, so every row has at least the end id; null ids and repeated rows
    are kept as they are; other columns are not read; an empty table gives no rows.
    ``tokenizer`` is a path that the workers can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        encode = tokens.encode
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(types)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1), SLICE):
                given = [encode(batch.column(c).slice(a, b - a)) for c in range(1, batch.num_columns)]
                for doc_id, *ids in zip(batch.column(0).slice(a, b - a).to_pylist(), *given, strict=True):
                    whole = np.concatenate((*ids, end))
                    packer.add(Part(doc_id, 0, whole, len(ids[0]) if prompt else 0, len(whole)))
                    if len(packer.rows) >= 512:
                        yield flush()
        packer.finish()
        yield flush()
        tokens.clear()
        give_back()

    return docs.select("doc_id", *([prompt] if prompt else []), "text").mapInArrow(run, SCHEMA)
