"""Packs documents' token ids into fixed-length training sequences, balancing attention cost.

Documents become token ids plus an end id. Within a window of documents (a
bounded buffer in one task) the descending rest lengths go to the sequence of
lowest estimated cost (linear plus quadratic in each piece's length) that has
token capacity left. Of the ``tries`` cheapest sequences the first with room for
all of it is taken; if none has, the cheapest takes what it can and the rest goes
on (cutting is allowed, and a bounded look keeps the step logarithmic). What fills no whole
sequence moves to the next window, and at a task's end leaves as sequences whose
lengths are powers of two, which need no padding. There is no shuffle: each id
is tokenized once, packed where it was read, and only piece rows leave the task.

Nulls: a null text packs as an empty one (the end id alone); a null key is
kept, and a key may be of any type. Repeated rows are packed each; rests of equal
length (ties) go in the order in which they were read, sequences of equal cost in
that of their numbers. A very long text fills whole sequences first. An empty table
gives no pieces. Other columns are not read, whatever their names, but ``key`` must
not be named as a result is.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import fresh, give_back, kept_by_worker, slices, split_words

#: Words after which a worker's table is emptied; a table of that size takes some 100 MB.
MOST_WORDS = 1_500_000
#: Rows of a batch: large enough that most of its words repeat. Words whose ids are gathered at once.
ROWS, GATHERED = 1024, 400_000
#: Sequence ids: the task's partition times this, plus a count.
STRIDE = 1 << 33


class WordTable:
    """Ids of words, found by 128-bit hashes in an open-addressing table of numpy arrays."""

    def __init__(self, most: int):
        self.n, self.mask = 0, (1 << (2 * most - 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.empty((most, 2), np.uint64)
        self.start, self.length = np.empty(most, np.int64), np.empty(most, np.int32)
        self.ids, self.used = np.empty(4 * most, np.uint32), 0

    def room(self, n: int) -> bool:
        return self.n + n <= len(self.start)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot, active = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(active):
            entry = self.slots[slot[active]]
            there = entry >= 0
            active, entry = active[there], entry[there]
            same = (self.keys[entry] == keys[active]).all(1)
            out[active[same]] = entry[same]
            active = active[~same]
            slot[active] = (slot[active] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """New entries for keys that are not there; their numbers."""
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(length.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids) // 2, total), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        new = np.arange(self.n, self.n + len(ids))
        self.keys[new], self.length[new] = keys, length
        self.start[new] = self.used + np.cumsum(length) - length
        self.n, self.used = self.n + len(ids), self.used + total
        slot, active = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(active):
            at = slot[active]
            free = self.slots[at] < 0
            self.slots[at[free]] = new[active[free]]
            active = active[self.slots[at] != new[active]]
            slot[active] = (slot[active] + 1) & self.mask
        return new


class WordIds:
    """Ids of whole texts from a tokenizer that lower-cases and never joins what white space parts.

    A batch's distinct words are tokenized once each (and remembered), and the ids
    of its texts are gathered from theirs. Lower-casing A-Z first is idempotent
    under the tokenizer; texts that might spell a special token in capitals keep
    their case.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.table = most_words, WordTable(most_words)

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """Each text's ids (unsigned 32-bit), followed by ``end_id`` if there is one."""
        texts = fresh(texts)
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        number, words, offsets = split_words(texts)
        del texts
        entry = self._entries(words.to_pylist())
        del words
        start, length, flat = self.table.start[entry], self.table.length[entry], self.table.ids
        out: list[np.ndarray] = []
        end = np.array([] if end_id is None else [end_id], np.uint32)
        first = 0
        while first < len(offsets) - 1:  # whole texts of some words together
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GATHERED, "right")) - 1)
            part = number[offsets[first] : offsets[last]]
            each = length[part].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(start[part] - ends[:-1], each) + np.arange(ends[-1])]
            bounds = ends[offsets[first : last + 1] - offsets[first]]
            out += [np.concatenate([ids[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            first = last
        return out

    def _entries(self, words: list[str]) -> np.ndarray:
        import xxhash

        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        entry = self.table.find(keys)
        gaps = np.flatnonzero(entry < 0)
        if not self.table.room(len(gaps)):
            self.table = None
            self.table = WordTable(max(self.most, len(words)))
            gaps = np.arange(len(words))
        for at in range(0, len(gaps), 5_000):
            some = gaps[at : at + 5_000]
            encoded = self.tokenizer.encode_batch_fast([words[k] for k in some], add_special_tokens=False)
            entry[some] = self.table.add(keys[some], [e.ids for e in encoded])
        return entry


def assign(lengths: list[tuple[int, int, int]], n_sequences: int, capacity: int, quadratic: float, tries: int = 8) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length) dealt to ``n_sequences``; the pieces of each, and what found no room.

    The total of ``lengths`` is at least ``n_sequences * capacity``, so all sequences end full.
    """
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n_sequences)]
    room = [capacity] * n_sequences
    heap = [(0.0, k) for k in range(n_sequences)]
    rest: list[tuple[int, int, int]] = []
    for doc, start, length in sorted(lengths, key=lambda x: (-x[2], x[0], x[1])):
        while length and heap:
            passed = []
            while heap and len(passed) < tries and room[heap[0][1]] < length:
                passed.append(heapq.heappop(heap))
            # the lowest cost with room for all of it, else the lowest of all
            cost, k = heapq.heappop(heap) if heap and room[heap[0][1]] >= length else passed.pop(0) if passed else heapq.heappop(heap)
            for x in passed:
                heapq.heappush(heap, x)
            take = min(length, room[k])
            sequences[k].append((doc, start, take))
            room[k] -= take
            start, length = start + take, length - take
            if room[k]:
                heapq.heappush(heap, (cost + take + quadratic * take * take, k))
        if length:
            rest.append((doc, start, length))
    return sequences, rest


class Packer:
    """Packs one task's documents; holds at most ``window`` ids and what was left of the window before."""

    def __init__(self, capacity: int, window: int, quadratic: float, first_sequence: int, tries: int = 8):
        self.capacity, self.window, self.quadratic, self.next, self.tries = capacity, window, quadratic, first_sequence, tries
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.pending: list[tuple[int, int, int]] = []
        self.tokens = 0

    def add(self, keys: list, documents: list[np.ndarray]) -> Iterator[tuple]:
        for key, ids in zip(keys, documents, strict=True):
            self.pending.append((len(self.docs), 0, len(ids)))
            self.docs.append((key, ids))
            self.tokens += len(ids)
            if self.tokens >= self.window:
                yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        cap, whole, rests = self.capacity, [], []
        for doc, start, length in self.pending:
            full = length // cap
            whole += [[(doc, start + k * cap, cap)] for k in range(full)]
            if length % cap:
                rests.append((doc, start + full * cap, length % cap))
        sequences, rest = assign(rests, sum(x[2] for x in rests) // cap, cap, self.quadratic, self.tries)
        if last:
            sequences += _powers(rest)
            rest = []
        for pieces in whole + sequences:
            offset = 0
            for doc, start, length in pieces:
                key, ids = self.docs[doc]
                yield key, start, length, zlib.crc32(ids[start : start + length]), len(ids), self.next, offset
                offset += length
            self.next += 1
        kept = sorted({x[0] for x in rest})
        place = {doc: k for k, doc in enumerate(kept)}
        self.docs = [(self.docs[doc][0], self.docs[doc][1].copy()) for doc in kept]
        self.pending = [(place[doc], start, length) for doc, start, length in rest]
        self.tokens = sum(x[2] for x in rest)


def _powers(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences of lengths 2^k, descending, that hold all of ``rest``."""
    out, rest, left = [], list(reversed(rest)), sum(x[2] for x in rest)
    while left:
        size = room = 1 << (left.bit_length() - 1)
        out.append([])
        while room:
            doc, start, length = rest.pop()
            take = min(room, length)
            out[-1].append((doc, start, take))
            if take < length:
                rest.append((doc, start + take, length - take))
            room -= take
        left -= size
    return out


SCHEMA = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 4096, window_sequences: int = 512, quadratic: float = 1 / 4096, tries: int = 8) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window_sequences`` bounds a task's buffer (that many times ``capacity`` ids, and one document more), ``tries`` the sequences looked at for a piece.
    """
    source = docs.select(key, text)
    schema = T.StructType([source.schema[key], *SCHEMA.fields])
    kinds = [pa.int64()] * 6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = kept_by_worker(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        packer = Packer(capacity, window_sequences * capacity, quadratic, TaskContext.get().partitionId() * STRIDE, tries)
        some: list[tuple] = []
        for row in _pieces(batches, encode, packer, end_id):
            some.append(row)
            if len(some) == 8192:
                yield _batch(some, kinds, schema.names, key_type)
                some = []
        if some:
            yield _batch(some, kinds, schema.names, key_type)

    key_type = to_arrow_type(source.schema[key].dataType)
    return source.mapInArrow(run, schema)


def _pieces(batches: Iterable[pa.RecordBatch], encode: WordIds, packer: Packer, end_id: int) -> Iterator[tuple]:
    """The pieces of one task's documents; what a batch needed besides is given back, as two workers and a grown heap share an executor's memory."""
    for batch in slices(batches, ROWS):
        yield from packer.add(batch.column(0).to_pylist(), encode(batch.column(1), end_id))
        give_back()
    yield from packer.flush(last=True)


def _batch(rows: list[tuple], kinds: list, names: list[str], key_type) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=names)
