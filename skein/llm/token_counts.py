"""Token counts by a forward pass over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch go into a trie (sorted, level by level); the
forward state of a prefix - its best score, last piece and number of tokens - is
computed once at its node for all pre-tokens that share it, and a pre-token's
count is read off its terminal node. A text's count is the sum over its
pre-tokens.

For a unigram model the forward state is led by the summed piece scores. For a
merge (BPE) model such scores are ranks and give other counts than the model's
own, so there the state is led by the last piece that merging allows (see
piece_codec). Either way the counts are the library's.

A long pre-token (text without spaces) is first cut where no piece can cross, and
so becomes many short ones that share their trie with the others.

A null or empty text has 0 tokens, an empty table gives no rows. Repeated rows are
counted each. Of merges of equal rank (ties) the one further left comes first, as
in the library. Other columns are not read, whatever their names, but ``key`` must
not be named as a result is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import kept_by_worker, slices
from skein.llm.piece_codec import LONGEST, REMEMBERED, ROWS, Pieces, pretokens

#: Cells of a trie's level matrix that are held at once.
CELLS = 4_000_000


class TrieCounter:
    """Counts of words; remembers those of short ones."""

    def __init__(self, path: str, merges: bool | None = None):
        self.pieces = Pieces(path, merges)
        self.known: dict[str, int] = {}
        self.nodes = self.positions = 0

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word."""
        parts = [(k, part) for k, w in enumerate(words) for part in (self.pieces.cut(w) if len(w) > LONGEST else [w])]
        whole = list(dict.fromkeys(part for _, part in parts))
        found = dict(zip(whole, self._of_parts(whole).tolist(), strict=True))
        return np.bincount([k for k, _ in parts], [found[part] for _, part in parts], len(words)).astype(np.int64)

    def _of_parts(self, words: list[str]) -> np.ndarray:
        """The counts of distinct words, by tries of bounded size."""
        order = sorted(range(len(words)), key=lambda k: words[k])
        # long words go apart, so that a short one's row isn't as long as they are
        out = np.zeros(len(words), np.int64)
        for long in (False, True):
            some = [k for k in order if (len(words[k]) > LONGEST) == long]
            at = 0
            while at < len(some):
                n, width = 0, 1
                while at + n < len(some) and (not n or (n + 1) * (max(width, len(words[some[at + n]])) + 1) <= CELLS):
                    width = max(width, len(words[some[at + n]]))
                    n += 1
                rows = some[at : at + n]
                out[rows] = self._trie([words[k] for k in rows])
                at += n
        return out

    def _trie(self, words: list[str]) -> np.ndarray:
        """The counts of sorted words, by their trie."""
        p, m = self.pieces, len(words)
        size = np.array([len(w) for w in words])
        width = int(size.max())
        codes = np.zeros((m, width), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[np.repeat(np.arange(m), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat + np.uint64(1)
        # a row opens a node at a depth if its prefix of that length isn't the row above's
        opens = np.ones((m, width), bool)
        opens[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        prefix = np.zeros((m, width + 1), np.uint64)
        node = np.zeros((m, width + 1), np.int32)
        last, best, count = [np.array([-1])], [np.zeros(1)], [np.zeros(1, np.int64)]
        with np.errstate(over="ignore"):
            for depth in range(1, width + 1):
                prefix[:, depth] = prefix[:, depth - 1] * p.powers[1] + codes[:, depth - 1]
                there = size >= depth
                opening = opens[:, depth - 1] & there
                node[:, depth] = np.cumsum(opening) - 1
                row = np.flatnonzero(opening)
                starts = np.arange(max(0, depth - p.longest), depth)
                at, hit = p.probe(prefix[row, depth, None] - prefix[row[:, None], starts] * p.powers[depth - starts], depth - starts)
                above = node[row[:, None], starts]
                before = np.stack([last[s][above[:, i]] for i, s in enumerate(starts)], 1)
                scores = np.stack([best[s][above[:, i]] for i, s in enumerate(starts)], 1)
                k, piece, score = p.step(at, hit, before, scores)
                tokens = np.stack([count[s][above[:, i]] for i, s in enumerate(starts)], 1)[np.arange(len(row)), k]
                c = codes[row, depth - 1] - np.uint64(1)
                in_bytes = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                last.append(piece)
                best.append(score)
                count.append(tokens + np.where(piece >= 0, 1, in_bytes))
                self.nodes += len(row)
        self.positions += int(size.sum())
        out = np.zeros(m, np.int64)
        for depth in np.unique(size):
            rows = np.flatnonzero(size == depth)
            out[rows] = count[depth][node[rows, depth]]
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the number of pre-tokens and of tokens."""
        number, words, offsets = pretokens(texts)
        known = self.known
        found = list(map(known.get, words))
        gaps = [k for k, c in enumerate(found) if c is None]
        if len(known) + len(gaps) > REMEMBERED:
            known.clear()
        for k, c in zip(gaps, self.counts([words[k] for k in gaps]).tolist(), strict=True):
            found[k] = c
            if len(words[k]) <= LONGEST:
                known[words[k]] = c
        each = np.array(found, np.int64)[number] if len(number) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])[offsets]
        parts = np.concatenate([[0], np.cumsum(each > 0)])[offsets]
        return np.diff(parts), np.diff(ends)


def count(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_pretokens and n_tokens of each row's whole text."""
    source = docs.select(key, text)
    out = T.StructType([source.schema[key], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(("trie counter", model_path), lambda: TrieCounter(model_path))
        for batch in slices(batches, ROWS):
            parts, tokens = counter.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int64()), pa.array(tokens, pa.int64())], names=out.names)

    return source.mapInArrow(run, out)
