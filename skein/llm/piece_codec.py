"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text's pre-tokens (a run of spaces opens one, a line feed is one) are numbered per
batch; distinct ones of equal length advance together. Rolling hashes of all
substrings that end at a position probe the sorted keys of the pieces, a
vectorised maximum over the pieces that may end there is stored as back-pointer,
and the back-pointers give the ids.

For a unigram model the maximum is that of the summed piece scores. The scores of
a merge (BPE) model are merge ranks, whose sums give other ids than the model's
own, so there the maximum is taken over what merging allows: a prefix has exactly
one last piece that stands next to the piece before it without the two sides
merging, and that one is kept. Either way the ids are the library's.

Characters that no piece covers fall back to the byte pieces, so decoding gives
the text back exactly (but for the model's own mark of a space, which the model
cannot tell from one).

A null text encodes as an empty one, which has no ids; an empty table gives no
rows. Repeated rows are encoded each; a text of any length is encoded whole, a long
pre-token cut where no piece can cross. Of merges of equal rank (ties) the one
further left comes first, as in the library. Other columns are not read, whatever
their names, but ``key`` must not be named as a result is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import fresh, kept_by_worker, slices

SPACE, CUT = "▁", "\x01"
RUNS = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a worker remembers before it forgets them all, and the longest remembered.
REMEMBERED, LONGEST = 1_000_000, 48
ROWS = 4096


class Pieces:
    """A model file's pieces, probed by substring hashes. ``merges``: whether their scores are merge ranks (None: as they look)."""

    def __init__(self, path: str, merges: bool | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        raw = np.array([model.get_score(i) for i in range(n)], np.float64)
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.merges = bool(np.all(raw[normal] == np.round(raw[normal]))) if merges is None else merges
        if self.merges:
            self.ranks = {self.pieces[i]: -raw[i] for i in normal}
            self._spines(normal)
            normal = [i for i in normal if len(self.pieces[i]) == 1 or self.pieces[i] in self.parts]
        lengths = np.array([len(self.pieces[i]) for i in normal])
        self.longest = int(lengths.max())
        self.joined = {p[k : k + 2] for i in normal for p in [self.pieces[i]] for k in range(len(p) - 1)}
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                self.powers[k] = self.powers[k - 1] * BASE
        keys = np.array([self._hash(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.lengths = keys[order], np.array(normal)[order], lengths[order]
        self.scores = raw[self.ids]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.fallback = float(self.scores.min()) - 10.0
        self.pairs: dict[int, bool] = {}
        self.spelled: list[bytes] | None = None

    def _spines(self, normal: list[int]) -> None:
        """The two parts that each piece is merged from, and for its left and right edge the parts that come to stand there, each with the rank at which it is merged away."""
        self.parts = {p: last for i in normal if len(p := self.pieces[i]) > 1 and (last := self._last_merge(p))}
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        for i in normal:
            for side, spine in ((0, self.left), (1, self.right)):
                p, until = self.pieces[i], np.inf
                spine[i] = [(p, until)]
                while p in self.parts:
                    until, p = self.ranks[p], self.parts[p][side]
                    spine[i].append((p, until))

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols that merging leaves of a piece just before it is whole; None if it never is."""
        symbols = list(piece)
        while len(symbols) > 2:
            rank, k = min((self.ranks.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == np.inf:
                return None
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return tuple(symbols)

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces ``a`` and ``b`` side by side: no symbols that meet at their border merge before both are taken up."""
        ranks = self.ranks
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                rank = ranks.get(x + y)
                # of equal ranks the merge further left comes first
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For pairs of ids, whether the second may follow the first; -1 before stands for a text's start or a character in bytes."""
        pairs, inverse = np.unique(before.astype(np.int64) << 32 | piece, return_inverse=True)
        known = self.pairs
        if len(known) > 1_000_000:
            known.clear()
        out = np.ones(len(pairs), bool)
        for k, pair in enumerate(pairs.tolist()):
            if pair >= 0:
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.beside(pair >> 32, pair & 0xFFFFFFFF)
                out[k] = ok
        return out[inverse]

    def probe(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where among the keys each substring's hash is, and whether it is a piece."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, (self.keys[at] == hashes) & (self.lengths[at] == lengths)

    def step(self, at: np.ndarray, hit: np.ndarray, last: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One position for many words: from the pieces that may end there (rows: words; columns: starts, the last one a character back)
        and the last pieces and scores at those starts, the best start's column, the piece (-1: the last character in bytes) and the score."""
        rows = np.arange(len(at))
        if self.merges:
            r, c = np.nonzero(hit)
            allowed = np.zeros(hit.shape, bool)
            allowed[r, c] = self.may_follow(last[r, c], self.ids[at[r, c]])
            k = allowed.argmax(1)
            found, score = allowed[rows, k], np.zeros(len(at))
        else:
            total = np.where(hit, best + self.scores[at], -np.inf)
            k = total.argmax(1)
            alone = best[:, -1] + self.fallback
            found = total[rows, k] >= alone
            score = np.where(found, total[rows, k], alone)
        return np.where(found, k, at.shape[1] - 1), np.where(found, self.ids[at[rows, k]], -1), score

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def cut(self, word: str) -> list[str]:
        """The parts of a word between characters that stand side by side in no piece: each is encoded as if it were alone."""
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; long ones are cut into parts first."""
        parts = [self.cut(w) if len(w) > LONGEST else [w] for w in words]
        whole = list(dict.fromkeys(x for p in parts for x in p))
        found = dict(zip(whole, self._of_parts(whole), strict=True))
        return [found[p[0]] if len(p) == 1 else [i for x in p for i in found[x]] for p in parts]

    def _of_parts(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words: those of a length advance together."""
        out: list[list[int]] = [[] for _ in words]
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for length, rows in by.items():
            block = max(1, 400_000 // (length + 1))
            for at in range(0, len(rows), block) if length else ():
                some = rows[at : at + block]
                for k, ids in zip(some, self._advance([words[k] for k in some], length), strict=True):
                    out[k] = ids
        return out

    def _advance(self, words: list[str], n: int) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
        m = len(words)
        with np.errstate(over="ignore"):
            prefix = np.zeros((m, n + 1), np.uint64)
            for j in range(n):
                prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j] + np.uint64(1)
            best = np.zeros((m, n + 1))
            back, used = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int64)
            for end in range(1, n + 1):
                starts = np.arange(max(0, end - self.longest), end)
                at, hit = self.probe(prefix[:, end : end + 1] - prefix[:, starts] * self.powers[end - starts], end - starts)
                k, used[:, end], best[:, end] = self.step(at, hit, used[:, starts], best[:, starts])
                back[:, end] = starts[k]
        out = []
        for w, b, u in zip(words, back.tolist(), used.tolist(), strict=True):
            ids, end = [], n
            while end:
                ids.append(u[end] if u[end] >= 0 else w[b[end] : end])
                end = b[end]
            ids.reverse()
            if any(isinstance(x, str) for x in ids):
                ids = [i for x in ids for i in ([x] if isinstance(x, int) else self.byte_ids[list(x.encode("utf-8", "surrogatepass"))].tolist())]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        if self.spelled is None:
            self.spelled = self._bytes()
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")[1:]

    def _bytes(self) -> list[bytes]:
        table = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        return table


def pretokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The pre-tokens of texts: each one's number among the distinct ones, those, and where each text's begin and end."""
    texts = fresh(texts)
    odd = pc.match_substring(texts, CUT)
    if pc.any(odd).as_py():  # the cut itself occurs: Python parts such texts
        lists = pa.array([[w for w in RUNS.findall((SPACE + t).replace(" ", SPACE))] if t else [] for t in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", SPACE).cast(pa.large_string())
        marked = pc.binary_join_element_wise(lead, pc.replace_substring(texts, " ", CUT + SPACE), pa.scalar("", pa.large_string()))
        for _ in range(2):  # a run of spaces stays whole: the first round leaves no single one
            marked = pc.replace_substring(marked, SPACE + CUT + SPACE, SPACE + SPACE)
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}"), CUT)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), offsets - offsets[0]


class Encoder:
    """Encodes batches of whole texts; remembers the ids of short words."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        number, words, offsets = pretokens(texts)
        known = self.known
        ids = list(map(known.get, words))
        gaps = [k for k, v in enumerate(ids) if v is None]
        if len(known) + len(gaps) > REMEMBERED:
            known.clear()
        for k, found in zip(gaps, self.pieces.viterbi([words[k] for k in gaps]), strict=True):
            ids[k] = np.array(found, "<u4").tobytes()
            if len(words[k]) <= LONGEST:
                known[words[k]] = ids[k]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(size)])
        each = size[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(first[number] - ends[:-1], each) + np.arange(ends[-1])] if len(number) else flat
        bounds = ends[offsets]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """``key``, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decodes_back and, if asked for, the ids of each row."""
    source = docs.select(key, text)
    fields = [source.schema[key], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decodes_back", T.BooleanType())]
    out = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("piece encoder", model_path), lambda: Encoder(model_path))
        for batch in slices(batches, ROWS):
            texts = batch.column(1).fill_null("")
            ids = encoder(texts)
            back = [encoder.pieces.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts.to_pylist(), strict=True)]
            columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(back, pa.bool_())]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out)


def decode(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of each row's ids (null for null ids)."""
    source = rows.select(key, ids)
    out = T.StructType([source.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_by_worker(("piece encoder", model_path), lambda: Encoder(model_path)).pieces
        for batch in slices(batches, ROWS):
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=out.names)

    return source.mapInArrow(run, out)
