"""Toxicity by misspelling-tolerant lexicon matches and their contexts.

A lexicon of words and of stems (which match every word that begins with them) is
mined from labelled texts and put in a trie. Words meet it through a Levenshtein
automaton: the automaton's state (a row of edit distances) runs down the trie for a
whole batch of words at once, and leaves a branch when no word can end within its
distance. Each match's window of words, and whether quotation marks enclose it at
whatever length up to ``LONGEST_QUOTE`` words, say how likely the match is used
rather than quoted or mentioned; a logistic model over the evidence that remains
scores the text.

Training uses a bounded sample: at most ``per_label`` labelled texts of each
label, those with the smallest key hash; texts alike in their words count once. A
term is taken if its rate among the words of toxic texts is significantly higher,
given how many candidates were looked at and how its occurrences cluster in texts;
there is no cap on how many. What a window's words say starts from ``CUES`` and is
moved by the windows of the labelled texts. The logistic model is fitted on evidence
that lexicons of the other folds find, so that it doesn't trust a lexicon on the texts
that it was mined from.

A null or empty text scores as one without matches. A very long text is matched
whole; its words are met in blocks of bounded size. Without labels of both kinds (an
empty table too) every score is the share of label 1 (or 0.5); an empty table to
score gives no rows. Repeated rows are scored each. Terms that tie go by their
weight, then by their place in the trie. Other columns are not read, whatever
their names, but ``key`` must not be named ``score``.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh, kept_by_worker, slices, split_words, written
from skein.llm.quality import labelled

#: Stripped from both ends of a word.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‚‹›…–—¡¿·"
#: What opens a quotation at a word's start, and what closes it at a word's end.
CLOSERS = {'"': '"”', "'": "'’", "`": "`'", "“": "”\"", "„": "“”\"", "«": "»", "»": "«", "‘": "’'", "‚": "‘’", "‹": "›", "›": "‹"}
CLOSING = frozenset("".join(CLOSERS.values()))
#: Words of a quotation at most, and of a window on either side of a match.
LONGEST_QUOTE, CONTEXT = 120, 6
#: Words that tell of a mention, and for how much (in log-odds) before any labelled text is seen.
CUES = dict.fromkeys("slur slurs insult insults epithet swearword offensive derogatory definition defined insulte injure beleidigung schimpfwort insulto definición".split(), 3.0) | dict.fromkeys(
    "word words term terms called said says wrote quote quoted quotes means meaning mot terme dit signifie wort begriff sagte bedeutet palabra término dijo significa".split(), 2.0
)
QUOTED, USED = 7.0, -3.0
#: Texts that a cue's starting value weighs as much as, and deviations by which another word must differ.
PRIOR, SURE = 20.0, 4.0
#: Shortest and longest stems, words whose match is remembered, words that a worker remembers before it forgets them all.
STEM, REMEMBERED_LENGTH, REMEMBERED = (3, 12), 40, 600_000
#: Rows of a batch: large enough that most of its words repeat. Cells of a matrix of words.
ROWS, CELLS = 4096, 2_000_000
N_FEATURES, FOLDS = 5, 3
#: What a feature's unit adds to the log-odds before any labelled text is seen.
START = np.array([0.4, 0.4, 1.0, 0.5, 1.0])
#: Tasks that share the sample.
TASKS = 24
#: Of an exact match's weight, what a misspelling has that no harmless training text holds.
NEAR = 0.7


def allowed(term: str, stem: bool = False) -> int:
    """Edits within which a word counts as a misspelling of the term (or begins with one of the stem)."""
    return 0 if len(term) < (6 if stem else 4) else 1 if len(term) < 12 else 2


class Lexicon:
    """Weighted terms in a trie, met by batches of words. With ``swaps``, two neighbours that changed places are one edit; ``stems`` are the terms that match what begins with them."""

    def __init__(self, terms: list[str], weights: list[float], swaps: bool = False, stems: Iterable[str] = ()):
        self.swaps, marked = swaps, set(stems)
        self.terms, self.weights = terms, np.array(weights, np.float64)
        self.stems = np.array([t in marked for t in terms], bool)
        self.limits = np.array([allowed(t, t in marked) for t in terms], np.int64)
        self.most = int(self.limits.max()) if terms else 0
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.reach: list[int] = [0]  # the largest distance that a term below allows
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                self.reach[node] = max(self.reach[node], int(self.limits[k]))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
            self.ends[node] = k
            self.reach[node] = max(self.reach[node], int(self.limits[k]))

    def match(self, words: list[str]) -> list[tuple[int, int] | None]:
        """The nearest term (its number and distance; ties to the heavier) within its limit, for each word."""
        found: list[tuple[int, int] | None] = [None] * len(words)
        if not self.terms:
            return found
        longest = max(map(len, self.terms)) + self.most
        lengths = np.array([len(w) for w in words], np.int64)
        usable = np.flatnonzero((lengths > 0) & ((lengths <= longest) | self.stems.any()))
        usable = usable[np.argsort(lengths[usable], kind="stable")]
        width = np.minimum(lengths[usable], longest + 1)
        at = 0
        while at < len(usable):  # blocks of words of like length
            n = max(1, int(np.searchsorted(np.arange(1, len(usable) - at + 1) * (width[at:] + longest), CELLS)))
            rows = usable[at : at + n]
            for k, hit in zip(rows.tolist(), self._block([words[k][: longest + 1] for k in rows], lengths[rows], longest), strict=True):
                found[k] = hit
            at += n
        return found

    def _block(self, words: list[str], n: np.ndarray, longest: int) -> list[tuple[int, int] | None]:
        """``match`` for words cut to what the trie can tell apart; ``n``: their whole lengths."""
        m, band = len(words), self.most
        codes = np.zeros((m, max(map(len, words))), np.uint32)
        for row, w in zip(codes, words, strict=True):
            row[: len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        best_d = np.full(m, 127, np.int8)
        best_t = np.full(m, -1, np.int64)
        padded = np.ascontiguousarray(np.pad(codes, ((0, 0), (band + 1, band + longest + 1))).T)
        # states (a column for each word) hold distances to the word prefixes of length depth - band to depth + band only
        start = np.abs(np.arange(-band, band + 1)).astype(np.int8)
        start[:band] = 100
        start = np.repeat(start[:, None], m, axis=1)
        stack = [(0, np.arange(m), start, 0, None, "")]  # the last two: the state before, and the character since
        while stack:
            node, who, state, depth, older, last = stack.pop()
            if (k := self.ends[node]) >= 0:
                at = n[who] - depth + band
                if self.stems[k]:  # the nearest of all prefixes that the word has
                    d = np.where(np.arange(2 * band + 1)[:, None] <= at, state, 127).min(0)
                else:
                    d = np.where((at >= 0) & (at <= 2 * band), state[np.clip(at, 0, 2 * band), np.arange(len(who))], 127)
                heavier = (best_t[who] < 0) | (self.weights[k] > self.weights[np.maximum(best_t[who], 0)])
                better = (d <= self.limits[k]) & ((d < best_d[who]) | ((d == best_d[who]) & heavier))
                best_d[who[better]], best_t[who[better]] = d[better], k
            if not self.children[node]:
                continue
            near = padded[depth : depth + 2 * band + 2].take(who, 1)
            before, near = near[:-1], near[1:]  # the characters that the new states end with, and those before them
            kept = np.full(state.shape, 100, np.int8)
            kept[:-1] = state[1:] + 1
            for c, child in self.children[node].items():
                new = np.minimum(kept, state + (near != ord(c)))
                if self.swaps and depth:
                    swapped = (near == ord(last)) & (before == ord(c))
                    np.minimum(new, older + 1, out=new, where=swapped)
                if band > depth:
                    new[: band - depth - 1] = 100
                    new[band - depth - 1] = depth + 1
                for j in range(1, 2 * band + 1):
                    np.minimum(new[j], new[j - 1] + 1, out=new[j])
                live = np.flatnonzero(new.min(0) <= self.reach[child])
                if len(live):
                    stack.append((child, who[live], new.take(live, 1), depth + 1, state.take(live, 1), c))
        return [(t, d) if t >= 0 else None for t, d in zip(best_t.tolist(), best_d.tolist(), strict=True)]


def opens(word: str) -> str:
    """The mark with which a word opens a quotation, or nothing."""
    return word[:1] if word[:1] in CLOSERS else ""


def closes(word: str) -> str:
    """The mark with which a word closes one, or nothing."""
    last = word.rstrip(".,;:!?")[-1:]
    return last if last in CLOSING else ""


def quotations(marks: Iterable[tuple[int, str, str]]) -> list[tuple[int, int]]:
    """The first and last word of each quotation, from the words (their place, opening and closing mark) that have a mark.

    A mark that opens again while it is open starts over; one that is not closed within ``LONGEST_QUOTE`` words quotes nothing.
    """
    out, open_at = [], {}
    for k, opening, closing in marks:
        if opening:
            open_at[opening] = k
        for mark in [m for m in open_at if closing and closing in CLOSERS[m]]:
            if k - open_at[mark] < LONGEST_QUOTE:
                out.append((open_at[mark], k))
            del open_at[mark]
    return out


def quoted(words: list[str], at: int) -> bool:
    """Whether the word at ``at`` stands in a quotation."""
    return any(a <= at <= b for a, b in quotations((k, opens(w), closes(w)) for k, w in enumerate(words)))


#: Of each match: the term, the distance, whether quotation marks enclose it, and the bare words around it.
Hit = tuple[int, int, bool, list[str]]


class Matcher:
    """Matches of whole texts; remembers which words match."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, int] | bool] = {}

    def found(self, texts: pa.Array) -> list[tuple[int, list[Hit]]]:
        """Each text's number of words, and its matches."""
        number, distinct, offsets = split_words(pc.utf8_lower(fresh(texts)))
        distinct = distinct.to_pylist()
        met = self._met(distinct)
        out: list[tuple[int, list[Hit]]] = [(int(n), []) for n in np.diff(offsets)]
        matches = np.fromiter(map(bool, met), bool, len(met))
        at = np.flatnonzero(matches[number]) if len(met) else np.zeros(0, int)
        if not len(at):
            return out
        marked = np.fromiter((bool(opens(w) or closes(w)) for w in distinct), bool, len(distinct))
        docs = np.searchsorted(offsets, at, "right") - 1
        for doc in np.unique(docs).tolist():
            lo, hi = int(offsets[doc]), int(offsets[doc + 1])
            inside = lo + np.flatnonzero(marked[number[lo:hi]])
            spans = quotations((k, opens(distinct[number[k]]), closes(distinct[number[k]])) for k in inside.tolist())
            for k in at[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, "right")].tolist():
                around = [distinct[number[j]].strip(MARKS) for j in range(max(lo, k - CONTEXT), min(hi, k + CONTEXT + 1)) if j != k]
                term, distance = met[number[k]]
                out[doc][1].append((term, distance, any(a <= k <= b for a, b in spans), around))
        return out

    def hits(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, bool]]]]:
        """``found`` without the words around."""
        return [(n, [h[:3] for h in found]) for n, found in self.found(texts)]

    def _met(self, words: list[str]) -> list[tuple[int, int] | bool]:
        known = self.known
        met = list(map(known.get, words))
        gaps = [k for k, m in enumerate(met) if m is None]
        if len(known) + len(gaps) > REMEMBERED:
            known.clear()
        bare = {words[k].strip(MARKS) for k in gaps}
        some, found = list(bare), {}
        for at in range(0, len(some), 50_000):
            chunk = some[at : at + 50_000]
            found.update((w, m) for w, m in zip(chunk, self.lexicon.match(chunk), strict=True) if m)
        for k in gaps:
            met[k] = found.get(words[k].strip(MARKS), False)
            if len(words[k]) <= REMEMBERED_LENGTH:
                known[words[k]] = met[k]
        return met


class Context:
    """How likely a match is used rather than mentioned: log-odds of a mention, summed over its window's words and its quotation marks."""

    def __init__(self, words: dict[str, float], quote: float):
        self.words, self.quote = words, quote

    @classmethod
    def learned(cls, found: list[tuple[int, list[Hit]]], y: np.ndarray, stems: np.ndarray) -> Context:
        """From the windows of words matched as they are spelled in harmless and toxic texts: a word beyond ``CUES`` counts if it differs by more than ``SURE`` deviations."""
        texts, count = np.zeros(2), defaultdict(lambda: np.zeros(2))
        for (_, hits), label in zip(found, y.astype(int).tolist(), strict=True):
            exact = [h for h in hits if not h[1] and not stems[h[0]]]
            if exact:
                texts[label] += 1
                for w in {w for h in exact for w in h[3] if w} | ({""} if any(h[2] for h in exact) else set()):
                    count[w][label] += 1  # "" stands for quotation marks
        out = dict(CUES)
        for w, (c0, c1) in count.items():
            seen = float(np.log((c0 + 0.5) / (texts[0] + 1)) - np.log((c1 + 0.5) / (texts[1] + 1)))
            if not w or w in CUES or abs(seen) > SURE * np.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5)):
                out[w] = (PRIOR * (CUES.get(w, 0.0) if w else QUOTED) + (c0 + c1) * seen) / (PRIOR + c0 + c1)
        quote = out.pop("", QUOTED)
        return cls(out, quote)

    def used(self, hit: Hit) -> float:
        """Between 0 (mentioned) and 1 (used)."""
        words = [self.words[w] for w in set(hit[3]) if w in self.words]
        z = USED + self.quote * hit[2] + sum(w for w in words if w > 0) + max(-1.0, sum(w for w in words if w < 0))
        return float(1 / (1 + np.exp(np.clip(z, -30, 30))))


class Model:
    """A lexicon, its terms' weights when misspelled, what contexts tell, and a logistic score of the evidence."""

    def __init__(self, lexicon: Lexicon, near: np.ndarray, coef: np.ndarray, bias: float, context: Context | None = None):
        self.lexicon, self.near, self.coef, self.bias = lexicon, near, coef, bias
        self.context = context or Context(CUES, QUOTED)

    def evidence(self, found: list[tuple[int, list[Hit]]]) -> np.ndarray:
        """Of each text: the strongest use of a word as it is spelled, and of other matches; all uses; the terms used; the share of uses among its words."""
        out = np.zeros((len(found), N_FEATURES))
        for row, (n, hits) in zip(out, found, strict=True):
            if hits:
                used = [(self.near[h[0]] / h[1] if h[1] else self.lexicon.weights[h[0]]) * self.context.used(h) for h in hits]
                spelled = [not h[1] and not self.lexicon.stems[h[0]] for h in hits]
                row[0] = max((w for w, s in zip(used, spelled, strict=True) if s), default=0)
                row[1] = max((w for w, s in zip(used, spelled, strict=True) if not s), default=0)
                row[2] = np.log1p(sum(used))
                row[3] = np.log1p(len({h[0] for h, w in zip(hits, used, strict=True) if w > 1}))
                row[4] = min(1.0, 5 * sum(used) / n)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.bias, -30, 30)))


def near_weights(lexicon: Lexicon, found: list, y: np.ndarray) -> np.ndarray:
    """What a misspelling of each term weighs: less, the more harmless texts hold one."""
    harmless = np.zeros(len(lexicon.terms))
    for (_, hits), label in zip(found, y, strict=True):
        if label == 0:
            harmless[list({h[0] for h in hits if h[1]})] += 1
    return NEAR * lexicon.weights / (1 + harmless) ** 2


def mine(counts: pd.DataFrame, words: tuple[float, float], texts: tuple[float, float], least_share: float = 0.01, least_lift: float = 1.6, sure: float = 6.0, sure_texts: float = 12.0) -> tuple[list[str], list[float], set[str]]:
    """Terms whose rate in toxic texts is significantly higher, their log-odds, and which of them are stems.

    ``counts``: w, stem, and of each label the texts (a, b), occurrences (ao, bo) and the sums over texts of their squares by the text's
    words (aq, bq); ``words``: of all words those in toxic and in harmless texts; ``texts``: how many there are. The likelihood ratio, divided
    by the dispersion of the occurrences over texts, must exceed twice the logarithm of the number of candidates by ``sure``,
    and that of the texts which hold the term ``sure_texts``. A stem is left out if one word makes up most of it, a term if a stem that is as strong begins it.
    """
    if counts.empty:
        return [], [], set()
    c = counts[counts["a"] >= max(3, least_share * texts[0])].copy()
    total = words[0] + words[1]
    a, b = c["ao"].to_numpy(float), c["bo"].to_numpy(float)
    lift = np.log((a + 0.5) / (words[0] + 1)) - np.log((b + 0.5) / (words[1] + 1))
    # texts that hold it, whatever their length: one text's repetitions don't make a term
    n, m = c["a"].to_numpy(float), c["b"].to_numpy(float)
    part = lambda k, of, all_: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(of * all_, 1e-9)), 0)
    share = (n + m) / sum(texts)
    by_text = 2 * (part(n, share, texts[0]) + part(m, share, texts[1]) + part(texts[0] - n, 1 - share, texts[0]) + part(texts[1] - m, 1 - share, texts[1]))
    spread = np.maximum(1.0, ((c["aq"] + c["bq"]).to_numpy(float) * total / (a + b) - (a + b)) / sum(texts))
    ratio = 2 * (a * np.log(a * total / ((a + b) * words[0])) + np.where(b > 0, b * np.log(np.maximum(b, 1e-9) * total / ((a + b) * max(words[1], 1))), 0)) / spread
    c["lift"], c["ratio"] = lift, ratio
    c = c[(lift >= least_lift) & (ratio >= 2 * np.log(max(2, len(counts))) + sure) & (by_text >= sure_texts)].sort_values(["ratio", "stem", "w"], ascending=[False, True, True])
    whole = c[~c["stem"]].set_index("w")["a"].to_dict()
    largest: dict[str, int] = {}
    for w, n in whole.items():
        for k in range(STEM[0], min(len(w), STEM[1]) + 1):
            largest[w[:k]] = max(largest.get(w[:k], 0), n)
    terms: dict[str, float] = {}
    stems: set[str] = set()
    for w, stem, n, up in zip(c["w"], c["stem"], c["a"], c["lift"], strict=True):
        if stem and largest.get(w, 0) > 0.6 * n:
            continue
        if any(w[:k] in stems for k in range(STEM[0], len(w) + 1)) or w in terms:
            continue
        if stem and any(t.startswith(w) for t in stems):
            continue
        terms[w] = float(up)
        if stem:
            stems.add(w)
    return list(terms), list(terms.values()), stems


def candidates(texts: pa.Array, labels: np.ndarray, folds: np.ndarray) -> pa.RecordBatch:
    """Of each word and stem, by fold and label: texts, occurrences, and their squares over the text's words, summed. The row ("", no stem) counts texts and words."""
    number, distinct, offsets = split_words(pc.utf8_lower(fresh(texts)))
    place: dict[str, int] = {}
    bare = np.array([place.setdefault(w.strip(MARKS), len(place)) for w in distinct.to_pylist()], np.int64)
    words, sizes = list(place), np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pair, held = np.unique(doc * max(1, len(words)) + bare[number], return_counts=True) if len(number) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc, word = pair // max(1, len(words)), pair % max(1, len(words))
    group, length = folds * 2 + labels, np.array([len(w) for w in words], np.int64)
    parts = [([""], False, np.arange(len(sizes)), np.zeros(len(sizes), np.int64), sizes)]
    real = length[word] > 0
    parts.append((words, False, doc[real], word[real], held[real]))
    for size in range(STEM[0], STEM[1] + 1):
        stems: dict[str, int] = {}
        of = np.array([stems.setdefault(w[:size], len(stems)) if len(w) >= size else -1 for w in words], np.int64)
        some = of[word] >= 0 if len(word) else np.zeros(0, bool)
        both, inverse = np.unique(doc[some] * max(1, len(stems)) + of[word[some]], return_inverse=True)
        parts.append((list(stems), True, both // max(1, len(stems)), both % max(1, len(stems)), np.bincount(inverse, held[some], len(both)).astype(np.int64)))
    rows = []
    for names, stem, docs, term, n in parts:
        key, inverse = np.unique(term * (2 * FOLDS) + group[docs], return_inverse=True)
        sums = [np.bincount(inverse, x, len(key)) for x in (np.ones(len(n)), n, n * n / np.maximum(1, sizes[docs]))]
        rows.append(pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()).take(pa.array(key // (2 * FOLDS))), pa.array(np.full(len(key), stem)), pa.array(key % (2 * FOLDS) // 2, pa.int32()), pa.array(key % 2, pa.int32()),
            pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]),
        ], names=["w", "stem", "f", "y", "n", "o", "q"]))
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", per_label: int = 4000) -> Model:
    """A model of ``labels`` learned from the rows of ``docs`` where ``learn`` holds."""
    sample = labelled(docs, labels, learn, label, key, text, per_label).select(F.coalesce(text, F.lit("")).alias("t"), F.col(label).cast("int").alias("y"))
    # near copies would make each of their words look significant: most share their two long words of smallest hash under one of four hashes
    words = F.array_distinct(F.split(F.lower("t"), r"\s+"))
    long = F.filter("_w", lambda w: F.length(w) >= 7)
    sample = sample.withColumn("_w", words).withColumn("_w", F.when(F.size(long) >= 4, long).otherwise(F.col("_w")))
    for k in range(4):
        sample = sample.withColumn("s", F.slice(F.array_sort(F.transform("_w", lambda w, k=k: F.xxhash64(F.lit(k), w))), 1, 2)).dropDuplicates(["s", "y"])
    sample = written(sample.select("t", "y", F.pmod(F.xxhash64("s"), F.lit(FOLDS)).cast("int").alias("f")).repartition(TASKS, "t"), "toxic-sample")

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield candidates(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    names = {"a": ("n", 1), "b": ("n", 0), "ao": ("o", 1), "bo": ("o", 0), "aq": ("q", 1), "bq": ("q", 0)}
    by_fold = [F.sum(F.when((F.col("y") == y) & (F.col("f") == f), F.col(c)).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS) for name, (c, y) in names.items()]
    in_toxic = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    counts = sample.mapInArrow(terms, "w string, stem boolean, f int, y int, n long, o long, q double").groupBy("w", "stem").agg(in_toxic.alias("a"), *by_fold).filter("a >= 3 or w = ''")
    found = counts.toPandas()  # words of three toxic texts of the sample: bounded by it
    totals = {c: {f: float(found.loc[found["w"] == "", f"{c}{f}"].sum()) for f in range(FOLDS)} for c in names}
    n_pos, n_neg = sum(totals["a"].values()), sum(totals["b"].values())
    if not n_pos or not n_neg:
        return Model(Lexicon([], []), np.zeros(0), np.zeros(N_FEATURES), 30.0 if n_pos else -30.0 if n_neg else 0.0)
    found = found[found["w"] != ""]

    def lexicon_without(left_out: int | None) -> Lexicon:
        some = [f for f in range(FOLDS) if f != left_out]
        part = pd.DataFrame({"w": found["w"], "stem": found["stem"].astype(bool), **{c: sum(found[f"{c}{f}"] for f in some) for c in names}})
        mined, weights, stems = mine(part, (sum(totals["ao"][f] for f in some), sum(totals["bo"][f] for f in some)), (sum(totals["a"][f] for f in some), sum(totals["b"][f] for f in some)))
        return Lexicon(mined, weights, swaps=True, stems=stems)

    lexicons = [lexicon_without(f) for f in (*range(FOLDS), None)]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x) for x in lexicons]
        for batch in slices(batches):
            rows = [json.dumps(x) for x in zip(*(m.found(batch.column(0)) for m in matchers), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.string())], names=["y", "f", "hits"])

    rows = sample.mapInArrow(encode, "y int, f int, hits string").toPandas().sort_values(["y", "f", "hits"])
    hits, y, fold = [json.loads(h) for h in rows["hits"]], rows["y"].to_numpy(np.float64), rows["f"].to_numpy()

    def untrained(k: int, rows: np.ndarray) -> Model:
        """The k-th lexicon, with what the matches in ``rows`` tell of misspellings and contexts."""
        mine_, labels_ = [hits[r][k] for r in rows], y[rows]
        return Model(lexicons[k], near_weights(lexicons[k], mine_, labels_), np.zeros(N_FEATURES), 0.0, Context.learned(mine_, labels_, lexicons[k].stems))

    x = np.zeros((len(y), N_FEATURES))
    for f in range(FOLDS):
        out = np.flatnonzero(fold == f)
        x[out] = untrained(f, np.flatnonzero(fold != f)).evidence([hits[r][f] for r in out])
    model = untrained(FOLDS, np.arange(len(y)))
    model.coef, model.bias = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards ``START``; all evidence speaks for the label, so no coefficient is negative."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    start, free = np.append(START, 0.0), np.ones(z.shape[1], bool)
    loss = lambda b: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b)).sum() + ridge / 2 * ((b - start)[free] ** 2).sum()
    while True:
        beta = np.where(free, start, 0.0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.zeros(len(beta))
            step[free] = np.linalg.solve((z[:, free] * (p * (1 - p))[:, None]).T @ z[:, free] + ridge * np.eye(int(free.sum())), (z.T @ (p - y) + ridge * (beta - start))[free])
            while np.abs(step).max() > 1e-9 and loss(beta - step) > loss(beta):  # a step too far
                step /= 2
            beta = beta - step
            if np.abs(step).max() < 1e-8:
                break
        below = (beta < 0) & (np.arange(len(beta)) < len(beta) - 1)
        if not below.any():
            return beta[:-1], float(beta[-1])
        free &= ~below


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the score (0 to 1, higher: toxic likelier) of each row."""
    source = docs.select(key, text)
    out = T.StructType([source.schema[key], T.StructField("score", T.DoubleType())])
    same = zlib.crc32(pickle.dumps((model.lexicon.terms, model.lexicon.weights.tolist(), model.lexicon.stems.tolist(), model.lexicon.swaps)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept_by_worker(("toxic matcher", same), lambda: Matcher(model.lexicon))
        for batch in slices(batches, ROWS):
            x = model.evidence(matcher.found(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=out.names)

    return source.mapInArrow(run, out)
