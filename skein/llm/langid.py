"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length; bytes are embedded,
convolved by filters of several widths, max-pooled over positions and classified
by a softmax. A text's scores are its windows' mean probabilities, weighted by
the bytes they hold, so that the whole text counts. At prediction, embedding and
filters fold into tables over pairs of bytes, so that a position costs two row
look-ups.

``train`` uses a bounded sample: at most ``per_label`` texts of each language (all
languages together at most ``most_texts``), those with the smallest key hash, with
all their windows, which share their text's weight. Of more than ``MOST_LABELS``
languages the commonest are learned (of equally common ones those that sort
first); texts in the others are predicted as one of those. ``teach`` goes on from
there over every text in a learned language: each task once over its own, then the
tasks' networks are averaged. How rows are dealt over tasks moves the result a little.

Nulls, and texts without any letter, are ``und`` with score 0. With no language
to learn from (an empty table too), every text is ``und``; an empty table to
predict gives no rows. A very long text is taken window by window. Of languages
that tie, the one that sorts first is predicted. Repeated rows are scored each.
Other columns are not read, whatever their names; those in ``keep`` come back as
they were, and must not be named as the results are.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import averaged, bounded_sample, descend, flat, free_worker, slices
from skein.plans.scratch import remove, scratch_path

UNKNOWN = "und"
WINDOW, WIDTHS, EMBED, FILTERS = 256, (2, 3, 4), 8, 12
MOST_LABELS = 512
LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of ``size``, the last filled with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def shortened(x: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """The windows, three in ten of them cut, so that short texts are learned too."""
    x = x.copy()
    for k in np.flatnonzero(g.random(len(x)) < 0.3):
        x[k, g.integers(8, WINDOW) :] = 0
    return x


class ByteNet:
    """The network: ``fit`` on windows and classes, ``proba`` of windows."""

    def __init__(self, classes: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        self.classes = classes
        n = FILTERS * len(WIDTHS)
        self.p = {"e": g.normal(0, 0.5, (256, EMBED)), "w": g.normal(0, 0.3, (n, len(classes))), "b": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"k{w}"] = g.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0  # filling

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7, share: np.ndarray | None = None) -> ByteNet:
        """``share``: how much of its text each window stands for; languages weigh alike."""
        g = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        share = np.ones(len(y)) if share is None else share
        weight = (share / np.bincount(y, share, minlength=len(self.classes))[y]).astype(np.float32)
        weight *= len(y) / weight.sum()
        for epoch in range(epochs):
            order = g.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                grad = self._gradient(shortened(x[rows], g), y[rows], weight[rows])
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, d in grad.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                self.p["e"][0] = 0
        return self

    def go_on(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, g: np.random.Generator, rate: float, batch: int = 64) -> None:
        """Once over the windows, in plain steps: those of many tasks add up as their gradients do."""
        order = g.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            descend(self.p, self._gradient(shortened(x[rows], g), y[rows], weight[rows]), rate)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED)
            z = patches @ p[f"k{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + p[f"c{w}"]
            pooled.append(np.maximum(top, 0))
            kept.append((patches, at, top > 0))
        h = np.concatenate(pooled, 1)
        s = h @ p["w"] + p["b"]
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q *= weight[:, None] / n
        out = {"w": h.T @ q, "b": q.sum(0), "e": np.zeros_like(p["e"])}
        dh = q @ p["w"].T
        for k, w in enumerate(WIDTHS):
            patches, at, on = kept[k]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            rows = np.arange(n)[:, None]
            best = patches[rows, at]  # n, filters, w * embed
            out[f"k{w}"] = np.einsum("nfi,nf->if", best, d)
            out[f"c{w}"] = d.sum(0)
            de = d[:, :, None] * p[f"k{w}"].T[None]  # n, filters, w * embed
            for j in range(w):
                np.add.at(out["e"], x[rows, at + j], de[:, :, j * EMBED : (j + 1) * EMBED])
        out["e"][0] = 0
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Partial sums for pairs of bytes at a position, and at two positions on."""
        part = {w: [self.p["e"] @ self.p[f"k{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        first = np.concatenate([pair(part[2][0], part[2][1]), pair(part[3][0], part[3][1]), pair(part[4][0], part[4][1])], 1)
        later = np.concatenate([pair(part[3][2], np.zeros_like(part[3][2])), pair(part[4][2], part[4][3])], 1)
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(later, np.float32)

    def proba(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None, block: int = 48) -> np.ndarray:
        first, later = tables or self.tables()
        bias = np.concatenate([self.p[f"c{w}"] for w in WIDTHS])
        h = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(x), block):
            b = np.concatenate([x[at : at + block], np.zeros((len(x[at : at + block]), 2), np.uint8)], 1).astype(np.intp)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            z = first[pairs[:, : WINDOW - 1]]
            z[:, :, FILTERS:] += later[pairs[:, 2:]]
            h[at : at + block, :FILTERS] = z[:, :, :FILTERS].max(1)
            h[at : at + block, FILTERS : 2 * FILTERS] = z[:, : WINDOW - 2, FILTERS : 2 * FILTERS].max(1)
            h[at : at + block, 2 * FILTERS :] = z[:, : WINDOW - 3, 2 * FILTERS :].max(1)
        s = np.maximum(h + bias, 0) @ self.p["w"] + self.p["b"]
        q = np.exp(s - s.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 250, most_texts: int = 6000, most_labels: int = MOST_LABELS) -> ByteNet | None:
    """A network learned from a bounded sample of the rows where ``learn`` holds and ``lang`` is known."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    # at most most_texts rows: a proven bound
    sample = F.broadcast(bounded_sample(known, "_lang", key, per_label, most_labels, most_texts).select(F.col(key).alias("_key"), F.col("_lang").alias("_name")).distinct())
    picked = known.join(sample, (F.col(key) == F.col("_key")) & (F.col("_lang") == F.col("_name")), "left_semi")

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(name, windows(t.encode())) for t, name in zip(frame["_text"], frame["_lang"], strict=True) if LETTER.search(t)]
            yield pd.DataFrame([(str(name), w.tobytes()) for name, w in rows], columns=["name", "bytes"])

    found = picked.mapInPandas(cut, "name string, bytes binary").toPandas().sort_values(["name", "bytes"])
    if found.empty:
        return None
    classes = sorted(found["name"].unique())
    each = found["bytes"].map(len).to_numpy() // WINDOW
    x = np.frombuffer(b"".join(map(bytes, found["bytes"])), np.uint8).reshape(-1, WINDOW)
    y = np.repeat(np.searchsorted(classes, found["name"].to_numpy(dtype=object)), each)
    epochs = max(2, min(60, 45_000 // len(x)))
    return ByteNet(classes).fit(x, y, epochs, share=np.repeat(1 / each, each))


def predict(docs: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``key``, the columns in ``keep``, and under ``names`` the language and its score of each row."""
    source = docs.select(key, F.col(text).alias("_text"), *keep)
    out = T.StructType([source.schema.fields[0], *source.schema.fields[2:], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        tables = net.tables() if net else None
        for batch in slices(batches):
            found, scores = label(batch.column(1).to_pylist(), net, tables)
            columns = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=out.names)

    return source.mapInArrow(run, out)


def teach(docs: DataFrame, net: ByteNet | None, learn: Column, text: str = "text", lang: str = "lang", rate: float = 0.1) -> ByteNet | None:
    """``net`` taught by every row where ``learn`` holds and ``lang`` is one of its languages, which weigh alike."""
    if net is None:
        return None
    known = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isin(net.classes)).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    # one row for each of the network's languages: a proven bound
    counts = known.groupBy("_lang").agg(F.count("*"), F.sum(F.ceil(F.greatest(F.octet_length("_text"), F.lit(1)) / WINDOW))).collect()
    if not counts:
        return net
    weights = {r[0]: sum(c[2] for c in counts) / len(counts) / r[1] for r in counts}  # of a text, shared by its windows; the mean of all windows is 1
    index = {name: k for k, name in enumerate(net.classes)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        part, own, n = TaskContext.get().partitionId(), copy.deepcopy(net), 0
        g = np.random.default_rng([7, part])
        for batch in slices(batches):
            rows = [(windows(t.encode()), name) for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if LETTER.search(t)]
            if rows:
                each = np.array([len(w) for w, _ in rows])
                y = np.repeat([index[name] for _, name in rows], each)
                weight = np.repeat([weights[name] / len(w) for w, name in rows], each).astype(np.float32)
                own.go_on(np.concatenate([w for w, _ in rows]), y, weight, g, rate)
                own.p["e"][0] = 0
                n += len(y)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([float(n)]), "p": pa.array([flat(own.p)], pa.binary())})

    out = copy.deepcopy(net)
    out.p = averaged(known.mapInArrow(run, "part int, n double, p binary"), net.p)
    return out


def least_share(docs: DataFrame, net: ByteNet | None, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", lost: float = 0.005, bins: int = 4096) -> float:
    """The score below which no more than ``lost`` of all rightly labelled held-out texts fall.

    Their scores, and nothing else, are written. Each round counts them in bins of the range that holds the score looked
    for, and goes on within one bin, until that holds a single score. Without such texts: halfway between the floor of the
    network's classes and 1. All texts weigh alike, so the loss may be larger among those in a rare language.
    """
    known = docs.filter(held_out & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = predict(known, net, key, text, (lang,), ("_lang", "_share")).filter((F.col("_lang") == F.col(lang)) & (F.col("_lang") != UNKNOWN))
    path = scratch_path(docs.sparkSession, "shares")
    found.select("_share").write.parquet(path)
    shares = docs.sparkSession.read.parquet(path)
    n, low, high = shares.agg(F.count("*"), F.min("_share"), F.max("_share")).first()
    below = int(lost * (n - 1))
    while n and low < high:
        number = F.least(F.floor((F.col("_share") - low) / (high - low) * bins), F.lit(bins - 1))
        inside = shares.filter(F.col("_share").between(low, high)).groupBy(number.alias("_bin"))
        # at most `bins` rows: a proven bound
        for _, count, low, high in sorted(inside.agg(F.count("*"), F.min("_share"), F.max("_share")).collect()):  # noqa: B007  the last bin entered is kept
            if below < count:
                break
            below -= count
    remove(docs.sparkSession, path)
    if not n:
        return (1 + 1 / len(net.classes)) / 2 if net else 0.0
    return float(low)


def label(texts: list[str | None], net: ByteNet | None, tables=None, most: int = 4096) -> tuple[list[str], list[float]]:
    """The language and score of each text; at most ``most`` windows, or one text, are held at once."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    waiting: list[tuple[int, np.ndarray, int]] = []

    def settle() -> None:
        if not waiting:
            return
        q = net.proba(np.concatenate([w for _, w, _ in waiting]), tables)
        at = 0
        for k, w, n in waiting:
            weight = np.full(len(w), WINDOW, np.float64)
            weight[-1] = n - WINDOW * (len(w) - 1)
            mean = weight @ q[at : at + len(w)] / weight.sum()
            at += len(w)
            best = int(mean.argmax())
            names[k], scores[k] = net.classes[best], float(min(1.0, mean[best]))
        waiting.clear()

    for k, t in enumerate(texts):
        if net and t and LETTER.search(t):
            data = t.encode()
            waiting.append((k, windows(data), len(data)))
            if sum(len(w) for _, w, _ in waiting) >= most:
                settle()
    settle()
    return names, scores
