"""Document quality by attention-based multiple-instance learning, in numpy.

A text is a bag of passages. Each passage is encoded (surface statistics, then a
learned layer), a gated attention unit weighs the passages, and the weighted
passage representation is scored; only documents have labels. The whole text is
scored: every passage is encoded, long texts simply have more of them.

``train`` uses a bounded sample: at most ``per_label`` labelled texts of each
label, those with the smallest key hash, with all their passages. ``teach`` goes on
from there over every labelled text: each task once over its own, then the tasks'
models are averaged (the sample's mean and scale of each statistic stay: the learned
layer takes up what they leave). How rows are dealt over tasks moves the result a little.

A null text counts as empty: one passage without characters. A very long text is
one bag of many passages, each of bounded size. Without labels of both kinds (an
empty table too) every score is the share of label 1 (or 0.5); an empty table to
score gives no rows. Repeated rows and ties are scored each, alike; label rows that
are null or repeat a key with another label are left out. Other columns are not
read, whatever their names; those in ``keep`` come back as they were, and must not
be named as the score is.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import averaged, bounded_sample, descend, flat, free_worker, slices
from skein.plans.scratch import remove, scratch_path

PASSAGE = 512
#: Byte classes: control, space, newline, digit, upper, lower, sentence marks, bars, shouts, other marks, beyond ASCII.
CLASS = np.full(256, 10, np.uint8)
CLASS[:128] = 9
CLASS[:32] = 0
CLASS[[9, 32]] = 1
CLASS[[10, 13]] = 2
CLASS[48:58] = 3
CLASS[65:91] = 4
CLASS[97:123] = 5
CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
CLASS[[ord(c) for c in "|<>{}[]/\\=_"]] = 7
CLASS[[ord(c) for c in "!*#$%&@^~+"]] = 8
N_CLASSES, LAGS = 11, (1, 2, 3, 5, 8)
N_FEATURES = N_CLASSES + len(LAGS) + 9


def passages(text: str) -> list[str]:
    """Slices of ``PASSAGE`` characters; one empty passage for an empty text."""
    return [text[k : k + PASSAGE] for k in range(0, len(text), PASSAGE)] or [""]


def features(parts: list[str], text_length: int) -> np.ndarray:
    """A row of surface statistics for each passage of one text."""
    out = np.zeros((len(parts), N_FEATURES), np.float32)
    seen: set[str] = set()
    for row, part in zip(out, parts, strict=True):
        data = np.frombuffer(part.encode(), np.uint8)
        n = max(1, len(data))
        row[:N_CLASSES] = np.bincount(CLASS[data], minlength=N_CLASSES) / n
        words = part.split()
        w = max(1, len(words))
        k = N_CLASSES
        for lag in LAGS:
            row[k] = sum(map(eq, words, words[lag:])) / w
            k += 1
        distinct = set(words)
        row[k] = len(distinct) / w
        row[k + 1] = len(distinct - seen) / max(1, len(distinct))
        row[k + 2] = min(1.0, n / w / 20)
        row[k + 3] = sum(map(str.isupper, words)) / w
        lines = part.split("\n")
        row[k + 4] = 1 - len(set(lines)) / len(lines)
        row[k + 5] = sum(map(str.isalpha, words)) / w
        row[k + 6] = min(1.0, w / 100)
        row[k + 7] = min(1.0, np.log1p(text_length) / 12)
        row[k + 8] = max(map(len, words), default=0) / (n + 1)
        seen |= distinct
    return out


class AttentionBags:
    """Gated attention over encoded passages, and a logistic score of the weighted representation."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 16, gate: int = 8, seed: int = 5):
        g = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        n = len(mean)
        self.p = {"e": g.normal(0, 1 / np.sqrt(n), (n, hidden)), "f": np.zeros(hidden), "v": g.normal(0, 0.3, (hidden, gate)), "u": g.normal(0, 0.3, (hidden, gate)), "w": g.normal(0, 0.3, gate), "c": g.normal(0, 0.3, hidden), "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["e"] + p["f"])
        a, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        g = (a * s) @ p["w"]
        top = np.maximum.reduceat(g, starts)
        alpha = np.exp(g - np.repeat(top, sizes))
        alpha /= np.repeat(np.add.reduceat(alpha, starts), sizes)
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return h, a, s, alpha, z, y

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self._forward(x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)[-1]

    def gradient(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss over bags of ``sizes`` passages, by parameter."""
        p, starts = self.p, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h, a, s, alpha, z, y = self._forward(x, starts, sizes)
        dy = (y - labels) * weights / len(sizes)
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        da = (h * dz).sum(1)
        dg = alpha * (da - np.repeat(np.add.reduceat(alpha * da, starts), sizes))
        dv, du = dg[:, None] * p["w"] * s * (1 - a * a), dg[:, None] * p["w"] * a * s * (1 - s)
        dh = (alpha[:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "f": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "w": (a * s).T @ dg, "c": z.T @ dy, "b": np.array([dy.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 40, rate: float = 0.01, batch: int = 64, seed: int = 5) -> AttentionBags:
        g = np.random.default_rng(seed)
        bags = [(b - self.mean) / self.scale for b in bags]
        m, v, t, p = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0, self.p
        for epoch in range(epochs):
            order = g.permutation(len(bags))
            for at in range(0, len(bags), batch):
                rows = order[at : at + batch]
                some = [bags[k] for k in rows]
                grad = self.gradient(np.concatenate(some), np.array([len(b) for b in some]), labels[rows], weights[rows])
                t += 1
                for k, d in grad.items():
                    d = d + 1e-4 * p[k]
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


    def go_on(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, g: np.random.Generator, rate: float, batch: int = 64) -> None:
        """Once over the bags, in plain steps: those of many tasks add up as their gradients do."""
        order = g.permutation(len(bags))
        for at in range(0, len(bags), batch):
            rows = order[at : at + batch]
            x = (np.concatenate([bags[k] for k in rows]) - self.mean) / self.scale
            descend(self.p, self.gradient(x, np.array([len(bags[k]) for k in rows]), labels[rows], weights[rows]), rate)


class Constant:
    """Stands for a model where there is nothing to learn from."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.score)


def unambiguous(labels: DataFrame, label: str, key: str) -> DataFrame:
    """The keys and labels that are 0 or 1 and don't repeat a key with another label."""
    return labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_most")).filter(F.col("_most") == F.col(label)).select(key, label)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, label: str, key: str, text: str, per_label: int) -> DataFrame:
    """A bounded sample of (key, text, label): the texts whose label is known and ``learn`` allows."""
    keys = docs.filter(learn).select(key).distinct().join(unambiguous(labels, label, key), key)
    sample = bounded_sample(keys, label, key, per_label)
    # at most per_label rows for each of two labels: a proven bound
    return docs.select(key, text).join(F.broadcast(sample), key)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text", per_label: int = 1500) -> AttentionBags | Constant:
    """A model of ``labels`` learned from the rows of ``docs`` where ``learn`` holds; ``per_label`` bounds the labelled rows, not what is read of a text."""
    sample = labelled(docs, labels, learn, label, key, text, per_label)

    def encode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t, y in zip(frame[key], frame[text], frame[label], strict=True):
                t = t if isinstance(t, str) else ""
                rows.append((str(k), int(y), features(passages(t), len(t)).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "y", "x"])

    found = sample.mapInPandas(encode, "id string, y int, x binary").toPandas().sort_values(["id", "x"])
    y = found["y"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(bytes(x), np.float32).reshape(-1, N_FEATURES) for x in found["x"]]
    every = np.concatenate(bags)
    weights = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    return AttentionBags(every.mean(0), every.std(0) + 0.02).fit(bags, y, weights, epochs=max(25, min(200, 60_000 // len(bags))))


def teach(docs: DataFrame, labels: DataFrame, model: AttentionBags | Constant, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text", rate: float = 0.05) -> AttentionBags | Constant:
    """``model`` taught by every row of ``docs`` where ``learn`` holds and ``labels`` has its label; both labels weigh alike."""
    if isinstance(model, Constant):
        return model
    source = docs.filter(learn).select(F.col(key).alias("_key"), text)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            x = [features(passages(t), len(t)).tobytes() for t in (x or "" for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["_key", "_x"])

    encoded = source.mapInArrow(encode, T.StructType([source.schema.fields[0], T.StructField("_x", T.BinaryType())]))
    known = unambiguous(labels, label, key).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"))
    path = scratch_path(docs.sparkSession, "bags")
    # labels are of any number, so none are broadcast: the same plan at any size
    encoded.join(known.hint("merge"), "_key").select("_x", "_y").write.parquet(path)
    bags = docs.sparkSession.read.parquet(path)
    n, good = bags.agg(F.count("*"), F.sum("_y")).first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        part, own, seen = TaskContext.get().partitionId(), copy.deepcopy(model), 0
        g = np.random.default_rng([5, part])
        for batch in slices(batches):
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in batch.column(0).to_pylist()]
            if x:
                own.go_on(x, y, np.where(y == 1, 0.5 * n / good, 0.5 * n / (n - good)), g, rate)
                seen += len(x)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([float(seen)]), "p": pa.array([flat(own.p)], pa.binary())})

    if not n or not 0 < good < n:
        remove(docs.sparkSession, path)
        return model
    out = copy.deepcopy(model)
    out.p = averaged(bags.mapInArrow(run, "part int, n double, p binary"), model.p)
    remove(docs.sparkSession, path)
    return out


def score(docs: DataFrame, model: AttentionBags | Constant, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``key``, the columns in ``keep`` and ``name``, the score (0 to 1, higher: label 1 likelier) of each row."""
    source = docs.select(key, F.col(text).alias("_text"), *keep)
    out = T.StructType([source.schema.fields[0], *source.schema.fields[2:], T.StructField(name, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in slices(batches):
            bags = [features(passages(t), len(t)) for t in (x or "" for x in batch.column(1).to_pylist())]
            columns = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep)))]
            scores = model.scores(bags) if bags else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=out.names)

    return source.mapInArrow(run, out)
