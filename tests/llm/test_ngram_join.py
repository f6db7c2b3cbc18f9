import os
import random
import re
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from skein.llm import ngram_join

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """Component of each (key, text) row: equal keys are one document."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, grams(t)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        find(a)
        for b, y in sets[:i]:
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted((k, len(s), find(k)) for k, s in sets)


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, component_id string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs, **kw).collect())


def made(seed, n):
    g = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(n):
        if rows and g.random() < 0.6:
            w = words(g.choice(rows)[1])
            for _ in range(g.randint(0, 4)):
                if w:
                    at = g.randrange(len(w))
                    w[at : at + g.randint(0, 1)] = [f"e{g.randrange(50)}"]
        else:
            w = [f"w{g.randrange(400)}" for _ in range(g.choice([0, 1, 2, 3, 4, 5, 9, 40, 80]))]
            if g.random() < 0.3:
                w += passage
        rows.append((k * 3, " ".join(w) if g.random() < 0.9 else "\t".join(w).upper() + "\n"))
    return rows


def test_against_brute_force(spark):
    rows = made(1, 120)
    assert run(spark, rows) == brute(rows)
    # tiny blocks, no table of frequent columns, another similarity
    assert run(spark, rows, block_rows=3, most_frequent=1, local_count=2) == brute(rows)
    assert run(spark, made(2, 60), percent=60, shared=1) == brute(made(2, 60), 60)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (9, "ONE  Two"), (5, "one"), (7, "à é"), (6, "À É"), (8, "x y z w " * 5000), (11, "x y z w " * 4000), (12, "one two"), (12, "one two")]
    got = run(spark, rows)
    assert got == brute(rows) and (9, 1, 4) in got and (8, 4, 8) in got and (11, 4, 8) in got and (6, 1, 6) in got
    assert run(spark, rows[:3]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted(map(str, (r["component_id"] for r in ngram_join.near_duplicates(docs).collect()))) == ["3", "3", "None"]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_of_many_and_few():
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[g.random(60) < 0.95], g.integers(0, 1 << 60, g.integers(0, 6)).astype(np.uint64)])) for _ in range(40)] + [np.zeros(0, np.uint64)]
    want = {frozenset((i, j)) for i in range(41) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) and 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c)}

    def parts(edges):
        label = list(range(41))
        for _ in range(41):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    for dense in (2, 9, 100):
        assert parts(ngram_join.links(np.arange(41), sets, 85, dense)) == parts([tuple(e) for e in want])


def test_bounds_keep_every_link():
    """Any two sets as similar share as many first columns as is asked for."""
    g = random.Random(9)
    for _ in range(400):
        n = g.randint(1, 200)
        a = g.sample(range(10_000), n)
        b = list(a)
        for _ in range(g.randint(0, max(1, n // 8))):
            if g.random() < 0.5 and len(b) > 1:
                b.pop(g.randrange(len(b)))
            else:
                b.append(g.randrange(20_000, 90_000))
        x, y = (np.unique(np.array(v, np.uint64)) for v in (a, b))
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        first = [set(c.tolist()) for c in ngram_join.first_columns([x, y], x[:5], np.arange(1, len(x[:5]) + 1), 85, 3)]
        for s in (x, y):
            shortest = -(-85 * len(s) // 100)
            assert len(first[0] & first[1]) >= ngram_join.least_shared(shortest, 85, 3)


def test_sets_of_slices():
    texts = ["Ä b c d e", "né à", "a b c d"] * 3
    assert [len(s) for s in ngram_join.ngram_sets(pa.array(["q", *texts]).slice(1), 4)] == [2, 1, 1] * 3


def test_large_groups_of_near_copies_are_not_compared_block_by_block(spark, monkeypatch):
    g = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:60], f"own{k}", *base[60:]])) for k in range(90)] + [(100 + k, " ".join(g.choice(base) for _ in range(80))) for k in range(10)]
    seen = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    got = run(spark, rows, block_rows=8)
    assert got == brute(rows) and {c for k, _, c in got if k < 90} == {0}
    assert seen[0].filter("id < 90").count() == 0


def test_columns_are_counted_in_little_memory():
    # in a process of its own: the operator's first pass over 6,144 texts of 900 words
    code = f"""
import re, sys, threading, time
from unittest.mock import MagicMock
sys.path.insert(0, {ROOT!r})
import numpy as np, pyarrow as pa
from skein.llm import ngram_join

class Got(Exception):
    pass

class Docs:
    sparkSession = None
    def select(self, *a): return self
    def mapInArrow(self, f, schema): raise Got(f)

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.005)

g = np.random.default_rng(1)
words = np.array([f"w{{k}}" for k in range(20_000)])
made = [pa.RecordBatch.from_arrays([pa.array([" ".join(words[g.integers(0, len(words), 900)]) for _ in range(2048)])], names=["t"]) for _ in range(3)]
ngram_join.F = MagicMock()
try:
    ngram_join.near_duplicates(Docs())
except Got as e:
    count = e.args[0]
before = held()
most = [before]
threading.Thread(target=watch, daemon=True).start()
list(count(iter(made)))
print("GREW", most[0] - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert float(done.stdout.split("GREW")[1]) < 150, done.stdout + done.stderr


def test_counts_of_one_task():
    g = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(30)])
    texts = [" ".join(words[g.integers(0, 30, g.integers(0, 60))]) for _ in range(3000)] + [None, "", "a b"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 700])], names=["t"]) for k in range(0, len(texts), 700)]
    want = Counter(int(x) for s in ngram_join.ngram_sets(pa.array(texts), 2) for x in s)
    columns, counts = ngram_join.column_counts(iter(batches), 2)
    assert columns.tolist() == sorted(columns.tolist()) and dict(zip(columns.tolist(), counts.tolist())) == {k: n for k, n in want.items() if n > 1}
    for gathered in (10, 5000):  # a buffer smaller than a text's set too
        columns, counts = ngram_join.column_counts(iter(batches), 2, gathered)
        assert len(columns) and all(n <= want[k] for k, n in zip(columns.tolist(), counts.tolist())) and (counts > 1).all()
    assert len(ngram_join.column_counts(iter([]), 2)[0]) == 0


def test_disk_is_given_back_step_by_step(spark, monkeypatch):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data") if f.exists()}

    before, left, written = set(shuffled()), [], ngram_join.written

    def watched(df, name):
        end = time.time() + 5  # executors delete a little later
        while time.time() < end and (held := sum(n for f, n in shuffled().items() if f not in before)) > 100_000:
            time.sleep(0.1)
        left.append(held)
        return written(df, name)

    monkeypatch.setattr(ngram_join, "written", watched)
    g = random.Random(7)
    rows = [(k, " ".join(f"w{g.randrange(900)}" for _ in range(400))) for k in range(300)]
    rows += [(k + 1000, t + " end") for k, t in rows]
    got = run(spark, rows)
    assert {c for k, _, c in got} == set(range(300)) and max(left) < 100_000, left


def test_the_filter_of_copies_only_saves_work(spark, monkeypatch):
    rows = made(4, 60)
    rows += [(k + 500, t) for k, t in rows[::2]] + [(3, "some other words that no text has"), (3, "x"), (600, "x")]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)  # which takes most rows for copies
    assert run(spark, rows) == brute(rows)
