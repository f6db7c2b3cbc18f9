import os
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from skein.llm import packing

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello  World", "a\x1cb  c", "<|endoftext|> x", "<|ENDOFTEXT|>", "é é́ ́x", "\xa0a b\x85c​d", "don't  IT'S 12 3½ ﬁ", "x" * 3000, "word " * 9000, "ÀÉ Ünï\nß"]


def test_ids_are_the_librarys():
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in TEXTS]
    encode = packing.WordIds(PATH)
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encode(pa.array(TEXTS), 2)] == want
    assert [x.tolist() for x in encode(pa.array(["zz", *TEXTS]).slice(1), 2)] == want


def test_costs_are_balanced_and_sequences_full():
    g = np.random.default_rng(1)
    lengths = [(k, 0, int(n)) for k, n in enumerate(sorted(g.integers(1, 400, 300)))]
    total = sum(x[2] for x in lengths)
    sequences, rest = packing.assign(lengths, total // 512, 512, 1 / 64)
    assert all(sum(x[2] for x in s) == 512 for s in sequences) and sum(x[2] for x in rest) == total % 512
    cost = [sum(n + n * n / 64 for _, _, n in s) for s in sequences]
    # filled in the order of arrival instead, costs differ more
    plain, room = [0.0], 512
    for _, _, n in lengths:
        while n:
            take = min(n, room)
            plain[-1] += take + take * take / 64
            n, room = n - take, room - take
            if not room:
                plain.append(0.0)
                room = 512
    assert max(cost) < max(plain) and np.std(cost) < np.std(plain[:-1]) / 2


def test_every_id_lies_in_one_piece(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(k, t, "q") for k, t in enumerate(TEXTS)] + [(99, None, "q"), (7, TEXTS[7], "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").coalesce(2)
    pieces = packing.pack(docs, PATH, capacity=256, window_sequences=4).collect()
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t, _ in rows}
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        held[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for k, x in ids.items():
        assert sorted(held[k]) == sorted(list(range(len(x))) * (2 if k == 7 else 1))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_keys_of_any_type(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (1, "a b")], "doc_id long, text string")
    for kind in ("short", "string", "double", "date", "decimal(12,2)"):
        key = F.col("doc_id").cast("string").cast("date") if kind == "date" else F.col("doc_id").cast(kind)
        assert packing.pack(docs.withColumn("doc_id", key), PATH).groupBy("doc_id").count().count() in (1, 2)


def test_a_task_keeps_no_freed_memory():
    # in a process of its own: its words take some 4 MB, and what each batch needs besides some 50 MB
    code = f"""
import re, sys
sys.path.insert(0, {ROOT!r})
import numpy as np, pyarrow as pa
from skein.llm import packing

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    g = np.random.default_rng(1)
    words = np.array([f"w{{k}}" for k in range(100_000)])
    for _ in range(3):
        yield pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array([" ".join(words[g.integers(0, len(words), 600)]) for _ in range(1024)])], names=["doc_id", "text"])

encode, made = packing.WordIds({PATH!r}), list(batches())
before = held()
for _ in packing._pieces(made, encode, packing.Packer(4096, 64 * 4096, 1 / 4096, 0), 2):
    pass
print("GREW", held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert float(done.stdout.split("GREW")[1]) < 25, done.stdout + done.stderr
