"""The pipeline's stages against brute force, and the queries' registration."""

import gc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from skein.llm import langid, quality, queries
from skein.llm.common import fold

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    before = docs
    for name, stage in pipeline.STAGES[:3]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        kept, had = {r["doc_id"] for r in after.collect()}, {r["doc_id"] for r in before.collect()}
        assert kept <= had and len(kept) > 0.7 * len(had), name
        if name == "n-gram Jaccard join":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            assert kept == {c for _, _, c in brute(rows)}
        before = docs.filter(F.col("doc_id").isin(sorted(kept)))


def test_run_packs_all_that_was_kept(spark):
    pieces = pipeline.run(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held = defaultdict(list)
    for p in pieces.itertuples():
        held[p.doc_id].append(p)
    for doc, parts in held.items():
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids) == parts[0].doc_tokens
    assert 0.6 * len(texts) < len(held) <= len(texts)


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    g, texts = np.random.default_rng(1), [r["text"].split() for r in docs.filter("length(text) > 400").orderBy("doc_id").limit(400).collect()]
    mixed = [" ".join(str(g.choice(w)) for _ in range(100) for w in (texts[k] for k in g.choice(400, 4, False))) for _ in range(60)]
    added = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(mixed)], "doc_id long, text string")
    # German is not learned, as no row says that it is German
    some = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang"))).unionByName(added, allowMissingColumns=True)
    kept = {r["doc_id"] for r in pipeline.known_language(spark, some, "").select("doc_id").collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.filter(r"text rlike '\\p{L}'").collect()}
    share = lambda ids: len(kept & set(ids)) / len(ids)
    assert share(range(10**6, 10**6 + 60)) < 0.1 and share([k for k, v in lang.items() if v == "de"]) < 0.2
    assert share([k for k, v in lang.items() if v != "de"]) > 0.98


def test_all_held_out_texts_set_the_least_score(spark, monkeypatch):
    g = np.random.default_rng(3)
    word = lambda letters: "".join(g.choice(list(letters), 4))
    text = lambda own, other, n: " ".join(word(own if g.random() < n else other) for _ in range(8))
    # three languages, one of them rare; the clearer or the less clear a text, the more or fewer words of its own language
    rows = [(k, text("aeiou", "bcdfg", g.uniform(0.4, 1)), "v") if k % 2 else (k, text("bcdfg", "aeiou", g.uniform(0.4, 1)), "c") for k in range(9000)]
    rows += [(k, text("wxyz", "aeiou", g.uniform(0.4, 1)), "w") for k in range(9000, 9200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, fold(F.col("doc_id"), 3) != 1, per_label=100)
    monkeypatch.setattr(langid, "train", lambda *a, **k: net)
    monkeypatch.setattr(langid, "teach", lambda *a, **k: net, raising=False)
    found = langid.predict(docs, net, keep=("lang",)).withColumn("held", fold(F.col("doc_id"), 3) == 1).toPandas()
    right = found[found["held"] & (found["lang"] == found["lang_pred"])]
    least = np.quantile(right["score"], 0.005, method="lower")
    assert len(right) > 2000 and right["lang"].nunique() == 3
    assert {r["doc_id"] for r in pipeline.known_language(spark, docs, "").collect()} == set(found[found["score"] >= least]["doc_id"])


def test_every_text_outside_the_held_out_fold_is_learned(spark, monkeypatch):
    # one text in eight is of letters that the sample, of ten texts of each kind, holds too seldom or never
    g = np.random.default_rng(5)
    word = lambda letters: "".join(g.choice(list(letters), 4))
    seldom = lambda k: k % 16 < 2
    rows = [(k, " ".join(word((("hijk", "lmno") if seldom(k) else ("abcd", "vxyz"))[k % 2]) for _ in range(30)), "ab"[k % 2]) for k in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = fold(F.col("doc_id"), 3) != 1
    net = langid.train(docs.filter("doc_id % 16 >= 2"), learn, per_label=10)
    loss = lambda n: float(np.mean([1 - s if p == y else s for _, y, p, s in langid.predict(docs.filter((~learn) & (F.col("doc_id") % 16 < 2)), n, keep=("lang",)).collect()]))
    assert loss(langid.teach(docs, net, learn)) < 0.8 * loss(net)
    assert langid.teach(docs, None, learn) is None and langid.teach(docs.limit(0), net, learn) is net
    monkeypatch.setattr(langid, "train", lambda *a, **k: net)
    taught = []
    monkeypatch.setattr(langid, "least_share", lambda found, n, *a: taught.append(n) or 0.0)
    pipeline.known_language(spark, docs, "")
    assert loss(taught[0]) < 0.8 * loss(net)


def test_every_labelled_text_is_learned(spark):
    # bad texts are of two kinds; the model begins without the second, which is half of them
    text = lambda k: ("plain words of a text " if k % 2 else "$$ ## %% " if k % 4 else "12 34 5678 ") * (20 + k % 7)
    docs = spark.createDataFrame([(k, text(k)) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, quality int")
    learn = fold(F.col("doc_id"), 4) != 2
    model = quality.train(docs.filter("doc_id % 4 > 0"), labels, learn, per_label=20)
    share = lambda m: np.mean([r["score"] for r in quality.score(docs.filter((~learn) & (F.col("doc_id") % 4 == 0)), m).collect()])
    before, after = share(model), quality.teach(docs, labels, model, learn)
    assert share(after) < before / 2
    empty = quality.Constant(1.0)
    assert quality.teach(docs, labels, empty, learn) is empty and quality.teach(docs, labels.limit(0), model, learn) is model


def test_near_copies_of_two_changed_words(spark):
    words = [f"w{k}" for k in range(100)]
    other = [("x" if k in (30, 70) else "") + w for k, w in enumerate(words)]  # five words: 86 of 106 alike, four: 89 of 105
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:70]))], "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, "").collect()} == {1, 3}


def test_extra_columns_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("s"), "lang_pred": F.lit(1), "component_id": F.lit(None).cast("string")})
    for _, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert pipeline.STAGES[2][1](spark, docs.limit(0), SF).count() == 0


def test_each_stage_begins_with_a_heap_that_was_given_back(spark):
    docs, runtime = spark.read.parquet(f"{SF}/documents.parquet"), spark._jvm.java.lang.Runtime.getRuntime()
    for name, stage in pipeline.STAGES:
        grown = spark._jvm.java.nio.ByteBuffer.allocate(1500 << 20)
        had = runtime.totalMemory()
        del grown
        gc.collect()
        stage(spark, docs.limit(0), SF)
        assert runtime.totalMemory() < had - (400 << 20), name


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
