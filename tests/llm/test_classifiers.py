import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import langid, quality, toxicity
from skein.llm.common import bounded_sample, fold

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_bounded_sample_is_the_same_at_any_partitioning(spark):
    rows = spark.range(5000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    one, many = (sorted(map(tuple, bounded_sample(rows.repartition(n), "label", "id", 40).collect())) for n in (1, 9))
    assert one == many and len(one) == 80
    assert bounded_sample(rows.limit(0), "label", "id", 5).count() == 0


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    held = fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels, ~held)
    found = quality.score(docs.filter(held), model).join(labels, "doc_id").toPandas()
    assert auc(found["quality"].to_numpy(), found["score"].to_numpy()) > 0.95
    assert ((found["score"] >= 0.7) == (found["quality"] == 1)).mean() > 0.93


def test_attention_gradient():
    g = np.random.default_rng(0)
    bags = [g.normal(size=(n, 5)).astype(np.float32) for n in (1, 4, 3)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    before = quality.AttentionBags(np.zeros(5), np.ones(5))
    loss = lambda m: -np.mean(y * np.log(m.scores(bags)) + (1 - y) * np.log(1 - m.scores(bags)))
    start = loss(before)
    assert loss(before.fit(bags, y, w, epochs=80, rate=0.02)) < start / 4


def test_gradient_is_the_slope_of_the_loss():
    g = np.random.default_rng(4)
    sizes, y, w = np.array([1, 4, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    x, model = g.normal(size=(8, 5)), quality.AttentionBags(np.zeros(5), np.ones(5))

    def loss():
        s = model.scores([x[:1], x[1:5], x[5:]])
        return -np.mean(w * (y * np.log(s) + (1 - y) * np.log(1 - s)))

    for name, grad in model.gradient(x, sizes, y, w).items():
        p = model.p[name]
        for at in np.ndindex(*p.shape):
            was = p[at]
            p[at] = was + 1e-5
            up = loss()
            p[at] = was - 1e-5
            down = loss()
            p[at] = was
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6, name


def test_quality_scores_against_a_plain_forward_pass(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels, F.lit(True), per_label=60)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.limit(200).unionByName(docs.limit(5)), model).collect()}
    p = model.p
    for row in docs.limit(200).collect():
        hidden, gates = [], []
        text = row["text"] or ""
        for f in quality.features([text[k : k + 512] for k in range(0, len(text), 512)] or [""], len(text)):
            h = [np.tanh(sum((f[i] - model.mean[i]) / model.scale[i] * p["e"][i, j] for i in range(len(f))) + p["f"][j]) for j in range(len(p["f"]))]
            gate = sum(p["w"][j] * np.tanh(np.dot(h, p["v"][:, j])) / (1 + np.exp(-np.dot(h, p["u"][:, j]))) for j in range(len(p["w"])))
            hidden.append(h)
            gates.append(np.exp(gate))
        whole = sum(g * np.array(h) for g, h in zip(gates, hidden, strict=True)) / sum(gates)
        assert abs(got[row["doc_id"]] - 1 / (1 + np.exp(-(whole @ p["c"] + p["b"][0])))) < 1e-5


def test_training_reads_every_passage(spark):
    # good and bad texts differ in their last passages only
    rows = [(k, "plain words of a text " * 900 + ("$$ ## %% " * 300 if k % 2 else "and more of the same " * 130)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") < 60)
    got = quality.score(docs.filter("doc_id >= 60"), model).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in got) and len(got) == 20


def test_new_words_are_counted_over_the_whole_text():
    parts = [" ".join(f"w{k}" for k in range(6000)), "these words come late", "late come these words"]
    new = quality.features(parts, 1)[:, quality.N_CLASSES + len(quality.LAGS) + 1]
    assert new.tolist() == [1.0, 1.0, 0.0]


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x" * 100_000, "c"), (1, "some text", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert [r["score"] for r in quality.score(docs, model).collect()] == [1.0] * 4
    assert quality.score(docs, quality.train(docs, labels.limit(0), F.lit(True))).first()["score"] == 0.5
    assert quality.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    held = fold(F.col("doc_id"), 3) == 1
    net = langid.train(docs, ~held, per_label=150)
    found = langid.predict(docs.filter(held), net, keep=("lang",)).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_tables_compute_the_network():
    net = langid.ByteNet(["a", "b"])
    x = np.random.default_rng(2).integers(1, 255, (5, langid.WINDOW)).astype(np.uint8)
    e = net.p["e"][x]
    pooled = []
    for w in langid.WIDTHS:
        z = np.stack([sum(e[:, t + j] @ net.p[f"k{w}"][j * langid.EMBED : (j + 1) * langid.EMBED] for j in range(w)) for t in range(langid.WINDOW - w + 1)], 1)
        pooled.append(np.maximum(z.max(1) + net.p[f"c{w}"], 0))
    s = np.concatenate(pooled, 1) @ net.p["w"] + net.p["b"]
    q = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert np.allclose(net.proba(x), q, atol=1e-5)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "ça" * 50_000)], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    net = langid.ByteNet(["fr"])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "fr"
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(none, F.lit(True)) is None


def test_whole_texts_teach_the_language(spark):
    # the languages differ only beyond the first kilobyte
    g = random.Random(2)
    word = lambda letters: "".join(g.choice(letters) for _ in range(4))
    rows = [(k, " ".join([word("aeiou") for _ in range(400)] + [word("bcdf" if k % 2 else "xyzw") for _ in range(400)]), "ab"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, F.col("doc_id") < 50)
    tail = spark.createDataFrame([(k, t[2000:], y) for k, t, y in rows[50:]], docs.schema)
    assert all(r["lang"] == r["lang_pred"] for r in langid.predict(tail, net, keep=("lang",)).collect())


def test_many_languages_and_clashing_names(spark):
    rows = [(k, f"text of number {k} " * 3, f"l{k % 1500}", "x") for k in range(3000)] + [(k, "der die das und " * 9, "de", "x") for k in range(3000, 3040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string")
    net = langid.train(docs, F.lit(True), per_label=20, most_labels=40, most_texts=800)
    assert len(net.classes) == 40 and "de" in net.classes and "l0" in net.classes
    got = langid.predict(docs.unionByName(docs.limit(3)), net).select("lang_pred").collect()
    assert len(got) == 3043 and {r[0] for r in got} <= set(net.classes)
    assert langid.train(docs.limit(0), F.lit(True)) is None and langid.predict(docs.limit(0), net).count() == 0


def test_ties_of_labels_in_the_sample(spark):
    rows = spark.createDataFrame([(k, f"n{k % 10}") for k in range(100)] + [(k, None) for k in range(100, 200)], "id long, name string")
    got = {r["name"] for r in bounded_sample(rows, "name", "id", 5, most_labels=3).collect()}
    assert got == {"n0", "n1", "n2"}
    assert bounded_sample(rows, "name", "id", 5, most_rows=20).groupBy("name").count().filter("count > 2").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def aligned(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            d = min(rows[-2][j] + 1, rows[-1][-1] + 1, rows[-2][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-3][j - 2] + 1)
            rows[-1].append(d)
    return rows[-1][-1]


def test_automaton_against_plain_distance():
    g = random.Random(4)
    terms = ["idiot", "clown", "réeuxment", "disgustingly", "scum", "worthless", "worth", "achlichkeitung"]
    lexicon = toxicity.Lexicon(terms, [3.0, 2.0, 1.0, 4.0, 5.0, 6.0, 1.5, 2.5])
    words = ["", "a", *terms, "x" * 200]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(g.randint(1, 3)):
                k = g.randrange(len(w) + 1)
                w[k : k + g.randint(0, 1)] = g.choice(["", "z", t[0], "é"])
            words.append("".join(w))
    for w, m in zip(words, lexicon.match(words), strict=True):
        near = [(d, -lexicon.weights[k]) for k, t in enumerate(terms) if (d := distance(w, t)) <= lexicon.limits[k]]
        assert (m is None) == (not near) and (m is None or (m[1], -lexicon.weights[m[0]]) == min(near))


def test_swaps_and_four_letters():
    terms = ["idiot", "scum", "disgustingly"]
    lexicon = toxicity.Lexicon(terms, [3.0, 2.0, 4.0], swaps=True)
    g, words = random.Random(9), ["idoit", "scmu", "csum", "scun", "scums", "diiot", "idito", "dsigustnigly", "dsigustnigyl", "sc"]
    assert [m and m[1] for m in lexicon.match(words)] == [1, 1, 1, 1, 1, 1, 1, 2, None, None]
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(g.randint(1, 3)):
                k = g.randrange(len(w) - 1)
                w[k : k + 2] = g.choice([w[k : k + 2][::-1], w[k : k + 1], [*w[k : k + 2], "z"], ["z"]]) if len(w) > 2 else w
            words.append("".join(w))

    for w, m in zip(words, lexicon.match(words), strict=True):
        near = [(d, -lexicon.weights[k]) for k, t in enumerate(terms) if (d := aligned(t, w)) <= lexicon.limits[k]]
        assert (m is None) == (not near) and (m is None or (m[1], -lexicon.weights[m[0]]) == min(near))


def test_stems_against_plain_distance():
    g, stems = random.Random(3), ["achlich", "réê", "bomente", "worthy"]
    terms = [*stems, "idiot", "achlicher"]
    lexicon = toxicity.Lexicon(terms, [3.0, 2.0, 1.0, 4.0, 5.0, 6.0], stems=stems)
    words = ["", "a", *terms, "achlich" + "x" * 5000, "y" * 300]
    for t in terms:
        for _ in range(80):
            w = list(t + "".join(g.choice("abré") for _ in range(g.randint(0, 6))))
            for _ in range(g.randint(0, 2)):
                k = g.randrange(len(w) + 1)
                w[k : k + g.randint(0, 1)] = g.choice(["", "z", "é"])
            words.append("".join(w))
    for w, m in zip(words, lexicon.match(words), strict=True):
        near = []
        for k, t in enumerate(terms):
            d = min(distance(w[:n], t) for n in range(min(len(w), len(t) + 3) + 1)) if t in stems and w else distance(w[:60], t)
            if d <= lexicon.limits[k]:
                near.append((d, -lexicon.weights[k]))
        assert (m is None) == (not near) and (m is None or (m[1], -lexicon.weights[m[0]]) == min(near)), w


def test_quotation():
    words = 'he said "you idiot" and left'.split()
    assert toxicity.quoted(words, 3) and not toxicity.quoted("you are an idiot today".split(), 3)
    matcher = toxicity.Matcher(toxicity.Lexicon(["idiot"], [5.0]))
    assert matcher.hits(pa.array(['he said "you IDIOT" and left', "you idoit!!", "you idiott", None])) == [(6, [(0, 0, True)]), (2, []), (2, [(0, 1, False)]), (0, [])]
    long = ["«it", *["was"] * 40, "idiot", *["was"] * 40, "so».", "idiot"]
    assert toxicity.quoted(long, 41) and not toxicity.quoted(long, len(long) - 1)
    # a stray mark quotes nothing, and one that opens again starts over
    assert not toxicity.quoted(['"oh', "idiot", *["was"] * 200, 'so"'], 1)
    assert not toxicity.quoted(['"oh', "idiot", 'then"', '"he', "left"], 4) and not toxicity.quoted(['"oh', "idiot", '"he', 'left"'], 1)


def test_scores_against_a_plain_computation(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.lit(True))
    lexicon = model.lexicon
    some = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").limit(120).collect()]
    some += [(-1, 'You "idiot and moron" said he. Worthles, stupidd; clown'), (-2, ""), (-3, "clown " * 5), (-4, "the word clown is an insult")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for key, text in some:
        words = text.lower().split()
        bare, use = [w.strip(toxicity.MARKS) for w in words], []
        for k, w in enumerate(bare):
            near = []
            for n, t in enumerate(lexicon.terms):
                d = aligned(t, w) if not lexicon.stems[n] else min(aligned(t, w[:i]) for i in range(len(w) + 1))
                if w and d <= lexicon.limits[n]:
                    near.append((d, -lexicon.weights[n], n))
            if near:
                d, _, n = min(near)
                around = {bare[j] for j in range(max(0, k - 6), min(len(words), k + 7)) if j != k}
                told = [model.context.words[x] for x in around if x in model.context.words]
                z = toxicity.USED + model.context.quote * toxicity.quoted(words, k) + sum(x for x in told if x > 0) + max(-1, sum(x for x in told if x < 0))
                use.append((n, d, (lexicon.weights[n] if d == 0 else model.near[n] / d) / (1 + np.exp(z))))
        x = np.zeros(5)
        if use:
            x[0] = max([u for n, d, u in use if d == 0 and not lexicon.stems[n]], default=0)
            x[1] = max([u for n, d, u in use if d or lexicon.stems[n]], default=0)
            x[2], x[3] = np.log1p(sum(u for _, _, u in use)), np.log1p(len({n for n, _, u in use if u > 1}))
            x[4] = min(1, 5 * sum(u for _, _, u in use) / len(words))
        assert abs(got[key] - 1 / (1 + np.exp(-(x @ model.coef + model.bias)))) < 1e-9, key
    assert got[-3] > 0.5 > got[-4] and got[-2] < 0.5


def test_few_labels_raise_few_false_alarms(spark, tables):
    docs, labels = tables
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held)
    found = toxicity.score(docs.filter(held), model).join(labels, "doc_id").toPandas()
    assert (found.loc[found["toxic"] == 0, "score"] >= 0.5).mean() < 0.02 and (found.loc[found["toxic"] == 1, "score"] >= 0.5).mean() > 0.6
    some = [
        (1, "you are an idiot and a worthless moron"), (2, "the teacher explained that the slur idiot is an insult"), (3, None), (4, "x" * 1_000_000 + " " + "und so weiter " * 30_000), (2, "again"),
        (5, 'the report says that "one of the men shouted for a very long time that the other was a stupid worthless idiot and a pathetic moron who should go home at once" and then the men left'),
    ]
    rows = spark.createDataFrame([(*r, "s", 1) for r in some], "doc_id long, text string, toxic string, t int")
    got = [(r["doc_id"], r["score"] >= 0.5) for r in toxicity.score(rows, model).collect()]
    assert sorted(got) == [(1, True), (2, False), (2, False), (3, False), (4, False), (5, False)]
    assert toxicity.score(rows.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels, F.lit(True)).bias == 0.0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held)
    found = toxicity.score(docs.filter(held), model).join(labels, "doc_id").toPandas()
    assert auc(found["toxic"].to_numpy(), found["score"].to_numpy()) > 0.95
    assert (found.loc[found["toxic"] == 0, "score"] >= 0.5).mean() < 0.01 and (found.loc[found["toxic"] == 1, "score"] >= 0.5).mean() > 0.85


def test_misspelled_terms_are_caught(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.lit(True))
    some = spark.createDataFrame([(1, "thher stupidd ond the idiiot, wortless of ing"), (2, "the and of ing thher ond"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(some, model).collect()}
    assert got[1] > 0.5 > got[2] == got[3]
    assert toxicity.score(some, toxicity.train(docs, labels.limit(0), F.lit(True))).first()["score"] == 0.5
