import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import merkle


def brute(rows):
    """(id, n, sha, edited sha) of rows sorted by (id with null first, text)."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = []
    for i, (k, t) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(t) // 4
        out.append((k, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def test_edits_against_brute_force(spark):
    rows = [(5, "a b c d\ne f g h\n" * 3), (1, None), (2, ""), (2, "zz yy"), (9, "日本語 text" * 20), (9, "日本語 text" * 20), (None, "first"), (400_000, "x" * 70_000), (7, "one\ntwo\nthree\nfour")]
    docs = spark.createDataFrame([(k, t, "q") for k, t in rows], "doc_id long, text string, next_text string")
    got = [tuple(r) for r in merkle.edited_fingerprints(docs).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_many_ranges(spark):
    docs = spark.range(3000).select((F.pow("id", F.lit(3))).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id"), F.lit(" and more of it")).alias("text"))
    found = merkle.with_next(docs, "doc_id", "text", rows_a_range=16, most_quantiles=8, most_steps=9).collect()
    order = {r["doc_id"]: r for r in found}
    keys = sorted(order)
    assert len(keys) == 3000 and all(order[a]["next_text"] == order[b]["text"] for a, b in zip(keys, keys[1:] + keys[:1], strict=True))


def prints(spark, *texts):
    return merkle.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def changes(spark, before, after):
    rows = merkle.differences(prints(spark, before), prints(spark, after)).collect()
    return sorted((r["change"], r["left_paragraph"], r["right_paragraph"], r["n_paragraphs"]) for r in rows)


def test_fingerprints_tell_texts_apart(spark):
    rows = {r["doc_id"]: r for r in prints(spark, "a b\n\nc", "a b\n\nc", None, "", "a b\nc", "a  b\n\nc", "a b \n\nc").collect()}
    roots = [rows[k]["fingerprint"] for k in range(7)]
    assert roots[0] == roots[1] and roots[2] == roots[3] and len(set(roots)) == 5
    assert rows[0]["paragraph_sizes"][1] == 0 and sum(rows[0]["section_sizes"]) == 3 == len(rows[0]["paragraphs"])
    # the tree by hand
    sha, nodes = lambda x: hashlib.sha256(x.encode()).hexdigest(), []
    for line in ("a b", "", "c"):
        leaves, run = [], []
        for w in {"a b": ["a ", "b"], "": [], "c": ["c"]}[line]:
            run.append(hashlib.md5(w.encode()).hexdigest())
            if run[-1][-1] in "0123":
                leaves.append(sha(" ".join(run)))
                run = []
        leaves += [sha(" ".join(run))] if run else []
        nodes.append(sha(" ".join(leaves)))
    assert rows[0]["paragraphs"] == nodes


def test_differences_locate_edits(spark):
    lines = [f"line {k} of it" for k in range(40)]
    text = lambda x: "\n".join(x)
    assert changes(spark, text(lines), text(lines)) == []
    assert changes(spark, text(lines), text([*lines[:20], "new", *lines[20:]])) == [("inserted", None, 20, 1)]
    assert changes(spark, text(lines), text([*lines[:20], *lines[21:]])) == [("deleted", 20, None, 1)]
    assert changes(spark, text(lines), text([*lines[:20], "changed", *lines[21:]])) == [("deleted", 20, None, 1), ("inserted", None, 20, 1)]
    assert changes(spark, text(lines), text([*lines[:20], lines[3], *lines[20:]])) == [("inserted", None, 20, 1)]
    assert changes(spark, text(lines), text([*lines[:5], *lines[6:30], lines[5], *lines[30:]])) == [("moved", 5, 29, 1)]
    keyed = spark.createDataFrame([("x", "a\nb"), ("y", "c")], "name string, text string")
    got = merkle.differences(merkle.fingerprint(keyed, "name"), merkle.fingerprint(keyed.replace("c", "d"), "name"), "name").collect()
    assert {(r["name"], r["change"]) for r in got} == {("y", "deleted"), ("y", "inserted")}


def test_likeness(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "w x y z"), (3, ""), (4, ""), (5, "\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.edited_fingerprints(docs).collect()}
    assert got[1]["near_next"] == 0 == got[2]["near_next"] and got[3]["near_next"] == 1 == got[4]["near_next"] and got[5]["near_next"] == 0
    assert merkle.edited_fingerprints(docs.limit(0)).count() == 0
    one = merkle.edited_fingerprints(docs.limit(1)).first()
    assert one["near_next"] == 1.0 and one["n_leaves"] > 0


def test_a_word_more_changes_one_leaf(spark):
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(words), " ".join(["early", *words]), " ".join(words[:2000] + words[2001:]), "x" * 5000 + "y" * 5000, "x" * 5000 + "z" * 5000]
    got = [r["near_next"] for r in merkle.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert 0.99 < got[0] < 1 and 0.99 < got[1] < 1 and 0 < got[3] < 1


def test_keys_that_are_no_integers(spark):
    rows = [(f"doc-{k:05d}", f"text {k} of it") for k in range(700)] + [(None, "none"), ("doc-00007", "a second")]
    for kind, cast in (("string", str), ("double", lambda k: float(k[4:]) / 8)):
        made = [(cast(k) if k else None, t) for k, t in rows]
        docs = spark.createDataFrame(made, f"doc_id {kind}, text string")
        want = [t for _, t in sorted(made, key=lambda x: (x[0] is not None, x[0] or cast("doc-00000"), x[1]))]
        got = {r["text"]: r["next_text"] for r in merkle.with_next(docs, "doc_id", "text", most_quantiles=8).collect()}
        assert got == dict(zip(want, want[1:] + want[:1], strict=True))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.text(alphabet="ab \n", max_size=12)), min_size=1, max_size=8))
def test_any_keys(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in merkle.edited_fingerprints(docs).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(got) == sorted(brute(rows))
