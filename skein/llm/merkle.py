"""Document fingerprints: Merkle trees over sections, paragraphs and leaves, in DataFrame functions only.

A paragraph is a line; it is cut into tokens (up to 32 characters that are no space,
and the spaces behind them). A leaf is a run of tokens that ends after one whose MD5
ends in a digit from 0 to 3 (one in four), so a word put in or left out changes the
leaf it is in and moves no other border. A paragraph's node hashes its leaves' nodes;
a section is a run of paragraphs that ends after one whose node ends in 0 or 1 (one
in eight), and hashes theirs; the root hashes the sections' nodes. Equal roots mean
equal texts, and differing branches locate edits (``differences``). The likeness of
two trees is the share of leaves that both hold: branches with equal nodes hold the
same leaves, so what lowers it lies below nodes that differ.

``with_next`` joins each text with the next one by ascending key. The order comes
from at most 65,536 key ranges (quantiles, then even steps within them; for keys that
are no integers, quantiles of a bounded sample), so texts are shuffled once and no
task sees more than a few ranges; only the ranges' first texts are sent to the range
before.

A null text counts as empty. A null key sorts first; repeated keys (ties) are ordered
by their texts. A single row is its own next one; an empty table gives none. Two
texts without leaves are alike (1), one without is unlike any other (0). A very long
text is one row of arrays that grow with it. Other columns are not read, whatever
their names, but ``key`` must not be named as a result is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TOKEN = "[^ ]{1,32} *| +"
LEAF_END, SECTION_END = r"(?<=[0-3]) ", r"(?<=[01]) "
FIRST = -(1 << 63)
#: The arrays of a tree, flat and in order: nodes of each level, and how many of the level below each one holds.
TREE = ("sections", "section_sizes", "paragraphs", "paragraph_sizes", "leaves")


def _above(nodes: Column, end: str) -> Column:
    """Nodes in order, parted after those at whose end ``end`` finds a border."""
    return F.split(F.array_join(nodes, " "), end, -1)


def _hashed(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.sha2(part, 256))


def _line(line: Column) -> Column:
    """The nodes of a line's leaves; none for an empty line."""
    tokens = F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), lambda w: F.md5(w))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(_hashed(_above(tokens, LEAF_END)))


def with_trees(rows: DataFrame, *texts: str) -> DataFrame:
    """The rows with the trees of some text columns: ``{text}_{array}`` for each array in ``TREE``."""
    step = lambda df, name, make: df.select("*", *(make(t).alias(f"{t}_{name}") for t in texts))
    col = lambda t, name: F.col(f"{t}_{name}")
    rows = step(rows, "lines", lambda t: F.transform(F.split(F.col(t), "\n", -1), _line))
    rows = step(rows, "paragraphs", lambda t: F.transform(col(t, "lines"), lambda nodes: F.sha2(F.array_join(nodes, " "), 256)))
    rows = step(rows, "parts", lambda t: _above(col(t, "paragraphs"), SECTION_END))
    rows = step(rows, "sections", lambda t: _hashed(col(t, "parts")))
    rows = step(rows, "section_sizes", lambda t: F.transform(col(t, "parts"), lambda part: F.size(F.split(part, " "))))
    rows = step(rows, "paragraph_sizes", lambda t: F.transform(col(t, "lines"), lambda nodes: F.size(nodes)))
    rows = step(rows, "leaves", lambda t: F.flatten(col(t, "lines")))
    return rows.drop(*(f"{t}_{name}" for t in texts for name in ("lines", "parts")))


def root(sections: Column) -> Column:
    """The root above section nodes."""
    return F.sha2(F.array_join(sections, " "), 256)


def likeness(a: Column, b: Column) -> Column:
    """Of the leaves that either of two trees holds, the share that both do; from their leaves' nodes."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, fingerprint (the root) and the tree's arrays of each row: all that ``differences`` and ``likeness`` need of a text."""
    rows = with_trees(docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_t")), "_t")
    return rows.select(key, root(F.col("_t_sections")).alias("fingerprint"), *(F.col(f"_t_{name}").alias(name) for name in TREE))


def differences(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where two fingerprinted versions of a key differ: ``key``, change, and the numbers (from 0) of the paragraphs on either side.

    The trees are walked from their roots: only sections that differ are opened. A paragraph (or, where it is whole, a section of
    ``n_paragraphs``) that one side lacks is ``deleted`` or ``inserted``, the n-th of equal ones pairing with the n-th; one that both
    have but with other neighbours on both sides is ``moved``.
    """
    both = left.alias("a").join(right.alias("b"), key).filter(F.col("a.fingerprint") != F.col("b.fingerprint"))
    sides = [both.select(key, F.lit(side).alias("side"), *(F.col(f"{side}.{name}").alias(name) for name in TREE[:3])) for side in "ab"]
    rows = sides[0].unionByName(sides[1])
    numbered = lambda sizes: F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = rows.withColumn("starts", numbered(F.col("section_sizes")))
    section = F.explode(F.transform("sections", lambda node, i: F.struct(node.alias("node"), F.get("starts", i).alias("at"), F.get("section_sizes", i).alias("n"))))
    sections = _matched(rows.select(key, "side", section.alias("s")).select(key, "side", "s.*"), key)
    # the paragraphs of sections that only one side has
    opened = sections.filter("a is null or b is null").select(key, F.when(F.col("a").isNotNull(), "a").otherwise("b").alias("side"), F.coalesce("a", "b").alias("at"), "n")
    inside = opened.join(rows.select(key, "side", "paragraphs"), [key, "side"]).select(key, "side", F.posexplode(F.slice("paragraphs", F.col("at") + 1, F.col("n"))).alias("i", "node"), "at")
    paragraphs = _matched(inside.select(key, "side", "node", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n")), key)
    units = sections.filter("a is not null and b is not null").unionByName(paragraphs)
    held = units.filter("a is not null and b is not null")
    for side in "ab":
        order = Window.partitionBy(key).orderBy(side)
        held = held.withColumns({f"{side}_before": F.lag("a").over(order), f"{side}_after": F.lead("a").over(order)})
    moved = held.filter(~F.col("a_before").eqNullSafe(F.col("b_before")) & ~F.col("a_after").eqNullSafe(F.col("b_after")))
    named = lambda df, change: df.select(key, F.lit(change).alias("change"), F.col("a").alias("left_paragraph"), F.col("b").alias("right_paragraph"), F.col("n").alias("n_paragraphs"))
    return named(units.filter("b is null"), "deleted").unionByName(named(units.filter("a is null"), "inserted")).unionByName(named(moved, "moved"))


def _matched(rows: DataFrame, key: str) -> DataFrame:
    """(key, node, a, b, n): where each node is on either side, the n-th of equal ones together."""
    nth = F.row_number().over(Window.partitionBy(key, "side", "node").orderBy("at"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("at"))).alias(side)
    return rows.withColumn("nth", nth).groupBy(key, "node", "nth").agg(at("a"), at("b"), F.max("n").alias("n")).drop("nth")


def _ranges(rows: DataFrame, kind: T.DataType, rows_a_range: int, most_quantiles: int, most_steps: int) -> DataFrame:
    """``rows`` with ``_r``, the number of the range of their order ``_k``."""
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        # at most 16,384 keys, those of smallest hash
        sample = rows.select("_k").filter("_k.here").orderBy(F.xxhash64("_k"), "_k").limit(16_384).orderBy("_k").collect()
        step = max(1, len(sample) // most_quantiles)
        ends = F.array(*(F.lit(r["_k"]["value"]) for r in sample[::step])) if sample else F.array().cast(T.ArrayType(kind))
        return rows.withColumn("_r", F.when(F.col("_k.here"), F.size(F.filter(ends, lambda b: b <= F.col("_k.value")))).otherwise(0).cast("long"))
    keys = rows.select("_k")
    n = keys.count()
    quantiles = max(1, min(most_quantiles, n // rows_a_range))
    steps = max(1, min(most_steps, n // (rows_a_range * quantiles)))
    bounds = keys.agg(F.percentile_approx("_k", [i / quantiles for i in range(quantiles + 1)], 10_000)).first()[0] if n else None
    bounds = sorted(set(bounds or [0]))
    ends = F.array(*(F.lit(b) for b in bounds))
    q = F.size(F.filter(ends, lambda b: b <= F.col("_k")))
    low, high = F.element_at(ends, F.least(F.greatest(q, F.lit(1)), F.lit(len(bounds)))), F.element_at(ends, F.least(q + 1, F.lit(len(bounds))))
    # doubles: the distance of two keys may not fit a long
    step = F.floor((F.col("_k").cast("double") - low.cast("double")) * steps / (high.cast("double") - low.cast("double") + 1))
    return rows.withColumn("_r", q.cast("long") * (steps + 1) + F.least(F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)), F.lit(steps)))


def with_next(docs: DataFrame, key: str, text: str, rows_a_range: int = 256, most_quantiles: int = 256, most_steps: int = 256) -> DataFrame:
    """``key``, text (never null) and the next row's text, ``next_text``."""
    kind = docs.schema[key].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    order = F.coalesce(F.col(key).cast("long"), F.lit(FIRST)) if whole else F.struct(F.col(key).isNotNull().alias("here"), F.col(key).alias("value"))
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_t"), order.alias("_k"))
    rows = _ranges(rows, kind, rows_a_range, most_quantiles, most_steps)
    # one row for each range: at most (most_quantiles + 2) * (most_steps + 1)
    firsts = rows.groupBy("_r").agg(F.min("_k").alias("_k"))
    every = Window.orderBy("_r")
    before = F.coalesce(F.lag("_r").over(every), F.max("_r").over(Window.partitionBy()))
    firsts = F.broadcast(firsts.withColumn("_before", before))
    heads = rows.join(firsts, ["_r", "_k"]).groupBy("_before").agg(F.min("_t").alias("_t"))
    heads = heads.select(F.lit(None).cast(kind).alias(key), "_t", F.lit(None).cast(rows.schema["_k"].dataType).alias("_k"), F.col("_before").alias("_r"), F.lit(1).alias("_head"))
    both = rows.withColumn("_head", F.lit(0)).select(key, "_t", "_k", "_r", "_head").unionAll(heads)
    following = F.lead("_t").over(Window.partitionBy("_r").orderBy("_head", "_k", "_t"))
    return both.withColumn("next_text", following).filter("_head = 0").select(key, F.col("_t").alias("text"), "next_text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint and that of its text with the last quarter replaced by the start of the next row's text.

    Columns: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (the likeness of the text's tree
    to the edited text's and the next text's), and n_sections, n_paragraphs, n_leaves, edited_paragraphs (those of the edited text
    that the text lacks).
    """
    rows = with_next(docs, key, text).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = with_trees(rows.select(F.col(key).alias("_key"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("text").alias("t"), F.col("edited").alias("e"), F.col("next_text").alias("u")), "t", "e", "u")
    return rows.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", root(F.col("t_sections")).alias("fingerprint"), root(F.col("e_sections")).alias("edited_fingerprint"),
        likeness(F.col("t_leaves"), F.col("e_leaves")).alias("near_edited"), likeness(F.col("t_leaves"), F.col("u_leaves")).alias("near_next"),
        F.size("t_sections").alias("n_sections"), F.size("t_paragraphs").alias("n_paragraphs"), F.size("t_leaves").alias("n_leaves"),
        F.size(F.array_except("e_paragraphs", "t_paragraphs")).alias("edited_paragraphs"),
    )
