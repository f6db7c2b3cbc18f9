"""The subpackage's queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, langid, merkle, ngram_join, packing, piece_codec, quality, token_counts, toxicity, warc
from skein.llm.common import fold, scratch_path, table


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    net = langid.train(docs, ~held_out)
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.records(spark, path)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_quality, op4_language_id, op5_fingerprints, op6_toxicity, op7_neighbours, op8_packing, op9_ngram_join, op10_warc)}


def _leaves(text: str) -> str:
    """The leaves of each line of a text, as merkle.py has them: runs of tokens that end after one whose MD5 ends in 0 to 3."""
    nodes = "array_to_string(list_transform(regexp_extract_all(l, '[^ ]{1,32} *| +'), lambda w: md5(w)), ' ')"
    return f"list_transform(string_split({text}, chr(10)), lambda l: case when l = '' then []::varchar[] else list_transform(string_split(regexp_replace({nodes}, '([0-3]) ', '\\1|', 'g'), '|'), lambda p: sha256(p)) end)"


def _sections(paragraphs: str) -> str:
    """Sections that end after a paragraph whose node ends in 0 or 1."""
    return f"list_transform(string_split(regexp_replace(array_to_string({paragraphs}, ' '), '([01]) ', '\\1|', 'g'), '|'), lambda p: sha256(p))"


_OP5 = f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id, coalesce(text, '')) as k, count(*) over () as n from documents),
p as (select a.doc_id, a.t, b.t as u, length(a.t) as c, length(a.t) // 4 as q from d a join d b on b.k = a.k % a.n + 1),
e as (select *, substring(t, 1, (c - q)::bigint) || substring(u, 1, q::bigint) as x from p),
l as (select doc_id, c, x, {_leaves("t")} as tl, {_leaves("x")} as xl, {_leaves("u")} as ul from e),
f as (select *, list_transform(tl, lambda v: sha256(array_to_string(v, ' '))) as tp, list_transform(xl, lambda v: sha256(array_to_string(v, ' '))) as xp,
      list_distinct(flatten(tl)) as tb, list_distinct(flatten(xl)) as xb, list_distinct(flatten(ul)) as ub from l),
g as (select *, {_sections("tp")} as ts, {_sections("xp")} as xs, len(list_intersect(tb, xb)) as tx, len(list_intersect(tb, ub)) as tu from f)
select doc_id, c::bigint as n_chars, sha256(x) as edited_sha256, sha256(array_to_string(ts, ' ')) as fingerprint, sha256(array_to_string(xs, ' ')) as edited_fingerprint,
  case when len(tb) + len(xb) = 0 then 1.0::double else tx::double / (len(tb) + len(xb) - tx) end as near_edited,
  case when len(tb) + len(ub) = 0 then 1.0::double else tu::double / (len(tb) + len(ub) - tu) end as near_next,
  len(ts)::int as n_sections, len(tp)::int as n_paragraphs, len(flatten(tl))::int as n_leaves, len(list_filter(list_distinct(xp), lambda h: not list_contains(tp, h)))::int as edited_paragraphs from g"""

_OP9 = r"""
with recursive d as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from d),
u as (select doc_id, len(g) as n, unnest(g) as h from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k, a.n as nx, b.n as ny from u a join u b on a.h = b.h and a.doc_id != b.doc_id group by all),
a as (select x as src, y as dst from c where 100 * k >= 85 * (nx + ny - k)),
b(id, component) using key (id) as (select doc_id, doc_id from s union select a.dst, min(b.component) from b join a on a.src = b.id join recurring.b r on r.id = a.dst where b.component < r.component group by a.dst)
select doc_id, len(g)::bigint as n_shingles, component as component_id from s join b on id = doc_id"""

_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::bigint >> {shift}) & 31)::int, 1)" for g in range(8) for shift in (15, 10, 5, 0))
_OP10 = f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages), f as (select *, min(page_id) over (partition by t) as first from p)
select page_id, strlen(t)::bigint as payload_bytes, {_DIGIT} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id != first then first end as refers_to from f"""

SQL: dict[str, str] = {"op5_fingerprints": _OP5, "op9_ngram_join": _OP9, "op10_warc": _OP10}
