import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from skein.llm import piece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a  b ", "\n\nx\n", "a\x01b c\n", "中😀\t", "a▁b", "﻿x", "é" * 50, "x" * 300, "aaaaaaaaa bbbb ))))((", "  \n  ", "日本語のテキスト", "ﬁ ½ ①", "w" * 5000, "中文没有空格的长文章，" * 300 + "x", "aé日" * 400, "the日本語thing" * 90]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts():
    g = random.Random(3)
    made = ["".join(g.choice("ab e\n.,)(▁=é中\x01-0The ing") for _ in range(g.randint(1, 40))) for _ in range(800)]
    return ODD + made + ["a" + " " * k + "b" for k in range(40)]


def test_ids_are_the_librarys(library, texts):
    ids = piece_codec.Encoder(MODEL)(pa.array(texts))
    assert [x.tolist() for x in ids] == [library.encode(t) for t in texts]


def test_decoding_gives_texts_back(texts):
    encoder = piece_codec.Encoder(MODEL)
    assert [encoder.pieces.decode(i) for i in encoder(pa.array(texts))] == [t.replace("▁", " ") for t in texts]


def test_trie_counts_are_the_librarys(library, texts):
    counter = token_counts.TrieCounter(MODEL)
    parts, tokens = counter.texts(pa.array([*texts, None]))
    assert tokens.tolist() == [len(library.encode(t)) for t in texts] + [0]
    assert counter.nodes < counter.positions and parts[0] == 0


def test_unigram_scores_against_brute_force():
    pieces = piece_codec.Pieces(MODEL, merges=False)
    score = dict(zip((pieces.pieces[i] for i in pieces.ids), pieces.scores, strict=True))

    def best(word):
        top = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            alone = (top[end - 1][0] + pieces.fallback, top[end - 1][1] + len(word[end - 1].encode()))
            found = [(top[s][0] + score[word[s:end]], top[s][1] + 1) for s in range(max(0, end - pieces.longest), end) if word[s:end] in score]
            top.append(max([*found, alone], key=lambda x: x[0]))
        return top[-1][1]

    words = ["▁the", "▁thinking", "abc", "▁ünter", "x中y", "▁zzzz"]
    assert token_counts.TrieCounter(MODEL, merges=False).counts(words).tolist() == [best(w) for w in words]
    assert [len(x) for x in pieces.viterbi(words)] == [best(w) for w in words]


def test_slices_of_arrays(library):
    long = pa.array(["Der Ä über", "ça va", "né à Ñ"] * 50).slice(7, 60)
    assert [x.tolist() for x in piece_codec.Encoder(MODEL)(long)] == [library.encode(t) for t in long.to_pylist()]


def test_long_texts_without_spaces_are_cut(library):
    import time

    text = "".join(chr(0x4E00 + (k * k) % 5000) for k in range(100_000))
    pieces = piece_codec.Pieces(MODEL)
    assert "".join(pieces.cut(text[:999])) == text[:999] and max(map(len, pieces.cut(text))) < 50
    start = time.perf_counter()
    assert token_counts.TrieCounter(MODEL).counts(["▁" + text])[0] == len(pieces.viterbi(["▁" + text])[0]) == len(library.encode(text))
    assert time.perf_counter() - start < 10


def test_frames(spark, library):
    rows = [(1, "the cat", "x"), (2, None, "y"), (3, "", None), (None, "the cat", "z"), (1, "the cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.count(docs, MODEL).collect()), key=str)
    n = len(library.encode("the cat"))
    assert got == sorted([(1, n), (1, n), (2, 0), (3, 0), (None, n)], key=str)
    coded = piece_codec.encode(docs, MODEL)
    assert all(r["decodes_back"] for r in coded.collect())
    back = piece_codec.decode(coded, MODEL)
    assert sorted((r["text"] for r in back.collect())) == ["", "", "the cat", "the cat", "the cat"]
    assert token_counts.count(docs.limit(0), MODEL).count() == piece_codec.encode(docs.limit(0), MODEL).count() == 0
    assert np.isfinite(n)
