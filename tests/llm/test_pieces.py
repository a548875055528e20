"""Piece counts against greedy longest match written out."""

import random

import public_tokenizers
import pyarrow as pa
import pytest

from gleanery.llm import pieces


def greedy(word, initial, rest):
    n, at = 0, 0
    while at < len(word):
        own = initial if at == 0 else rest
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in own), default=0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("seed", range(30))
def test_against_greedy(seed):
    rng = random.Random(seed)
    make = lambda k: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, k)))
    initial = {make(6) for _ in range(rng.randint(1, 25))}
    rest = None if seed % 3 == 0 else {make(5) for _ in range(rng.randint(0, 25))}
    words = [make(14) for _ in range(400)] + [b""]
    got = pieces.Automaton(initial, rest).count(pa.array(words, pa.binary()))
    assert got.tolist() == [greedy(w, initial, initial if rest is None else rest) for w in words]


def test_no_words():
    assert len(pieces.Automaton([b"a"]).count(pa.array([], pa.binary()))) == 0


def test_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = set(pieces.byte_level(path))
    rows = [(0, None), (1, ""), (2, "The greedy  longest\tmatch"), (2, "again"), (None, "é 日本 " + "x" * 5000), (4, "\x1c \x0b")]
    got = pieces.token_counts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens"), path).collect()
    want = [(i, len((x or "").encode().split()), sum(greedy(b" " + w, vocab, vocab) for w in (x or "").encode().split())) for i, x in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_query_on_whole_table(spark):
    from gleanery.llm import queries

    vocab = set(pieces.byte_level(public_tokenizers.path("byte_bpe_50k.json")))
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op3_longest_match_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got[:25]:
        assert r.n_tokens == sum(greedy(b" " + w, vocab, vocab) for w in rows[r.doc_id].encode().split())
