"""Token files and packing: against whole-text encoding, by exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gleanery.llm import packing, repair, tokens

TEXTS = ["", None, "a\x0bb\x0cc\x1cd é", " lead", "x  y   z  ", "foo.\nBar  q", "a \nb\n c", "Don't we'll ÀÉ ß\xa0x", "<|endoftext|> hi", "\n\n a \n\n", "É é.", "AB.Cd a.b, ÉÀ., ab...", "x.\nYz! ab\nc", "x_y. a'b. a.'s", "İI straße x² ŉa ǅ ﬁne, x\u0301y J\u030c. ٣a", "a<|endoftext|>b <|STARTOFTEXT|>", "lead  <|startoftext|>x", "word " * 9000]
FILES = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")]


@pytest.mark.parametrize("name,cut", FILES)
def test_ids_are_those_of_the_library_as_it_comes(name, cut):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    ids, at = tokens.Encoder(public_tokenizers.path(name), cut).encode(pa.array(TEXTS), 7)
    for text, a, b in zip(TEXTS, at, at[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("name,cut", FILES)
def test_cached_pieces_give_the_ids_of_whole_texts(name, cut):
    coder = tokens.Encoder(public_tokenizers.path(name), cut)
    for _ in range(2):
        ids, at = coder.encode(pa.array(TEXTS), 2)
        want, where = coder.encode_whole(pa.array(TEXTS), 2)
        assert np.array_equal(at, where) and np.array_equal(ids, want)


@pytest.mark.parametrize("name,cut", FILES)
def test_a_full_memory_changes_nothing(name, cut, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 6)
    coder = tokens.Encoder(public_tokenizers.path(name), cut)
    for texts in (TEXTS[:4], TEXTS, TEXTS[::-1], TEXTS):
        ids, at = coder.encode(pa.array(texts), 2)
        want, where = coder.encode_whole(pa.array(texts), 2)
        assert np.array_equal(at, where) and np.array_equal(ids, want)


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 4000) % 50 if seed % 2 else np.tile(rng.integers(0, 9, 17), 300)[: 5000 - seed]
    body, left, right, terminals = repair.compress(ids, min_count=2)
    assert np.array_equal(repair.expand(body, left, right, terminals), ids)
    assert len(body) < len(ids)
    sizes = repair.expansions(left, right, terminals)
    for i in (0, len(left) // 2, len(left) - 1):
        assert sizes[i] == len(repair.expand(np.array([terminals + i]), left, right, terminals))


def test_empty_grammar():
    body, left, right, terminals = repair.compress(np.zeros(0, np.int32))
    assert not len(body) and not len(repair.expand(body, left, right, terminals))


def test_token_file(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as part", "'x' as ids")
    path = str(tmp_path / "file")
    file = public_tokenizers.path("word_bpe_49k.json")
    repair.write(docs, path, file, end=2, shard_ids=64, partitions=3)
    got = repair.documents(spark, path).orderBy("start").collect()
    coder = tokens.Encoder(file, "words")
    start = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    by = {i: {tuple(coder.whole(x or "").tolist() + [2]) for j, x in rows if j == i} for i, _ in rows}
    for r in got:
        assert r.start == start and tuple(r.ids) in by[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids)
        start += r.n_tokens
    for row in spark.read.parquet(path).collect():
        shard = repair.Shard(row.asDict())
        whole = shard.all()
        for i, stop in enumerate(shard.doc_ends):
            assert np.array_equal(shard.document(i), whole[shard.doc_ends[i - 1] if i else 0 : stop])


def test_token_file_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    repair.write(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.path("word_bpe_49k.json"))
    assert repair.documents(spark, path).count() == 0


@pytest.mark.parametrize("seed,last", [(0, False), (1, False), (2, False), (3, True), (4, True)])
def test_place_follows_the_rule(seed, last):
    """Against the sum of squares taken anew for every choice."""
    rng = np.random.default_rng(seed)
    most = 24
    lengths = rng.integers(1, most + 1, 150)
    bins, offsets, fill = packing.place(lengths, most, last)
    gaps: dict[int, int] = {}

    def total(changed):
        open_ = [g for g in {**gaps, **changed}.values() if g]
        return sum(open_.count(g) ** 2 for g in set(open_))

    for i in np.argsort(-lengths, kind="stable").tolist():
        s, b = int(lengths[i]), int(bins[i])
        choices = [(total({c: g - s}), 0, g) for c, g in gaps.items() if g >= s]
        if not (last and choices):
            choices.append((total({-1: most - s}), 1, most))
        own = (total({b: gaps[b] - s}), 0, gaps[b]) if b in gaps else (total({b: most - s}), 1, most)
        assert own == min(choices) and offsets[i] == (most - gaps[b] if b in gaps else 0)
        gaps[b] = gaps.get(b, most) - s
    assert [most - gaps[b] for b in range(len(fill))] == fill.tolist()


def test_packing_nulls_and_repeats(spark):
    rows = [(None, "a b"), (None, None), (5, "x y z"), (5, "x y z"), (5, "other"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "'x' as full").repartition(3)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.columns == packing.COLUMNS
    got = got.collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "6", "None", "None"] and all((r.piece, r.start) == (0, 0) for r in got)
    # what three tasks leave open is one sequence in the end
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got)[0] == 0


def test_packing_is_whole_and_gapless(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(100 + i, "some words here " * (40 * i % 700)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    file = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, file, end=0).collect()
    coder = tokens.Encoder(file, "spaces")
    ids = {i: np.append(coder.whole(x or ""), 0) for i, x in rows}
    for i, _ in rows:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert len(own) == -(-len(ids[i]) // 2048) and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].astype("<u4").tobytes())
            at += r.length
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= sum(map(len, ids.values())) / 2048 + 2
    assert packing.pack(docs.limit(0), file).count() == 0
