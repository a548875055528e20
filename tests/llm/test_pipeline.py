"""The pipeline's stages against brute-force versions, each on what the one before kept."""

import corpus_pipeline as pipeline

from . import test_contamination, test_jaccard, test_quality, test_substring


def test_stages(spark):
    rng = __import__("random").Random(4)
    rows = [(i, x, lang, source, len(x)) for i, x, lang, source in test_quality.corpus(7, 150) if x is not None and i < 900]
    long = [r for r in rows if 120 < len(r[1].split()) < 400]
    for i, (_, x, *rest) in enumerate(long[:20]):
        words = x.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), *rest))
    for i, (_, x, *rest) in enumerate(long[20:40]):
        rows.append((1100 + i, " ".join(f"n{i}x{j}" for j in range(90)) + " " + " ".join(x.split()[:40]), *rest))
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    rows.append((1200, " ".join(f"m{j}" for j in range(70)) + " " + item.text + " " + " ".join(f"k{j}" for j in range(70)), "en", "a", 5))
    rows.append((None, " ".join(f"l{j}" for j in range(70)), None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    name = lambda i: -1 if i is None else i
    texts = {name(r[0]): r[1] for r in rows}

    kept = {name(r[0]) for r, (_, _, ok) in zip(rows, test_quality.brute([r[:4] for r in rows])) if ok}
    docs = pipeline.quality_rules(spark, docs, "").cache()
    assert docs.columns == pipeline.COLUMNS and {name(r.doc_id) for r in docs.collect()} == kept < set(texts)

    groups = test_jaccard.brute([(i, texts[i]) for i in kept])
    firsts = {i for i, (_, least) in groups.items() if i == least}
    docs = pipeline.near_duplicates(spark, docs, "").cache()
    assert docs.columns == pipeline.COLUMNS and {name(r.doc_id) for r in docs.collect()} == firsts < kept

    cut = test_substring.brute([(i, texts[i]) for i in firsts], 20)
    docs = pipeline.repeated_passages(spark, docs, "").cache()
    got = {name(r.doc_id): r for r in docs.collect()}
    whole = {i: len(texts[i].encode().split()) for i in firsts}
    assert set(got) == {i for i in firsts if cut[i]} and any(len(cut[i]) < whole[i] for i in firsts)
    for i, r in got.items():
        assert r.text == (texts[i] if len(cut[i]) == whole[i] else b" ".join(cut[i]).decode())

    docs = pipeline.benchmark_leaks(spark, docs, "/root/testdata/sf0.001").cache()
    items = [test_contamination.shingles(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = {i for i, r in got.items() if not any(b and 100 * len(test_contamination.shingles(r.text) & b) >= 80 * len(b) for b in items)}
    assert {name(r.doc_id) for r in docs.collect()} == clean and 1200 not in clean

    pieces = pipeline.packed(spark, docs, "").collect()
    assert {name(r.doc_id) for r in pieces} == clean


def test_run_is_its_stages(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
