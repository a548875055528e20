"""The daily run, extractors and the queue stream."""

import datetime as dt
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from gleanery.operators import daily, ingest
from gleanery.streaming import streams

NOW = "2026-09-23 12:00:00"


def test_daily_run(spark):
    now = F.lit(NOW).cast("timestamp")
    names = ["Llama 4 runs on a laptop", "Llama 4 runs on laptop", "Quiet funding news today", "Vision paper of note", "", "Stored story here"]
    rows = [(1, i, t, f"https://a.com/{i}?utm_source=x", "Blog", "companies", dt.date(2026, 9, 23), 0, 1.0 + i / 10) for i, t in enumerate(names)]
    candidates = spark.createDataFrame(rows, "priority int, pos long, title string, url string, source string, hint string, published date, points int, weight double")
    stored = spark.createDataFrame([("x", "2026-W39", "https://a.com/5", "Other words entirely", "Blog", "local", 50, 5, dt.datetime(2026, 9, 23, 9))], "id string, issue_id string, url string, title string, source string, category string, score int, read_minutes int, created_at timestamp")

    def judge(batches):
        for b in batches:
            yield pd.DataFrame({"pos": list(b["pos"]) + [10**15], "score": 3.0, "promotion": [0.9 if "funding" in t else 0.0 for t in b["title"]] + [0.0], "category": "local"})

    new, day = daily.run(candidates, stored, now, judge)
    got = {r.title: r for r in new.collect()}
    assert set(got) == {names[1], names[3]} and got[names[3]].category == "local" and got[names[3]].id.startswith("local-2026w39-vision-paper-of-note-")
    assert {r.item_id for r in day.collect()} == {"x", *(r.id for r in got.values())}
    plain, _ = daily.run(candidates, stored, now)
    assert names[2] in {r.title for r in plain.collect()}


def test_extractors(spark):
    long = "word " * 90
    html = f"<title>T</title><meta property='article:published_time' content='soon'><meta name='date' content='2026-01-02'><p>{long}</p>"
    rows = spark.createDataFrame([("article", "https://a.com/x", html, long), ("article", "https://a.com/f%20g.zip", None, None), ("x", "https://x.com/a/status/1", '{"author_name":"A","html":"<p>one<br><br>two</p>"}', None), ("github", "https://github.com/o/r", "not json", None)], "kind string, url string, body string, text string")
    u, b = F.col("url"), F.col("body")
    got = ingest.extracted(rows, {"article": ingest.article(u, b, F.col("text")), "x": ingest.x_post(b), "github": ingest.github(u, b, F.lit(None))}, fallback=ingest.metadata_only(u, b)).collect()
    assert [r.extracted.title for r in got] == ["T", "f g.zip", "A: one\n\ntwo", "r"] and str(got[0].extracted.published) == "2026-01-02" and got[2].extracted.text == "one\n\ntwo"
    atom = "<feed><entry><title>P\n q</title><summary>s</summary><published>2026-01-02T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><author><name>C</name></author><author><name>D</name></author></entry></feed>"
    paper = spark.range(1).select(ingest.arxiv(F.lit("https://arxiv.org/abs/2411.01234"), F.lit(atom)).alias("p")).first().p
    assert (paper.title, paper.author, paper.error) == ("P q", "A, B, C et al.", None)
    body = spark.range(1).select(ingest.body_text(F.lit("é").cast("binary"), F.lit("text/html")).alias("b"), ingest.body_text(F.lit("long").cast("binary"), F.lit(None), 2).alias("c")).first()
    assert body.b.text == "é" and body.c.error == "body too large"
    latin = [("ő".encode("iso-8859-2"), 'text/html; charset="ISO-8859-2"'), (b"\x80", "text/html; charset=iso-8859-1"), ("ő".encode(), "text/html; charset=none-such"), (b"a\xff", None), (b"abcdef", "text/plain"), (None, "text/html; charset=cp1250")]
    texts = spark.createDataFrame(latin, "b binary, t string").select(ingest.body_text(F.col("b"), F.col("t"), 4, truncate=True).alias("x"), ingest.is_html(F.col("t")).alias("h")).collect()
    assert [r.x.text for r in texts] == ["ő", "€", "ő", "a\ufffd", "abcd", None] and [r.h for r in texts] == [True, True, True, True, False, True]
    objects = spark.createDataFrame([('{"a":1}',), ("[1]",), ("null",), ("x",), (None,)], "b string").select(ingest.json_object(F.col("b")).isNotNull().alias("x")).collect()
    assert [r.x for r in objects] == [True, False, False, False, False]


def test_what_falls_back_to_what(spark):
    answer = '{"author_name":"A","html":"<blockquote><p>#tag &amp; one<br>line<br><br>two</p>&mdash; A <a href=\\"u\\">March 5, 2026</a></blockquote>"}'
    rows = [("x", "https://x.com/a/status/1", answer), ("x", "https://x.com/a/status/2", "gone"), ("youtube", "https://youtu.be/abcdefghijk", '{"title":"V","author_name":"B"}'), ("youtube", "https://youtube.com/x", None), ("pdf", "https://a.test/p.pdf", None), ("github", "https://github.com/o/r", "down")]
    df = spark.createDataFrame(rows, "kind string, url string, body string")
    u, b = F.col("url"), F.col("body")
    bad = F.when(F.lit(True), ingest._struct(error=F.lit("no reader")))
    page = ingest._struct(title=F.lit("page"), text=F.lit("t"))
    got = ingest.extracted(df, {"x": ingest.x_post(b), "youtube": ingest.video_only(u, b), "pdf": bad, "github": ingest.github(u, b, F.lit(None)), "article": page}, fallback=ingest.metadata_only(u, F.lit(None).cast("string"))).collect()
    assert [(r.extracted.title if r.extracted else None, r.error) for r in got] == [("A: #tag & one line\n\ntwo", None), (None, "unreachable: no post"), ("V", None), (None, "unreachable: no video"), ("p.pdf", None), ("page", None)]
    assert str(got[0].extracted.published) == "2026-03-05" and got[2].extracted.text == "V — B"


def feed(spark, folder, batches, schema):
    """Files of a folder, one a batch, in order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        (part,) = Path(path).glob("*.parquet")
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))


def test_queue_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    steps = [(1, "claim", 0), (1, "error", 1), (1, "claim", 20), (1, "claim", 21), (1, "done", 30), (2, "claim", 0), (2, "error", 1), (2, "claim", 2), (2, "error", 15), (2, "claim", 16), (2, "error", 17), (3, "claim", 25), (4, "error", 3), (4, "claim", 5), (4, "claim", 15), (4, "claim", 25)]
    schema = "id long, step string, ts timestamp"
    feed(spark, tmp_path / "in", [[(i, s, at(m)) for i, s, m in steps], [(9, "claim", at(34))], [(9, "done", at(36))], [(8, "claim", at(60))], [(3, "claim", at(61)), (9, "claim", at(61))]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.run_once(streams.work_queue(stream), "queue", str(tmp_path), "update")
    rows = sorted((r.batch, r.id, r.status, r.attempts, r.held) for r in got.collect())
    assert [r[1:] for r in rows if r[0] == 0] == [(1, "done", 2, False), (2, "failed", 3, False), (3, "pending", 1, True), (4, "pending", 3, True)]
    ended = [r[1:] for r in rows if r[1] in (3, 4) and r[0] > 0]
    # no step of theirs came: the leases of 3 and 4 end by time alone, the last attempt of 4 with it; then 3 is claimed again
    assert ended == [(3, "pending", 1, False), (4, "failed", 3, False), (3, "pending", 2, True)]
    assert [r[2:] for r in rows if r[1] == 9][-1] == ("done", 1, False)


def test_weeks_close(spark, tmp_path):
    day = lambda n, h=0: dt.datetime(2026, 1, 5) + dt.timedelta(days=n, hours=h)
    row = lambda i, t, kind="a": (i, t, 1, kind, 1.5, None)
    batches = [[row(1, day(0)), row(2, day(1)), row(3, day(8))], [row(4, day(6)), row(5, day(9), "b")], [row(6, day(16))], [row(7, day(2)), row(8, day(16))], [row(9, day(23))]]
    feed(spark, tmp_path / "in", batches, streams.EVENT)
    stream = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    table = f"{tmp_path}/weeks"
    query = streams.drain_weeks(streams.weekly(stream, "2 days"), table, f"{tmp_path}/state")
    got = sorted((r.week, r.event_type, r.n, r.total) for r in spark.read.parquet(table).collect())
    # event 7 comes when its week is over and is refused; event 4, a day late, is taken
    assert got == [("2026-W02", "a", 3, 4.5), ("2026-W03", "a", 1, 1.5), ("2026-W03", "b", 1, 1.5), ("2026-W04", "a", 2, 3.0), ("2026-W05", "a", 1, 1.5)]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(kept) <= 3 and kept[-1] <= 2
    before = {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet") if "W02" in str(p) or "W03" in str(p)}
    spark.createDataFrame([row(10, day(0)), row(11, day(24))], streams.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    streams.drain_weeks(streams.weekly(stream, "2 days"), table, f"{tmp_path}/state")
    assert [(r.n, r.total) for r in spark.read.parquet(table).where("week = '2026-W05'").collect()] == [(2, 3.0)]
    assert before == {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet") if "W02" in str(p) or "W03" in str(p)}
