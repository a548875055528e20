"""Operators on small cases, some against a plain reading of their rule."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import htmltree, text
from gleanery.operators import blocks, dedupe, publish, queue, ranking, reading, search, state
from gleanery.sources import feeds


def quota(rows, n=10, least=3, most=5):
    """The rule as it reads: of the best n, the last of the unwanted kind gives way to the best left of the wanted one."""
    order = sorted(rows, key=lambda r: (-r[1], r[3]))
    top, left = order[:n], order[n:]
    short = lambda r: r[2] <= 15
    while True:
        many = sum(map(short, top))
        wanted = True if many < least else False if many > most else None
        come = next((r for r in left if short(r) == wanted), None)
        go = next((r for r in reversed(top) if short(r) != wanted), None)
        if wanted is None or come is None or go is None:
            return [r[0] for r in sorted(top, key=lambda r: (-r[1], r[3]))]
        top.remove(go)
        left.remove(come)
        top.append(come)


def test_daily_quota(spark):
    rng = random.Random(12)
    days = {d: [(f"{d}-{p}", rng.randint(1, 30), rng.choice([5, 15, 16, 40] if d % 3 else [4, 9, 50]), p) for p in range(rng.randint(0, 30))] for d in range(120)}
    df = spark.createDataFrame([(d, *r) for d, rows in days.items() for r in rows], "day int, id string, score int, minutes int, pos int")
    got = ranking.daily_top(df, ["day"], F.col("minutes") <= 15, [F.desc("score"), "pos"]).orderBy("day", "rank").collect()
    assert {d: [r.id for r in got if r.day == d] for d in days} == {d: quota(rows) for d, rows in days.items()}


def greedy(rows, covered):
    """The rule as it reads."""
    alike = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.6
    slots = []
    for pos, words, weight in rows:
        if any(alike(words, c) for c in covered):
            continue
        twin = next((s for s in slots if alike(words, s[1][1])), None)
        if twin is None:
            slots.append([pos, (pos, words, weight)])
        elif weight > twin[1][2]:
            twin[1] = (pos, words, weight)
    return sorted((s[1][0], s[0]) for s in slots)


def test_repeated_stories(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, frozenset(rng.sample(vocabulary, rng.randint(0, 6))), rng.randint(1, 4)) for i in range(120)]
    covered = [frozenset(rng.sample(vocabulary, 5)) for _ in range(4)]
    left = spark.createDataFrame([(i, " ".join(sorted(w)), k) for i, w, k in rows], "pos long, title string, weight int")
    right = spark.createDataFrame([(" ".join(sorted(c)),) for c in covered], "title string")
    got = sorted((r.pos, r.slot) for r in dedupe.drop_repeated(left, right).collect())
    assert got == greedy(rows, covered)


def test_blocks(spark):
    page = "<html><head><title>T &amp; x</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <a href='/a'>link</a><p>Two</p><p>Two</p><hr><hr><ul><li>a<li>b</ul><div class='post-share'>share</div><pre><code class='language-py'>x = 1\n  y</code></pre><img src='/i.png' width='32'><img srcset='s.png 1x, l.png 2x'><p>Follow us</p><hr></article></body></html>"
    got = htmltree.blocks(page)
    assert [(b["type"], b["text"]) for b in got] == [("heading", "Head"), ("paragraph", "One link"), ("paragraph", "Two"), ("paragraph", "Two"), ("divider", ""), ("divider", ""), ("list", "a\nb"), ("code", "x = 1\n  y"), ("image", ""), ("paragraph", "Follow us"), ("divider", "")]
    df = spark.createDataFrame([(1, "https://a.com/x", page), (2, "https://a.com/y", None), (3, "https://a.com/z", "<meta name='robots' content='noarchive'><p>" + "word " * 90)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in blocks.extract_pages(df).collect()}
    assert [b.type for b in rows[1].blocks] == ["heading", "paragraph", "paragraph", "divider", "list", "code", "image"] and rows[1].title == "T & x"
    assert rows[2].title == "https://a.com/y" and rows[3].error == "noarchive" and rows[3].text is None and not rows[3].blocks
    ids = blocks.with_ids(spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate([("p", "a"), ("p", "b"), ("p", "a")])], "d int, pos int, k string, t string"), "d", "pos", F.col("k"), F.col("t")).orderBy("pos").collect()
    assert ids[2].block_id == ids[0].block_id + "-2"


def test_noise_names():
    kinds = lambda html: [(b["type"], b["text"]) for b in htmltree.blocks(html, "https://a.com/p/")]
    assert kinds("<div class='newsletter-page'><article><p>Kept</p></article></div>") == [("paragraph", "Kept")]
    assert kinds("<div class='promo-box'><p>Gone</p></div><p>Stays, and is the longer of both</p>") == [("paragraph", "Stays, and is the longer of both")]
    assert kinds("<pre>x <span class='token comment'># why</span></pre><p>y</p>") == [("code", "x # why"), ("paragraph", "y")]
    assert kinds("<div id='ad-hoc' class='section level2'><h2>Ad hoc</h2></div><p>long enough a text to hold more than half</p>")[0] == ("heading", "Ad hoc")
    assert kinds("<div id='comments'><h2>3 comments</h2><p>much more text than the page itself has</p></div><p>a</p>") == [("paragraph", "a")]
    assert kinds("<title>Not text</title><p>a</p>") == [("paragraph", "a")]
    assert kinds("<ul><li><a href='https://t.me/share'>s</a><li>b</ul>") == [("list", "s\nb")]


def test_images_of_pages():
    link = lambda html: [b["url"] for b in htmltree.blocks(html, "https://a.com/p/x") if b["type"] == "image"]
    assert link("<img srcset='/c_limit,w_424/a.jpg 424w,/c_limit,w_848/a.jpg 848w'>") == ["https://a.com/c_limit,w_848/a.jpg"]
    assert link("<img srcset='a.jpg, b.jpg 2x'>") == ["https://a.com/p/b.jpg"] and link("<img data-lazy-src='l.png' src='data:x'>") == ["https://a.com/p/l.png"]
    assert link("<img src='data:x'><noscript><img src='/n.png'></noscript>") == ["https://a.com/n.png"] and link("<img src='javascript:1'>") == []


def test_ids_of_blocks(spark):
    """The ids are fixed values: they must never change."""
    own = spark.createDataFrame([(1, "https://blog.test/", "<p>Local models are  <b>Fast</b></p><h2>Results</h2><img src='/figure.png' alt='A figure'><p>local MODELS are fast</p>")], "page_id long, url string, html string")
    got = blocks.page_blocks(own).orderBy("pos").collect()
    assert [r.block_id for r in got] == ["pd6988894", "h073e213f", "i599b87fb", "pd6988894-2"] and not any(r.clipped for r in got)


def test_linked_data(spark):
    html = "<script type='application/ld+json'>{broken</script><script type='application/ld+json'>{\"@graph\":[{\"author\":\"A\"}]}</script>"
    assert spark.range(1).select(blocks.linked_data(F.lit(html), "author").alias("x")).first().x == "A"


def test_search(spark):
    docs = spark.createDataFrame([(1, "Open weights model", "the gguf file"), (2, "Closed", "open the weights"), (3, "Gizmo", "other")], "id int, title string, body string").selectExpr("*", "body as snippet", "'/x' as href", "null as url", "'m' as meta")
    ids = lambda q: [int(r.id) for r in search.search_all({"item": docs}, q).collect()]
    assert ids('"open weights"') == [1] and set(ids("open weights")) == {1, 2} and ids("the -gguf") == [2] and ids("gizmoo") == [3] and ids("x") == []
    assert set(ids("gguf or closed")) == {1, 2}


def test_search_with_refusals_alone_and_limits(spark):
    rows = [(i, t, b, None, None, None, None) for i, (t, b) in enumerate([("one", "a b"), ("two", "b c"), ("three", None), (None, "a_b"), ("a", "")])]
    tables = search.index({"item": spark.createDataFrame(rows, "id int, title string, body string, snippet string, href string, url string, meta string")})
    ids = lambda q, n=40: [int(r.id) for r in search.search_all(tables, q, n).collect()]
    assert sorted(ids("-b -zz")) == [2, 3, 4] and sorted(ids("a_b or -b")) == [2, 3, 4] and sorted(ids('"b c" or three')) == [1, 2]
    assert ids("b -a") == [4, 1] and len(ids("-zz", 0)) == 1 and ids(" ") == [] and ids('""') == [] and ids("thre") == [2]


def test_rank_has_the_numbers_of_the_public_algorithm(spark):
    """What the ranking function of the public full-text search gives."""
    have = lambda **places: F.create_map(*(x for k, v in places.items() for x in (F.lit(k), F.array(*(F.lit(p) for p in v)))))
    cases = [(have(a=[1]), "a", 0.06079271), (have(a=[1, 2]), "a", 0.07599088), (have(a=[1], b=[2]), "a b", 0.09910322), (have(a=[1], b=[2]), "a or b", 0.06079271), (have(a=[1]), "a or b", 0.030396355), (have(a=[1]), "a b", 1e-20), (have(a=[1], b=[3]), '"a x" b', 0.09850086), (have(a=[1, 3], b=[2]), "a b", 1 - (1 - 0.09910322) ** 2)]
    for places, query, want in cases:
        got = spark.range(1).select(search.rank(places, query).alias("x")).first().x
        assert abs(got - want) < 2e-7, (query, got, want)


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://a.com/1</link><pubDate>Tue, 22 Sep 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;Hi&lt;/p&gt;</description></item><item><title>Old</title><link>https://a.com/2</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate></item><item><title>Undated</title><link>https://a.com/3</link></item><item><title>No link</title></item><item><title>Promo</title><link>https://a.com/4</link></item></channel></rss>"
    atom = "<feed><entry><title>E</title><link rel='self' href='https://b.com/s'/><link href='https://b.com/1'/><updated>2026-09-23T01:00:00Z</updated><summary>S</summary></entry></feed>"
    bodies = spark.createDataFrame([("A", rss, "companies", 1.2, "Promo"), ("B", atom, "research", 0.9, None), ("C", "broken <", "local", 1.0, None)], "source string, body string, hint string, weight double, exclude string")
    day = lambda x: F.lit(x).cast("date")
    got = {r.url: r for r in feeds.parse_feeds(bodies, day("2026-09-20"), day("2026-09-24")).collect()}
    assert set(got) == {"https://a.com/1", "https://a.com/3", "https://b.com/1"}
    assert str(got["https://a.com/3"].published) == "2026-09-24" and got["https://a.com/1"].title == "A & B" and got["https://b.com/1"].snippet == "S"
    hn = spark.createDataFrame([('{"hits":[{"url":"https://c.com","title":"T","points":120,"created_at":"2026-09-23T00:00:00Z"},{"title":"no link","points":500},{"url":"https://d.com","title":"few","points":3}]}',)], "body string")
    assert [r.source for r in feeds.parse_hacker_news(hn, day("2026-09-20"), day("2026-09-24")).collect()] == ["Hacker News · 120 pts"]


def test_requests_and_answers_of_sources(spark):
    bodies = spark.createDataFrame([("A", "<?xml version='1.0'?><!-- x --><rss><channel>" + "".join(f"<item><title>{i}</title><link>https://a.test/{i}</link></item>" for i in range(9)) + "</channel></rss>", 2), ("B", "<rss><channel><item>", None), ("C", "<html></html>", None), ("D", None, None)], "source string, body string, limit int").selectExpr("*", "'local' as hint", "1.0 as weight", "cast(null as string) as exclude")
    day = lambda x: F.lit(x).cast("date")
    assert sorted(r.url for r in feeds.parse_feeds(bodies, day("2026-09-20"), day("2026-09-24")).collect()) == ["https://a.test/0", "https://a.test/1"]
    assert {r.source: r.error for r in feeds.feed_errors(bodies).collect()} == {"B": "breaks off", "C": "no feed", "D": "nothing fetched"}
    at = F.lit("2026-03-04 10:00:00").cast("timestamp")
    assert [(str(r.day), r.url) for r in feeds.paper_requests(spark.range(1), "https://p.test", day("2026-03-02"), at).collect()] == [("2026-03-02", "https://p.test?date=2026-03-02"), ("2026-03-03", "https://p.test?date=2026-03-03")]
    asked = spark.createDataFrame([("big news", False), ("Name", True)], "query string, exact boolean")
    assert [r.url for r in feeds.search_requests(asked, "https://s.test", at).collect()] == ["https://s.test?tags=story&query=big%20news&numericFilters=created_at_i>1772618400,points>80", "https://s.test?tags=story&query=Name&typoTolerance=false&restrictSearchableAttributes=title&numericFilters=created_at_i>1772618400,points>80"]
    assert [r.url for r in feeds.repository_requests(asked.selectExpr("'rag' as topic").limit(1), "https://g.test", at).collect()] == ["https://g.test?q=topic%3Arag%20created%3A%3E2026-02-25&sort=stars&order=desc&per_page=10"]
    papers = spark.createDataFrame([("2026-03-02", '[{"title":"P","summary":"<b>s</b>","paper":{"id":"2603.00001","upvotes":4}},{"title":"odd","paper":{"id":"x","upvotes":99}}]'), ("2026-03-03", '[{"title":"Q","paper":{"id":"2603.00002","upvotes":9}}]'), ("2026-03-04", "broken")], "day string, body string").withColumn("day", F.to_date("day"))
    assert [(r.title, r.source, r.snippet, str(r.published)) for r in feeds.parse_papers(papers).collect()] == [("Q", "Papers · 9 upvotes", "", "2026-03-03"), ("P", "Papers · 4 upvotes", "s", "2026-03-02")]


def test_queue_and_state(spark):
    rows = spark.createDataFrame([(1, "pending", 3, None, "u"), (2, "failed", 1, None, "u"), (3, "failed", 1, None, "v"), (4, "pending", 0, None, "u")], "id long, status string, attempts int, claimed_at timestamp, owner string")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert {r.id: r.status for r in queue.close_stuck(rows, now).collect()}[1] == "failed"
    assert {r.id: (r.status, r.attempts) for r in queue.retry(rows, rows.select("id"), F.lit("u")).collect()} == {1: ("pending", 3), 2: ("pending", 0), 3: ("failed", 1), 4: ("pending", 0)}
    done = queue.finish(rows, spark.createDataFrame([(4, None, True), (2, "x" * 600, True), (3, "e", False)], "id long, error string, has_post boolean"))
    assert {r.id: (r.status, len(r.last_error or "")) for r in done.collect()} == {1: ("pending", 0), 2: ("failed", 500), 3: ("failed", 1), 4: ("done", 0)}
    log = spark.createDataFrame([(1, "a", 2, 1), (1, "a", None, 2), (1, "b", 1, 1)], "user_id int, target string, value int, t int")
    assert [tuple(r) for r in state.fold(log, ["user_id", "target"], "value", ["t"]).collect()] == [(1, "b", 1)]
    assert state.own(log, F.lit(2)).count() == 0


def test_a_reader_s_columns_stay(spark):
    stored = spark.createDataFrame([(1, "old", "mine")], "id int, text string, note string")
    new = spark.createDataFrame([(1, "new"), (2, "first")], "id int, text string")
    assert sorted(map(tuple, publish.upsert_columns(stored, new, "id", ["text"]).collect())) == [(1, "new", "mine"), (2, "first", None)]


def test_words_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("the",)], "t string")
    assert [r.w for r in df.select(text.words(F.col("t")).alias("w")).collect()] == [None, [], []]


def test_reading(spark):
    raw = lambda x: spark.range(1).select(reading.repository_image(F.lit(x), F.lit("Own/Repo"), F.lit("main")).alias("x")).first().x
    base = "https://raw.githubusercontent.com/Own/Repo/"
    assert [raw(x) for x in ("/a.png", "/own/repo/blob/dev/d/a.png", "/own/other/a.png", "//cdn.test/a.png", "a.png")] == [base + "main/a.png", base + "dev/d/a.png", base + "main/own/other/a.png", None, None]
    one = spark.createDataFrame([("pdf",), ("other",)], "k string").select(reading.kind_name(F.col("k")).alias("n")).collect()
    assert one[0].n.en == "PDF" and one[1].n is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert [r.t for r in reading.by_id(rows, "id", 2).collect()] == ["b"] and reading.by_id(rows, "id", 3).count() == 0
    said = spark.createDataFrame([("failed", 1), ("done", None), ("done", 4)], "s string, p int").select(reading.reply(F.col("s"), F.col("p"), F.lit("e")).alias("r")).collect()
    assert [tuple(r.r) for r in said] == [("failed", None, "e"), ("pending", None, None), ("done", 4, None)]


def test_pages_are_read_once_and_in_small_pieces(spark, monkeypatch):
    from gleanery.operators import blocks

    pages = spark.createDataFrame([(i, f"https://a.test/{i}", "<p>" + "word " * n + "</p>" if n else "") for i, n in enumerate([0, 3, 50_000, 1, 45_000])], "page_id long, url string, html string")
    found = blocks.page_blocks(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {(r.page_id, r.pos, r.clipped, len(r.text)) for r in found.collect()} == {(1, 0, False, 14), (2, 0, False, 249_999), (3, 0, False, 4), (4, 0, False, 224_999)}
    import pyarrow as pa

    monkeypatch.setattr(blocks, "AT_ONCE", 10)
    assert list(blocks._pieces(pa.array([4, 4, 4, 30, None, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_clipped_in_place_as_in_rows(spark):
    from pyspark.sql import functions as F

    from gleanery.operators import blocks

    lists = [[], [9], [2, 2, 2, 2], [1, 5, 1], [0] * 6, [6, 0, 1]]
    rows = spark.createDataFrame([(i, [("x" * n,) for n in own]) for i, own in enumerate(lists)], "id long, b array<struct<text: string>>")
    got = {r.id: (len(r.c.blocks), r.c.clipped) for r in rows.select("id", blocks._clipped(F.col("b"), 4, 6).alias("c")).collect()}
    flat = rows.select("id", F.posexplode("b").alias("pos", "b")).withColumn("n", F.length("b.text"))
    want = {r.id: (r.n, r.clipped) for r in blocks.clip(flat, "id", "pos", "n", 4, 6).groupBy("id").agg(F.count("*").alias("n"), F.max("clipped").alias("clipped")).collect()}
    assert got == {0: (0, False)} | want


def test_open_references_stand_for_themselves_in_queries(spark):
    from gleanery.operators import blocks

    page = spark.createDataFrame([("<title>A &amp;&amp; b&amp</title><h1>A &lt;&eacute; &amp</h1>",)], "html string")
    row = page.select(blocks.closed_references("html").alias("h"), blocks.page_title(blocks.closed_references("html")).alias("title")).head()
    assert row.title == "A && b&amp"
    assert row.h == "<title>A &amp;&amp; b&amp;amp</title><h1>A &lt;&amp;eacute; &amp;amp</h1>"


def test_alike_short_and_long_headlines_meet_by_few_keys(spark):
    import random

    from gleanery.operators import dedupe

    rng = random.Random(3)
    sets = {i: sorted(rng.sample([f"w{k}" for k in range(26)], rng.choice([1, 2, 3, 9, 15, 16, 17, 22]))) for i in range(150)}
    sets = {min(i for i in sets if sets[i] == own): own for own in sets.values()}
    found = dedupe.alike(spark.createDataFrame(list(sets.items()), "id long, words array<string>"))
    alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.6}
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)


def test_repeated_stories_of_frequent_words(spark, monkeypatch):
    """Words that many headlines have bring candidates together by pairs alone, with each other and with covered ones."""
    monkeypatch.setattr(dedupe, "OFTEN", 3)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(24)]
    rows = [(i, frozenset(rng.sample(vocabulary, rng.choice([0, 1, 2, 14, 18]))), rng.randint(1, 4)) for i in range(90)]
    covered = [frozenset(rng.sample(vocabulary, n)) for n in (1, 13, 15)]
    left = spark.createDataFrame([(i, " ".join(sorted(w)), k) for i, w, k in rows], "pos long, title string, weight int")
    right = spark.createDataFrame([(" ".join(sorted(c)),) for c in covered], "title string")
    assert sorted((r.pos, r.slot) for r in dedupe.drop_repeated(left, right).collect()) == greedy(rows, covered)


@pytest.mark.parametrize("least", [0.45, 0.6, 0.8])
def test_alike_long_headlines_of_frequent_words_meet_by_pairs_of_them(spark, monkeypatch, least):
    """Against all pairs, where most words have more than OFTEN headlines and sets differ by a few words."""
    import random

    from gleanery.operators import dedupe

    monkeypatch.setattr(dedupe, "OFTEN", 5)
    rng = random.Random(4)
    sets = {}
    for i in range(160):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else rng.sample([f"w{k}" for k in range(60)], rng.choice([1, 2, 5, 20, 40]))
        sets[i] = sorted({*base, *(f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 6)))} - set(rng.sample(base, len(base) // 6)))
    sets = {min(i for i in sets if sets[i] == own): own for own in sets.values()}
    frame = lambda odd: spark.createDataFrame([(i, w) for i, w in sets.items() if odd in (None, i % 2)], "id long, words array<string>")
    close = {(a, b) for a in sets for b in sets if a != b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= least}
    assert sorted((r.a, r.b) for r in dedupe.alike(frame(None), least=least).collect()) == sorted(x for x in close if x[0] < x[1])
    assert sorted((r.a, r.b) for r in dedupe.alike(frame(0), frame(1), least).collect()) == sorted(x for x in close if x[0] % 2 == 0 and x[1] % 2)


def test_an_index_for_one_query_holds_its_words_alone(spark):
    from gleanery.operators import search

    rows = spark.sql("select 1L id, 'one two' title, 'three one' body, repeat('s', 500) snippet, '' href, '' url, '' meta")
    own = search.index({"item": rows}, "one -three")
    assert {(r.token, tuple(r.places)) for r in own.words.collect()} == {("one", (1, 4)), ("three", (3,))}
    assert own.rows.head().snippet == "s" * 240
