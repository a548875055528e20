"""Scalar functions against a plain reading of their rule, or on cases of their own."""

import datetime as dt
import math
import random
import re
import unicodedata
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from gleanery.functions import dates, scoring, text, urls


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def of(spark, values, column, kind="string"):
    """A column of x for each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column.alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def test_weeks(spark):
    days = [dt.date(y, m, d) for y in range(2018, 2032) for m, d in ((1, 1), (1, 2), (1, 4), (12, 28), (12, 30), (12, 31), (6, 17))]
    names = [f"{c.year}-W{c.week:02}" for c in (d.isocalendar() for d in days)]
    assert of(spark, days, dates.iso_week(F.col("x")), "date") == names
    mondays = [d - dt.timedelta(days=d.weekday()) for d in days]
    assert of(spark, names, dates.iso_week_monday(F.col("x"))) == mondays
    assert of(spark, mondays, dates.archive_label(F.col("x")), "date") == [f"{d + dt.timedelta(days=6):%m. %d.}" for d in mondays]
    long_years = {y for y in range(2018, 2032) if dt.date(y, 12, 28).isocalendar().week == 53}
    assert of(spark, [f"{y}-W53" for y in range(2018, 2032)], dates.iso_week_monday(F.col("x")).isNotNull()) == [y in long_years for y in range(2018, 2032)]
    assert of(spark, ["2020-W00", "2020-W54", "20-W10", "2020W10", " ", None], dates.iso_week_monday(F.col("x"))) == [None] * 6


def test_budapest(spark):
    zone, utc = ZoneInfo("Europe/Budapest"), dt.timezone.utc
    moments = [dt.datetime(2025, m, d, h, 45) for m, d in ((2, 28), (3, 29), (3, 30), (3, 31), (8, 9), (10, 25), (10, 26), (12, 31)) for h in (0, 1, 21, 22, 23)]
    local = [m.replace(tzinfo=utc).astimezone(zone) for m in moments]
    assert of(spark, moments, dates.budapest_day(F.col("x")), "timestamp") == [x.date() for x in local]
    starts = [dt.datetime.combine(x.date(), dt.time(), zone).astimezone(utc) for x in local]
    assert of(spark, moments, F.date_format(dates.budapest_day_start(F.col("x")), "yyyy-MM-dd HH:mm"), "timestamp") == [f"{x:%Y-%m-%d %H:%M}" for x in starts]


def test_published(spark):
    cases = {
        "Sat, 1 Aug 2020 22:15:00 -0300": "2020-08-02", "2020-08-01T22:15:00-03:00": "2020-08-01", "1 Aug 2020 01:00 +0530": "2020-07-31", "August 1st, 2020": "2020-08-01", "Aug. 1 2020 at 11:59 pm": "2020-08-01", "1-Aug-2020": "2020-08-01",
        "2020/8/1": "2020-08-01", "8/1/2020, 12:30 AM": "2020-08-01", "Aug 1, 2020 20:00 EDT": "2020-08-02", "Feb 30 2021": "2021-03-02", "2021-02-30": None, "32 Aug 2020": None, "tomorrow": None, "": None, "Aug 2020": None, "1 Foo 2020": None,
    }
    assert [None if x is None else str(x) for x in of(spark, cases, dates.published_date(F.col("x")))] == list(cases.values())


def test_urls(spark):
    same = ["https://site.test/p?utm_medium=a&gclid=b", "https://www.site.test/p/", "https://SITE.test/p#part", "https://site.test:443/p?ref_src=q&mc_eid=1"]
    assert set(of(spark, same, urls.url_key(F.col("x")))) == {"https://site.test/p"}
    papers = [f"https://arxiv.org/{kind}/2501.0{i}00{end}" for i, (kind, end) in enumerate((("pdf", ".pdf"), ("abs", "v2"), ("html", "/")))]
    assert of(spark, papers, urls.url_key(F.col("x"))) == [f"https://arxiv.org/abs/2501.0{i}00" for i in range(3)]
    kept = {"https://twitter.com/n/status/7?t=z&s=1": "https://twitter.com/n/status/7", "https://site.test/?page=2": "https://site.test/?page=2", "plain words": "plain words", "http://192.168.0.9/b/": "http://192.168.0.9/b/", "http://site.test/p": "http://site.test/p"}
    assert of(spark, kept, urls.url_key(F.col("x"))) == list(kept.values())
    kinds = {"https://www.youtube.com/watch?v=A_b-C1d2E3f": "youtube", "https://youtube.com/c/some": "article", "https://arxiv.org/abs/cs.CL/0101001": "arxiv", "https://github.com/own/tool.git": "github", "https://github.com/own/tool/pulls": "article", "https://github.com/explore/x": "article", "https://twitter.com/n/status/12": "x", "https://site.test/a/File.Pdf?x": "pdf", "https://site.test/pdf": "article"}
    assert of(spark, kinds, urls.detect_source(F.col("x"))) == list(kinds.values())
    assert of(spark, ["7", "07", "-7", "7.0", "9" * 16, "9" * 17], urls.parse_id(F.col("x"))) == [7, None, None, None, 9999999999999999, None]
    said = {"look: https://w.test/a_(b), ok": ("https://w.test/a_(b)", "look: ok"), "(https://w.test/c)": ("https://w.test/c", None), "no link": (None, None)}
    links = of(spark, said, urls.message_link(F.col("x")))
    assert links[0].url == "https://w.test/a_(b)" and links[0].note.startswith("look:") and links[1].url == "https://w.test/c" and (links[2] is None or links[2].url is None)


def test_private_addresses(spark):
    private = ["::", "::1", "[::1]", "FE80::1", "fd12::", "ff02::1", "::ffff:10.1.2.3", "::ffff:a01:203", "64:ff9b::192.168.1.1", "2002:7f00:1::", "::169.254.0.1", "127.0.0.1", "100.64.0.1"]
    public = ["2001:db8::1", "::ffff:8.8.8.8", "64:ff9b::808:808", "2002:808:808::1", "8.8.8.8", "100.128.0.1", "1:2:3:4:5:6:7:8", "1::2::3", "::ffff:1.2.3.999", "g::1", "site.test", ""]
    assert of(spark, private + public, urls.is_private(F.col("x"))) == [True] * len(private) + [False] * len(public)
    groups = {"1:2:3:4:5:6:7:8": [1, 2, 3, 4, 5, 6, 7, 8], "::": [0] * 8, "a::b": [10, 0, 0, 0, 0, 0, 0, 11], "1:2:3:4:5:6:7::": [1, 2, 3, 4, 5, 6, 7, 0], "::1.2.3.4": [0] * 6 + [258, 772], "1:2:3": None, "1:2:3:4:5:6:7:8:9": None, ":::": None, "12345::": None, "1:2:3:4::5:6:7:8": None}
    assert of(spark, groups, urls.ipv6(F.col("x"))) == list(groups.values())


def test_text(spark):
    rng = random.Random(8)
    titles = ["".join(rng.choice("aB7 é,-Űñ.") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["Of the Straße and ﬁre 4", None]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not 0x300 <= ord(c) <= 0x36F)
    stop = set(text.STOP_WORDS)
    want = [None if t is None else {w for w in re.split("[^a-z0-9]+", fold(t)) if (len(w) > 1 or w.isdigit()) and w not in stop} for t in titles]
    got = of(spark, titles, text.words(F.col("x")))
    assert [g if g is None else set(g) for g in got] == want

    def fnv(t):
        h = 2166136261
        for i in range(0, len(b := t.encode("utf-16-le")), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "little")) * 16777619 % 2**32
        return f"{h:08x}"

    keys = ["", "x", "é ő", "😀 pair", "https://w.test/p?q=1"]
    assert of(spark, keys, text.fnv1a(F.col("x"))) == [fnv(k) for k in keys] and of(spark, keys, text.short_hash(F.col("x"))) == [fnv(k)[:6] for k in keys]
    # fixed values: ids of stored rows, which must never change
    week = dates.week_compact(F.lit("2026-09-23").cast("date"))
    assert one(spark, text.item_id(F.lit("research"), week, F.lit("Title"), F.lit("https://a.example/1")))[0] == "research-2026w39-title-a42106"
    sentences = " ".join(f"Point {i} of the report is short." for i in range(40))
    lead, cut, none = of(spark, [sentences, "verylongword " * 80, " \n"], text.lead_summary(F.col("x")))
    assert sentences.startswith(lead) and lead.endswith(".") and 280 <= len(lead) < 280 + 36 and len(cut) <= 601 and cut.endswith("…") and none == ""
    told = [("RAG for LoRA", "rag and agents"), ("", "rag lora rag"), ("Vision", "an agent, agents, an agentic eval; evals"), ("none", "at all")]
    hits = lambda t, b: sorted((-n, i, k) for i, (k, p) in enumerate(text.TAGS.items()) if (n := 2 * len(re.findall(p, t, re.I | re.A)) + len(re.findall(p, b, re.I | re.A))) >= 2)
    df = spark.createDataFrame(told, "t string, b string").select(text.keyword_tags(F.col("t"), F.col("b")).alias("r"))
    assert [r.r for r in df.collect()] == [[k for *_, k in hits(t, b)][:4] for t, b in told]
    stars = {0: "0", 999: "999", 1000: "1K", 1049: "1K", 1050: "1.1K", 99_949: "99.9K", 100_400: "100K", 999_499: "999K", 999_500: "1M", 12_340_000: "12.3M"}
    assert of(spark, stars, text.format_stars(F.col("x")), "long") == list(stars.values())
    assert of(spark, [0, 59, 61, 3599, 3600, 36_061], text.timestamp_label(F.col("x")), "long") == ["0:00", "0:59", "1:01", "59:59", "1:00:00", "10:01:01"]
    assert of(spark, ["<i>x</i> &lt;y&gt;\n z", "<br>", None], text.strip_html(F.col("x"))) == ["x y z", "", None]
    lists = spark.createDataFrame([((["h"], ["e"]),), ((["h"], []),)], "v struct<hu:array<string>,en:array<string>>").select(text.original_list(F.col("v")).alias("r"))
    assert [r.r for r in lists.collect()] == [["e"], ["h"]]


def test_scores(spark):
    """The rules written out."""
    now = dt.datetime(2025, 5, 9, 18)
    rows = [(w, dt.date(2025, 5, d), p) for w in (0.4, 1.0, 3.0) for d in (1, 8, 9, 20) for p in (0, 7, 5000)]

    def rule(w, day, p):
        age = max((now - dt.datetime(day.year, day.month, day.day, 12)).total_seconds() / 86400, 0)
        return 0.45 * min(w / 1.5, 1) + 0.3 * 0.5 ** (age / 2) + 0.25 * min(math.log(1 + p) / math.log(501), 1)

    df = spark.createDataFrame(rows, "w double, d date, p int")
    got = [r.r for r in df.select(scoring.rule_score(F.col("w"), F.col("d"), F.col("p"), F.lit(now)).alias("r")).collect()]
    assert all(abs(a - rule(*r)) < 1e-9 for a, r in zip(got, rows))

    def final(r, v, promo):
        p = (0.7 * v + 0.3 * min(max((r - 0.35) / 0.4, 0), 1)) * (0.3 if promo > 0.6 else 1)
        return min(max(math.floor(100 * p + 0.5), 0), 99)

    cases = [(r, v, m) for r in (0.1, 0.35, 0.6, 0.9) for v in (0.0, 0.31, 0.8, 1.0) for m in (0.0, 0.6, 0.61)]
    df = spark.createDataFrame(cases, "r double, v double, m double")
    assert [int(x.s) for x in df.select(scoring.final_score(F.col("r"), F.col("v"), F.col("m")).alias("s")).collect()] == [final(*c) for c in cases]
    hn = "Hacker News · 7 pts"
    told = [("companies", hn, "GGUF builds for laptops"), ("companies", hn, "A new benchmark paper on arXiv"), ("companies", hn, "Quarterly results"), ("companies", "Some blog", "GGUF builds"), ("local", hn, "A paper")]
    got = [r.c for r in spark.createDataFrame(told, "h string, s string, t string").select(scoring.category_for(F.col("h"), F.col("s"), F.col("t")).alias("c")).collect()]
    assert got[0] == "local" and got[2:] == ["companies", "companies", "local"]
    minutes = [("https://arxiv.org/pdf/1", "local", hn), ("https://w.test", "research", hn), ("https://w.test", "local", hn), ("https://w.test", "local", "Blog"), ("https://w.test", "companies", "Blog")]
    got = [r.m for r in spark.createDataFrame(minutes, "u string, h string, s string").select(scoring.estimate_minutes(F.col("u"), F.col("h"), F.col("s")).alias("m")).collect()]
    assert got == [20, 20, 6, 8, 5]


def test_noise_ends_with_its_own_element():
    """Items and paragraphs that HTML lets stand unclosed don't keep a skipped element open."""
    from gleanery.functions.htmltree import blocks

    of = lambda html: [b["text"] for b in blocks(html)]
    assert of("<nav><ul><li>a<li>b</ul></nav><p>Text</p>") == ["Text"]
    assert of("<footer><p>x<p>y</footer><p>Text</p>") == ["Text"]
    assert of("<div class='ad'><p>x</div><p>Text</p>") == ["Text"]
    assert of("<p class='ad'>Buy<p>Text</p>") == ["Text"]
    assert of("<ul><li class='ad'>Buy<li>One</ul><p>Text</p>") == ["One", "Text"]
    assert of("<div><aside>x</div><p>Text</p>") == ["Text"]
