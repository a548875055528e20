"""Queries of the service's writes, guards and answers that the lists don't show: each rule over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, scoring, text, urls
from ..operators import ingest, publish, queue, reading, serve, state
from ..sources import feeds
from ..sources.tables import overwrite_partitions, shared, table
from . import api
from .catalog import query


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'new' when o_orderkey % 5 > 0 then 'old' end v from orders where o_orderkey % 3 = 0 or o_orderkey % 5 > 0")
def upserted_rows(spark, d):
    orders = table(spark, d, "orders")
    made = lambda rule, v: orders.where(rule).select(F.col("o_orderkey").alias("id"), F.lit(v).alias("v"))
    return publish.upsert(made("o_orderkey % 5 > 0", "old"), made("o_orderkey % 3 = 0", "new"), ["id"])


@query(
    """with r as (select strftime(o_orderdate, '%Y-%m') as day, month(o_orderdate) % 2 = 0 and o_orderkey % 2 = 0 again from orders), h as (select distinct day from r where again)
    select day, case when day in (from h) then 'second' else 'first' end list, count(*) n from r where again or day not in (from h) group by all"""
)
def overwritten_lists(spark, d):
    """Lists of months written, then those of even months once more and shorter: their old rows are gone, other months stay."""
    path = f"{shared(spark)}/lists-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderkey").alias("id"))
    even = (F.substring("day", 6, 2).cast("int") % 2 == 0) & (F.col("id") % 2 == 0)
    overwrite_partitions(rows.withColumn("list", F.lit("first")).repartition("day"), path, "day")
    overwrite_partitions(rows.where(even).withColumn("list", F.lit("second")).repartition("day"), path, "day")
    return spark.read.schema("id long, list string, day string").parquet(path).groupBy("day", "list").agg(F.count("*").alias("n"))


_QUEUE = "o_orderkey id, case o_orderkey % 3 when 0 then 'done' when 1 then 'failed' else 'pending' end status, (o_orderkey % 4)::int attempts, o_custkey % 2 as owner"


def _queue(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 3 when 0 then 'done' when 1 then 'failed' else 'pending' end as status", "cast(o_orderkey % 4 as int) as attempts", "o_custkey % 2 as owner")


@query(f"select id, case when id % 2 = 0 and owner = 1 and status = 'failed' then 'pending' else status end status, case when id % 2 = 0 and owner = 1 and status = 'failed' then 0 else attempts end attempts from (select {_QUEUE} from orders)")
def retried_sources(spark, d):
    rows = _queue(spark, d)
    return queue.retry(rows, rows.where("id % 2 = 0").select("id"), F.lit(1)).select("id", "status", "attempts")


@query(f"select id, case when id % 5 = 0 then status when id % 5 < 3 then 'done' when id % 2 = 0 then status else 'failed' end status, case when id % 5 > 2 then 500 end cut from (select {_QUEUE} from orders)")
def finished_sources(spark, d):
    """Results of runs: none, good ones, and errors of rows with and without a post."""
    rows = _queue(spark, d)
    results = rows.where("id % 5 > 0").select("id", F.when(F.col("id") % 5 > 2, F.repeat(F.lit("e"), F.lit(600))).alias("error"), (F.col("id") % 2 == 0).alias("has_post"))
    return queue.finish(rows, results).select("id", "status", F.length("last_error").alias("cut"))


@query(
    """with a as (select l_orderkey post_id, l_linenumber * 1000000 + l_partkey pos, 'b' || l_partkey brief from lineitem where l_linenumber > 1), f as (select post_id, arg_min(brief, pos) brief from a group by 1)
    select o_orderkey post_id, case when o_orderkey % 4 = 0 then 'own' else f.brief end brief from orders left join f on post_id = o_orderkey"""
)
def written_briefs(spark, d):
    """The first answer for each post; one that has a brief keeps it."""
    posts = table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.when(F.col("o_orderkey") % 4 == 0, "own").alias("brief"))
    answers = table(spark, d, "lineitem").where("l_linenumber > 1").selectExpr("l_orderkey as post_id", "l_linenumber * 1000000 + l_partkey as pos", "concat('b', l_partkey) as brief")
    return ingest.write_briefs(posts, answers)


@query("select doc_id post_id, case when doc_id % 3 = 1 then 'o' || doc_id else 'old' end overrides, doc_id % 3 = 1 hidden from documents")
def guarded_edits(spark, d):
    """An owner's edits of their own posts."""
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), (F.col("doc_id") % 3).alias("owner"), F.lit("old").alias("overrides"), F.array().cast("array<string>").alias("hidden"))
    edits = posts.where("owner = 1").select("post_id", F.concat(F.lit("o"), "post_id").alias("overrides"), F.array(F.lit("b")).alias("hidden"))
    return ingest.guarded_update(posts, edits, F.lit(1)).select("post_id", "overrides", (F.size("hidden") > 0).alias("hidden"))


@query(
    """with r as (select event_id, case when event_id % 7 > 0 then value / 20 - 0.5 end score, case when event_id % 5 > 0 then value / 100 end promo, case event_id % 4 when 0 then 'github' when 1 then 'local' when 2 then 'research' end category from events),
    g as (select *, score is not null and promo is not null and category in ('local', 'research') good from r)
    select event_id, case when good then round(least(greatest(score / 4, 0), 1), 6) end relevance, case when good then round(promo, 6) end promotion, coalesce(case when good then promo end, 0) <= 0.6 and event_id % 100 >= 35 publishable from g"""
)
def judged_events(spark, d):
    """A model's answers: those that make sense, in their bounds, and what may be published."""
    category = F.when(F.col("event_id") % 4 == 0, "github").when(F.col("event_id") % 4 == 1, "local").when(F.col("event_id") % 4 == 2, "research")
    j = scoring.judgement(F.when(F.col("event_id") % 7 > 0, F.col("value") / 20 - 0.5), F.when(F.col("event_id") % 5 > 0, F.col("value") / 100), category)
    return table(spark, d, "events").select("event_id", F.round(j["relevance"], 6).alias("relevance"), F.round(j["promotion"], 6).alias("promotion"), scoring.publishable(F.col("event_id") % 100, j["promotion"]).alias("publishable"))


@query(
    """with o as (select l_orderkey, list('Name ' || l_partkey order by l_linenumber, l_partkey) a from lineitem group by 1), t as (select *, array_to_string(a, ', ') || repeat(', Another Name', (l_orderkey % 12)::int) t from o)
    select l_orderkey, array_to_string(a[1:3], ', ') || case when len(a) > 3 then ' et al.' else '' end authors, case when length(t) <= 120 then t when contains(left(t, 120), ',') then regexp_replace(left(t, 120), ',[^,]*$', '') else left(t, 120) end byline from t"""
)
def bylines(spark, d):
    """Authors of orders: three and others, and a line that is cut at a comma."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat(F.lit("Name "), "l_partkey").alias("n")))).alias("a"))
    rows = own.select("l_orderkey", F.transform("a", lambda x: x["n"]).alias("a"))
    whole = F.concat(F.array_join("a", ", "), F.repeat(F.lit(", Another Name"), (F.col("l_orderkey") % 12).cast("int")))
    return rows.select("l_orderkey", text.author_list(F.col("a")).alias("authors"), text.trim_byline(whole).alias("byline"))


@query("select event_id, case when s >= 3600 then s // 3600 || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0') label, case when event_id % 3 = 0 and event_id > 0 then event_id end id from (select event_id, event_id * 37 % 20000 s from events)")
def time_labels(spark, d):
    """Seconds as h:mm:ss, and ids that are whole numbers from 1 on."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("0"), "event_id")).otherwise(F.concat("event_id", F.lit("x")))
    return table(spark, d, "events").select("event_id", text.timestamp_label(F.col("event_id") * 37 % 20000).alias("label"), urls.parse_id(raw).alias("id"))


@query("select p_partkey, 'https://w.test/' || p_partkey || case p_partkey % 4 when 1 then '_(x)' else '' end url, case p_partkey % 4 when 0 then 'see this' when 1 then 'look: now' when 2 then '' else 'and more text' end note from part")
def message_links(spark, d):
    """Links in messages: signs after them go, a bracket stays if the link opened it."""
    said = F.expr("case p_partkey % 4 when 0 then concat('see https://w.test/', p_partkey, '. this') when 1 then concat('look: https://w.test/', p_partkey, '_(x), now') when 2 then concat('https://w.test/', p_partkey, ')!') else concat('  and https://w.test/', p_partkey, ' more   text ') end")
    found = urls.message_link(said)
    return table(spark, d, "part").select("p_partkey", found["url"].alias("url"), F.coalesce(found["note"], F.lit("")).alias("note"))


@query(
    """select p_partkey, case p_partkey % 5 when 0 then 'https://raw.githubusercontent.com/Own/R' || p_partkey || '/main/a/b.png' when 1 then 'https://raw.githubusercontent.com/Own/R' || p_partkey || '/dev/d/a.png' when 2 then 'https://raw.githubusercontent.com/Own/R' || p_partkey || '/main/other/r/x.png' end url from part"""
)
def readme_images(spark, d):
    """Rooted links of pictures in read-mes."""
    link = F.expr("case p_partkey % 5 when 0 then '/a/b.png' when 1 then concat('/own/r', p_partkey, '/blob/dev/d/a.png') when 2 then '/other/r/x.png' when 3 then '//cdn.test/x.png' else 'x.png' end")
    return table(spark, d, "part").select("p_partkey", reading.repository_image(link, F.concat(F.lit("Own/R"), "p_partkey"), F.lit("main")).alias("url"))


@query(
    """with r as (select event_id, ts, (ts at time zone 'UTC' at time zone 'Europe/Budapest') l, timestamp '2024-01-20 17:30:00' now from events)
    select event_id, greatest(0, 600 - (epoch(now) - epoch(date_trunc('second', ts))))::bigint wait, case when ts::date < now::date then datediff('day', ts::date, now::date) else 0 end::int finished, l::date = date '2024-01-20' today, l::date <> date '2024-01-20' late from r"""
)
def clocks(spark, d):
    """Seconds to wait, days that are over and whether a list is today's or late, at a moment after six in Budapest."""
    now = F.lit("2024-01-20 17:30:00").cast("timestamp")
    fresh = dates.stale(dates.budapest_day(F.col("ts")), now)
    return table(spark, d, "events").select("event_id", dates.cooldown_seconds(F.date_trunc("second", "ts"), now).alias("wait"), F.size(dates.finished_days(F.col("ts"), now)).alias("finished"), fresh["today"].alias("today"), fresh["late"].alias("late"))


@query("select user_id, event_id post_id, 'repo:own/r' || event_id rating_key from events where event_type = 'view' and event_id % 4 = 0 and event_id > 0")
def opened_posts(spark, d):
    """Posts that readers have opened, by the keys of their flags."""
    key = F.expr("case event_id % 4 when 0 then concat('post:', event_id) when 1 then concat('post:0', event_id) when 2 then concat('item-', event_id) else 'post:' end")
    rows = table(spark, d, "events").select("user_id", key.alias("item_id"), (F.col("event_type") == "view").alias("is_read"))
    return state.read_post_ids(rows).select("user_id", "post_id", state.rating_key(F.lit("repo"), F.concat(F.lit("Own/R"), "post_id")).alias("rating_key"))


@query("select page_id, url, case when page_id % 3 = 0 then page_id || '/x' end path from pages")
def reused_images(spark, d):
    fresh = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    stored = fresh.where("page_id % 3 = 0").select("url", F.concat("page_id", F.lit("/x")).alias("path"))
    return ingest.reuse_images(fresh, stored).select("page_id", F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "path")


@query("select doc_id, case when doc_id % 4 = 1 then 'mine' else 'made ' || doc_id end title, case when doc_id % 3 = 0 then 'a,c' else 'a,b,c' end reader, 'a,b,c' editor from documents")
def shown_posts(spark, d):
    """Titles that a submitter wrote, unless they are blank, and the blocks that a reader and an editor see."""
    block = lambda *ids: F.array(*(F.struct(F.lit(i).alias("id")) for i in ids))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 1, "mine").when(F.col("doc_id") % 4 == 2, "  ").alias("own"), F.concat(F.lit("made "), "doc_id").alias("made"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("b"))).alias("hidden"), block("a", "b", "c").alias("blocks"))
    seen = lambda **how: F.array_join(F.transform(serve.visible(F.col("blocks"), F.col("hidden"), **how), lambda b: b["id"]), ",")
    return rows.select("doc_id", serve.override(F.col("own"), F.col("made")).alias("title"), seen().alias("reader"), seen(editing=True).alias("editor"))


@query(
    """with i as (select strftime(o_orderdate, '%G-W%V') issue_id, o_orderkey id, o_totalprice score, o_orderkey % 30 + 1 read_minutes from orders)
    select issue_id, count(*) items, sum(read_minutes)::bigint as minutes, arg_min('Story ' || id, (-score, id)) top_title from i where issue_id <> (select max(issue_id) from i) group by 1"""
)
def past_archive(spark, d):
    """All weeks but the current one."""
    rows = table(spark, d, "orders").select(dates.iso_week(F.to_date("o_orderdate")).alias("issue_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("Story "), "o_orderkey").alias("title"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 30 + 1).alias("read_minutes"))
    return api.get_archive(rows.select("issue_id").distinct(), rows, rows.agg(F.max("issue_id")).head()[0])


@query(
    """with l as (select event_id id, case event_id % 4 when 0 then 'https://www.n.test/' || event_id // 8 || '/' when 1 then 'https://n.test/' || event_id // 8 || '?utm_id=1' when 2 then 'http://localhost/' || event_id else 'https://arxiv.org/pdf/2401.' || lpad((event_id // 8 % 100000)::varchar, 5, '0') end url, user_id as owner from events),
    k as (select id, case when id % 4 < 2 then 'https://n.test/' || id // 8 when id % 4 = 3 then 'https://arxiv.org/abs/2401.' || lpad((id // 8 % 100000)::varchar, 5, '0') end key from l)
    select id, key url_key, case id % 4 when 3 then 'arxiv' else 'article' end kind from k where key is not null and (id // 8) % 5 > 0 qualify row_number() over (partition by key order by id) = 1"""
)
def added_sources(spark, d):
    """Submitted links that are new: not stored yet, the first of each page, public ones."""
    url = F.expr("case event_id % 4 when 0 then concat('https://www.n.test/', event_id div 8, '/') when 1 then concat('https://n.test/', event_id div 8, '?utm_id=1') when 2 then concat('http://localhost/', event_id) else concat('https://arxiv.org/pdf/2401.', lpad(cast(event_id div 8 % 100000 as string), 5, '0')) end")
    links = table(spark, d, "events").select(F.col("event_id").alias("id"), url.alias("url"), F.col("user_id").alias("owner"))
    there = table(spark, d, "events").where("(event_id div 8) % 5 = 0").select(urls.url_key(url).alias("url_key")).distinct()
    return api.post_sources(there, links, F.lit("2026-01-01").cast("timestamp"))[0].select("id", "url_key", "kind")


@query(
    """with r as (select doc_id, source || '/' || doc_id // 200 source, doc_id pos from documents), k as (select source, doc_id, pos, doc_id % 7 as age, 'D' || doc_id || case when doc_id % 11 = 0 then ' Promo' else '' end title from r),
    f as (select * from k where doc_id % 5 > 0 and age <= 4 and not contains(title, 'Promo') qualify row_number() over (partition by source order by pos) <= 25)
    select 'https://f.test/' || doc_id url, title, source, case when doc_id % 3 = 0 then date '2026-03-10' else date '2026-03-10' - age::int end published from f"""
)
def feed_items(spark, d):
    """RSS feeds of sources, made of 200 documents' numbers each: undated items count as today's, old, excluded and linkless ones go, 25 of a feed."""
    item = F.expr("concat('<item><title>D', doc_id, case when doc_id % 11 = 0 then ' &lt;b&gt;Promo&lt;/b&gt;' else '' end, '</title>', case when doc_id % 5 > 0 then concat('<link>https://f.test/', doc_id, '</link>') else '' end, case when doc_id % 3 = 0 and doc_id % 7 <= 4 then '' else concat('<pubDate>', date_format(date_sub(date'2026-03-10', cast(doc_id % 7 as int)), 'd MMM yyyy'), ' 10:00:00 GMT</pubDate>') end, '</item>')")
    rows = table(spark, d, "documents").groupBy(F.concat_ws("/", "source", F.expr("doc_id div 200")).alias("source")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("i"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("i", lambda x: x["x"]), ""), F.lit("</channel></rss>"))
    bodies = rows.select("source", body.alias("body"), F.lit("local").alias("hint"), F.lit(1.0).alias("weight"), F.lit("Promo").alias("exclude"))
    day = lambda x: F.lit(x).cast("date")
    return feeds.parse_feeds(bodies, day("2026-03-06"), day("2026-03-10")).select("url", "title", "source", "published")


@query("select 'https://h.test/' || event_id url, 'T' || event_id title, 'Hacker News · ' || floor(value * 2)::int || ' pts' source, ts::date published from (select *, value from events) where event_id % 4 > 0 and floor(value * 2)::int > 80 and ts::date >= date '2024-01-10'")
def story_items(spark, d):
    """Stories of search answers: with a link, enough points and not too old."""
    hit = F.struct(F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("https://h.test/"), "event_id")).alias("url"), F.concat(F.lit("T"), "event_id").alias("title"), F.floor(F.col("value") * 2).cast("int").alias("points"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    bodies = table(spark, d, "events").select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("body"))
    day = lambda x: F.lit(x).cast("date")
    return feeds.parse_hacker_news(bodies, day("2024-01-10"), day("2024-03-10")).select("url", "title", "source", "published")
