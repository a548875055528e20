"""Queries of what readers are shown beside the lists, and of feeds' answers that Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import queue, ranking, serve, stored
from ..sources import feeds
from ..sources.tables import table
from .catalog import query


@query(
    r"""with r as (select l_orderkey, l_linenumber, case when l_linenumber % 4 > 0 then l_returnflag end lang, case when l_linenumber % 3 > 0 then (l_quantity * 9)::bigint end stars, case when l_linenumber % 2 = 0 then l_suppkey % 100 end score, l_shipdate::date a, l_shipdate::date + (l_partkey % 40)::int b from lineitem)
    select l_orderkey, l_linenumber, coalesce(lang, '—') || ' · ★ ' || coalesce(stars::varchar, '—') || ' · ' || coalesce(score || '/100', '—') line, strftime(a, 'W%V') || case when strftime(a, '%G-%V') = strftime(b, '%G-%V') then '' else '–' || strftime(b, 'W%V') end span,
        strftime(a + (7 - isodow(a))::int, '%m. %d.') sunday from r"""
)
def repository_lines(spark, d):
    """The line under a repository's name, the weeks that it was listed and the Sunday of the first."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 40).cast("int")).alias("b"))
    line = text.repo_line(F.when(F.col("l_linenumber") % 4 > 0, F.col("l_returnflag")), F.when(F.col("l_linenumber") % 3 > 0, (F.col("l_quantity") * 9).cast("long")), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 100))
    first, last = dates.iso_week(F.col("a")), dates.iso_week(F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", line.alias("line"), text.week_span(first, last).alias("span"), dates.archive_label(dates.iso_week_monday(first)).alias("sunday"))


_LINK = "case event_id % 8 when 0 then 'https://www.youtube.com/embed/' || {0} when 1 then 'https://youtu.be/' || {0} || '?t=3' when 2 then 'https://m.youtube.com/watch?list=x&v=' || {0} when 3 then 'https://player.vimeo.com/video/' || event_id || '?h=1' when 4 then 'https://vimeo.com/' || event_id when 5 then 'https://www.youtube.com/embed/videoseries?list=x' when 6 then 'https://youtube-nocookie.com/live/' || {0} || 'x' else 'https://youtube.com/shorts/' || {0} end"
_TUBE = "lpad(cast(event_id as {0}), 11, 'aB_-')"


@query(f"select event_id, case when event_id % 8 in (0, 1, 2, 7) then 'youtube' when event_id % 8 = 3 then 'vimeo' end provider, case when event_id % 8 in (0, 1, 2, 7) then {_TUBE.format('varchar')} when event_id % 8 = 3 then event_id::varchar end video_id from events")
def video_links(spark, d):
    """Links of videos in their forms, of lists and of other pages."""
    rows = table(spark, d, "events").selectExpr("event_id", f"{_LINK.format(_TUBE.format('string'))} as url")
    return rows.select("event_id", urls.video_of(F.col("url")).alias("v")).select("event_id", "v.provider", "v.video_id")


@query(
    """with r as (select o_orderkey, case o_orderkey % 5 when 0 then 2 when 1 then 1 when 2 then -1 end rating, o_orderpriority language from orders)
    select 'heart' name, count(*) n from r where rating = 2 union all select 'up', count(*) from r where rating = 1 union all select 'down', count(*) from r where rating = -1 union all select 'none', count(*) from r where rating is null
    union all select 'other', count(*) from r union all select 'urgent up', count(*) from r where rating = 1 and language = '1-URGENT'"""
)
def narrowed_lists(spark, d):
    """How long the list of repositories is under each filter."""
    rating = F.when(F.col("o_orderkey") % 5 == 0, 2).when(F.col("o_orderkey") % 5 == 1, 1).when(F.col("o_orderkey") % 5 == 2, -1)
    rows = table(spark, d, "orders").select(rating.alias("rating"), F.col("o_orderpriority").alias("language"))
    asked = {"heart": ("heart", None), "up": ("up", None), "down": ("down", None), "none": ("none", None), "other": ("odd", ""), "urgent up": ("up", "1-URGENT")}
    counts = [serve.narrowed(rows, *how).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, how in asked.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query(
    """with s as (select o_orderkey source_id, 'https://www.news.test/' || o_custkey || '/?utm_source=x' url, case when o_orderkey % 3 = 0 then 'done' else 'failed' end status, o_orderkey % 5 attempts, case when o_orderkey % 4 = 0 then o_orderkey * 10 end post_id from orders),
    f as (select url, min(source_id) source_id from s group by url)
    select c_custkey id, case when post_id is not null then 'post' when status <> 'done' and attempts < 3 then 'pending' else 'unavailable' end state, post_id from customer join f on f.url = 'https://www.news.test/' || c_custkey || '/?utm_source=x' join s using (source_id)"""
)
def read_here(spark, d):
    """Items whose link has a source, in any spelling, with the state of its copy."""
    orders = table(spark, d, "orders")
    sources = orders.selectExpr("o_orderkey as source_id", "concat('https://www.news.test/', o_custkey, '/?utm_source=x') as url", "case when o_orderkey % 3 = 0 then 'done' else 'failed' end as status", "o_orderkey % 5 as attempts")
    posts = orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey as source_id", "o_orderkey * 10 as post_id")
    items = table(spark, d, "customer").selectExpr("c_custkey as id", "concat('https://news.test/', c_custkey, '#top') as url")
    return queue.read_here(items, sources, posts).select("id", "copy.state", "copy.post_id")


#: What a model wrote about a document, sometimes out of its form.
_WRITTEN = """concat('{{"title":"T', doc_id, '","summary":', case when doc_id % 7 = 0 then 'null' else '"S"' end, ',"keyPoints":[', case when doc_id % 5 = 0 then '"a","b","c","d","e","f","g","h","i"' else '"a","b"' end, '],"tags":[', case doc_id % 4 when 0 then '"agents","rag"' when 1 then '' when 2 then '"agents","odd"' else '"agents","rag","evals","vision","agents"' end,
    '],"brief":[', case when doc_id % 6 = 5 then '1' else '"p"' end, '],"sections":[{{"heading":"H","points":["x","y"]}},{{"heading":"I', doc_id, '","points":[', case when doc_id % 3 = 0 then '5' else '' end, ']}}]}}')""".format()


@query(
    """select doc_id, case when doc_id % 7 > 0 and doc_id % 5 > 0 and doc_id % 4 < 2 and doc_id % 6 < 5 then 'T' || doc_id || ':' || case doc_id % 4 when 0 then 'agents,rag' else '' end end generated,
    case when doc_id % 3 > 0 then 'heading H|list x;y|heading I' || doc_id || '|list ' end notes from documents"""
)
def model_texts(spark, d):
    """A model's answers as posts store them; those that are out of form give nothing."""
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_WRITTEN} as raw").select("doc_id", stored.read_generated(F.col("raw")).alias("g"), stored.read_notes(F.col("raw")).alias("n"))
    said = lambda b: F.concat_ws(" ", b["type"], F.coalesce(b["text"], F.array_join(F.transform(b["items"], stored.spans_text), ";")))
    made = F.when(F.col("g").isNotNull(), F.concat(F.col("g.title.hu"), F.lit(":"), F.array_join("g.tags", ",")))
    return rows.select("doc_id", made.alias("generated"), F.array_join(F.transform("n", said), "|").alias("notes"))


@query(
    """with r as (select p_brand topic, p_partkey, p_name, (p_retailprice * 10)::int stars, row_number() over (partition by p_brand order by (p_retailprice * 10)::int desc, p_partkey) i, p_partkey % 9 = 0 old from part),
    kept as (select *, row_number() over (partition by 'own/' || p_partkey % 300 order by topic desc, i desc) k from r where i <= 10 and not old)
    select 'own/' || p_partkey % 300 repo, left(p_name, 90) focus, stars from kept where k = 1 order by stars desc, repo limit 25"""
)
def topic_repositories(spark, d):
    """Answers of repository searches, a topic each: ten of a topic, new ones, the last of a name, the 25 of most stars."""
    part = table(spark, d, "part").withColumn("stars", (F.col("p_retailprice") * 10).cast("int"))
    old = F.col("p_partkey") % 9 == 0
    part = ranking.top(part, ["p_brand"], [F.desc("stars"), "p_partkey"], 12)  # a page of an answer
    made = F.struct(F.concat(F.lit("own/"), F.col("p_partkey") % 300).alias("full_name"), F.col("p_name").alias("description"), F.lit("u").alias("html_url"), F.col("stars").alias("stargazers_count"), F.when(old, "2026-01-01T00:00:00Z").otherwise("2026-01-05T00:00:00Z").alias("created_at"))
    listed = part.select("p_brand", F.struct((-F.col("stars")).alias("s"), "p_partkey", made.alias("item")).alias("x"))
    bodies = listed.groupBy(F.col("p_brand").alias("pos")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))).alias("body"))
    return feeds.parse_repositories(bodies, since=F.lit("2026-01-02")).select("repo", "focus", "stars")
