"""Feeds and APIs as candidates: url, title, source, snippet, published, hint, points, weight.

Fetched bodies are a column; a body that can't be read gives no candidates, and
``feed_errors`` names it.  What to fetch is a frame of requests; fetching itself
is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import finished_days, published_date
from ..functions.text import strip_html
from ..operators.ranking import ranked

_ITEM = "struct<title:string,link:string,pubDate:string,description:string,date:string>"
_ENTRY = "struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string,content:string>"
SNIPPET, PER_FEED = 400, 25


def _since(rows: DataFrame, since: Column, today: Column, exclude: Column | None) -> DataFrame:
    """Undated rows are today's and stay; older ones, those without a link and excluded ones go."""
    day = published_date(F.col("date"))
    rows = rows.where(F.coalesce("url", F.lit("")).startswith("http")).where(day.isNull() | (day >= since))
    if exclude is not None:
        rows = rows.where(~F.coalesce(F.rlike("title", exclude) | F.rlike("url", exclude), F.lit(False)))
    return rows.withColumn("published", F.coalesce(day, today)).drop("date")


def parse_feeds(bodies: DataFrame, since: Column, today: Column, limit: int = PER_FEED) -> DataFrame:
    """Candidates of RSS and Atom bodies.

    bodies: source, body, hint, weight, exclude (a regex or null) and, if
    sources have limits of their own, limit.  At most ``limit`` of any other
    source, in the feed's order.
    """
    bodies = bodies if "limit" in bodies.columns else bodies.withColumn("limit", F.lit(None).cast("int"))
    tags = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"<(/?)\w+:(date)\b", "<$1$2"), r"(?s)<(/?)\w+:\w+[^>]*>", " ")
    keep = ["source", "hint", "weight", "exclude", "limit"]
    rss = bodies.select(*keep, F.posexplode(tags("item")).alias("pos", "x")).select(*keep, "pos", F.from_xml(bare(F.col("x")), _ITEM).alias("i"))
    rss = rss.select(*keep, "pos", F.trim("i.link").alias("url"), "i.title", F.coalesce("i.pubDate", "i.date").alias("date"), F.col("i.description").alias("raw"))
    atom = bodies.select(*keep, F.posexplode(tags("entry")).alias("pos", "x")).select(*keep, "pos", F.from_xml(bare(F.col("x")), _ENTRY).alias("i"))
    link = F.get(F.filter("i.link", lambda a: ~F.coalesce(a["_rel"], F.lit("alternate")).isin("self", "replies")), F.lit(0))["_href"]
    atom = atom.select(*keep, "pos", link.alias("url"), "i.title", F.coalesce("i.published", "i.updated").alias("date"), F.coalesce("i.summary", "i.content").alias("raw"))
    rows = rss.unionByName(atom).withColumn("title", strip_html(F.col("title"))).withColumn("snippet", F.substring(strip_html(F.coalesce("raw", F.lit(""))), 1, SNIPPET)).drop("raw")
    rows = _since(rows, since, today, F.coalesce("exclude", F.lit("(?!)")))
    own = F.coalesce("limit", F.lit(limit))
    return ranked(rows, ["source"], ["pos"]).where(F.col("rank") <= own).select("url", "title", "source", "snippet", "published", "hint", F.lit(0).alias("points"), "weight")


def feed_errors(bodies: DataFrame) -> DataFrame:
    """source and error of the bodies (source, body) that are no feed: nothing fetched, another kind of page, or one that breaks off."""
    root = F.regexp_extract("body", r"(?is)^\s*(?:<\?xml.*?\?>)?(?:\s|<!--.*?-->|<!DOCTYPE[^>]*>|<\?.*?\?>)*<(rss|feed|rdf:RDF)[\s>]", 1)
    whole = F.rtrim(F.lower("body")).endswith(F.concat(F.lit("</"), F.lower(root), F.lit(">")))
    error = F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "nothing fetched").when(root == "", "no feed").when(~whole, "breaks off")
    return bodies.select("source", error.alias("error")).where("error is not null")


def paper_requests(one: DataFrame, address: str, since: Column, now: Column) -> DataFrame:
    """day and url of the papers' days from since that are over, a day's votes being open while it runs. one: a row that the days are made from."""
    days = one.select(F.explode(finished_days(since, now)).alias("day"))
    return days.select("day", F.concat(F.lit(f"{address}?date="), F.col("day").cast("string")).alias("url"))


def search_requests(queries: DataFrame, address: str, since: Column, points: int = 80) -> DataFrame:
    """query and url of story searches; queries: query, exact. Exact ones allow no typos and look at titles alone."""
    exact = F.when(F.col("exact"), "&typoTolerance=false&restrictSearchableAttributes=title").otherwise("")
    late = F.concat(F.lit("&numericFilters=created_at_i>"), F.unix_seconds(since).cast("string"), F.lit(f",points>{points}"))
    return queries.select("query", F.concat(F.lit(f"{address}?tags=story&query="), F.replace(F.url_encode("query"), F.lit("+"), F.lit("%20")), exact, late).alias("url"))


def repository_requests(topics: DataFrame, address: str, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    """topic and url of searches for a topic's new repositories, those of most stars first."""
    asked = F.concat(F.lit("topic:"), F.col("topic"), F.lit(" created:>"), F.date_sub(F.to_date(now), days).cast("string"))
    return topics.select("topic", F.concat(F.lit(f"{address}?q="), F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20")), F.lit(f"&sort=stars&order=desc&per_page={n}")).alias("url"))


#: Fixed value: how much a story found by search counts.
HN_WEIGHT = 0.8


def parse_hacker_news(bodies: DataFrame, since: Column, today: Column, points: int = 80) -> DataFrame:
    """Candidates of search answers (body: JSON); rows without a link go, the source says the points."""
    hit = "struct<hits:array<struct<url:string,title:string,points:int,created_at:string>>>"
    rows = bodies.select(F.explode(F.from_json("body", hit)["hits"]).alias("h")).select("h.url", "h.title", "h.points", F.col("h.created_at").alias("date"))
    rows = _since(rows.where(F.col("points") > points), since, today, None)
    return rows.select("url", "title", F.format_string("Hacker News · %d pts", "points").alias("source"), F.lit("").alias("snippet"), "published", F.lit("companies").alias("hint"), "points", F.lit(HN_WEIGHT).alias("weight"))


def parse_papers(bodies: DataFrame, n: int = 15, name: str = "Papers") -> DataFrame:
    """The n papers with most votes over all days' answers (day, body), dated by the day that was asked for; of equal votes the earlier day and place first."""
    paper = "array<struct<title:string,summary:string,paper:struct<id:string,upvotes:int>>>"
    rows = bodies.select("day", F.posexplode(F.from_json("body", paper)).alias("pos", "p")).where(F.col("p.paper.id").rlike(r"^\d{4}\.\d{4,5}$"))
    rows = rows.select("day", "pos", "p.title", "p.summary", "p.paper.id", F.coalesce("p.paper.upvotes", F.lit(0)).alias("upvotes")).orderBy(F.desc("upvotes"), "day", "pos").limit(n)
    snippet = F.substring(strip_html(F.coalesce("summary", F.lit(""))), 1, SNIPPET)
    return rows.select(F.concat(F.lit("https://arxiv.org/abs/"), "id").alias("url"), "title", F.format_string(f"{name} · %d upvotes", "upvotes").alias("source"), snippet.alias("snippet"), F.col("day").alias("published"), F.lit("research").alias("hint"), F.col("upvotes").alias("points"), F.lit(1.0).alias("weight"))


def parse_repositories(bodies: DataFrame, n: int = 25, of_topic: int = 10, since: Column | None = None) -> DataFrame:
    """repo, focus, url, stars, language: the n of most stars over the first ``of_topic`` of each answer (pos, body), made after since; of one named twice the last answer counts."""
    item = "struct<items:array<struct<full_name:string,description:string,html_url:string,stargazers_count:int,language:string,created_at:string>>>"
    rows = bodies.select("pos", F.posexplode(F.slice(F.from_json("body", item)["items"], 1, of_topic)).alias("i", "r")).select("pos", "i", "r.*")
    if since is not None:
        rows = rows.where(F.to_date(F.substring("created_at", 1, 10)) > F.to_date(since))
    last = rows.groupBy("full_name").agg(F.max_by(F.struct("description", "html_url", "stargazers_count", "language"), F.struct("pos", "i")).alias("r")).select("full_name", "r.*")
    return last.orderBy(F.desc("stargazers_count"), "full_name").limit(n).select(F.col("full_name").alias("repo"), F.substring(F.coalesce("description", F.lit("")), 1, 90).alias("focus"), F.col("html_url").alias("url"), F.col("stargazers_count").alias("stars"), "language")
