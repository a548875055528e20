"""From fetched bodies to posts: extractors by kind with fallbacks, errors as columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import once
from ..functions.dates import published_date
from ..functions.text import author_list, collapse, trim_byline
from ..functions.urls import arxiv_id, filename_of, host_of, youtube_id
from . import blocks, stored

LEAST_TEXT, METADATA_BYTES, BODY_BYTES = 200, 2 << 20, 8 << 20
#: What an extractor gives: columns title, author, site, published, text, error.
FIELDS = "title string, author string, site string, published date, text string, error string"
_KIND = f"struct<{FIELDS.replace(', ', ',').replace(' ', ':')}>"


@F.pandas_udf(StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw, name):
        try:
            # browsers read Latin-1 as its Windows superset
            return raw.decode({"iso-8859-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "latin1": "cp1252"}.get(name.lower(), name), "replace")
        except (LookupError, UnicodeError):
            return raw.decode("utf-8", "replace")

    return pd.Series([None if raw is None else one(raw, name) for raw, name in zip(body, charset)])


def body_text(body: Column, content_type: Column, most: int = BODY_BYTES, truncate: bool = False) -> Column:
    """struct(text, error) of a fetched body in the charset that its type names (UTF-8 if it names none or an unknown one; broken letters are replaced). A body of more than ``most`` bytes is an error, or is cut there."""
    charset = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*\"?([\w.:-]+)", 1)
    large = F.octet_length(body) > most
    kept = F.substring(body, 1, most) if truncate else F.when(~large, body)
    text = F.when(F.upper(charset).isin("", "UTF-8", "UTF8"), F.make_valid_utf8(kept.cast("string"))).otherwise(_decoded(kept, charset))
    return F.struct(text.alias("text"), F.when(large & ~F.lit(truncate), F.lit("body too large")).alias("error"))


def json_object(body: Column) -> Column:
    """A body's JSON as a VARIANT if it is an object; null for everything else."""
    v = stored.opened(body)
    return F.when(F.coalesce(stored.form(v).startswith("OBJECT"), F.lit(False)), v)


def is_html(content_type: Column) -> Column:
    """Whether a type, or none at all, means a page."""
    return F.coalesce(content_type, F.lit("")).rlike(r"(?i)^$|^(text/html|application/xhtml\+xml)\s*(;|$)")


def is_latex_page(html: Column) -> Column:
    """Whether a page was made from LaTeX: its classes say so."""
    return F.coalesce(html, F.lit("")).rlike("ltx_page_main|ltx_document")


def _struct(**columns: Column) -> Column:
    kinds = dict(x.split(" ") for x in FIELDS.split(", "))
    return F.struct(*(columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def article(url: Column, html: Column, text: Column) -> Column:
    """A page by its metadata and blocks; the first date that is one; an error under 200 characters."""

    def told(linked: Column) -> Column:
        dated = F.array(blocks.meta(html, "article:published_time"), linked["published"], blocks.meta(html, "date"))
        return F.struct(F.get(F.filter(F.transform(dated, published_date), lambda d: d.isNotNull()), F.lit(0)).alias("published"), F.coalesce(blocks.meta(html, "og:site_name"), linked["site"]).alias("site"))

    found = once(blocks.linked_page(html), told)
    author = trim_byline(F.coalesce(blocks.linked_data(html, "author.name"), blocks.linked_data(html, "author"), blocks.meta(html, "author")))
    return _struct(title=F.coalesce(blocks.page_title(html), url), author=author, site=F.coalesce(found["site"], host_of(url)), published=found["published"], text=text, error=F.when(F.coalesce(F.length(text), F.lit(0)) < LEAST_TEXT, "too little text"))


def arxiv(url: Column, atom: Column) -> Column:
    """A paper by its Atom answer."""
    entry = F.from_xml(F.regexp_replace(F.regexp_extract(atom, r"(?s)<entry[\s>].*?</entry>", 0), r"(?s)<(/?)\w+:\w+[^>]*>", " "), "struct<title:string,summary:string,published:string,author:array<struct<name:string>>>")
    return _struct(title=collapse(entry["title"]), author=author_list(F.transform(entry["author"], lambda a: a["name"])), site=F.lit("arXiv"), published=F.to_date(F.substring(entry["published"], 1, 10)), text=collapse(entry["summary"]), error=F.when(arxiv_id(url).isNull() | entry["title"].isNull(), "no paper"))


def github(url: Column, answer: Column, readme: Column) -> Column:
    """A repository by its JSON answer and its read-me's text, if there is one."""
    repo = F.from_json(answer, "struct<full_name:string,description:string,owner:struct<login:string>>")
    return _struct(title=repo["full_name"], author=repo["owner"]["login"], site=F.lit("GitHub"), text=F.concat_ws("\n\n", repo["description"], readme), error=F.when(repo["full_name"].isNull(), "no repository"))


def x_post(answer: Column) -> Column:
    """A post by its embed answer: its paragraphs, parted where two breaks stand together, and the day that its last link names."""
    post = F.from_json(answer, "struct<author_name:string,html:string>")
    inner = F.array_join(F.regexp_extract_all(post["html"], F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), "<br><br>")
    parts = F.filter(F.transform(F.split(inner, r"(?i)(?:<br\s*/?>\s*){2,}"), lambda x: collapse(blocks.unescape_basic(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), "<[^>]*>", "")))), lambda x: x != "")
    text = F.array_join(parts, "\n\n")
    title = F.concat(F.coalesce(post["author_name"], F.lit("X")), F.lit(": "), F.substring(text, 1, 80), F.when(F.length(text) > 80, "…").otherwise(""))
    last = F.element_at(F.regexp_extract_all(post["html"], F.lit(r"(?is)<a\b[^>]*>([^<]*)</a>\s*</blockquote>"), F.lit(1)), -1)
    day = published_date(F.concat(F.when(F.size(F.regexp_extract_all(post["html"], F.lit(r"(?is)<a\b[^>]*>([^<]*)</a>\s*</blockquote>"), F.lit(1))) > 0, last), F.lit(" UTC")))
    return _struct(title=title, author=post["author_name"], site=F.lit("X"), published=day, text=text, error=F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "unreachable: no post"))


def video_only(url: Column, answer: Column) -> Column:
    """A video by its embed answer, if there is one: its title and who made it."""
    told = F.from_json(answer, "struct<title:string,author_name:string>")
    title = F.coalesce(told["title"], url)
    return _struct(title=title, author=told["author_name"], site=F.lit("YouTube"), text=F.concat_ws(" — ", title, told["author_name"]), error=F.when(youtube_id(url).isNull(), "unreachable: no video"))


def chapters(given: Column) -> Column:
    """Chapters in the order of their seconds; of two at one second the first."""
    return F.filter(F.array_sort(given, lambda a, b: a["seconds"] - b["seconds"]), lambda c: c["seconds"] >= 0)


def metadata_only(url: Column, html: Column) -> Column:
    """What is left when no extractor works: a title from the head of a page, else from its file's name."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, METADATA_BYTES)
    return _struct(title=F.coalesce(blocks.page_title(head), filename_of(url), url), site=host_of(url), text=F.coalesce(blocks.meta(head, "og:description"), blocks.meta(head, "description")))


#: Kinds whose pages hold nothing to read when their own extractor fails, and kinds that can't be had at all when they are unreachable.
NO_ARTICLE, NO_FALLBACK = ("pdf", "youtube", "x"), ("article", "x", "youtube")


def extracted(rows: DataFrame, extractors: dict[str, Column], kind: str = "kind", fallback: Column | None = None) -> DataFrame:
    """rows with ``extracted``: their kind's extractor, else the article's, else the fallback; the first error is kept.

    An error that begins with unreachable leaves articles, posts and videos
    without a fallback; PDFs, posts and videos are never read as articles.
    """
    own = F.lit(None).cast(_KIND)
    for name, column in extractors.items():
        own = F.when(F.col(kind) == name, column).otherwise(own)
    told = rows.withColumn("_own", own)
    failed = ~F.coalesce(F.col("_own").isNotNull() & F.col("_own.error").isNull(), F.lit(False))
    away = F.coalesce(F.col("_own.error").startswith("unreachable") & F.col(kind).isin(*NO_FALLBACK), F.lit(False))
    reads = F.when(failed & ~away & ~F.col(kind).isin(*NO_ARTICLE, "article"), extractors["article"]) if "article" in extractors else F.lit(None).cast(_KIND)
    last = F.lit(None).cast(_KIND) if fallback is None else F.when(failed & ~away, fallback)
    told = told.withColumns({"_article": reads, "_last": last})
    tries = [F.col(c) for c in ("_own", "_article", "_last")]
    found = F.coalesce(*(F.when(c["error"].isNull(), c) for c in tries))
    error = F.when(found.isNull(), F.coalesce(*(c["error"] for c in tries), F.lit("no extractor")))
    return told.withColumns({"extracted": found, "error": error}).drop("_own", "_article", "_last")


def judged(candidates: DataFrame, judge: Callable, schema: str = "pos long, score double, promotion double, category string") -> DataFrame:
    """candidates with a judge's answers by pos. The judge is a ``mapInPandas`` function of batches; it is asked a batch at a time, of its answers on a row the first counts, made-up places and second answers count for nothing, missing ones are null."""

    def asked(batches):
        for batch in batches:
            for told in judge(iter([batch])):
                yield told[told["pos"].isin(batch["pos"])].drop_duplicates("pos")

    answers = candidates.mapInPandas(asked, schema)
    return candidates.join(answers.groupBy("pos").agg(F.first(F.struct("score", "promotion", "category")).alias("answer")), "pos", "left")


def brief_targets(day_items: DataFrame, sources: DataFrame, posts: DataFrame, least: int = 600, most: int = 6000) -> DataFrame:
    """post_id and text of the day's items that have a post of enough text and no brief yet."""
    rows = day_items.join(sources.select("url_key", "source_id"), "url_key").join(posts.where("brief is null"), "source_id")
    return rows.where(F.length("text") >= least).select("post_id", F.substring("text", 1, most).alias("text")).dropDuplicates(["post_id"])


def write_briefs(posts: DataFrame, answers: DataFrame) -> DataFrame:
    """posts with answers (post_id, pos, brief) written in: the first for each, unknown posts none."""
    first = answers.groupBy("post_id").agg(F.min_by("brief", "pos").alias("new"))
    return posts.join(first, "post_id", "left").withColumn("brief", F.coalesce("brief", "new")).drop("new")


def search_text(*parts: Column) -> Column:
    """What search reads of a row: all parts that aren't null, arrays joined."""
    return F.concat_ws(" ", *parts)


def guarded_update(posts: DataFrame, edits: DataFrame, viewer: Column) -> DataFrame:
    """posts with the viewer's edits (post_id, overrides, hidden); an edit of another owner's post raises."""
    rows = posts.join(edits.select("post_id", F.col("overrides").alias("o"), F.col("hidden").alias("h"), F.lit(True).alias("edited")), "post_id", "left")
    refused = F.coalesce(F.col("edited"), F.lit(False)) & (F.col("owner") != viewer)
    mine = F.when(refused, F.raise_error(F.lit("not the owner"))).otherwise(F.col("edited"))
    return rows.withColumn("edited", mine).withColumns({"overrides": F.when(F.col("edited"), F.col("o")).otherwise(F.col("overrides")), "hidden": F.when(F.col("edited"), F.col("h")).otherwise(F.col("hidden"))}).select(posts.columns)


def reuse_images(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Images (url) with the stored path of those that were fetched before."""
    return fresh.join(stored.select("url", "path"), "url", "left")
