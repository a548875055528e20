"""Typed blocks of pages: conversion, noise, repeats, ids, clipping."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import htmltree
from ..functions.text import collapse, fnv1a, let
from . import stored

_TEXT = T.StringType()
#: A run of text under the same marks; a null mark is none.
SPAN = T.StructType([T.StructField("text", _TEXT), T.StructField("href", _TEXT), *(T.StructField(k, T.BooleanType()) for k in ("bold", "italic", "code"))])
_FIELDS = (
    ("type", _TEXT), ("text", _TEXT), ("identity", _TEXT), ("level", T.IntegerType()), ("language", _TEXT), ("ordered", T.BooleanType()), ("url", _TEXT), ("alt", _TEXT),
    ("caption", _TEXT), ("cite", _TEXT), ("provider", _TEXT), ("video_id", _TEXT), ("content", T.ArrayType(SPAN)), ("items", T.ArrayType(T.ArrayType(SPAN))),
)
BLOCK = T.StructType([T.StructField(k, t) for k, t in _FIELDS])
MOST_BLOCKS, MOST_CHARS = 400, 200_000
# fixed values
SHARE_LINK = r"(?i)(twitter\.com/intent|x\.com/intent|facebook\.com/sharer|linkedin\.com/share|reddit\.com/submit|news\.ycombinator\.com/submitlink|t\.me/share|wa\.me/)"
BOILERPLATE_PHRASE = r"(?i)\b(subscribe to (our|the) newsletter|sign up for (our|the) newsletter|share this (post|article)|follow us|you might also like)\b"
BOILERPLATE_EXACT = r"(?i)^(advertisement|sponsored|related (posts|articles|stories)|hírlevél|kapcsolódó cikkek|hirdetés)$"
BOILERPLATE_PREFIX = r"(?i)^(iratkozz fel|oszd meg)\b"
ICON_FILENAME = r"(?i)(^|[-_.])(icon|logo|emoji|badge|sprite|spacer)s?([-_.]|$)"
BADGE_HOST = r"(?i)(^|\.)img\.shields\.io$"
AVATAR_HOST = r"(?i)((^|\.)gravatar\.com$)|(avatars\d*\.githubusercontent\.com$)"


#: Bytes of markup that are read into blocks at once; what a worker holds doesn't grow with a batch's rows.
AT_ONCE = 2 << 20
_LIST = to_arrow_type(T.ArrayType(BLOCK))


def _pieces(size: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about AT_ONCE together, one row at least."""
    first = have = 0
    for i, n in enumerate(size.to_pylist()):
        if i > first and have + (n or 0) > AT_ONCE:
            yield first, i
            first, have = i, 0
        have += n or 0
    yield first, len(size)


@F.arrow_udf(T.ArrayType(BLOCK))
def image_blocks(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Blocks of pages from their markup and address; the third is the address that pictures are relative to, a page's own if it is null."""
    for html, page, images in batches:
        for a, b in _pieces(pc.binary_length(html)):
            rows = zip(*(x.slice(a, b - a).to_pylist() for x in (html, page, images)))
            yield pa.array([htmltree.blocks(*row) for row in rows], _LIST)


def html_blocks(html: Column | str, page: Column | str) -> Column:
    return image_blocks(html, page, F.lit(None).cast("string"))


def readme_blocks(html: Column, repository: Column, branch: Column) -> Column:
    """Blocks of a repository's read-me: links lead to its files, pictures to their raw contents, wherever the read-me has them from."""
    place = F.concat_ws("/", repository, F.lit("blob"), branch, F.lit(""))
    raw = F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), repository, branch, F.lit(""))
    found = image_blocks(html, F.concat(F.lit("https://github.com/"), place), raw)
    fixed = lambda url: F.regexp_replace(F.regexp_replace(url, r"^https://raw\.githubusercontent\.com/([^/]+/[^/]+)/(?:blob|raw)/", "https://raw.githubusercontent.com/$1/"), r"^https://github\.com/([^/]+/[^/]+)/(?:blob|raw)/", "https://raw.githubusercontent.com/$1/")
    return F.transform(found, lambda b: b.withField("url", F.when(b["type"] == "image", fixed(b["url"])).otherwise(b["url"])))


@F.pandas_udf(_TEXT)
def unescape(text: pd.Series) -> pd.Series:
    """Character references as what they stand for; Spark has no function for them."""
    return text.map(lambda x: None if x is None else entities.unescape(x))


def unescape_basic(text: Column) -> Column:
    """The five references that every page may use, as what they stand for."""
    for mark, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(letter))
    return text


def closed_references(html: Column | str) -> Column:
    """Markup in which only the five references that every page may use, closed by a semicolon, are any; every other ampersand stands for itself."""
    return F.regexp_replace(html, "&(?!(?:lt|gt|quot|#x27|amp);)", "&amp;")


def meta(html: Column, name: str) -> Column:
    """A meta tag's content, by name or property."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def page_title(html: Column) -> Column:
    """og:title, else the title element's text, with character references decoded; null if blank."""
    return F.nullif(collapse(unescape(F.coalesce(meta(html, "og:title"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))), F.lit(""))


def noarchive(html: Column, header: Column | None = None) -> Column:
    """Whether the page, or its header, asks not to be kept."""
    said = F.coalesce(meta(html, "robots").rlike("(?i)noarchive"), F.lit(False))
    return said if header is None else said | F.coalesce(header.rlike("(?i)noarchive"), F.lit(False))


def linked_nodes(html: Column) -> Column:
    """Arrays of VARIANT nodes, one for each JSON-LD script: those of an array, of a graph, or the script itself; a broken script has none."""
    kind = r"application/ld\+json"
    scripts = F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*\btype\s*=\s*(?:\"\s*{kind}\s*(?:;[^\"]*)?\"|'\s*{kind}\s*(?:;[^']*)?'|{kind}(?=[\s>;]))[^>]*>(.*?)</script>"), F.lit(1))

    def nodes(v: Column) -> Column:
        listed = F.coalesce(stored.elements(v), stored.elements(v, "$['@graph']"), F.array(v))
        return F.filter(listed, lambda n: F.coalesce(stored.form(n).startswith("OBJECT"), F.lit(False)))

    return F.coalesce(F.transform(scripts, lambda s: nodes(stored.opened(s))), F.array().cast("array<array<variant>>"))


def _text_at(node: Column, path: str) -> Column:
    return F.when(stored.is_text(node, path), stored.at(node, path, "string"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def linked_page(html: Column) -> Column:
    """struct(published, site): of every script the first node that carries a date or a publisher's name, of these the first value of each field."""
    own = lambda n: F.struct(_text_at(n, "$.datePublished").alias("published"), _text_at(n, "$.publisher.name").alias("site"))
    chosen = F.transform(linked_nodes(html), lambda nodes: F.get(F.filter(F.transform(nodes, own), lambda x: x["published"].isNotNull() | x["site"].isNotNull()), F.lit(0)))
    return F.struct(_first(F.transform(chosen, lambda x: x["published"])).alias("published"), _first(F.transform(chosen, lambda x: x["site"])).alias("site"))


def linked_data(html: Column, field: str) -> Column:
    """The first text at a path of any node, over all scripts in order."""
    return _first(F.transform(F.flatten(linked_nodes(html)), lambda n: _text_at(n, f"$.{field}")))


def is_icon(url: Column) -> Column:
    """Badges, avatars, and icons by the name of their file alone."""
    host = F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^(?:https?://[^/?#]+)?([^?#]*)", 1)
    return host.rlike(BADGE_HOST) | F.array_contains(F.split(path, "/"), "badge") | host.rlike(AVATAR_HOST) | F.regexp_extract(path, "([^/]*)$", 1).rlike(ICON_FILENAME)


def _shared(spans: Column) -> Column:
    return F.exists(spans, lambda s: F.coalesce(s["href"].rlike(SHARE_LINK), F.lit(False)))


def is_noise(b: Column, host: Column) -> Column:
    """Empty texts, short calls to act, share links, links that lead back into the site alone, icons. host: of the page, without www."""
    text, spans, items = F.trim(b["text"]), F.coalesce(b["content"], _none(SPAN)), F.coalesce(b["items"], _none(T.ArrayType(SPAN)))
    own = lambda href: F.regexp_replace(F.lower(F.regexp_extract(href, r"^https?://([^/?#:]+)", 1)), r"^www\.", "") == host
    running, worded = b["type"].isin("paragraph", "quote"), b["type"].isin("paragraph", "quote", "heading")
    inside = F.forall(spans, lambda s: F.coalesce(own(s["href"]), F.trim(s["text"]) == ""))
    # lengths come first: most texts are too long for the rules that read all their spans
    return (
        (worded & (text == ""))
        | (worded & (F.length(text) < 120) & (text.rlike(BOILERPLATE_PHRASE) | text.rlike(BOILERPLATE_EXACT) | text.rlike(BOILERPLATE_PREFIX)))
        | (running & (F.length(text) < 200) & _shared(spans))
        | ((b["type"] == "list") & F.forall(items, lambda item: (F.trim(F.array_join(F.transform(item, lambda s: s["text"]), "")) == "") | _shared(item)))
        | (running & (F.length(text) < 40) & (F.size(spans) > 0) & inside)
        | ((b["type"] == "image") & is_icon(b["url"]))
    )


def _none(kind: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(kind))


def repeat_key(b: Column) -> Column:
    """What makes a block a repeat of the one before: code by its exact text, others by their identity (an image's link, a video, folded text)."""
    return F.when(b["type"] == "code", b["text"]).otherwise(b["identity"])


def without_noise(blocks: Column, host: Column) -> Column:
    """Noise goes; then a block like the one kept before it, leading and doubled dividers, and trailing ones."""
    clean = F.filter(blocks, lambda b: ~F.coalesce(is_noise(b, host), F.lit(False)))
    start = F.slice(blocks, 1, 0)

    def step(kept: Column, b: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        again = (last["type"] == b["type"]) & (repeat_key(b) != "") & (repeat_key(last) == repeat_key(b))
        idle = (b["type"] == "divider") & (last.isNull() | (last["type"] == "divider"))
        return F.when(F.coalesce(again, F.lit(False)) | F.coalesce(idle, F.lit(False)), kept).otherwise(F.concat(kept, F.array(b)))

    done = F.aggregate(clean, start, step)
    return F.get(F.transform(F.array(done), lambda k: F.when(F.get(k, F.size(k) - 1)["type"] == "divider", F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k)), F.lit(0))


def clip(rows: DataFrame, doc: str, pos: str, length: str, blocks: int = MOST_BLOCKS, chars: int = MOST_CHARS) -> DataFrame:
    """Blocks of each document before one limit is passed, the first always; ``clipped`` says that some went."""
    own = Window.partitionBy(doc)
    run = own.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumns({"_n": F.count("*").over(run), "_c": F.sum(length).over(run)})
    good = (F.col("_n") == 1) | ((F.col("_n") <= blocks) & (F.col("_c") <= chars))
    return r.withColumn("_ok", good).withColumn("clipped", F.max(~F.col("_ok")).over(own)).where("_ok").drop("_n", "_c", "_ok")


def with_ids(rows: DataFrame, doc: str, pos: str, kind: Column, content: Column) -> DataFrame:
    """block_id: the kind's first letter, a hash of kind and content, and -2, -3 from the second alike on."""
    base = F.concat(F.substring(kind, 1, 1), fnv1a(F.concat(kind, F.lit("\0"), content)))
    nth = F.row_number().over(Window.partitionBy(doc, "_base").orderBy(pos))
    return rows.withColumn("_base", base).withColumn("block_id", F.when(nth == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", nth))).drop("_base")


def plain_text(blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda x: F.trim(x) != ""), "\n\n")


def _clipped(blocks: Column, most: int = MOST_BLOCKS, chars: int = MOST_CHARS) -> Column:
    """struct(blocks, clipped) of one page's array: what ``clip`` keeps of its rows, counted in place."""
    lengths = F.transform(blocks, lambda b: F.coalesce(F.length(b["text"]), F.lit(0)).cast("long"))
    state = lambda n, c: F.struct(n.alias("n"), c.alias("c"))
    fits = lambda s, x: (s["n"] == 0) | ((s["n"] < most) & (s["c"] + x <= chars))
    kept = F.aggregate(lengths, state(F.lit(0), F.lit(0).cast("long")), lambda s, x: state(F.when(fits(s, x), s["n"] + 1).otherwise(s["n"]), s["c"] + x))["n"]
    return F.struct(F.slice(blocks, F.lit(1), kept).alias("blocks"), (kept < F.size(blocks)).alias("clipped"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, clipped, block_id and the fields of each block of pages (page_id, url, html; a row a page), after the noise rules and clipped."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)), r"^www\.", "")
    # markup goes to all tasks before it is read: a file's pages are more than one task's work
    pages = pages.select("page_id", "url", "html").repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    own = pages.select("page_id", let(without_noise(html_blocks("html", "url"), host), lambda b: _clipped(b)).alias("c"))
    # an outer one, as for the other the optimizer would read every page twice to find out which have blocks
    kept = own.select("page_id", "c.clipped", F.posexplode_outer("c.blocks").alias("pos", "b")).where("pos is not null").select("page_id", "pos", "b.*", "clipped")
    return with_ids(kept, "page_id", "pos", F.col("type"), F.col("identity"))


def extract_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """page_id, url, title, blocks (with their ids), clipped, text, error of pages (page_id, url, html), a row a page_id. Under ``least`` characters a page keeps its title alone; noarchive ones keep no text."""
    fields = [f.name for f in BLOCK.fields]
    found = page_blocks(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", *fields))).alias("blocks"), F.max("clipped").alias("clipped"))
    found = found.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["block_id"].alias("block_id"), *(b[f].alias(f) for f in fields))))
    heads = pages.select("page_id", "url", F.coalesce(page_title(F.col("html")), F.col("url")).alias("title"), noarchive(F.col("html")).alias("noarchive"))
    rows = heads.join(found, "page_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType))).withColumn("text", plain_text(F.col("blocks")))
    error = F.when(F.col("noarchive"), "noarchive").when(F.length("text") < least, "too little text")
    none = F.col("noarchive")
    return rows.select("page_id", "url", "title", F.when(none, F.slice("blocks", 1, 0)).otherwise(F.col("blocks")).alias("blocks"), F.coalesce("clipped", F.lit(False)).alias("clipped"), F.when(~none, F.col("text")).alias("text"), error.alias("error"))
