"""Stored JSON read with care, and readers' edits: what has the right form stays, what hasn't goes alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.text import TAGS

# fixed values
TITLE_MAX, SUMMARY_MAX = 300, 2000
MOST_HIDDEN, MOST_PARAGRAPHS, MOST_POINTS, MOST_TAGS, MOST_SECTIONS, MOST_SECTION_POINTS = 400, 6, 8, 4, 8, 10

SPANS = "array<struct<text:string,href:string,bold:boolean,italic:boolean,code:boolean>>"
_CHAPTERS = "array<struct<seconds:double,title:string>>"
#: Fields of a block as it is read: where it is, its type, the kinds of block that have it.
FIELDS = {
    "level": ("level", "int", "heading"), "text": ("text", "string", "heading"), "content": ("content", SPANS, "paragraph quote"), "cite": ("cite", "string", "quote"),
    "ordered": ("ordered", "boolean", "list"), "items": ("items", f"array<{SPANS}>", "list"), "language": ("language", "string", "code repo"), "code": ("code", "string", "code"),
    "originalUrl": ("originalUrl", "string", "image"), "alt": ("alt", "string", "image"), "caption": ("caption", "string", "image"), "path": ("path", "string", "image"),
    "format": ("format", "string", "image"), "widths": ("widths", "array<double>", "image"), "width": ("width", "double", "image"), "height": ("height", "double", "image"), "placeholder": ("placeholder", "string", "image"),
    "provider": ("provider", "string", "video"), "videoId": ("videoId", "string", "video"), "start": ("start", "double", "video"), "chapters": ("items", _CHAPTERS, "chapters"),
    "fullName": ("fullName", "string", "repo"), "url": ("url", "string", "repo"), "stars": ("stars", "double", "repo"), "topics": ("topics", "array<string>", "repo"), "license": ("license", "string", "repo"),
}


def opened(raw: Column) -> Column:
    """JSON text as a VARIANT; null for what isn't JSON."""
    return F.try_parse_json(raw)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def form(v: Column, path: str = "$") -> Column:
    """The JSON type there; null where nothing is."""
    return F.schema_of_variant(at(v, path))


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def is_text(v: Column, path: str = "$") -> Column:
    return _sure(form(v, path) == "STRING")


def is_number(v: Column, path: str = "$") -> Column:
    return _sure(form(v, path).rlike(r"^(BIGINT|DOUBLE|DECIMAL\(.*)$"))


def is_true_or_none(v: Column, path: str) -> Column:
    return form(v, path).isNull() | _sure(at(v, path, "boolean") & (form(v, path) == "BOOLEAN"))


def may(test: Column, v: Column, path: str) -> Column:
    """A field that may be left out."""
    return form(v, path).isNull() | test


def elements(v: Column, path: str = "$") -> Column:
    """The elements of an array there; null if it is none."""
    return F.when(form(v, path).startswith("ARRAY"), at(v, path, "array<variant>"))


def every(v: Column, path: str, test) -> Column:
    """Whether an array is there, all elements of which pass."""
    return _sure(F.forall(elements(v, path), lambda e: _sure(test(e))))


def is_span(v: Column) -> Column:
    return is_text(v, "$.text") & may(is_text(v, "$.href"), v, "$.href") & reduce(Column.__and__, (is_true_or_none(v, f"$.{m}") for m in ("bold", "italic", "code")))


def is_block(v: Column) -> Column:
    """Whether a VARIANT is a block of one of the ten kinds."""
    text = lambda *names: reduce(Column.__and__, (is_text(v, f"$.{n}") for n in names))
    texts = lambda *names: reduce(Column.__and__, (may(is_text(v, f"$.{n}"), v, f"$.{n}") for n in names))
    numbers = lambda *names: reduce(Column.__and__, (may(is_number(v, f"$.{n}"), v, f"$.{n}") for n in names))
    kind, one_of = at(v, "$.type", "string"), lambda n, *values: is_text(v, f"$.{n}") & _sure(at(v, f"$.{n}", "string").isin(*values))
    rules = {
        "heading": is_number(v, "$.level") & _sure(at(v, "$.level", "double").isin(2.0, 3.0, 4.0)) & text("text"),
        "paragraph": every(v, "$.content", is_span),
        "list": _sure(form(v, "$.ordered") == "BOOLEAN") & every(v, "$.items", lambda item: every(item, "$", is_span)),
        "quote": every(v, "$.content", is_span) & texts("cite"),
        "code": text("code") & texts("language"),
        "image": text("originalUrl", "alt") & (is_text(v, "$.path") | _sure(form(v, "$.path") == "VOID")) & texts("caption", "placeholder") & numbers("width", "height")
        & may(one_of("format", "avif", "webp"), v, "$.format") & may(every(v, "$.widths", is_number), v, "$.widths"),
        "video": one_of("provider", "youtube", "vimeo") & text("videoId") & numbers("start"),
        "chapters": every(v, "$.items", lambda c: is_number(c, "$.seconds") & is_text(c, "$.title")),
        "repo": text("fullName", "url") & is_number(v, "$.stars") & every(v, "$.topics", is_text) & texts("language", "license"),
        "divider": F.lit(True),
    }
    found = F.lit(False)
    for name, rule in rules.items():
        found = F.when(kind == name, rule).otherwise(found)
    return is_text(v, "$.id") & is_text(v, "$.type") & found


def read_blocks(raw: Column) -> Column:
    """The valid blocks of stored JSON as typed structs, in order; a broken one goes alone, and what is no array has none."""

    def typed(v: Column) -> Column:
        kind = at(v, "$.type", "string")
        fields = [F.when(kind.isin(*kinds.split()), at(v, f"$.{path}", sql)).alias(name) for name, (path, sql, kinds) in FIELDS.items()]
        return F.struct(at(v, "$.id", "string").alias("id"), kind.alias("type"), *fields)

    found = F.transform(F.filter(elements(opened(raw)), lambda e: is_block(e)), typed)
    return F.coalesce(found, F.slice(F.array(typed(opened(F.lit("{}")))), 1, 0))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), "")


def block_text(b: Column) -> Column:
    """The words of a block as it is read."""
    image = F.concat_ws(" ", F.nullif(b["alt"], F.lit("")), F.nullif(b["caption"], F.lit("")))
    return (
        F.when(b["type"] == "heading", b["text"])
        .when(b["type"].isin("paragraph", "quote"), spans_text(b["content"]))
        .when(b["type"] == "list", F.array_join(F.transform(b["items"], spans_text), "\n"))
        .when(b["type"] == "code", b["code"])
        .when(b["type"] == "image", image)
        .when(b["type"] == "chapters", F.array_join(F.transform(b["chapters"], lambda c: c["title"]), "\n"))
        .when(b["type"] == "repo", b["fullName"])
        .otherwise("")
    )


def plain_text(blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t != ""), "\n\n")


def texts_below(raw: Column) -> Column:
    """Every string under a key ``text``, at any depth.

    In compact JSON whose strings hold no quotes (those are written as codes
    first), ``{"text":"`` and ``,"text":"`` stand nowhere but at such a key,
    so one scan of the row finds them all, however deep.
    """
    compact = F.replace(F.replace(F.to_json(opened(raw)), F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    found = F.regexp_extract_all(compact, F.lit(r'[{,]"text":("[^"]*")'), F.lit(1))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^[\\s ﻿]+|[\\s ﻿]+$", "")


def localized(v: Column, path: str, most: int) -> Column:
    """struct(hu, en) of a field whose two texts hold 1 to ``most`` characters when trimmed; else null."""
    texts = {lang: trimmed(at(v, f"{path}.{lang}", "string")) for lang in ("hu", "en")}
    good = reduce(Column.__and__, (is_text(v, f"{path}.{lang}") & _sure(F.length(t).between(1, most)) for lang, t in texts.items()))
    return F.when(good, F.struct(*(t.alias(lang) for lang, t in texts.items())))


def read_overrides(raw: Column) -> Column:
    """struct(title, summary), each null unless it has its form."""
    v = opened(raw)
    return F.struct(localized(v, "$.title", TITLE_MAX).alias("title"), localized(v, "$.summary", SUMMARY_MAX).alias("summary"))


def read_hidden(raw: Column) -> Column:
    """Ids of hidden blocks: the strings of an array, as many as a post can have."""
    strings = F.transform(F.filter(elements(opened(raw)), lambda e: is_text(e)), lambda e: at(e, "$", "string"))
    return F.coalesce(F.slice(strings, 1, MOST_HIDDEN), F.array().cast("array<string>"))


def read_brief(raw: Column) -> Column:
    """struct(hu, en) of paragraphs: in both languages one at least and no more than six, all strings; else null."""
    v = opened(raw)
    good = reduce(Column.__and__, (every(v, f"$.{lang}", is_text) & _sure(F.size(elements(v, f"$.{lang}")).between(1, MOST_PARAGRAPHS)) for lang in ("hu", "en")))
    return F.when(good, F.struct(*(at(v, f"$.{lang}", "array<string>").alias(lang) for lang in ("hu", "en"))))


def read_generated(raw: Column) -> Column:
    """What a model wrote about a source, as a post stores it: title, summary (in both slots), key_points, tags and brief; null unless all of it has its form."""

    def read(v: Column) -> Column:
        lists = {"keyPoints": MOST_POINTS, "tags": MOST_TAGS, "brief": MOST_PARAGRAPHS}
        good = is_text(v, "$.title") & is_text(v, "$.summary")
        for name, most in lists.items():
            good = good & every(v, f"$.{name}", lambda e: is_text(e)) & _sure(F.size(elements(v, f"$.{name}")) <= most)
        tags = at(v, "$.tags", "array<string>")
        good = good & _sure(F.forall(tags, lambda t: t.isin(*TAGS)))
        both = lambda f, kind="string": F.struct(at(v, f"$.{f}", kind).alias("hu"), at(v, f"$.{f}", kind).alias("en"))
        return F.when(good, F.struct(both("title").alias("title"), both("summary").alias("summary"), both("keyPoints", "array<string>").alias("key_points"), tags.alias("tags"), both("brief", "array<string>").alias("brief")))

    return once(opened(raw), read)


def read_notes(raw: Column) -> Column:
    """Blocks of a model's notes: a heading and a list for each section; null unless all sections have their form."""
    section = lambda e: is_text(e, "$.heading") & every(e, "$.points", lambda p: is_text(p)) & _sure(F.size(elements(e, "$.points")) <= MOST_SECTION_POINTS)
    good = lambda v: every(v, "$.sections", section) & _sure(F.size(elements(v, "$.sections")) <= MOST_SECTIONS)
    return once(opened(raw), lambda v: F.when(good(v), sections_to_blocks(at(v, "$.sections", "array<struct<heading:string,points:array<string>>>"))))


def sections_to_blocks(sections: Column) -> Column:
    """array(struct(heading, points)) as a heading and a list each."""
    span = lambda p: F.array(F.struct(p.alias("text")))
    none = F.lit(None)
    heading = lambda s: F.struct(F.lit("heading").alias("type"), F.lit(2).alias("level"), s["heading"].alias("text"), none.cast("boolean").alias("ordered"), none.cast("array<array<struct<text:string>>>").alias("items"))
    points = lambda s: F.struct(F.lit("list").alias("type"), none.cast("int").alias("level"), none.cast("string").alias("text"), F.lit(False).alias("ordered"), F.transform(s["points"], span).alias("items"))
    return F.flatten(F.transform(sections, lambda s: F.array(heading(s), points(s))))


def edit_diff(made: Column, draft: Column, fields: tuple[str, ...] = ("title", "summary")) -> Column:
    """Of a draft, the fields that differ from what was made, trimmed texts compared; the others are null, so that no made text becomes an edit."""
    same = lambda f: reduce(Column.__and__, (trimmed(draft[f][lang]).eqNullSafe(trimmed(made[f][lang])) for lang in ("hu", "en")))
    return F.struct(*(F.when(~same(f), draft[f]).alias(f) for f in fields))


def rebased(draft: Column, before: Column, now: Column, fields: tuple[str, ...] = ("hu", "en")) -> Column:
    """A three-way merge by field: what the draft left as it was before follows to what is now, what it changed stays."""
    return F.struct(*(F.when(draft[f].eqNullSafe(before[f]), now[f]).otherwise(draft[f]).alias(f) for f in fields))


def rebase(drafts: DataFrame, before: DataFrame, now: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """drafts (key, fields) carried from the rows they were begun on to the present ones; a row that is no more keeps its draft."""
    side = lambda rows, name: rows.select(key, F.struct(*fields).alias(name))
    joined = side(drafts, "_draft").join(side(before, "_before"), key, "left").join(side(now, "_now"), key, "left")
    merged = F.when(F.col("_now").isNull(), F.col("_draft")).otherwise(rebased(F.col("_draft"), F.col("_before"), F.col("_now"), fields))
    return joined.select(key, merged.alias("_m")).select(key, "_m.*")


def own_hidden(hidden: Column, ids: Column) -> Column:
    """Of the ids to hide those of the post's own blocks, in order."""
    return F.filter(hidden, lambda h: F.array_contains(ids, h))


def read_patch(raw: Column) -> Column:
    """struct(valid, title, summary, hidden) of a request to edit a post: fields may be left out but not be wrong, hidden must be there."""
    v, read = opened(raw), read_overrides(raw)
    fields = reduce(Column.__and__, (form(v, f"$.{f}").isNull() | read[f].isNotNull() for f in ("title", "summary")))
    valid = _sure(form(v).startswith("OBJECT")) & fields & every(v, "$.hidden", is_text) & _sure(F.size(elements(v, "$.hidden")) <= MOST_HIDDEN)
    return F.struct(valid.alias("valid"), read["title"].alias("title"), read["summary"].alias("summary"), at(v, "$.hidden", "array<string>").alias("hidden"))


def save_edits(posts: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with the last good edit of each, a status for every edit).

    posts: post_id, owner, blocks (JSON), title, summary (structs hu, en),
    hidden; edits: edit_id, viewer, post_id, body (JSON).  An edit replaces
    title, summary and hidden as a whole, only its post's owner may make it,
    and ids that aren't of the post's blocks hide nothing.
    """
    known = posts.select("post_id", "owner", F.transform(read_blocks(F.col("blocks")), lambda b: b["id"]).alias("_ids"))
    told = edits.withColumn("_p", read_patch(F.col("body"))).join(known, "post_id", "left")
    status = F.when(~F.col("_p.valid"), "invalid").when(F.col("_ids").isNull(), "not_found").when(F.coalesce(F.col("owner") != F.col("viewer"), F.lit(True)), "forbidden").otherwise("ok")
    told = told.withColumn("status", status)
    last = told.where("status = 'ok'").groupBy("post_id").agg(F.max_by(F.struct("_p.title", "_p.summary", own_hidden(F.col("_p.hidden"), F.col("_ids")).alias("hidden")), "edit_id").alias("_new"))
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    changed = posts.join(last, "post_id", "left").select(*(pick(c) if c in ("title", "summary", "hidden") else F.col(c) for c in posts.columns))
    return changed, told.select("edit_id", "post_id", "status")


def claim_extraction(posts: DataFrame, requests: DataFrame, now: Column, minutes: int = 10) -> tuple[DataFrame, DataFrame]:
    """(posts with extracted_at set where a request won, a status and seconds to wait for every request).

    posts: post_id, owner, extracted_at; requests: request_id, viewer, post_id.
    All requests have read the same rows: of those that an owner makes after
    the cooldown, the first of each post wins and sets the time, and the
    others find it changed.
    """
    left = F.lit(60 * minutes) - (F.unix_seconds(now) - F.unix_seconds("extracted_at"))
    wait = F.when(F.col("extracted_at").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(left, F.lit(60 * minutes))))
    found = F.col("_known").isNotNull()
    told = requests.join(posts.select("post_id", "owner", "extracted_at", F.lit(True).alias("_known")), "post_id", "left").withColumn("wait", wait.cast("long"))
    able = told.withColumn("_able", F.coalesce(found & (F.col("owner") == F.col("viewer")) & (F.col("wait") == 0), F.lit(False)))
    first = able.where("_able").groupBy("post_id").agg(F.min("request_id").alias("_first"))
    able = able.join(first, "post_id", "left")
    won = F.col("_able") & (F.col("request_id") == F.col("_first"))
    status = F.when(~F.coalesce(found, F.lit(False)), "not_found").when(F.coalesce(F.col("owner") != F.col("viewer"), F.lit(True)), "forbidden").when(won, "accepted").otherwise("cooldown")
    told = able.withColumn("status", status)
    pause = F.when(F.col("status") == "cooldown", F.when(F.col("_able"), F.lit(60 * minutes)).otherwise(F.col("wait"))).cast("long")
    changed = posts.join(first, "post_id", "left").withColumn("extracted_at", F.when(F.col("_first").isNotNull(), now).otherwise(F.col("extracted_at"))).select(posts.columns)
    return changed, told.select("request_id", "post_id", "status", pause.alias("retry_after"))
