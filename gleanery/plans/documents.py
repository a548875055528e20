"""Queries of stored JSON and of edits, over JSON that Spark and DuckDB each make of conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, urls
from ..operators import blocks, stored
from ..sources.tables import table
from .catalog import query

#: JSON of a conversation's turn, as an expression that both engines read; {q} is its text in quotes.
_RAW = """concat('[{{"id":"h","type":"heading","level":', turn % 6, ',"text":', {q}, '}},{{"id":', case when conv_id % 5 = 0 then 'null' else '"p"' end, ',"type":"paragraph","content":[{{"text":', {q}, ',"bold":', case conv_id % 4 when 0 then 'false' when 1 then '1' else 'true' end,
    ',"more":{{"text":"deep, {{text}}","x":[[{{"text":', {q}, '}}]]}}}}]}},{{"id":"l","type":"list","ordered":', case when turn % 3 = 0 then '"no"' else 'false' end, ',"items":[[{{"text":"a"}}],[{{"text":', case when turn % 4 = 1 then '7' else {q} end, '}}]]}},{{"id":"c","type":"code","code":', {q},
    case when conv_id % 3 = 0 then ',"language":null' else '' end, '}},{{"id":"i","type":"image","originalUrl":"https://a.test/', conv_id, '.png","alt":"A","path":', case turn % 4 when 0 then 'null' when 1 then '"7/x"' else '3' end, ',"widths":[640', case when conv_id % 7 = 1 then ',"1"' else '' end,
    ']}},{{"id":"v","type":"video","provider":"', case when conv_id % 2 = 0 then 'youtube' else 'other' end, '","videoId":"x"}},{{"id":"d","type":"divider"}},7,null,{{"type":"divider"}},{{"id":"z","type":"odd"}}', case when conv_id % 11 = 10 then '' else ']' end)"""
_QUOTED = "to_json(coalesce(text, ''))::varchar"


def _turns(spark, d):
    """conv_id, turn and the JSON; in Spark a text's quotes come from an array of it."""
    rows = table(spark, d, "conversations").withColumn("_a", F.to_json(F.array(F.coalesce("text", F.lit("")))))
    return rows.withColumn("q", F.substring("_a", F.lit(2), F.length("_a") - 2)).selectExpr("conv_id", "turn", "role", f"{_RAW.format(q='q')} as raw")


_SPANS_OK = "len(list_filter({0}, lambda s: not (json_type(s, '$.text') is not distinct from 'VARCHAR' and coalesce(json_type(s, '$.bold') = 'BOOLEAN' and s ->> '$.bold' = 'true', json_type(s, '$.bold') is null)))) = 0"


@query(
    f"""with r as (select conv_id, turn, {_RAW.format(q=_QUOTED)} raw from conversations),
    e as (select conv_id, turn, unnest(range(0, len(j))) pos, unnest(j) e from (select conv_id, turn, case when json_valid(raw) then json_extract(raw, '$[*]') else [] end j from r)),
    k as (select *, e ->> '$.type' kind from e where json_type(e) = 'OBJECT' and json_type(e, '$.id') = 'VARCHAR'),
    good as (select conv_id, turn, pos, e ->> '$.id' id, kind as type, case kind when 'heading' then e ->> '$.text' when 'paragraph' then list_aggregate(json_extract_string(e, '$.content[*].text'), 'string_agg', '') when 'code' then e ->> '$.code'
        when 'image' then e ->> '$.alt' when 'list' then list_aggregate(list_transform(json_extract(e, '$.items[*]'), lambda x: list_aggregate(json_extract_string(x, '$[*].text'), 'string_agg', '')), 'string_agg', chr(10)) else '' end as text from k
        where case kind when 'heading' then json_type(e, '$.text') = 'VARCHAR' and (e ->> '$.level') in ('2', '3', '4')
            when 'paragraph' then {_SPANS_OK.format("json_extract(e, '$.content[*]')")}
            when 'list' then json_type(e, '$.ordered') = 'BOOLEAN' and {_SPANS_OK.format("json_extract(e, '$.items[*][*]')")}
            when 'code' then json_type(e, '$.code') = 'VARCHAR' and coalesce(json_type(e, '$.language') = 'VARCHAR', true)
            when 'image' then json_type(e, '$.path') in ('VARCHAR', 'NULL') and len(list_filter(json_extract(e, '$.widths[*]'), lambda w: json_type(w) = 'VARCHAR')) = 0
            when 'video' then (e ->> '$.provider') in ('youtube', 'vimeo') when 'divider' then true else false end)
    select conv_id, turn, (row_number() over (partition by conv_id, turn order by pos) - 1)::int pos, id, type, text from good"""
)
def stored_blocks(spark, d):
    """Blocks of stored JSON, broken ones among them and some that is no JSON: each that has its form."""
    rows = _turns(spark, d).select("conv_id", "turn", F.posexplode(stored.read_blocks(F.col("raw"))).alias("pos", "b"))
    return rows.select("conv_id", "turn", "pos", "b.id", "b.type", stored.block_text(F.col("b")).alias("text"))


@query(
    f"""with r as (select conv_id, turn, {_RAW.format(q=_QUOTED)} raw from conversations),
    t as (select conv_id, turn, x.value ->> '$' t from (select * from r where json_valid(raw)) r, json_tree(raw) x where x.key = 'text' and x.type = 'VARCHAR')
    select conv_id, turn, count(*)::bigint n, string_agg(t, '|' order by t) as texts from t group by 1, 2"""
)
def nested_texts(spark, d):
    """Every string under a key text of stored JSON, however deep: what search reads of a post."""
    found = _turns(spark, d).select("conv_id", "turn", stored.texts_below(F.col("raw")).alias("t")).where(F.size("t") > 0)
    return found.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), "|").alias("texts"))


#: Overrides of a document: texts that are too long, blank, no text, or right.
_OVERRIDES = """concat('{{"title":{{"hu":"', case doc_id % 5 when 0 then '  ' when 1 then repeat('x', 301) else '  c' || doc_id || ' ' end, '","en":', case when doc_id % 7 = 3 then '5' else '"t"' end, '}},"summary":', case doc_id % 6 when 0 then 'null' when 1 then '{{"hu":"s"}}' else '{{"hu":"s","en":"' || repeat('y', cast(1998 + doc_id % 5 as int)) || '"}}' end,
    ',"hidden":', case doc_id % 4 when 0 then '"b1"' when 1 then '["b1",2,null,"b2"]' else '["b1"]' end, '}}')""".format()


@query(
    f"""with r as (select doc_id, {_OVERRIDES} raw from documents),
    v as (select doc_id, raw, trim(raw ->> '$.title.hu') th, case when json_type(raw, '$.title.en') = 'VARCHAR' then trim(raw ->> '$.title.en') end te, raw ->> '$.summary.hu' sh, raw ->> '$.summary.en' se from r)
    select doc_id, case when length(th) between 1 and 300 and length(te) between 1 and 300 then th || '/' || te end title, case when length(sh) between 1 and 2000 and length(se) between 1 and 2000 then length(se) end summary,
        coalesce(array_to_string(list_filter(list_transform(case when json_type(raw, '$.hidden') = 'ARRAY' then json_extract(raw, '$.hidden[*]') else [] end, lambda x: case when json_type(x) = 'VARCHAR' then x ->> '$' end), lambda x: x is not null), ','), '') hidden from v"""
)
def stored_overrides(spark, d):
    """A submitter's overrides: a field counts if it has its form, whatever the other has."""
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_OVERRIDES} as raw")
    read = stored.read_overrides(F.col("raw"))
    hidden = F.array_join(stored.read_hidden(F.get_json_object("raw", "$.hidden")), ",")
    return rows.select("doc_id", F.concat_ws("/", F.when(read["title"].isNotNull(), read["title"]["hu"]), read["title"]["en"]).alias("title"), F.length(read["summary"]["en"]).cast("long").alias("summary"), hidden.alias("hidden")).withColumn("title", F.nullif("title", F.lit("")))


#: Texts of an order: as it was, as it is now and as a reader's draft has it, by bits of its key.
_WAS, _NOW, _DRAFT = (
    {"hu": "concat('h', o_custkey)", "en": "o_orderpriority"},
    {"hu": "concat('h', o_custkey + o_orderkey % 2)", "en": "concat(o_orderpriority, case when o_orderkey div 2 % 2 = 1 then '!' else '' end)"},
    {"hu": "concat('h', o_custkey + 5 * (o_orderkey div 4 % 2))", "en": "case when o_orderkey div 8 % 2 = 1 then case when o_orderkey div 16 % 2 = 1 then null else concat(o_orderpriority, ' ') end else o_orderpriority end"},
)


def _divided(sql: str) -> str:
    return sql.replace(" div ", " // ")


@query(
    f"""with r as (select o_orderkey, o_orderkey % 13 = 0 gone, {", ".join(f"{_divided(v[f])} {n}_{f}" for n, v in (("was", _WAS), ("now", _NOW), ("draft", _DRAFT)) for f in ("hu", "en"))} from orders)
    select o_orderkey, case when not gone and draft_hu is not distinct from was_hu then now_hu else draft_hu end hu, case when not gone and draft_en is not distinct from was_en then now_en else draft_en end en,
        not (trim(draft_hu) is not distinct from trim(was_hu) and trim(draft_en) is not distinct from trim(was_en)) edited from r"""
)
def edit_rebase(spark, d):
    """Drafts begun on one version of rows and carried to the next, field by field; a row that is gone keeps its draft. And which drafts are edits at all."""
    orders = table(spark, d, "orders")
    was, now, draft = (orders.selectExpr("o_orderkey", f"{v['hu']} as hu", f"{v['en']} as en") for v in (_WAS, _NOW, _DRAFT))
    merged = stored.rebase(draft, was, now.where("o_orderkey % 13 <> 0"), "o_orderkey", ("hu", "en"))
    pair = lambda rows, name: rows.select("o_orderkey", F.struct(F.struct("hu", "en").alias("title")).alias(name))
    diff = pair(was, "m").join(pair(draft, "d"), "o_orderkey").select("o_orderkey", stored.edit_diff(F.col("m"), F.col("d"), ("title",))["title"].isNotNull().alias("edited"))
    return merged.join(diff, "o_orderkey")


#: Requests to edit a document, from events; the document's two blocks are b1 and b2.
_PATCH = """concat('{{"hidden":["b2","b9","b1"', case when event_id % 5 = 0 then ',1' else '' end, ']', case when event_id % 3 = 0 then concat(',"title":{{"hu":"h', event_id, '","en":', case when event_id % 2 = 0 then '" e "' else '" "' end, '}}') else '' end, '}}')""".format()
_EDITS = "select event_id edit_id, user_id % 3 viewer, event_id % {0} post_id, {1} body from events"


@query(
    f"""with e as ({_EDITS.format("1500", _PATCH)}), p as (select doc_id, doc_id % 3 as owner from documents)
    select edit_id, post_id, case when edit_id % 5 = 0 or edit_id % 3 = 0 and edit_id % 2 <> 0 then 'invalid' when owner is null then 'not_found' when owner <> viewer then 'forbidden' else 'ok' end status from e left join p on doc_id = post_id"""
)
def edit_statuses(spark, d):
    """Requests to edit posts: which are taken, and why others aren't."""
    return _saved(spark, d)[1]


@query(
    f"""with e as ({_EDITS.format("1500", _PATCH)}), p as (select doc_id, doc_id % 3 as owner from documents),
    ok as (select doc_id, max(edit_id) edit_id from e join p on doc_id = post_id where owner = viewer and edit_id % 5 <> 0 and not (edit_id % 3 = 0 and edit_id % 2 <> 0) group by 1)
    select p.doc_id post_id, case when edit_id is null then 'old' when edit_id % 3 = 0 then 'h' || edit_id || '/e' end title, case when edit_id is null then '' else 'b2,b1' end hidden from p left join ok on p.doc_id = ok.doc_id"""
)
def edited_posts(spark, d):
    """Posts after all edits: the last good one of each replaces what was there."""
    rows = _saved(spark, d)[0]
    return rows.select("post_id", F.when(F.col("title").isNotNull(), F.concat_ws("/", F.col("title.hu"), F.when(F.col("title.en") != "", F.col("title.en")))).alias("title"), F.array_join("hidden", ",").alias("hidden"))


def _saved(spark, d):
    blocks = '[{"id":"b1","type":"divider"},{"id":"b9","type":"odd"},{"id":"b2","type":"code","code":"x"}]'
    posts = table(spark, d, "documents").selectExpr("doc_id as post_id", "doc_id % 3 as owner", f"'{blocks}' as blocks", "named_struct('hu', 'old', 'en', '') as title", "cast(null as struct<hu:string,en:string>) as summary", "cast(array() as array<string>) as hidden")
    edits = table(spark, d, "events").selectExpr("event_id as edit_id", "user_id % 3 as viewer", "event_id % 1500 as post_id", f"{_PATCH} as body")
    return stored.save_edits(posts, edits)


@query(
    """with p as (select o_orderkey, o_custkey % 2 as owner, case when o_orderkey % 3 > 0 then timestamp '2024-01-01 12:00:00' - (o_orderkey % 20) * interval 1 minute end seen from orders),
    r as (select event_id, user_id % 2 viewer, event_id // 2 as key from events), j as (select *, case when seen is null then 0 else greatest(0, 600 - epoch(timestamp '2024-01-01 12:00:00' - seen))::bigint end wait from r left join p on o_orderkey = key),
    w as (select *, coalesce(owner = viewer and wait = 0, false) able, min(case when owner = viewer and wait = 0 then event_id end) over (partition by key) first from j)
    select event_id request_id, key post_id, case when owner is null then 'not_found' when owner <> viewer then 'forbidden' when able and event_id = first then 'accepted' else 'cooldown' end status,
        case when owner = viewer and not (able and event_id = first) then case when able then 600 else wait end end retry_after from w"""
)
def extraction_claims(spark, d):
    """Requests to read a source again: one wins, the others wait."""
    at = "case when o_orderkey % 3 > 0 then timestamp'2024-01-01 12:00:00' - make_interval(0, 0, 0, 0, 0, cast(o_orderkey % 20 as int)) end"
    posts = table(spark, d, "orders").selectExpr("o_orderkey as post_id", "o_custkey % 2 as owner", f"{at} as extracted_at")
    requests = table(spark, d, "events").selectExpr("event_id as request_id", "user_id % 2 as viewer", "event_id div 2 as post_id")
    return stored.claim_extraction(posts, requests, F.lit("2024-01-01 12:00:00").cast("timestamp"))[1]


#: JSON-LD of a page by its id: an object, an array, a graph, a broken script before a good one, nodes without a text.
_LINKED = """concat('<script type="application/ld+json">', case when page_id % 5 = 4 then '{{"datePublished":' else concat('{{"datePublished":', page_id, '}}') end, '</script><SCRIPT type=''application/ld+json; charset=utf-8''>',
    case page_id % 4 when 0 then concat('[{{"name":"x"}},{{"publisher":{{"name":"P', page_id, '"}}}},{{"datePublished":"never"}}]') when 1 then concat('{{"@graph":[7,{{"publisher":{{"name":5}}}},{{"datePublished":"D', page_id, '"}}]}}') when 2 then '{{"publisher":"text"}}' else concat('{{"datePublished":"D', page_id, '","publisher":{{"name":"Q"}}}}') end,
    '</SCRIPT><script>{{"datePublished":"no"}}</script><script type="application/ld+json">[[1],{{"publisher":{{"name":"last"}},"datePublished":"L"}}]</script>', substr(html, 1, 0))""".format()


@query(
    """select page_id, case when page_id % 4 in (1, 3) then 'D' || page_id else 'L' end published, case page_id % 4 when 0 then 'P' || page_id when 3 then 'Q' else 'last' end site,
    case page_id % 4 when 0 then 'P' || page_id when 3 then 'Q' else 'last' end publisher from pages"""
)
def linked_pages(spark, d):
    """Dates and publishers of JSON-LD: the first node that has one in every script, the first value of each field over all."""
    rows = table(spark, d, "pages").selectExpr("page_id", f"{_LINKED} as html")
    page = blocks.linked_page(F.col("html"))
    return rows.select("page_id", page["published"].alias("published"), page["site"].alias("site"), blocks.linked_data(F.col("html"), "publisher.name").alias("publisher"))


#: Forms that the day of an order is written in, with the days that the zone moves it by.
_WRITTEN = {
    "date_format(o_orderdate, 'yyyy-MM-dd')": 0, "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T23:30:00-05:00')": 0, "concat('Tue, ', date_format(o_orderdate, 'd MMM yyyy'), ' 23:30:00 -0500')": 1, "concat(date_format(o_orderdate, 'd MMM yyyy'), ' 00:10 GMT')": 0,
    "date_format(o_orderdate, 'MMMM d, yyyy')": 0, "concat('Monday ', date_format(o_orderdate, 'MMM d yyyy'), ' 12:30 am GMT+0100')": -1, "date_format(o_orderdate, 'yyyy/M/d')": 0, "concat(date_format(o_orderdate, 'M/d/yyyy'), ', 9:15:00 PM PST (Pacific)')": 1,
    "concat('on ', o_orderdate)": None, "concat(date_format(o_orderdate, 'yyyy-MM'), '-32')": None, "'yesterday'": None,
}


@query("select o_orderkey, case " + " ".join(f"when o_orderkey % {len(_WRITTEN)} = {i} then {'null' if n is None else f'o_orderdate::date + {n}'}" for i, n in enumerate(_WRITTEN.values())) + " end published from orders")
def published_dates(spark, d):
    """Days of orders written in eleven forms, three of which are no dates."""
    text = "case " + " ".join(f"when o_orderkey % {len(_WRITTEN)} = {i} then {sql}" for i, sql in enumerate(_WRITTEN)) + " end"
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{text} as t").select("o_orderkey", dates.published_date(F.col("t")).alias("published"))


#: An event's address: its first byte is often one of the special ones, the others are bits of a hash of its number.
_BYTES = {
    "a": "case event_id % 12 when 0 then 0 when 1 then 10 when 2 then 100 when 3 then 127 when 4 then 169 when 5 then 172 when 6 then 192 when 7 then 224 else event_id * 7 % 250 end",
    "b": "case when event_id % 5 = 0 then 254 when event_id % 5 = 1 then 168 else event_id * 13 % 256 end",
    "c": "event_id * 31 % 256",
    "e": "event_id * 57 % 256",
}


@query(
    f"""with v as (select event_id, event_id % 9 form, {", ".join(f"{sql} {k}" for k, sql in _BYTES.items())} from events), n as (select *, (a << 24) + (b << 16) + (c << 8) + e n from v)
    select event_id, case when form in (5, 7) then true when form in (6, 8) then false else n >> 24 in (0, 10, 127) or n >> 24 >= 224 or n >> 22 = (100 << 2) + 1 or n >> 16 = (169 << 8) + 254 or n >> 20 = (172 << 4) + 1 or n >> 16 = (192 << 8) + 168 end private from n"""
)
def private_addresses(spark, d):
    """Addresses in IPv4 and in the forms of IPv6 that carry one: what is private stays private in each."""
    high, low = "lower(hex(a * 256 + b))", "lower(hex(c * 256 + e))"
    quad = "concat(a, '.', b, '.', c, '.', e)"
    forms = [quad, f"concat('::ffff:', {quad})", f"concat('[::FFFF:', {high}, ':', {low}, ']')", f"concat('64:ff9b::', {high}, ':', {low})", f"concat('2002:', {high}, ':', {low}, '::1')", f"concat('fe80::', {low})", f"concat('2001:db8::', {high})", f"concat('fd00:0:0:0:0:0:', {high}, ':', {low})", f"concat('1:2:3:4:5:6:', {high}, ':', {low}, ':9')"]
    text = "case " + " ".join(f"when form = {i} then {sql}" for i, sql in enumerate(forms)) + " end"
    rows = table(spark, d, "events").selectExpr("event_id", "event_id % 9 as form", *(f"{sql} as {k}" for k, sql in _BYTES.items()))
    return rows.selectExpr("event_id", f"{text} as address").select("event_id", urls.is_private(F.col("address")).alias("private"))
