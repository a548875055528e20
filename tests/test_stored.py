"""Stored JSON and edits, by cases of their own."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import stored

SPAN = {"text": "t", "href": "h", "bold": True, "italic": True, "code": True}
GOOD = [
    {"type": "heading", "level": 3, "text": "H"}, {"type": "heading", "level": 2.0, "text": ""}, {"type": "paragraph", "content": [SPAN, {"text": "u", "other": 1}]}, {"type": "paragraph", "content": []},
    {"type": "list", "ordered": True, "items": [[SPAN], []]}, {"type": "quote", "content": [SPAN], "cite": "c"}, {"type": "code", "code": "x", "language": "py"},
    {"type": "image", "originalUrl": "u", "alt": "a", "caption": "c", "path": None, "format": "webp", "widths": [1, 2.5], "width": 3, "height": 4, "placeholder": "p"}, {"type": "image", "originalUrl": "u", "alt": "", "path": "k"},
    {"type": "video", "provider": "vimeo", "videoId": "1", "start": 9}, {"type": "chapters", "items": [{"seconds": 1, "title": "one"}, {"seconds": 2.5, "title": "two"}]},
    {"type": "repo", "fullName": "a/b", "url": "u", "stars": 5, "topics": ["x"], "language": "C", "license": "MIT"}, {"type": "divider", "content": "anything", "level": []},
]
BAD = [
    {"type": "heading", "level": 5, "text": "H"}, {"type": "heading", "level": "2", "text": "H"}, {"type": "heading", "level": 2}, {"type": "paragraph"}, {"type": "paragraph", "content": [{"text": 1}]}, {"type": "paragraph", "content": [{"text": "t", "bold": False}]},
    {"type": "paragraph", "content": [{"text": "t", "href": None}]}, {"type": "paragraph", "content": {"text": "t"}}, {"type": "list", "ordered": "yes", "items": []}, {"type": "list", "ordered": True, "items": [SPAN]}, {"type": "quote", "content": [SPAN], "cite": 1},
    {"type": "code", "code": None}, {"type": "code", "code": "x", "language": None}, {"type": "image", "originalUrl": "u", "alt": "a"}, {"type": "image", "originalUrl": "u", "alt": "a", "path": 1}, {"type": "image", "originalUrl": "u", "alt": "a", "path": None, "format": "png"},
    {"type": "image", "originalUrl": "u", "alt": "a", "path": None, "widths": ["1"]}, {"type": "video", "provider": "x", "videoId": "1"}, {"type": "chapters", "items": [{"seconds": "1", "title": "t"}]}, {"type": "repo", "fullName": "a", "url": "u", "stars": 1, "topics": [1]},
    {"type": "repo", "fullName": "a", "url": "u", "stars": 1}, {"type": None}, {"type": "odd"}, [], None, 5, "x",
]


def one(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("x")).first().x


def test_blocks_stay_or_go_alone(spark):
    whole = [{"id": f"g{i}", **b} for i, b in enumerate(GOOD)]
    mixed = [x for i, g in enumerate(whole) for x in (g, {"id": "b", **BAD[i]} if i < len(BAD) and isinstance(BAD[i], dict) else None)]
    mixed += [{"id": "b", **b} if isinstance(b, dict) else b for b in BAD[len(whole) :]] + [{k: v for k, v in whole[0].items() if k != "id"}, {**whole[0], "id": 7}]
    got = one(spark, stored.read_blocks(F.col("raw")), raw=json.dumps(mixed))
    assert [b.id for b in got] == [b["id"] for b in whole]
    assert got[2].content[0].asDict() == SPAN and got[4].items[1] == [] and got[7].widths == [1.0, 2.5] and got[7].path is None and got[10].chapters[1].title == "two" and got[11].topics == ["x"] and got[12].content is None
    texts = one(spark, F.transform(stored.read_blocks(F.col("raw")), stored.block_text), raw=json.dumps(whole))
    assert texts == ["H", "", "tu", "", "t\n", "t", "x", "a c", "", "", "one\ntwo", "a/b", ""]
    assert one(spark, stored.plain_text(stored.read_blocks(F.col("raw"))), raw=json.dumps(whole[:3])) == "H\n\ntu"


@pytest.mark.parametrize("raw", [None, "", "{", "null", "5", '"[]"', '{"0": {"id": "a", "type": "divider"}}', "[]", "[[]]"])
def test_what_is_no_array_has_no_blocks(spark, raw):
    assert one(spark, stored.read_blocks(F.col("raw")), raw=raw) == [] and one(spark, stored.read_hidden(F.col("raw")), raw=raw) == [] and one(spark, stored.read_brief(F.col("raw")), raw=raw) is None and one(spark, stored.texts_below(F.col("raw")), raw=raw) == []
    assert tuple(one(spark, stored.read_overrides(F.col("raw")), raw=raw)) == (None, None)


def test_texts_at_any_depth(spark):
    deep = {"text": 'say "text": {"text":"x"} \\', "a": [{"b": {"text": "é\n"}}, ["text", {"text": 5}], {"text": {"text": "in"}}], "c": '{"text":"no"}', "d": "\\", "e": "{", "mytext": "no"}
    for _ in range(60):
        deep = [{"x": deep}]
    found = one(spark, stored.texts_below(F.col("raw")), raw=json.dumps(deep))
    assert sorted(found) == sorted(['say "text": {"text":"x"} \\', "é\n", "in"])


def test_briefs_and_sections(spark):
    brief = lambda hu, en: one(spark, stored.read_brief(F.col("raw")), raw=json.dumps({"hu": hu, "en": en}))
    assert brief(["a"], ["b", "c"]).en == ["b", "c"]
    assert all(brief(*x) is None for x in (([], ["b"]), (["a"], []), (["a"] * 7, ["b"]), (["a", 1], ["b"]), ("a", ["b"])))
    sections = F.from_json("raw", "array<struct<heading:string,points:array<string>>>")
    got = one(spark, stored.sections_to_blocks(sections), raw=json.dumps([{"heading": "H", "points": ["p", "q"]}]))
    assert [(b.type, b.level, b.text, b.ordered) for b in got] == [("heading", 2, "H", None), ("list", None, None, False)] and [x[0].text for x in got[1]["items"]] == ["p", "q"]


def test_rows_that_are_missing(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, hu string, en string")
    got = stored.rebase(make([(1, "a", "b"), (2, "a", None), (3, None, "x")]), make([(1, "a", "z"), (3, None, "y")]), make([(1, "A", "B"), (2, "A", "B"), (3, "N", "M")]), "id", ("hu", "en"))
    assert sorted(map(tuple, got.collect())) == [(1, "A", "b"), (2, "a", "B"), (3, "N", "x")]
