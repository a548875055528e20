"""The service's calls on small frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import state
from gleanery.plans import api

NOW = dt.datetime(2026, 9, 23, 12)


def test_sources(spark):
    now = F.lit("2026-09-23 12:00:00").cast("timestamp")
    stored = spark.createDataFrame([("https://a.com/x",)], "url_key string")
    links = spark.createDataFrame([(1, "https://www.a.com/x/", "u"), (2, "https://b.com/y?utm_source=z", "u"), (3, "https://b.com/y", "u"), (4, "http://localhost/", "u")], "id long, url string, owner string")
    added, refused = api.post_sources(stored, links, now)
    assert [(r.id, r.url_key, r.kind) for r in added.collect()] == [(2, "https://b.com/y", "article")]
    assert {r.id: r.error for r in refused.collect()} == {1: "duplicate", 3: "duplicate", 4: "bad link"}
    posts = spark.createDataFrame([(9, 99)], "source_id long, post_id long")
    mine = added.unionByName(added.withColumn("id", F.lit(9).cast("long")).withColumn("status", F.lit("done")))
    got = api.get_my_sources(mine, posts, "u").collect()
    assert [(r.id, r.copy.state, r.copy.post_id) for r in got] == [(9, "post", 99), (2, "pending", None)]


def test_state(spark):
    make = spark.createDataFrame
    there = state.State(make([("u", "i", True, False), ("v", "i", False, True)], "user_id string, item_id string, is_read boolean, is_saved boolean"), make([("u", 4, "old", None, False), ("v", 5, "hers", None, False)], "user_id string, id long, text string, item_id string, is_done boolean"), make([("u", "item", "i", 1)], "user_id string, kind string, target string, rating int"))
    bodies = [{"action": "set_saved", "itemId": "i", "value": True}, {"action": "set_read", "itemId": "i", "value": 1}, {"action": "add_todo", "text": " buy ", "itemId": "i"}, {"action": "set_todo", "id": 4, "value": True}, {"action": "delete_todo", "id": 5}, {"action": "set_rating", "kind": "item", "id": "i", "value": None}, {"action": "set_rating", "kind": "repo", "id": "A/B", "value": 2}, {"action": "add_todo", "text": "second"}]
    bad = {"missing_item": {"action": "set_read"}, "invalid_item": {"action": "add_todo", "text": "x", "itemId": 5}, "missing_text": {"action": "add_todo", "text": "  "}, "invalid_id": {"action": "set_todo", "id": 1.5}, "invalid_target": {"action": "set_rating", "kind": "item", "id": "x" * 201, "value": 1}, "invalid_rating": {"action": "set_rating", "kind": "item", "id": "x"}, "unknown_action": {"action": "x"}}
    rows = [(i, "u", json.dumps(b)) for i, b in enumerate([*bodies, *bad.values()])] + [(90, "u", "{"), (91, "u", None)]
    new, answers = api.post_state(there, make(rows, "seq long, user_id string, body string"))
    mine = api.get_state(new, "u")
    assert [tuple(r) for r in mine.flags.collect()] == [("u", "i", False, True)]
    assert [tuple(r) for r in mine.todos.collect()] == [("u", 13, "second", None, False), ("u", 8, "buy", "i", False), ("u", 4, "old", None, True)]
    assert [tuple(r) for r in mine.ratings.collect()] == [("u", "repo", "a/b", 2)]
    assert new.todos.where("user_id = 'v'").count() == 1  # another reader's to-do stays
    got = {r.seq: (r.error, r.id) for r in answers.collect()}
    assert [got[i] for i in range(8)] == [(None, 8 if i == 2 else 13 if i == 7 else None) for i in range(8)]
    assert [got[i][0] for i in (*range(8, 15), 90, 91)] == [*bad, "unknown_action", "unknown_action"]


def test_edits(spark):
    posts = spark.createDataFrame([(1, "u", None, None), (2, "v", "o", None)], "post_id long, owner string, overrides string, hidden array<string>")
    edit = lambda i: spark.createDataFrame([(i, "new", ["b"])], "post_id long, overrides string, hidden array<string>")
    assert {r.post_id: r.overrides for r in api.patch_posts(posts, edit(1), "u").collect()} == {1: "new", 2: "o"}
    with pytest.raises(Exception, match="not the owner"):
        api.patch_posts(posts, edit(2), "u").collect()
