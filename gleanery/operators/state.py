"""Readers' state as folds over logs of what they did."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..sources.tables import written
from . import stored


def own(rows: DataFrame, viewer: Column | str) -> DataFrame:
    """A reader sees their own rows only."""
    return rows.where(F.col("user_id") == viewer)


def latest(log: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Each value as last set (a null sets nothing), by the greatest order."""
    at = F.struct(*order)
    return log.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))


def fold(log: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last row of each key, unless it deletes (its value is null)."""
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_m"))
    return last.where("_m._v is not null").select(*keys, F.col("_m._v").alias(value))


def toggled(log: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Presses of a rating: pressing the present one again clears it, another replaces it."""
    pressed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    none = F.lit(None).cast(log.schema[value].dataType)
    state = F.aggregate(pressed, none, lambda a, x: F.when(a.eqNullSafe(x["_v"]), none).otherwise(x["_v"]))
    return log.groupBy(*keys).agg(state.alias(value)).where(F.col(value).isNotNull())


# fixed values
ITEM_MOST, TODO_MOST, TARGET_MOST = 120, 180, 200
ACTIONS = ("set_read", "set_saved", "add_todo", "set_todo", "delete_todo", "set_rating")


def read_action(raw: Column) -> Column:
    """struct(error, action, item_id, value, text, todo_id, kind, target, rating) of a request's JSON.

    error is the code of the first field that is wrong, in the order in which
    an action names its fields; an unknown action, or what is no JSON, is
    unknown_action.  A flag that isn't true is false; only an explicit null
    takes a rating back.
    """
    return once(stored.opened(raw), lambda v: once(_action_error(v), lambda error: _action_values(v, error)))


def _text(v: Column, field: str) -> Column:
    return F.when(stored.is_text(v, f"$.{field}"), stored.at(v, f"$.{field}", "string"))


def _number(v: Column, field: str) -> Column:
    return F.when(stored.is_number(v, f"$.{field}"), stored.at(v, f"$.{field}", "double"))


def _action_error(v: Column) -> Column:
    none = lambda f: stored.form(v, f"$.{f}").isNull() | (stored.form(v, f"$.{f}") == "VOID")
    action, item, target, todo, rating = _text(v, "action"), _text(v, "itemId"), stored.trimmed(_text(v, "id")), _number(v, "id"), _number(v, "value")
    item_error = F.when(none("itemId"), "missing_item").when(item.isNull(), "invalid_item").when(item == "", "missing_item")
    words = stored.trimmed(_text(v, "text"))
    todo_error = F.when(F.coalesce(words, F.lit("")) == "", "missing_text").when(~none("itemId") & item.isNull(), "invalid_item")
    id_error = F.when(~F.coalesce((todo == F.floor(todo)) & (F.abs(todo) < 2.0**53), F.lit(False)), "invalid_id")
    good_target = _text(v, "kind").isin("item", "post", "repo") & F.length(target).between(1, TARGET_MOST)
    good_rating = rating.isin(-1.0, 1.0, 2.0) | (stored.form(v, "$.value") == "VOID")
    rating_error = F.when(~F.coalesce(good_target, F.lit(False)), "invalid_target").when(~F.coalesce(good_rating, F.lit(False)), "invalid_rating")
    return (
        F.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown_action")
        .when(action.isin("set_read", "set_saved"), item_error)
        .when(action == "add_todo", todo_error)
        .when(action.isin("set_todo", "delete_todo"), id_error)
        .otherwise(rating_error)
    )


def _action_values(v: Column, error: Column) -> Column:
    action, item, target = _text(v, "action"), _text(v, "itemId"), stored.trimmed(_text(v, "id"))
    flag = F.coalesce((stored.form(v, "$.value") == "BOOLEAN") & stored.at(v, "$.value", "boolean"), F.lit(False))
    of = lambda names, x, kind="string": F.when(error.isNull() & action.isin(*names), x).cast(kind)
    return F.struct(
        error.alias("error"),
        of(ACTIONS, action).alias("action"),
        of(("set_read", "set_saved", "add_todo"), F.nullif(F.substring(item, 1, ITEM_MOST), F.lit(""))).alias("item_id"),
        of(("set_read", "set_saved", "set_todo"), flag, "boolean").alias("value"),
        of(("add_todo",), F.substring(stored.trimmed(_text(v, "text")), 1, TODO_MOST)).alias("text"),
        of(("set_todo", "delete_todo"), _number(v, "id"), "long").alias("todo_id"),
        of(("set_rating",), _text(v, "kind")).alias("kind"),
        of(("set_rating",), F.when(_text(v, "kind") == "repo", F.lower(target)).otherwise(target)).alias("target"),
        of(("set_rating",), _number(v, "value"), "int").alias("rating"),
    )


class State(NamedTuple):
    """What readers have set: flags (user_id, item_id, is_read, is_saved), todos (user_id, id, text, item_id, is_done), ratings (user_id, kind, target, rating)."""

    flags: DataFrame
    todos: DataFrame
    ratings: DataFrame


def applied(there: State, actions: DataFrame) -> tuple[State, DataFrame]:
    """(the state after actions, an answer to each: seq, error, id of a new to-do).

    actions: seq (unique, in order), user_id, body (JSON).  Each is its
    reader's alone.  Flags, to-dos and ratings are folds of what is there and
    what is done, an aggregate each; a new to-do's id is the greatest there is
    plus seq, a step on one that isn't there does nothing.
    """
    told = written(actions.select("seq", "user_id", read_action(F.col("body")).alias("a")))  # requests are read once
    good = told.where("a.error is null").select("seq", "user_id", "a.*")
    old = lambda rows: rows.withColumn("seq", F.lit(-1).cast("long"))
    flag = lambda name: F.when(F.col("action") == name, F.col("value"))
    flags = good.where(F.col("action").isin("set_read", "set_saved")).select("seq", "user_id", "item_id", flag("set_read").alias("is_read"), flag("set_saved").alias("is_saved"))
    flags = latest(old(there.flags).unionByName(flags), ["user_id", "item_id"], ["is_read", "is_saved"], ["seq"]).na.fill(False, ["is_read", "is_saved"])

    base = there.todos.agg(F.max("id")).head()[0] or 0
    answers = told.select("seq", F.col("a.error").alias("error"), F.when(F.col("a.action") == "add_todo", F.lit(base) + F.col("seq") + 1).alias("id"))
    new = good.where("action = 'add_todo'").select("user_id", (F.lit(base) + F.col("seq") + 1).alias("id"), "text", "item_id", F.lit(False).alias("is_done"))
    steps = good.where(F.col("action").isin("set_todo", "delete_todo")).groupBy("user_id", F.col("todo_id").alias("id")).agg(F.max_by("value", F.when(F.col("action") == "set_todo", F.col("seq"))).alias("_done"), F.bool_or(F.col("action") == "delete_todo").alias("_gone"))
    kept = there.todos.select("user_id", "id", "text", "item_id", "is_done").unionByName(new).join(steps, ["user_id", "id"], "left").where(~F.coalesce("_gone", F.lit(False)))
    todos = kept.select("user_id", "id", "text", "item_id", F.coalesce("_done", "is_done").alias("is_done"))

    rated = good.where("action = 'set_rating'").select("seq", "user_id", "kind", "target", "rating")
    ratings = fold(old(there.ratings).unionByName(rated), ["user_id", "kind", "target"], "rating", ["seq"])
    return State(flags, todos, ratings), answers


def read_post_ids(states: DataFrame) -> DataFrame:
    """Posts that a reader has opened: keys 'post:<id>' that are read."""
    post = F.regexp_extract("item_id", r"^post:([1-9]\d{0,15})$", 1)
    return states.where(F.col("is_read") & (post != "")).select("user_id", post.cast("long").alias("post_id"))


def rating_key(kind: Column, target: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == "repo", F.lower(target)).otherwise(target))
