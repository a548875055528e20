"""What a reader sees of a week: views, orders, a week's state, cards, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_closed, iso_week, iso_week_monday
from .ranking import ranked, top
from .serve import unread_first

# fixed values
KIND_NAMES = {"article": ("cikk", "article"), "youtube": ("YouTube-videó", "YouTube video"), "arxiv": ("arXiv-tanulmány", "arXiv paper"), "github": ("GitHub-repó", "GitHub repo"), "x": ("X-poszt", "X post"), "pdf": ("PDF", "PDF")}
LISTED_CHARS, LISTED_MOST, THREAD = 280, 60, 10


def feed_view(items: DataFrame, view: str) -> DataFrame:
    """Items of a view: ``all`` but the must-reads, ``saved`` ones (now, or when the page was loaded), or those of a category.

    items: category, must_read, saved, saved_before; missing flags are false.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return items.where(~flag("must_read") if view == "all" else flag("saved") | flag("saved_before") if view == "saved" else F.col("category") == view)


def in_view(items: DataFrame, view: str, keys: list, order: list) -> DataFrame:
    """A view's items with their rank: must-reads, unread ones, then ``order``, as read flags stood at loading (read_before)."""
    rows = feed_view(items, view).withColumn("_key", unread_first(F.coalesce("must_read", F.lit(False)), F.col("read_before")))
    return ranked(rows, keys, ["_key", *order]).drop("_key")


def down_last(disliked: Column | str, order: list) -> list:
    """An order with the disliked rows at its end."""
    return [F.coalesce(F.col(disliked) if isinstance(disliked, str) else disliked, F.lit(False)), *order]


def todo_order(done: str, created: str, key: str) -> list:
    """To-dos: open ones, newest first, then the finished."""
    return [F.coalesce(F.col(done), F.lit(False)), F.desc(created), F.desc(key)]


def thread(rows: DataFrame, owner: str, newest: list, oldest: list, n: int = THREAD) -> DataFrame:
    """The n newest rows of each owner, oldest first, with their position. ``oldest`` is the reverse of ``newest``."""
    return ranked(top(rows, [owner], newest, n, "_new").drop("_new"), [owner], oldest, "position")


def reply(status: Column, post: Column, error: Column) -> Column:
    """struct(state, post_id, error) of a handed-in link: failed, done once its post is there, else pending."""
    state = F.when(status == "failed", "failed").when((status == "done") & post.isNotNull(), "done").otherwise("pending")
    return F.struct(state.alias("state"), F.when(state == "done", post).alias("post_id"), F.when(state == "failed", error).alias("error"))


def kind_name(kind: Column) -> Column:
    """struct(hu, en) of a source's kind; null for others."""
    names = F.create_map(*(x for k, (hu, en) in KIND_NAMES.items() for x in (F.lit(k), F.struct(F.lit(hu).alias("hu"), F.lit(en).alias("en")))))
    return F.try_element_at(names, kind)


def with_source(posts: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """posts (source_id, ...) with fields of their source; posts without one stay."""
    return posts.join(sources.select(F.col("id").alias("source_id"), *fields), "source_id", "left")


def listed(day_list: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of day lists (item_id, day, rank) with their items (id, ...); places whose item is gone are dropped."""
    return day_list.join(items.withColumnRenamed("id", "item_id"), "item_id")


def cards(items: DataFrame, day_list: DataFrame) -> DataFrame:
    """items (id, ...) with daily_rank, null where no day lists them; of several days the latest."""
    rank = day_list.groupBy(F.col("item_id").alias("id")).agg(F.max_by("rank", "day").cast("long").alias("daily_rank"))
    return items.join(rank, "id", "left")


def added_label(ts: Column) -> Column:
    """The local day that something was added on: 09. 29."""
    return F.date_format(F.from_utc_timestamp(ts, "Europe/Budapest"), "MM. dd.")


def week_pattern(week: Column) -> Column:
    """What the ids of a week's items are like; null for what is no week."""
    day = iso_week_monday(week)
    return F.concat(F.lit("%-"), F.lower(F.replace(iso_week(day), F.lit("-"), F.lit(""))), F.lit("-%"))


def week_states(states: DataFrame, week: str) -> DataFrame:
    """Flags of a week's items alone, by the form of their ids (item_id)."""
    return states.where(F.like("item_id", week_pattern(F.lit(week))))


def week_items(snapshots: DataFrame, live: DataFrame, week: str, current: str) -> DataFrame:
    """A week's rows (issue_id, ...): a closed week's from its snapshot, the present or a coming one's as they are now; none if it is no week."""
    asked = F.lit(week)
    own = (F.col("issue_id") == asked) & iso_week_monday(asked).isNotNull()
    closed = is_closed(asked, F.lit(current))
    return snapshots.where(own & closed).unionByName(live.where(own & ~closed))


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == F.lit(value))


def run_counts(queued: DataFrame, key: str, processed: Column, inserted: Column) -> DataFrame:
    """One row of a run's numbers: distinct queued keys, processed rows, inserted rows."""
    return queued.agg(F.count_distinct(key).alias("queued"), F.count_if(processed).alias("processed"), F.count_if(inserted).alias("inserted"))


def items_of_links(sources: DataFrame, items: DataFrame) -> DataFrame:
    """sources (id, url_key) with each item (item_id, url_key) of their link, a row a pair; links without an item stay."""
    return sources.join(items.select("url_key", "item_id").distinct(), "url_key", "left")


def listing(rows: DataFrame, order: list, n: int = LISTED_MOST) -> DataFrame:
    """One row: the n first candidates as a numbered list for a judge."""
    some = rows.orderBy(*order).limit(n)
    numbered = top(some.withColumn("_all", F.lit(0)), ["_all"], order, n, "_place").withColumn("_i", F.col("_place") - 1)
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n    "), F.substring("snippet", 1, LISTED_CHARS))).otherwise("")
    line = F.concat(F.lit("["), "_i", F.lit("] ("), "hint", F.lit(") "), "title", F.lit(" — "), "source", snippet)
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]), "\n").alias("listing"))


def repository_image(link: Column, repository: Column, branch: Column) -> Column:
    """A rooted image link of a read-me as its raw file, from the branch it names or the given one; null for other links."""
    names = F.split(link, "/")
    own = F.lower(F.concat_ws("/", F.get(names, F.lit(1)), F.get(names, F.lit(2)))) == F.lower(repository)
    file = own & F.get(names, F.lit(3)).isin("blob", "raw") & (F.size(names) > 5)
    path = F.when(file, F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(5), F.size(names)), "/"))).otherwise(F.concat(F.lit("/"), branch, link))
    return F.when(link.startswith("/") & ~link.startswith("//"), F.concat(F.lit("https://raw.githubusercontent.com/"), repository, path))
