"""Rankings, quotas and first-wins choices as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle.

    order: columns that sort ascending, a unique one last.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*(F.col(c).alias(f"_{i}") if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(order)), F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(*keys, "_b._row.*").select(rows.columns)


def ranked(rows: DataFrame, keys: list, order: list, name: str = "rank") -> DataFrame:
    """Place 1, 2, ... of each row among its key's."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top(rows: DataFrame, keys: list, order: list, n: int, name: str = "rank") -> DataFrame:
    """The n first rows of each key with their place; Spark cuts each partition to n a key before it shuffles."""
    return ranked(rows, keys, order, name).where(F.col(name) <= n)


def daily_top(rows: DataFrame, keys: list, short: Column, order: list, n: int = 10, least: int = 3, most: int = 5) -> DataFrame:
    """The n best of each key with ``least`` to ``most`` short ones, as far as there are so many of either kind; with their rank.

    n is ``most`` or more.  s0 short ones stand in the plain top n.  Too few are filled up, too many
    give way to long ones, always the best of the wanted kind for the last of
    the other.
    """
    # the n best of either kind decide everything, so only they reach a window over the whole key
    r = top(rows.withColumn("_short", F.coalesce(short, F.lit(False))), [*keys, "_short"], order, n, "_own")
    own = Window.partitionBy(*keys)
    r = r.withColumn("_all", F.row_number().over(own.orderBy(*order)))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(own)
    r = r.withColumns({"_s": count(F.col("_short")), "_l": count(~F.col("_short")), "_s0": count(F.col("_short") & (F.col("_all") <= n))})
    size = F.least(F.lit(n), F.col("_s") + F.col("_l"))
    s = F.when(F.col("_s0") < least, F.least(F.lit(least), F.col("_s"))).when(F.col("_s0") > most, F.greatest(F.lit(most), size - F.col("_l"))).otherwise(F.col("_s0"))
    r = r.where(F.col("_own") <= F.when(F.col("_short"), s).otherwise(size - s))
    return ranked(r, keys, order).drop("_short", "_all", "_own", "_s", "_l", "_s0")


def page(rows: DataFrame, order: list, number: int, size: int = 30, pages: int = 20) -> DataFrame:
    """All rows up to the end of a page, with ``more``: whether others follow. The page is 1 to ``pages``."""
    n = min(max(number, 1), pages) * size
    ahead = rows.orderBy(*order).limit(n + 1)
    numbered = ahead.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered.withColumn("more", F.max("position").over(Window.partitionBy()) > n).where(F.col("position") <= n)


def latest_day(rows: DataFrame, day: str) -> DataFrame:
    """Rows of the latest day that has any."""
    return rows.join(F.broadcast(rows.agg(F.max(day).alias(day))), day, "left_semi")
