"""Words and shingles as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words; everything else is part of one.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles of a folded text, in order; a text of fewer words is one shingle, one without words has none."""
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    of = lambda h: F.when(
        F.size(h) >= k,
        F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k)))),
    ).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.slice(h, 1, 0))
    return let(hashed(words(fold(text))), of)
