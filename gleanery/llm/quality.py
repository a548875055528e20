"""Quality rules by robust multivariate outliers.

Statistics of each text are transformed and held against a minimum-covariance-
determinant estimate of its language and source: of all parts of the data with
a fixed share of the rows the one whose covariance has the least determinant.
It is searched from several robust starts (medians and quartiles, tanh scores,
spatial signs) by concentration steps: a step keeps the rows of the smallest
Mahalanobis distances and takes their mean and covariance again, until the
determinant stops falling; the start with the least one wins.  A step is one
grouped aggregation: moments by narrow bins of distance, summed up to the cut,
so a source with a third of all rows is summed where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .wordlists import SPACES, let, words

#: Share of a group's rows that a concentration step keeps, and the factor that makes their covariance consistent
#: for normal data of five dimensions: share / P(chi2 of 7 <= 0.75 quantile of chi2 of 5).
KEEP, CONSISTENT = 0.75, 1.41
#: A search ends when a step lowers the logarithm of its determinant by less.
GAIN = 1e-3
#: A group of fewer rows takes the estimate of its language, then of all rows; without so many in all, nothing is an outlier.
LEAST_ROWS = 100
#: Squared distance over which a text is rejected.
CUTOFF = 50.0
#: Transformed statistics with the least spread that each is taken to have.
STATISTICS = {
    "log_words": ("ln(1 + n_words)", 0.5),
    "log_word_length": ("ln(1 + word_chars / n_words)", 0.08),
    "log_symbols": ("ln(1 + n_symbols / n_words)", 0.03),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.12),
    "repeat_words": ("n_repeat_words / n_words", 0.12),
}
_X = list(STATISTICS)
_P = len(_X)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included. Windows are compared by 64-bit hashes, sorted with their places."""

    def covered(pos: Column) -> Column:
        return F.aggregate(F.transform(pos, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(pos, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def windows(h: Column) -> Column:
        three = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(three)

    return let(let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), twice), covered)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of each whole text; base_failed says that a plain rule fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.length(F.translate(text, SPACES, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"),
        bare.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
    )
    rows = rows.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("l.n").alias("n_lines"), F.col("w.r").alias("n_repeat_words"))
    return rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _distance(params: str = "") -> Column:
    """Squared Mahalanobis distance: forward substitution in the lower triangle of the covariance."""
    col = lambda name: F.col(f"{params}{name}")
    z: list[Column] = []
    for i, x in enumerate(_X):
        rest = F.col(x) - col(f"m{i}")
        for j in range(i):
            rest = rest - col(f"l{i}{j}") * z[j]
        z.append(rest / col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _triangle(rows: DataFrame) -> DataFrame:
    """Cholesky factor l of a covariance c, column by column."""
    for j in range(_P):
        own = F.col(f"c{j}{j}")
        for k in range(j):
            own = own - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(own, F.lit(1e-12))))
        for i in range(j + 1, _P):
            off = F.col(f"c{j}{i}")
            for k in range(j):
                off = off - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            rows = rows.withColumn(f"l{i}{j}", off / F.col(f"l{j}{j}"))
    return rows


#: Groups whose estimates are broadcast; more of them meet the rows in a join that is salted over all partitions.
BROADCAST_GROUPS = 20_000


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with what a written table has of their group; a group of any share of the rows stays spread."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys or F.lit(True), how)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("salt", (F.monotonically_increasing_id() % n).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


_G = ["level", "lang", "source"]
_L = [f"l{i}{j}" for i in range(_P) for j in range(i + 1)]


_M = [f"m{i}" for i in range(_P)]
_LEAST = [s for _, s in STATISTICS.values()]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_LOGDET = " + ".join(f"2 * ln(l{i}{i})" for i in range(_P))


def _starts(rows: DataFrame) -> DataFrame:
    """Per group and start: n, location m, triangle l and logdet."""
    middle = rows.groupBy(_G).agg(F.count("*").alias("n"), *(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i, x in enumerate(_X)))
    scale = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(_LEAST[i]))
    middle = written(middle.select(*_G, "n", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(_P)), *(scale(i).alias(f"s{i}") for i in range(_P))), "middles")
    z = _beside(rows, middle, _G).select(*_G, "n", *_M, *(f"s{i}" for i in range(_P)), *(((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, x in enumerate(_X)))
    z = z.withColumn("length", F.expr("greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(_P)) + "), 1e-9)"))
    tanh, sign = (lambda i: F.tanh(f"z{i}")), (lambda i: F.col(f"z{i}") / F.col("length"))
    own = z.groupBy(*_G, "n", *_M, *(f"s{i}" for i in range(_P))).agg(*(F.covar_pop(f(i), f(j)).alias(f"{name}{i}{j}") for name, f in (("t", tanh), ("u", sign)) for i, j in _PAIRS))
    found = None
    for start, name in enumerate(("d", "t", "u")):
        spread = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(float(i == j)) if name == "d" else F.col(f"{name}{i}{j}"))  # noqa: E731, B023
        c = own.select(*_G, "n", F.lit(start).alias("start"), *_M, *((spread(i, j) + (_LEAST[i] ** 2 if i == j and name != "d" else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
        c = _triangle(c).select(*_G, "n", "start", *_M, *_L)
        found = c if found is None else found.unionAll(c)
    return found.withColumn("logdet", F.lit(float("inf"))).withColumn("moves", F.lit(True))


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates of one concentration step: of the rows of least distance, KEEP of each group."""
    key = [*_G, "start", "n"]
    bin_ = F.floor(F.log(_distance() + 1e-6) * 16)
    y = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    sums = [F.sum(y[i]).alias(f"y{i}") for i in range(_P)] + [F.sum(y[i] * y[j]).alias(f"y{i}{j}") for i, j in _PAIRS]
    bins = _beside(rows, now, _G).groupBy(*key, bin_.alias("bin")).agg(F.count("*").alias("rows"), *(F.first(m).alias(m) for m in _M), *sums)
    before = F.sum("rows").over(Window.partitionBy(*key).orderBy("bin")) - F.col("rows")
    near = bins.withColumn("before", before).where(F.col("before") < F.ceil(F.col("n") * KEEP))
    names = [f"y{i}" for i in range(_P)] + [f"y{i}{j}" for i, j in _PAIRS]
    whole = near.groupBy(*key).agg(F.sum("rows").alias("rows"), *(F.first(m).alias(m) for m in _M), *((F.sum(x)).alias(x) for x in names))
    mean = lambda x: F.col(x) / F.col("rows")
    c = [((mean(f"y{i}{j}") - mean(f"y{i}") * mean(f"y{j}")) * CONSISTENT + (_LEAST[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return _triangle(whole.select(*key, *((F.col(f"m{i}") + mean(f"y{i}")).alias(f"m{i}") for i in range(_P)), *c)).select(*key, *_M, *_L, F.expr(_LOGDET).alias("logdet"))


def searches(rows: DataFrame) -> DataFrame:
    """Per group and start where its search ended: level, lang, source, n, start, m, l, logdet."""
    names = [*_G, "n", "start", *_M, *_L, "logdet"]
    now = written(_starts(rows).select(*names, "moves"), "starts")
    while not now.where("moves").isEmpty():
        after = _step(rows, now.where("moves"))
        falls = F.col("b.logdet") < F.col("a.logdet") - GAIN
        both = now.where("moves").alias("a").join(after.alias("b"), [*_G, "start"])
        own = [*(F.col(x) for x in _G), F.col("a.n").alias("n"), F.col("start"), *(F.when(falls, F.col(f"b.{x}")).otherwise(F.col(f"a.{x}")).alias(x) for x in (*_M, *_L, "logdet"))]
        now = written(now.where("not moves").unionAll(both.select(*own, falls.alias("moves"))), "estimates")
    return now.select(names)


def estimates(stats: DataFrame) -> DataFrame:
    """Location m and triangle l per group: level 0 language and source, 1 language, 2 all."""
    rows = stats.where("not base_failed").select("lang", "source", *(F.expr(e).alias(x) for x, (e, _) in STATISTICS.items()))
    none = F.lit("")
    group = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else none).alias("lang"), (F.col("source") if k < 1 else none).alias("source")) for k in range(3))))
    rows = rows.select(group.alias("g"), *_X).select("g.*", *_X)
    best = searches(rows).groupBy(_G).agg(F.min_by(F.struct("n", *_M, *_L), F.struct("logdet", "start")).alias("p"))
    return written(best.select(*_G, "p.*"), "estimates")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, distance (null if base_failed or without an estimate), kept.

    docs: doc_id, text, lang, source; other columns are left out.  A null text
    is empty and so fails; null languages and sources are groups of their own.
    Each row, a repeated one too, gets its verdict; groups of fewer than
    ``least_rows`` rows take a wider estimate; no rows give none.
    """
    stats = written(statistics(docs), "statistics")
    found = estimates(stats).where(F.col("n") >= least_rows)
    rows = stats.select("*", *(F.expr(f"case when base_failed then null else {e} end").alias(x) for x, (e, _) in STATISTICS.items()))
    for k, on in enumerate((["lang", "source"], ["lang"], [])):
        own = found.where(F.col("level") == k).select(*on, F.struct(*(f"m{i}" for i in range(_P)), *_L).alias(f"p{k}"))
        rows = _beside(rows, own, on, "left")
    rows = rows.withColumn("p", F.coalesce("p0", "p1", "p2")).withColumn("distance", _distance("p."))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "distance"]
    return rows.select(*out, (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))
