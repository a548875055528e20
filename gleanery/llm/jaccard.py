"""Exact Jaccard join of documents on word shingles, bounded by R-trees over count vectors.

A document's shingles are hashed into groups; the counts per group are a
point.  Two sets overlap in at most the summed coordinate minima of their
points, and a set overlaps in at most that sum with the upper corner of a
tree's box with any set inside.

Documents meet by the few shingles of each that a partner of the wanted
similarity must share (under any one order of shingles, here: very common ones
last).  All that meet under a shingle go to the cell of the least of them, so
that a group of near copies shares one or a few cells however many shingles it
shares.  A prefix is so long that partners share several shingles of it; a
document's cells are dropped where it meets others too seldom for that, given
the number of its cells.  As linked sets differ little in size, a cell is one for each size.
Its points drop the documents without a possible partner, in blocks where it
has many, so that no text moves for a chance meeting; the texts of the others
come once a cell and are verified there on whole sets, and only links that
join two components leave it.  What then is too heavy for a task is first
held against a few of its documents, spread over tasks; what is in other
components than most of it is held against the rest in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .storage import written
from .substring import NO_ID

#: Words of a shingle; per cent of the union that a linked pair shares; groups that shingles are hashed into.
SHINGLE, PERCENT, GROUPS = 5, 80, 64
#: Points of a leaf; a cell of at most so many compares all its pairs at once.
LEAF = 32
#: A shingle in more than one of so many documents comes last in the order. The table of those is broadcast: at most so many times the mean set size.
COMMON = 2000
#: Shingles of its prefix that a document shares with a partner at least: so many and so many per cent of its set.
FEW, SHARED = 3, 4
#: Bits that say which documents' texts are wanted, at most; 8 MB are broadcast then.
BITS = 1 << 26
#: Bytes of text of which a task sends the shingles at once; entries of a bucket, about.
SLICE, BUCKET = 8 << 20, 2_000_000
#: Documents and shingles of a cell, or of a block of a heavier one, that one task holds.
CELL_DOCS, CELL_SHINGLES = 1024, 1 << 22
#: Points of a cell, or of a block of a wider one, that one task compares, and their bytes, about.
POINT_DOCS, POINT_BYTES = 4096, 1 << 23
#: Points next to one in size that are tried first.
BESIDE = 64
#: Documents of a heavy cell that all others are held against first.
CENTRES = 4
#: Steps of a set's size and of a shingle's place that travel with a key, as bytes.
_SIZES, _PLACES = 12, 255
#: Bits of a row of the bitmap of documents.
_ROW = 1 << 15


def sets(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets; A-Z folded, a text of fewer words is one shingle."""
    codes, offsets, vocab = tk.words(text, lower=True)
    h = tk.hashes(vocab)[codes]
    size = np.diff(offsets)
    whole = tk.rolling(h, k)
    n = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    flat = np.zeros(int(at[-1]), np.uint64)
    long = np.flatnonzero(size >= k)
    flat[tk.gather(at[long], n[long])] = whole[tk.gather(offsets[long], n[long])]
    for few in range(1, k):
        if len(short := np.flatnonzero(size == few)):
            flat[at[short]] = tk.mix(tk.rolling(h, few)[offsets[short]] + np.uint64(few))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][n > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[at]


def shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the prefixes of a set of size n and of a partner that isn't smaller have in common at least. It ascends with n."""
    return np.minimum((percent * n + 99) // 100, FEW + n * SHARED // 100)


def prefix(flat: np.ndarray, at: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index in flat, place in the order) of the shingles of which a partner's prefix has ``shared`` at least, by the smaller of both sets."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    last = np.isin(flat, common) if len(common) else np.zeros(len(flat), bool)
    seen = np.concatenate([[0], np.cumsum(last)])
    before = seen[:-1] - seen[at[:-1]][doc]  # common ones of the document before each
    place = np.arange(len(flat)) - at[:-1][doc]
    rank = np.where(last, (n - np.diff(seen[at]))[doc] + before, place - before)
    take = np.flatnonzero(rank < (n - (percent * n + 99) // 100 + shared(n, percent))[doc])
    return doc[take], take, rank[take]


def points(one: np.ndarray) -> np.ndarray:
    """Counts of one set per group as bytes; about a quarter as many groups as shingles, a power of two, GROUPS at least. 255 stands for any more."""
    groups = max(GROUPS, 1 << (len(one) // 4).bit_length())
    return np.minimum(np.bincount((one & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(point: np.ndarray, groups: int, n: int) -> np.ndarray:
    """The same set's counts over fewer groups, at least; n is its size."""
    return np.where(point == 255, n, point.astype(np.int32)).reshape(-1, groups).sum(0)


def bound(a: np.ndarray, b: np.ndarray, m: int, n: int) -> int:
    """Most that two sets of sizes m and n overlap in, by their points over as many groups as both have."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups, m), folded(b, groups, n)).sum())


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1)


class Tree:
    """A cell's points, packed by set size into leaves; each leaf has its upper corner, its sizes, and its component if it has one alone."""

    def __init__(self, point: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray | None = None):
        self.point, self.n, self.component, self.side = point, n, component, side  # n ascends
        self.first = np.arange(0, len(n), LEAF)
        self.corner = np.maximum.reduceat(point, self.first, axis=0)
        self.least, self.most = n[self.first], np.maximum.reduceat(n, self.first)
        self._same()

    def _same(self) -> None:
        low, high = np.minimum.reduceat(self.component, self.first), np.maximum.reduceat(self.component, self.first)
        self.same = np.where(low == high, low, -1)

    def join(self, i: int, j: int) -> None:
        """Points i and j are in one component from now on."""
        self.component[self.component == self.component[i]] = self.component[j]
        self._same()

    def partners(self, i: int, percent: int) -> np.ndarray:
        """Earlier points of other components, and with sides of the other side, that point i may be linked with."""
        n, leaf = self.n[i], i // LEAF + 1
        open_ = np.flatnonzero((self.most[:leaf] * 100 >= percent * n) & (self.same[:leaf] != self.component[i]))
        if len(open_):
            open_ = open_[_bound(self.corner[open_], self.point[i][None]) >= needed(self.least[open_], n, percent)]
        if not len(open_):
            return open_
        j = (open_[:, None] * LEAF + np.arange(LEAF)).ravel()
        j = j[j < i]
        j = j[(self.component[j] != self.component[i]) & (self.n[j] * 100 >= percent * n)]
        if self.side is not None:
            j = j[self.side[j] != self.side[i]]
        return j[_bound(self.point[j], self.point[i][None]) >= needed(self.n[j], n, percent)]


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), copy_of (least doc_id with the same set).

    Two documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets.  No link between two components is lost; inside a component
    only those that join it are looked for, so a group of near copies costs its
    size and not its pairs.

    A null or empty text has no shingles and is linked with nothing; a null
    doc_id is less than all others and comes back null; rows that share a
    doc_id are one document, which links as each of its texts does; other
    columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    digest = written(rows.mapInArrow(lambda b: _digest(b, k), "doc long, n long, s1 long, s2 long, point binary, times long"), "digests")
    sizes = digest.where("n is not null")
    n_docs, n_shingles = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = digest.where("times is not null").groupBy("s1").agg(F.sum("times").alias("n"), F.min("doc").alias("lead")).where(F.col("n") * COMMON > n_docs).select("s1", "lead").collect()
    hot = sorted((r.s1 & ((1 << 64) - 1), r.lead) for r in hot)
    common = spark.sparkContext.broadcast((np.array([h[0] for h in hot], np.uint64), np.array([h[1] for h in hot], np.int64)))
    classes = written(sizes.where("n > 0").groupBy("s1", "s2", "n", "point").agg(F.min("doc").alias("rep")), "classes")
    named = sizes.select("doc", "s1", "s2", "n").join(classes.drop("point"), ["s1", "s2", "n"], "left")

    # documents meet: those without words or partners have no row
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_shingles * (100 - percent + SHARED) / 100 + n_docs * FEW) // BUCKET)
    sent = rows.mapInArrow(lambda b: _entries(b, k, percent, common, buckets), "bucket int, keys binary, docs binary, sizes binary, places binary, leads binary")
    met = sent.groupBy("bucket").applyInArrow(lambda t: _cells(t, percent, buckets), "owner int, leads binary, docs binary, times binary").groupBy("owner").applyInArrow(_once, "lead long, doc long, times long, leads long")
    # what a document's prefix shares with a partner's, m shingles being the least partner, is dealt to cells of both: one of them holds its mean over the document's cells, or more
    m = f"(({percent} * n + 99) div 100)"
    few = F.expr(f"least(({percent} * {m} + 99) div 100, {FEW} + {m} * {SHARED} div 100)")
    cells = written(_by_size(met.join(named.where("rep is not null").select("doc", "rep", "n").distinct(), "doc").where(F.col("times") * F.col("leads") >= few).select("lead", F.col("rep").alias("doc"), "n").distinct(), percent), "cells")
    near = _possible(cells, classes.select(F.col("rep").alias("doc"), "n", "point"), percent)
    centres = [F.min("doc"), *(F.min_by("doc", F.xxhash64("doc", F.lit(i))) for i in range(CENTRES - 1))]
    weights = near.groupBy("lead").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.array_distinct(F.array(*centres)).alias("centres"))
    heavy = written(weights.where((F.col("docs") > CELL_DOCS) | (F.col("shingles") > CELL_SHINGLES)).where("docs > 1").select("lead", "centres", _blocks("docs", "shingles").alias("blocks")), "heavy")
    large = near.join(heavy, "lead")
    wanted = near.select("doc").distinct()
    texts = written(_about(rows, wanted, n_docs).join(wanted, "doc", "left_semi").distinct(), "texts")

    # a light cell in one task, a heavy one against a few of its documents
    task = near.select("lead", "doc").distinct().join(heavy, "lead", "left_anti").select("lead", F.lit(0).alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "doc", F.col("doc").alias("component"))
    several = named.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc", "a")  # texts of one doc_id
    links = written(_linked(task, texts, percent, k).unionAll(several.join(named, "doc").select("a", F.col("rep").alias("b"))), "links")
    if heavy.isEmpty():
        found = components(links)
    else:
        links = links.unionAll(written(_stars(large, texts, percent, k), "stars"))
        known = large.join(components(links).withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        found = components(links.unionAll(written(_linked(_block_pairs(written(known, "known")), texts, percent, k), "links")))
    reps = named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return reps.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "rep", "doc")).alias("component_id"), real(F.coalesce("rep", "doc")).alias("copy_of"))


def _about(rows: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """Rows of these documents and few others: a bitmap of the documents' hashes, of bounded size, goes to the rows, so that no text moves."""
    bits = min(BITS, max(_ROW, 1 << (16 * n_docs).bit_length()))
    place = F.expr(f"pmod(xxhash64(doc), {bits})")
    at = docs.select(place.alias("place")).select(F.expr(f"place div {_ROW}").alias("row"), F.expr(f"place % {_ROW}").alias("bit")).distinct()
    maps = at.repartition("row").groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("map"))
    byte = F.expr(f"cast(conv(hex(substring(map, cast(place % {_ROW} div 8 as int) + 1, 1)), 16, 10) as int)")
    on = (F.expr(f"place div {_ROW}") == F.col("row")) & (F.getbit(byte, F.expr("cast(place % 8 as int)")) == 1)
    return rows.withColumn("place", place).join(F.broadcast(maps), on, "left_semi").drop("place")


def _by(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the same names in one task, one after another."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names).sortWithinPartitions(*names)


def _by_size(cells: DataFrame, percent: int) -> DataFrame:
    """Cells (lead, doc, n) by steps of size: linked sets are of one step or of two next to each other; ``high`` is the upper one of a cell. Cells in which no two could be linked go."""
    step = F.floor(F.log("n") / (float(np.log(100 / percent)) + 1e-9)).cast("long")
    rows = cells.select("lead", "doc", "n", F.explode(F.array(F.struct(step.alias("step"), F.lit(False).alias("high")), F.struct((step - 1).alias("step"), F.lit(True).alias("high")))).alias("s"))
    rows = rows.select(F.xxhash64("lead", "s.step").alias("lead"), "doc", "n", F.col("s.high").alias("high"))
    return rows.join(rows.groupBy("lead").agg(F.count("*").alias("docs"), F.bool_and("high").alias("none")).where("docs > 1 and not none").select("lead"), "lead", "left_semi")


def _possible(cells: DataFrame, point: DataFrame, percent: int) -> DataFrame:
    """lead, doc, n of the rows of cells whose points allow a partner there. A wide cell's blocks are held against themselves, then who has found none against every block."""
    bytes_ = F.sum(F.greatest(F.lit(GROUPS), F.col("n") / 2))
    blocks = F.greatest(F.ceil(F.count("*") / POINT_DOCS), F.ceil(bytes_ / POINT_BYTES)).cast("int").alias("blocks")
    wide = written(cells.groupBy("lead").agg(blocks).where("blocks > 1"), "wide")
    placed = cells.join(wide, "lead", "left").withColumn("x", F.expr("cast(pmod(xxhash64(doc), coalesce(blocks, 1)) as int)"))
    names = ["lead", "x", "y"]

    def near(rows: DataFrame) -> DataFrame:
        rows = _by(rows.join(point, ["doc", "n"]), names).mapInArrow(lambda b: _near(b, percent), "lead long, doc long, n long")
        return written(rows.distinct(), "near")

    found = near(placed.select("lead", "doc", "n", "high", "x", F.lit(0).alias("y"), F.lit(True).alias("wants")))
    if wide.isEmpty():
        return found
    rest = placed.where("blocks is not null").join(found.withColumn("has", F.lit(True)), ["lead", "doc", "n"], "left").withColumn("wants", F.col("has").isNull())
    # the rest in blocks y of its own, as few as hold it
    rests = rest.where("wants").groupBy("lead").agg(blocks.alias("rests"))
    rest = rest.join(rests, "lead").withColumn("r", F.expr("cast(pmod(xxhash64(doc, 1), rests) as int)"))
    to = """concat(transform(sequence(0, rests - 1), j -> named_struct('x', x, 'y', j, 'wants', wants and j = r)),
        if(wants, transform(filter(sequence(0, blocks - 1), i -> i <> x), i -> named_struct('x', i, 'y', r, 'wants', true)), array()))"""
    return found.unionAll(near(rest.select("lead", "doc", "n", "high", F.explode(F.expr(to)).alias("t")).select("lead", "doc", "n", "high", "t.*")))


def _blocks(docs: str, shingles: str):
    """How many blocks of what a task may hold."""
    return F.greatest(F.ceil(F.col(docs) / CELL_DOCS), F.ceil(F.col(shingles) / CELL_SHINGLES), F.lit(1)).cast("int")


def _sums(flat: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set."""
    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(flat + np.uint64(salt)))])
    return (one[at[1:]] - one[at[:-1]]).view(np.int64)


def _digest(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with the size, a 128-bit hash and the point of its set, and one for each shingle that is often in a slice, with a document."""
    for part in tk.merged(batches, limit=SLICE):
        flat, at = sets(part.column("text"), k)
        ids, n = part.column("doc").to_numpy(), np.diff(at)
        fine = [points(flat[a:b]).tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]
        names, where, times = np.unique(flat, return_index=True, return_counts=True)
        often = times >= 4
        doc = ids[np.searchsorted(at, where[often], "right") - 1]
        m = int(often.sum())
        blank = pa.nulls(len(n), pa.int64())
        columns = [(pa.array(ids), pa.array(doc)), (pa.array(n), pa.nulls(m, pa.int64())), (pa.array(_sums(flat, at, 1)), pa.array(names[often].view(np.int64))), (pa.array(_sums(flat, at, 0x5851F42D4C957F2D)), pa.nulls(m, pa.int64())), (pa.array(fine, pa.binary()), pa.nulls(m, pa.binary())), (blank, pa.array(times[often]))]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in columns], names=["doc", "n", "s1", "s2", "point", "times"])


def _entries(batches: Iterable[pa.RecordBatch], k: int, percent: int, common: Broadcast, buckets: int) -> Iterator[pa.RecordBatch]:
    """The shingles by which documents meet, many in a row, by bucket. A very common one has its cell by its table and meets in none."""
    names, leads = common.value
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "docs", "sizes", "places", "leads"))])
    for part in tk.merged(batches, limit=SLICE):
        flat, at = sets(part.column("text"), k)
        ids, n = part.column("doc").to_numpy(), np.diff(at)
        # of equal sets of a slice the least document goes
        same = _sums(flat, at, 1)
        order = np.lexsort((ids, same))
        stays = np.zeros(len(n), bool)
        stays[order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]] = True
        doc, take, place = prefix(flat, at, names, percent)
        own = stays[doc]
        doc, key, place = doc[own], flat[take[own]], place[own]
        rows = []
        if len(names):
            i = np.minimum(np.searchsorted(names, key), len(names) - 1)
            hot = names[i] == key
            if hot.any():
                rows.append((int(ids[0] % buckets), b"", ids[doc[hot]].astype("<i8").tobytes(), b"", b"", leads[i[hot]].astype("<i8").tobytes()))
            doc, key, place = doc[~hot], key[~hot], place[~hot]
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids[doc], bucket))
        doc, key, place, bucket = doc[order], (key[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), place[order], bucket[order]
        size = np.minimum(np.log2(np.maximum(n, 1)) * _SIZES, 255).astype(np.uint8)[doc]
        place = np.maximum(place - shared(n, percent)[doc] + 1, 0)  # as if the last of those shared were the first
        place = (place * _PLACES // np.maximum(n[doc], 1)).astype(np.uint8)
        # only buckets that the slice has shingles for, however many there are
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)).tolist() if len(bucket) else []
        for a, z in zip(edges, edges[1:]):
            own = ids[doc[a:z]]
            step = np.diff(own)
            # ascending: the first, then 32-bit steps
            near = own[0] >= 0 and (not len(step) or step.max() < 1 << 32)
            sent = own[:1].astype("<i8").tobytes() + step.astype("<u4").tobytes() if near else own.astype("<i8").tobytes()
            rows.append((int(bucket[a]), key[a:z].tobytes(), sent, size[a:z].tobytes(), place[a:z].tobytes(), b""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_MET = pa.schema([("owner", pa.int32()), ("leads", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])


def _cells(table: pa.Table, percent: int, buckets: int) -> pa.Table:
    """(lead, doc, times) of the documents that meet in a bucket, many in a row, by bucket of the document: under each key those that may have a partner by size and place go to the least of them."""
    get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])
    key, size, place, lead = get("keys", "<u4"), get("sizes", "u1").astype(np.int64), get("places", "u1").astype(np.int64), get("leads", "<i8")
    docs, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, x in zip(table.column("keys").to_pylist(), table.column("docs").to_pylist()):
        if not k:
            known.append(np.frombuffer(x, "<i8"))
        elif len(x) == 2 * len(k) and len(k) > 4:
            docs.append(np.frombuffer(x, "<i8"))
        else:
            docs.append(np.frombuffer(x, "<i8", 1)[0] + np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u4", offset=8).astype(np.int64))]))
    doc = np.concatenate(docs)
    place[size == 255] = 0  # of unknown size
    order = np.lexsort((place, size, key))
    key, doc, size, place = key[order], doc[order], size[order], place[order]
    # runs of a key and a size; who may be a partner goes by the least place of each run near by
    cell = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) * 1024 + 256 if len(key) else np.zeros(0, np.int64)
    name = cell + size
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(key)))
    runs, least = name[first], place[first]
    second = np.where(many > 1, place[np.minimum(first + 1, max(len(key) - 1, 0))], 1 << 20)
    own = np.repeat(np.arange(len(first)), many)
    leading = np.zeros(len(key), bool)
    leading[first] = True
    t = percent / 100
    share = t / (1 + t)
    ratio = lambda d: 2.0 ** ((d - 1) / _SIZES)  # noqa: E731  at least so much larger is a set that is d steps larger
    last = lambda d: _PLACES * (1 - share * (1 + ratio(d))) + 1e-6  # noqa: E731  a first common shingle stands no later
    good = np.zeros(len(key), bool)
    if len(runs):
        wide = max(d for d in range(256) if ratio(d) * t <= 1 + 1e-9)
        for d in range(-wide, wide + 1):
            at = np.minimum(np.searchsorted(runs, runs + d), len(runs) - 1)
            other = np.where(runs[at] == runs + d, least[at], 1 << 20)[own]
            if d == 0:
                other = np.where(leading, second[own], other)
            good |= (place <= last(d)) & (other <= last(-d))
    key, doc = key[good], doc[good]
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lead = np.concatenate([np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(key)))), lead])
    pairs, times = np.unique(np.stack([tk.mix(np.concatenate([doc, *known]).view(np.uint64)) % np.uint64(buckets), lead.view(np.uint64), np.concatenate([doc, *known]).view(np.uint64)], 1), axis=0, return_counts=True)
    at = np.append(np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])), len(pairs)) if len(pairs) else np.zeros(1, np.int64)
    return pa.table([pa.array(pairs[at[:-1], 0].astype(np.int32)), tk.blobs(pairs[:, 1].view(np.int64), at), tk.blobs(pairs[:, 2].view(np.int64), at), tk.blobs(times.astype("<u4"), at)], schema=_MET)


def _once(table: pa.Table) -> pa.Table:
    """The pairs (lead, doc) of a bucket of documents, each once, with its times and the number of the document's leads."""
    get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])
    pairs, own = np.unique(np.stack([get("docs", "<i8"), get("leads", "<i8")], 1), axis=0, return_inverse=True)
    times = np.bincount(own.ravel(), get("times", "<u4"), len(pairs)).astype(np.int64)
    _, own, leads = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    return pa.table({"lead": pairs[:, 1], "doc": pairs[:, 0], "times": times, "leads": leads[own]})


def _tasks(batches: Iterable[pa.RecordBatch], names: list[str], limit: int, size) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of about ``limit`` that cut no run of equal names; and where each run begins, and the end."""

    def runs(t: pa.Table) -> np.ndarray:
        cut = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in names:
            x = t.column(c).to_numpy()
            cut |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [t.num_rows]])

    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += size(batch)
        if have >= limit:
            t = pa.Table.from_batches(held)
            at = runs(t)
            if len(at) > 2:
                yield t.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = t.slice(at[-2]).to_batches()
            have = sum(map(size, held))
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, runs(t)


def _near(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(lead, doc, n) of those that want a partner and whose points allow one in the cell or block. Two that are both of the upper size, or both want none, aren't held against each other."""
    for t, at in _tasks(batches, ["lead", "x", "y"], 16 << 20, lambda b: b.nbytes):
        lead, doc, n = (t.column(c).to_numpy() for c in ("lead", "doc", "n"))
        order = np.lexsort((n, np.repeat(np.arange(len(at) - 1), np.diff(at))))
        lead, doc, n = lead[order], doc[order], n[order]
        high, wants = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in ("high", "wants"))
        raw = t.column("point").to_pylist()
        fine = [np.frombuffer(raw[i], np.uint8) for i in order.tolist()]
        open_ = wants.copy()  # who looks for a partner still
        m = np.diff(at)
        small = np.flatnonzero((m > 1) & (m <= LEAF))
        own = tk.gather(at[small], m[small])
        if len(own):
            point = np.zeros((len(doc), GROUPS), np.int32)
            point[own] = np.stack([folded(fine[i], GROUPS, n[i]) for i in own.tolist()])
            after = np.repeat(at[1:][small], m[small]) - own - 1
            a, b = np.repeat(own, after), tk.gather(own + 1, after)
            fit = (doc[a] != doc[b]) & (n[a] * 100 >= percent * n[b]) & ~(high[a] & high[b]) & (wants[a] | wants[b])
            a, b = a[fit], b[fit]
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                ok = _bound(point[x], point[y]) >= needed(n[x], n[y], percent)
                for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                    if (open_[p] or open_[q]) and bound(fine[p], fine[q], n[p], n[q]) >= needed(n[p], n[q], percent):
                        open_[p] = open_[q] = False
        for f, e in zip(at[:-1][m > LEAF].tolist(), at[1:][m > LEAF].tolist()):
            _search(fine[f:e], doc[f:e], n[f:e], high[f:e], open_[f:e], percent)
        good = wants & ~open_
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (lead, doc, n)], names=["lead", "doc", "n"])


def _search(fine: list[np.ndarray], doc: np.ndarray, n: np.ndarray, high: np.ndarray, open_: np.ndarray, percent: int) -> None:
    """Takes from ``open_`` who has a possible partner among the points, which come by size: over half of their groups first, then over all."""
    groups = min(map(len, fine))
    levels = []
    for g in (max(groups // 2, GROUPS), groups):
        point = np.stack([folded(x, g, m) for x, m in zip(fine, n.tolist())])
        levels.append(point.astype(np.uint8) if point.max() < 256 else point)
    first = np.searchsorted(n * 100, percent * n)  # the least partner in size

    def hold(i: int, j: np.ndarray) -> None:
        j = j[(open_[j] | open_[i]) & ~(high[j] & high[i]) & (doc[j] != doc[i])]
        for point in levels:
            if not len(j):
                return
            j = j[np.minimum(point[j], point[i]).sum(axis=1, dtype=np.int64) >= needed(n[j], n[i], percent)]
        if len(j):
            open_[i] = False
            open_[j] = False

    for i in range(1, len(n)):
        near = max(int(first[i]), i - BESIDE)
        hold(i, np.arange(near, i))
        if near > first[i]:
            j = np.arange(first[i], near)
            hold(i, j if open_[i] else j[open_[j]])


_TASK = ["lead", "kind", "x", "y"]


def _linked(rows: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links a, b that join components: verified inside each task's documents, or with two kinds of sides between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _tasks(batches, _TASK, tk.SLICE_BYTES, lambda b: b.nbytes):
            flat, ends = sets(t.column("text").chunk(0), k)
            n = np.diff(ends)
            doc, side = t.column("doc").to_numpy(), t.column("side").to_numpy()
            names, component = np.unique(t.column("component").to_numpy(), return_inverse=True)
            kinds, codes = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(kinds), np.int32)
            groups = np.repeat(np.arange(len(n)) * GROUPS, n) + (flat & np.uint64(GROUPS - 1)).astype(np.int64)
            point = np.bincount(groups, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
            found = [np.zeros((0, 2), np.int64)]
            for f, e in zip(at.tolist(), at[1:].tolist()):
                if e - f > 1:
                    order = f + np.argsort(n[f:e], kind="stable")
                    sides = side[order] if side[f:e].min() != side[f:e].max() else None
                    pairs = _unite(Tree(point[order], n[order], component[order], sides), codes, ends[order], mark, percent)
                    found.append(doc[order][pairs])
            out = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return _by(rows.join(texts, "doc"), _TASK).mapInArrow(run, "a long, b long").distinct()


def _unite(tree: Tree, codes: np.ndarray, at: np.ndarray, mark: np.ndarray, percent: int) -> np.ndarray:
    """Verified links between different components of a tree's sets; each makes its two components one. mark is a blank for all codes."""
    out = []
    for i in range(1, len(tree.n)):
        j = tree.partners(i, percent)
        if not len(j):
            continue
        own = codes[at[i] : at[i] + tree.n[i]]
        mark[own] = 1
        some = 1
        while len(j):
            # a few of each component, then more
            j = j[np.argsort(tree.component[j], kind="stable")]
            c = tree.component[j]
            begins = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            rank = np.arange(len(j)) - np.repeat(begins, np.diff(np.append(begins, len(j))))
            now, j = j[rank < some], j[rank >= some]
            both = np.add.reduceat(mark[codes[tk.gather(at[now], tree.n[now])]], np.cumsum(tree.n[now]) - tree.n[now])
            for q in now[100 * both >= percent * (tree.n[now] + tree.n[i] - both)].tolist():
                if tree.component[q] != tree.component[i]:
                    out.append((q, i))
                    tree.join(q, i)
            j = j[tree.component[j] != tree.component[i]]
            some *= 4
        mark[own] = 0
    return np.array(out, np.int64).reshape(-1, 2)


def _stars(cells: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links a, b of the centres of heavy cells with their documents; a centre goes to every block of its cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for part in tk.slices(batches):
            flat, at = sets(part.column("text"), k)
            out = []
            names = ("lead", "block", "doc", "member")
            for lead, block, doc, member, a, b in zip(*(part.column(c).to_pylist() for c in names), at.tolist(), at[1:].tolist()):
                if (lead, block) != of:
                    of, held = (lead, block), []
                for other, one in held:
                    low, high = sorted((len(one), b - a))
                    if other != doc and low * 100 >= percent * high:
                        p = np.searchsorted(one, flat[a:b])
                        both = int((one[np.minimum(p, len(one) - 1)] == flat[a:b]).sum())
                        if 100 * both >= percent * (low + high - both):
                            out.append((other, doc))
                if not member:
                    held.append((doc, flat[a:b].copy()))
            links = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    member = ~F.array_contains("centres", F.col("doc"))
    block = F.when(member, F.array(F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = cells.select("lead", "doc", member.alias("member"), F.explode(block).alias("block")).join(texts, "doc")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "lead", "block").sortWithinPartitions("lead", "block", "member").mapInArrow(run, "a long, b long").distinct()


def _block_pairs(known: DataFrame) -> DataFrame:
    """Tasks for the documents of heavy cells: those outside the largest component of a cell, block by block, against its blocks and each other's."""
    per = known.groupBy("lead", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    main = per.groupBy("lead").agg(F.max_by("component", F.struct("docs", "component")).alias("main"), F.max(F.struct("docs", "component", "shingles")).alias("top"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"))
    parts = main.where("docs > top.docs").select("lead", "main", F.expr("docs - top.docs as d"), F.expr("shingles - top.shingles as s"), F.col("top.docs").alias("md"), F.col("top.shingles").alias("ms"))
    parts = parts.select("lead", "main", _blocks("md", "ms").alias("mains"), _blocks("d", "s").alias("rests"))
    rows = known.join(parts, "lead").withColumn("block", F.expr("cast(pmod(xxhash64(doc), if(component = main, mains, rests)) as int)"))
    to = """if(component = main,
        transform(sequence(0, rests - 1), j -> named_struct('kind', 1, 'x', block, 'y', j, 'side', 0)),
        concat(transform(sequence(0, mains - 1), i -> named_struct('kind', 1, 'x', i, 'y', block, 'side', 1)),
            transform(sequence(0, rests - 1), j -> named_struct('kind', 2, 'x', least(block, j), 'y', greatest(block, j), 'side', cast(block > j as int)))))"""
    return rows.select("lead", F.explode(F.expr(to)).alias("t"), "doc", "component").select("lead", "t.*", "doc", "component")
