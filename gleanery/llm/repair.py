"""Token files compressed by pair grammars (Re-Pair), one grammar a shard.

A shard holds the ids of consecutive documents.  Rounds of replacement turn
frequent pairs of symbols into nonterminals; the shard stores the rules, the
expansion length of each and the documents' ends, so any document, or any span
of ids, can be decoded without expanding the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from . import textkit as tk
from . import tokens

#: Ids of a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: A pair that occurs less often in its shard isn't replaced.
MIN_COUNT = 8
FILE = "part int, shard int, part_start long, n_ids long, terminals int, doc_ids binary, doc_ends binary, left binary, right binary, expand binary, body binary"


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(body, left, right, terminals): rule i expands symbol ``terminals + i`` to left[i], right[i].

    Rounds go on until none of the hashes of pairs shows one that can be
    replaced ``min_count`` times.
    """
    body = np.asarray(ids, np.uint64)
    terminals = int(body.max()) + 1 if len(body) else 0
    left, right, symbols = [], [], terminals
    live = np.arange(max(len(body) - 1, 0))  # where pairs begin that may be frequent: no other becomes so without a new symbol
    turn = idle = 0
    while len(live) >= min_count and idle < len(_ODD):
        bits = max(10, min(22, int(len(live)).bit_length()))
        pairs = (body[live] << np.uint64(32)) | body[live + 1]
        # pairs meet in slots; where two share a slot, the other waits for another round's hash
        slot = ((pairs * _ODD[turn % len(_ODD)]) >> np.uint64(64 - bits)).astype(np.int32)
        often = (np.bincount(slot, minlength=1 << bits) >= min_count)[slot]
        own, named, often = slot[often], pairs[often], live[often]
        live = often
        names = np.zeros(1 << bits, np.uint64)
        names[own[::-1]] = named[::-1]  # the first in the sequence
        is_it = names[own] == named
        often, own = often[is_it], own[is_it]
        counts = np.bincount(own, minlength=1 << bits)
        # a pair waits if another with the same first or second symbol is eight times as frequent
        some = np.flatnonzero(counts >= min_count)
        good = np.zeros(1 << bits, bool)
        good[some] = True
        for ends in (names[some] >> np.uint64(32), names[some] & np.uint64(0xFFFFFFFF)):
            ends = ends.astype(np.int64)
            most = np.zeros(int(ends.max(initial=0)) + 1, np.int64)
            np.maximum.at(most, ends, counts[some])
            good[some] &= counts[some] * 8 >= most[ends]
        chosen = good[own]
        hit, own = often[chosen], own[chosen]
        turn, idle = turn + 1, idle + 1
        if not len(hit):
            continue
        # of a run of overlapping matches every second is replaced
        starts = np.concatenate([[True], np.diff(hit) > 1])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
        take = (np.arange(len(hit)) - run) % 2 == 0
        at, which = hit[take], own[take]
        kept = np.bincount(which, minlength=1 << bits) >= min_count
        ok = kept[which]
        at, which = at[ok], which[ok]
        if not len(at):
            continue
        idle = 0
        number = np.cumsum(kept) - 1 + symbols
        left.append((names[kept] >> np.uint64(32)).astype(np.uint32))
        right.append((names[kept] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        symbols += int(kept.sum())
        stays = np.ones(len(body), bool)
        stays[at + 1] = False
        body = body.copy()
        body[at] = number[which].astype(np.uint64)
        fresh, again = np.zeros(len(body), bool), np.zeros(len(body), bool)
        fresh[at] = again[live] = True
        body, fresh, again = body[stays], fresh[stays], again[stays] | fresh[stays]
        again[:-1] |= fresh[1:]
        live = np.flatnonzero(again[:-1])
    none = np.zeros(0, np.uint32)
    return body.astype(np.uint32), np.concatenate([none, *left]), np.concatenate([none, *right]), terminals


def expansions(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to. A rule uses terminals and earlier rules only."""
    out = np.zeros(len(left), np.int64)
    done = np.zeros(len(left), bool)
    size = lambda x: np.where(x < terminals, 1, out[np.maximum(x.astype(np.int64) - terminals, 0)])
    known = lambda x: (x < terminals) | done[np.maximum(x.astype(np.int64) - terminals, 0)]
    while not done.all():
        now = ~done & known(left) & known(right)
        out[now] = size(left[now]) + size(right[now])
        done |= now
    return out


def expand(body: np.ndarray, left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    body = np.asarray(body, np.int64)
    while True:
        rule = body >= terminals
        if not rule.any():
            return body.astype(np.uint32)
        at = np.arange(len(body)) + np.cumsum(rule) - rule
        out = np.empty(len(body) + int(rule.sum()), np.int64)
        out[at[~rule]] = body[~rule]
        which = body[rule] - terminals
        out[at[rule]], out[at[rule] + 1] = left[which], right[which]
        body = out


class Shard:
    """One row of a token file, opened for random access."""

    def __init__(self, row: dict):
        u4 = lambda k: np.frombuffer(row[k], "<u4")
        self.doc_ids, self.doc_ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_ends"], "<i8")
        self.left, self.right, self.body, self.terminals = u4("left"), u4("right"), u4("body"), row["terminals"]
        self.expand = np.frombuffer(row["expand"], "<u4")
        self.ends: np.ndarray | None = None

    def all(self) -> np.ndarray:
        return expand(self.body, self.left, self.right, self.terminals)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; only the symbols that cover them are expanded."""
        if self.ends is None:
            body = self.body.astype(np.int64)
            self.ends = np.cumsum(np.where(body < self.terminals, 1, self.expand[np.maximum(body - self.terminals, 0)] if len(self.expand) else 1))
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.body[a : b + 1], self.left, self.right, self.terminals)[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.doc_ends[i - 1]) if i else 0, int(self.doc_ends[i]))


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, cut_at: str = "words", shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Encode all texts and write them as a token file: rows in ascending doc_id order.

    docs: doc_id and text; other columns are left out, a null text is an empty
    one, a null doc_id sorts first and is stored as the least integer, repeated
    rows are written each.  A shard is encoded by one task from a range of
    doc_id; ranges follow the data, so a hot source or language costs nothing.
    """
    none = np.iinfo(np.int64).min

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer, cut_at)
        part, shard, done = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def shut() -> pa.RecordBatch:
            nonlocal shard, done, size
            ids = np.concatenate([h[0] for h in held])
            doc_ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            body, left, right, terminals = compress(ids)
            raw = [doc_ids.astype("<i8"), np.cumsum(lengths).astype("<i8"), left, right, expansions(left, right, terminals).astype("<u4"), body.astype("<u4")]
            out = pa.RecordBatch.from_pylist([dict(zip(SHARD.names, [part, shard, done, len(ids), terminals, *(x.tobytes() for x in raw)]))], SHARD)
            shard, done, size = shard + 1, done + len(ids), 0
            held.clear()
            return out

        for rows in tk.slices(batches, limit=tokens.SLICE):
            ids, at = coder.encode(rows.column("text"), end)
            doc_ids = rows.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False)
            lengths, i = np.diff(at), 0
            while i < len(lengths):  # a slice may be more than one shard
                to = max(i + 1, int(np.searchsorted(at, at[i] + shard_ids - size, "right")) - 1) if size < shard_ids else i
                if to > i:
                    held.append((ids[at[i] : at[to]], doc_ids[i:to], lengths[i:to]))
                    size, i = size + int(at[to] - at[i]), to
                if size >= shard_ids or i < len(lengths):
                    yield shut()
        if held:
            yield shut()

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, FILE).write.mode("overwrite").parquet(path)


SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("terminals", pa.int32()), *((k, pa.binary()) for k in ("doc_ids", "doc_ends", "left", "right", "expand", "body"))])


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token file, each with ``start``: the ids of the file before it.

    Only a total per writing task (as many rows as tasks) is put in order and broadcast.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked, ids. Shards are decoded whole."""
    none = np.iinfo(np.int64).min

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ids, ends = shard.all(), shard.doc_ends
                at = np.concatenate([[0], ends])
                doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == none)
                out = [doc_ids, pa.array(at[:-1] + row["start"]), pa.array(np.diff(at)), pa.array(tk.crc32s(ids, at))]
                if with_ids:
                    out.append(tk.int_lists(ids.astype(np.int32), at, pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return shards(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_file(docs: DataFrame, tokenizer: str, end: int = 2, cut_at: str = "words") -> str:
    """Write a token file into the shared folder; its path."""
    path = storage.fresh(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end, cut_at)
    return path
