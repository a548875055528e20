"""The incremental path: the same operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.dates import iso_week
from ..operators.queue import ATTEMPTS, LEASE_MINUTES
from ..sources.tables import overwrite_partitions, written


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, files: int | None = None) -> DataFrame:
    """A Parquet table of a folder, one file or several, as a stream; ``files`` at most in a batch."""
    read = spark.readStream.schema(schema)
    return (read.option("maxFilesPerTrigger", files) if files else read).parquet(f"{folder}/{name}.parque[t]")  # a pattern may be a file, a plain path may not


def weekly(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums per ISO week and type; rows up to ``late`` behind are taken."""
    week = F.window("ts", "7 days", "7 days", "4 days")  # the epoch was a Thursday
    out = stream.withWatermark("ts", late).groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(iso_week(F.to_date("w.start")).alias("week"), "event_type", "n", "total")


def first_seen(stream: DataFrame, key: str, within: str = "14 days") -> DataFrame:
    """Rows whose key hasn't been seen within the time."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


LEASE = LEASE_MINUTES * 60_000


class WorkQueue(StatefulProcessor):
    """An item's steps, and the clock: a claim takes an attempt while no lease is held, results end it, three failures close it.

    A timer stands at the end of every lease.  It goes off when the stream's
    time gets there, without any further step of the item, and closes one
    whose attempts are used up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, attempts int, claimed long")

    def _held(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("pending", 0, 0)

    def _row(self, key, status: str, attempts: int, claimed: int) -> pd.DataFrame:
        self.state.update((status, attempts, claimed))
        return pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts], "held": [claimed > 0]})

    def _free(self, claimed: int) -> None:
        if claimed:
            self.handle.deleteTimer(claimed + LEASE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, claimed = self._held()
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            at = r.ts.value // 1_000_000
            if r.step == "claim" and status == "pending" and attempts < ATTEMPTS and not (claimed and at < claimed + LEASE):
                self._free(claimed)
                attempts, claimed = attempts + 1, at
                self.handle.registerTimer(at + LEASE)
            elif r.step in ("done", "error") and status != "done":
                self._free(claimed)
                status, claimed = "done" if r.step == "done" else "failed" if attempts >= ATTEMPTS else "pending", 0
        yield self._row(key, status, attempts, claimed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, claimed = self._held()
        if claimed and expiredTimerInfo.getExpiryTimeInMs() >= claimed + LEASE:
            yield self._row(key, "failed" if status == "pending" and attempts >= ATTEMPTS else status, attempts, 0)

    def close(self) -> None:
        pass


#: Fixed value: the store that state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_queue(steps: DataFrame, late: str = "0 seconds") -> DataFrame:
    """id, status, attempts and whether a lease is held, of each queued link after a stream of steps (id, ts, step: claim, done or error) and as leases end."""
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return steps.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(WorkQueue(), "id long, status string, attempts int, held boolean", "update", "eventtime")


def drain_weeks(weeks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there now into a table by week, in update mode.

    A batch writes the weeks that it changes and no others: their rows are
    taken from the table, the changed ones replaced, and the weeks' folders
    written anew.  The watermark drops a week's counts once it is over and
    refuses rows that come later still, so a closed week is never written
    again, and what is kept is the open weeks.  A batch that is repeated writes
    the same rows.
    """
    spark, keys = weeks.sparkSession, ["week", "event_type"]

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        open_weeks = [r[0] for r in batch.select("week").distinct().collect()]  # as many as the watermark leaves open
        if open_weeks:
            try:
                there = spark.read.schema(weeks.schema).parquet(path).where(F.col("week").isin(open_weeks)).join(batch.select(keys), keys, "left_anti")
                rows = written(there.select(weeks.columns).unionByName(batch))
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                rows = batch  # no table yet
            overwrite_partitions(rows, path, "week")
        batch.unpersist()

    query = weeks.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into a table; a restart goes on where the checkpoint stands. In update mode rows have the number of their batch, and a repeated batch replaces its own."""
    path, schema = f"{checkpoint}/{name}-rows", frame.schema
    if mode == "update":
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        run, schema = frame.writeStream.outputMode(mode).foreachBatch(write), frame.schema.add("batch", "long")
    else:
        run = frame.writeStream.outputMode(mode).format("parquet").option("path", path)
    run.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(schema).parquet(path)
