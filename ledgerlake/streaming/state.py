"""Keyed state by event time: windows that close once, and a manifest that admits a record once. Output is append-only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlake.plans.registry import query
from ledgerlake.sources.sinks import shared_path
from ledgerlake.sources.tables import load
from ledgerlake.streaming.batches import _AT, DAYS, events

#: A window's rows are dealt over so many keys by their id, so that a window that holds most rows has no hot task, and equal ids meet.
SHARDS = 64
DELAY = "1 day"
CLOSED, EMPTY, TRUNCATED, REPEATED, UNATTESTED = "CLOSED", "EMPTY_ATTESTED", "TRUNCATED", "REPEATED", "UNATTESTED"
ADMITTED, REFUSED = "ADMITTED", "CONFLICT"


@contextmanager
def kept_on_disk(spark: SparkSession) -> Iterator[None]:
    """Timers and lists of state need the store that keeps state on disk; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def appended(stream: DataFrame, home: str, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all that is there and return what all runs so far have appended, each batch passed through finish.

    A batch has its own folder, which a repeated attempt writes anew; an error in finish fails the stream before the folder
    is complete, and a restart meets the same batch again.
    """
    spark, schema = stream.sparkSession, []

    def keep(df: DataFrame, batch: int) -> None:
        out = finish(df)
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")

    with kept_on_disk(spark):
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    reader = spark.read.schema(schema[0]) if schema else spark.read  # a run without a batch has no schema of its own; earlier ones left theirs
    return reader.parquet(f"{home}/rows").drop("batch")


class WindowState(StatefulProcessor):
    """State of a (window, shard): rows so far, their sum, the attested total, and the ids, a chunk a batch. A timer at the
    window's end emits one row and drops the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, cents long, total long")
        self.ids = handle.getListState("ids", "ids binary")

    def handleInputRows(self, key, rows, timerValues):
        close = int(key[1])
        held = self.sums.get()
        if held is None:
            self.handle.registerTimer(close * 1000)
        n, cents, total = held or (0, 0, None)
        for pdf in rows:
            attested = pdf["total"].notna()
            for t in pdf.loc[attested, "total"].astype("int64"):
                total = int(t) if total in (None, int(t)) else -1  # attestations that differ fit no count
            own = pdf.loc[~attested]
            if len(own):
                n, cents = n + len(own), cents + int(own["cents"].fillna(0).sum())
                self.ids.appendValue((own["id"].astype("int64").to_numpy().tobytes(),))
        self.sums.update((n, cents, total))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, cents, total = self.sums.get()
        ids = [np.frombuffer(c[0], np.int64) for c in self.ids.get()]
        distinct = len(np.unique(np.concatenate(ids))) if ids else 0
        self.sums.clear()
        self.ids.clear()
        yield pd.DataFrame({"start": [int(key[0])], "close": [int(key[1])], "n": [n], "repeated": [n - distinct], "cents": [cents], "total": pd.array([total], "Int64")})

    def close(self) -> None:
        pass


def closed_windows(rows: DataFrame, attested: DataFrame, home: str, on_failure: str = "stop", delay: str = DELAY) -> DataFrame:
    """(start, close, n, cents, total, status): each window (start, close], once, when the watermark has passed its end.

    rows: a stream of (id, ts, cents), ids not null; rows without a time are no rows of any window. attested: a stream of
    (ts, total), the number of rows that the window of ts has by its source. A window is CLOSED if it holds as many
    distinct rows as attested, EMPTY_ATTESTED if that is none; else TRUNCATED, REPEATED or UNATTESTED, which stop the stream
    ("stop") or are told in the status ("tell"). A row that comes after its window's end was passed is not taken up, so a
    source that is late by more than delay is told by its count.
    """
    at = lambda ts: F.window(ts - F.expr("interval 1 microsecond"), f"{DAYS} days", startTime="4 days")
    null = F.lit(None).cast("long")
    rows = rows.where("ts is not null").select("id", F.col("ts").cast("timestamp").alias("ts"), "cents", null.alias("total")).withWatermark("ts", delay)
    # rows alone move the watermark; a total counts as of its window's last instant, so that it is late when the window is closed
    attested = attested.where("ts is not null").select(at(F.col("ts").cast("timestamp")).alias("w"), "total")
    both = rows.unionByName(attested.select(null.alias("id"), F.col("w.end").alias("ts"), null.alias("cents"), F.col("total").cast("long").alias("total")))
    keyed = both.withColumn("w", at(F.col("ts"))).select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("close"), F.coalesce(F.pmod(F.xxhash64("id"), F.lit(SHARDS)), F.lit(0)).alias("shard"), "id", "ts", "cents", "total")
    out = keyed.groupBy("start", "close", "shard").transformWithStateInPandas(WindowState(), "start long, close long, n long, repeated long, cents long, total long", "Append", "EventTime")

    def finish(df: DataFrame) -> DataFrame:
        g = df.groupBy("start", "close").agg(F.sum("n").alias("n"), F.sum("repeated").alias("repeated"), F.sum("cents").alias("cents"), F.max("total").alias("total"))
        status = F.when(F.col("total").isNull(), UNATTESTED).when(F.col("repeated") > 0, REPEATED).when(F.col("n") != F.col("total"), TRUNCATED).when(F.col("n") == 0, EMPTY).otherwise(CLOSED)
        g = g.withColumn("status", status)
        if on_failure == "stop":
            g = g.withColumn("status", F.when(F.col("status").isin(CLOSED, EMPTY), F.col("status")).otherwise(F.raise_error(F.format_string("%s: window (%s, %s] holds %s of %s rows", "status", "start", "close", "n", "total"))))
        return g.select("start", "close", "n", "cents", "total", "status")

    return appended(out, home, finish)


def first_and_other(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each key's rows, the one with the least id, and the least whose record differs from that one's: all that a later
    step can need of these rows, so that a hot key leaves two rows a batch of Arrow."""
    pdf = pdf.sort_values("id", kind="stable")
    first = pdf.drop_duplicates("key")
    held = pdf["key"].map(first.set_index("key")["record"])
    differs = ~((pdf["record"] == held) | (pdf["record"].isna() & held.isna()))
    return pd.concat([first, pdf[differs].drop_duplicates("key")])


class Admission(StatefulProcessor):
    """State of a key: the record that was admitted first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "id long, record string")

    def handleInputRows(self, key, rows, timerValues):
        kept = None
        for pdf in rows:  # folded as they come: memory does not grow with a key's rows
            kept = first_and_other(pdf if kept is None else pd.concat([kept, pdf]))
        kept = kept.sort_values("id", kind="stable")
        records = [None if pd.isna(r) else r for r in kept["record"]]
        out = []
        if (held := self.held.get()) is None:
            held = (int(kept["id"].iloc[0]), records[0])
            self.held.update(held)
            out.append((int(key[0]), held[0], held[1], ADMITTED))
        if other := [(int(key[0]), int(i), r, REFUSED) for i, r in zip(kept["id"], records, strict=True) if r != held[1]]:
            out.append(other[0])
        yield pd.DataFrame(out, columns=["key", "id", "record", "verdict"])

    def close(self) -> None:
        pass


def manifest(stream: DataFrame, home: str, on_conflict: str = "tell") -> DataFrame:
    """(key, id, record, verdict) of a stream of (key, id, record): the first record of a key is ADMITTED, once.

    First is the least id of the first batch that holds the key. Equal records later change nothing; others are refused:
    CONFLICT is told once a batch and key, by the least such id ("tell"), or stops the stream ("stop"). A null record is a
    record like others; rows without a key or an id are not admitted.
    """
    rows = stream.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("record").cast("string").alias("record")).where("key is not null and id is not null")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield first_and_other(pdf)

    folded = rows.mapInPandas(fold, rows.schema)
    out = folded.groupBy("key").transformWithStateInPandas(Admission(), "key long, id long, record string, verdict string", "Append", "None")

    def finish(df: DataFrame) -> DataFrame:
        if on_conflict == "stop":
            return df.withColumn("verdict", F.when(F.col("verdict") == ADMITTED, F.col("verdict")).otherwise(F.raise_error(F.format_string("CONFLICT: key %s, id %s", "key", "id"))))
        return df

    return appended(out, home, finish)


ALL_FILES = 2**31 - 1


@query(f"""WITH w AS (SELECT CAST({_AT} AS BIGINT) AS start, * FROM events WHERE ts IS NOT NULL)
SELECT start, start + {DAYS * 86400} AS close, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS total, '{CLOSED}' AS status
FROM w GROUP BY start HAVING (start + {DAYS * 86400 + 86400}) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events)""")
def stream_closed_windows(spark, sf_dir):
    """Weekly windows by timers on event time, closed once, with attested counts; a window still open is not told."""
    home = shared_path(spark, "closed")
    at = F.window(F.col("ts").cast("timestamp") - F.expr("interval 1 microsecond"), f"{DAYS} days", startTime="4 days")
    totals = load(spark, sf_dir, "events").where("ts is not null").groupBy(at.alias("w")).agg(F.count("*").alias("total"))
    totals.select((F.col("w.start") + F.expr("interval 1 microsecond")).alias("ts"), "total").write.parquet(f"{home}/attested")
    rows = events(spark, f"{sf_dir}/events.parque[t]", ALL_FILES).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return closed_windows(rows, events(spark, f"{home}/attested", ALL_FILES), home)


@query(f"""WITH f AS (SELECT user_id, min(event_id) AS id, arg_min(props, event_id) AS record FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id AS key, id, record, '{ADMITTED}' AS verdict FROM f UNION ALL
SELECT user_id, min(event_id), arg_min(props, event_id), '{REFUSED}' FROM events JOIN f USING (user_id) WHERE props IS DISTINCT FROM record GROUP BY user_id""")
def stream_manifest(spark, sf_dir):
    """R2: keyed admission: a key's first record stays, equal ones change nothing, others are refused and told."""
    rows = events(spark, f"{sf_dir}/events.parque[t]", ALL_FILES).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("props").alias("record"))
    return manifest(rows, shared_path(spark, "manifest"))
