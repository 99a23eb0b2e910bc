"""Structured Streaming forms of the incremental jobs; a landing folder of Parquet files is the source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.sinks import Table, newest, upsert


def landing(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def intake(stream: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLUSTER = "start timestamp, ticker string, buyers long, trades long"


class DistinctBuyers(StatefulProcessor):
    """Of one window and ticker: a state row for each buyer, and two counts. All of it goes when the window has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "who string", "n long")
        self.counts = handle.getValueState("counts", "buyers long, trades long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buyers, trades = self.counts.get() if self.counts.exists() else (0, 0)
        ends = None
        for batch in rows:
            for who, n in batch.groupby("who").size().items():
                trades += int(n)
                if not self.known.containsKey((who,)):
                    self.known.updateValue((who,), (1,))
                    buyers += 1
            ends = batch["until"].max()
        self.counts.update((buyers, trades))
        self.handle.registerTimer(int(ends.timestamp() * 1000))
        yield pd.DataFrame({"start": [key[0]], "ticker": [key[1]], "buyers": [buyers], "trades": [trades]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def insider_clusters(stream: DataFrame, days: int = 30, late: str = "3 days", slide: str = "1 day") -> DataFrame:
    """Distinct buyers in sliding windows as filings arrive: the watermark is on the filing time, the window too.

    A window's buyers are a map in the state, a row each, so that no row grows with their number. It is dropped when the
    watermark passes the window's end, and rows later than that are too. The state store has to be ROCKS; see `drain`.
    """
    w = F.window("filed_at", f"{days} days", slide)
    rows = stream.withWatermark("filed_at", late).where("code = 'P'").select(w.alias("w"), "ticker", "filed_at", F.coalesce("reporter_cik", F.lit("")).alias("who"))
    rows = rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("until"), "ticker", "filed_at", "who")
    return rows.groupBy("start", "ticker").transformWithStateInPandas(DistinctBuyers(), CLUSTER, "Update", "eventTime")


def rollup(stream: DataFrame, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Sum, count and last value by day and key in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "key").agg(
        F.sum(value).alias("total"), F.count("*").alias("n"), F.max_by(value, time).alias("last")
    ).select(F.col("w.start").alias("day"), "key", "total", "n", "last")


def flag_late(stream: DataFrame, arrived: str, opened: str) -> DataFrame:
    """Rows logged after their session opened are kept, flagged and not scored."""
    return stream.withColumn("late", F.col(arrived) >= F.col(opened)).withColumn("scored", ~F.col("late"))


def keyed_sink(table: Table, keys: list[str], version: str):
    """For foreachBatch: upsert, so that a repeated or corrected batch overwrites by key."""

    def put(batch: DataFrame, _: int) -> None:
        upsert(table, newest(batch, keys, version), keys, version)

    return put


DELTA = "bucket int, key long, at long, value double, nth int, version long, delta double"
HELD = "version long, keys binary, times binary, values binary"
#: Of a snapshot without a time: it is its key's last.
_NEVER = 2**63 - 1


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in a column; missing values are equal."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= (c[1:] != c[:-1]) & ~((c[1:] != c[1:]) & (c[:-1] != c[:-1]))
    return out


def _deltas(keep: int):
    """For all keys of a bucket at once, in order of key, time and value; times are in microseconds."""

    def run(bucket, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, *held = state.get if state.exists else (0, b"", b"", b"")
        key, at, value = (np.frombuffer(b, kind) for b, kind in zip(held, ("<i8", "<i8", "<f8"), strict=True))
        new = np.zeros(len(key), bool)
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            key, at, value = (np.concatenate([a, rows[name].to_numpy(a.dtype)]) for name, a in (("key", key), ("at", at), ("value", value)))
            order = np.lexsort((value, at, key))  # stable: of equal snapshots the known ones come first
            key, at, value, new = key[order], at[order], value[order], order >= len(new)
        first = _starts(key)
        if new.any():
            delta = np.full(len(key), np.nan)
            near = ~first[1:] & ((at[1:] == _NEVER) | (np.diff(at) <= keep))
            delta[1:][near] = np.diff(value)[near]
            place = np.arange(len(key))
            nth = place - np.maximum.accumulate(np.where(_starts(key, at, value), place, 0))
            told = new.copy()
            told[1:] |= new[:-1] & ~first[1:]  # one that a new snapshot came before is told again
            yield pd.DataFrame({"bucket": bucket[0], "key": key[told], "at": at[told], "value": value[told], "nth": nth[told].astype("int32"), "version": version + 1, "delta": delta[told]})
        low = state.getCurrentWatermarkMs() * 1000
        until = np.maximum.reduceat(np.where(at == _NEVER, -_NEVER, at), np.flatnonzero(first)) + keep
        kept = (until > low)[np.cumsum(first) - 1]
        kept[:-1] &= first[1:] | (at[1:] > low)  # of a key's snapshots up to the watermark only the last one
        if kept.any():
            state.update((version + 1, *(a[kept].tobytes() for a in (key, at, value))))
            state.setTimeoutTimestamp(max(int(until[until > low].min()) // 1000 + 1, 1))
        elif state.exists:
            state.remove()

    return run


def deltas(stream: DataFrame, late: str = "3 days", keep_days: int = 90, buckets: int = 512) -> DataFrame:
    """Change of a key's value since the snapshot before it in time (key, time, value), in whatever order they arrive.

    The state holds a key's snapshots since the watermark, and the last one before. One that comes late makes the next one's
    row be told again, with a higher version; `latest_deltas` keeps the last. nth tells equal snapshots apart. A snapshot more
    than so many days after the one before has no delta, and a key's state goes when the watermark has passed that time
    after its last one. Rows that are later than the watermark are dropped.

    Keys are dealt into buckets by a hash, and a bucket's keys are one row of the state and one call of Python, whatever
    their number. A batch rewrites the buckets that it touches: choose their number by the state's size, and keep it for
    as long as a checkpoint is used.
    """
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    rows = stream.withWatermark("time", late).select(bucket.alias("bucket"), F.coalesce("key", F.lit(0)).cast("long").alias("key"), "time", F.coalesce(F.unix_micros("time"), F.lit(_NEVER)).alias("at"), "value")
    out = rows.groupBy("bucket").applyInPandasWithState(_deltas(keep_days * 86_400_000_000), DELTA, HELD, "append", "EventTimeTimeout")
    return out.select(F.expr("CASE WHEN bucket >= 0 THEN key END").alias("key"), F.when(F.col("at") < _NEVER, F.timestamp_micros("at")).alias("time"), "value", "nth", "version", "delta")


def latest_deltas(rows: DataFrame) -> DataFrame:
    """A row for each snapshot of what `deltas` has told: its last version."""
    return rows.groupBy("key", "time", "value", "nth").agg(F.max_by("delta", "version").alias("delta")).drop("nth")


def drain(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Run what has landed to its end, into Parquet or, where rows are updated, through the memory of a batch, and read it.

    The query keeps its state in RocksDB, on disk; the session's own choice of a store is as before when it returns.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return _drain(stream, spark, path, mode)
    finally:
        spark.conf.set(name, before)


def _drain(stream: DataFrame, spark: SparkSession, path: str, mode: str) -> DataFrame:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")
