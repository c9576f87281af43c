"""Packet streams as Structured Streaming jobs; the batch operators define what is correct."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sensorlake.functions.packets import SEQUENCE
from sensorlake.sources.shared import new_path


def counts(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Packets and octets by id and window. stream: apid, ts (timestamp), data_len."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(window.alias("w"), "apid").agg(F.count("*").alias("n"), F.sum(F.col("data_len") + 6).alias("bytes"))
    return out.select(F.col("w.start").alias("start"), "apid", "n", "bytes")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same by runs of packets with pauses shorter than the gap."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "apid").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "apid", "n")


def first_arrivals(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "apid int, kind string, bucket long, previous int, seq_count int, missing int, first int, last int, n long"


class _Buckets(StatefulProcessor):
    """State of one id and stretch of time: its packets, appended as they come and read once, when the watermark has passed the stretch."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, pos long, seq int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            self.waiting.appendList(list(zip((p["ts"].astype("datetime64[us]").astype("int64")).tolist(), p["pos"].tolist(), p["seq_count"].tolist(), strict=True)))
        self.handle.registerTimer((int(key[1]) + 1) * self.millis)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        seqs = [seq for _, _, seq in sorted(map(tuple, self.waiting.get()))]
        self.waiting.clear()
        apid, bucket = int(key[0]), int(key[1])
        out = [(apid, "gap", bucket, a, b, (b - a - 1) % SEQUENCE, None, None, None) for a, b in zip(seqs[:-1], seqs[1:], strict=True) if b != (a + 1) % SEQUENCE]
        if seqs:
            out.append((apid, "edge", bucket, None, None, None, seqs[0], seqs[-1], len(seqs)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def gap_monitor(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """apid, kind, bucket, and previous, seq_count, missing of counter gaps in event-time order, or first, last, n of an id's packets in a stretch of
    time, once the watermark has closed it. Late packets wait in their own stretch, so the state of an id is dealt out over stretches and no state
    value holds more than the packets of one. The state lies in RocksDB. closed_gaps() joins the stretches."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    millis = int(pd.Timedelta(width).total_seconds() * 1000)
    marked = stream.withWatermark("ts", late).select("apid", F.floor(F.unix_millis("ts") / millis).alias("bucket"), "ts", "pos", "seq_count")
    return marked.groupBy("apid", "bucket").transformWithStateInPandas(_Buckets(millis), _OUT, "Append", "EventTime")


def closed_gaps(monitored: DataFrame) -> DataFrame:
    """apid, previous, seq_count, missing of all closed stretches: gaps inside them, and those between one and the next, from a row a stretch."""
    w = Window.partitionBy("apid").orderBy("bucket")
    edges = monitored.where("kind = 'edge'").select("apid", F.lag("last").over(w).alias("previous"), F.col("first").alias("seq_count"))
    edges = edges.withColumn("missing", F.pmod(F.col("seq_count") - F.col("previous") - 1, F.lit(SEQUENCE)).cast("int")).where("previous IS NOT NULL AND missing <> 0")
    return monitored.where("kind = 'gap'").select("apid", "previous", "seq_count", "missing").unionByName(edges)


def drained(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """All that a stream has given so far: what is there now is taken in by one availableNow run. at: a folder that holds the results and the checkpoint;
    a later run with the same one goes on where this one ended. Without it every call starts anew."""
    spark = stream.sparkSession
    at = at or new_path(spark, name)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def merged(df: DataFrame, batch: int, key: str, path: str, buckets: int) -> None:
    """Add the rows of a batch whose key no earlier batch brought. A batch owns its folder and writes it anew, so one that runs twice, or broke off,
    leaves its rows once. Of earlier rows only the buckets of keys that the batch touches are read."""
    spark = df.sparkSession
    new = df.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    if _there(spark, path):
        known = spark.read.parquet(path).where(F.col("bucket").isin(touched) & (F.col("batch") < batch))
        new = new.join(known.select(key), key, "left_anti")
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def arrivals_into(stream: DataFrame, key: str, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Append rows whose key the table at path does not hold, for all that is there now. The named checkpoint numbers the batches and is resumed."""
    stream.writeStream.foreachBatch(lambda df, batch: merged(df, batch, key, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arrived(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch", "bucket")


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:  # no table yet
        return False
    return True
