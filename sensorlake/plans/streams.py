"""Streaming queries (STR): the packet table is written as files, read as a stream and drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import LISTING, PACKET, listing, packets, sql
from sensorlake.plans.registry import query
from sensorlake.sources.shared import new_path
from sensorlake.streaming import packets as S


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in eight files by time, and one late sentinel in a file of its own that lets the watermark pass them all."""
    p = packets(spark, sf_dir)
    path = new_path(spark, "packet-stream")
    p.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/a")
    last = p.agg((F.max("ts") + F.expr("INTERVAL 800 DAYS")).alias("ts"))
    last.select(F.lit(-1).alias("apid"), F.lit(0).alias("seq_count"), F.lit(0).alias("pos"), F.lit(0).alias("data_len"), "ts").coalesce(1).write.parquet(f"{path}/b")
    return spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 4).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(path)


def deliveries(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """Packets in the order in which they arrive, up to ten minutes after their time, in some deliveries; and one packet of no id that closes the last stretch."""
    p = packets(spark, sf_dir).withColumn("_at", F.unix_seconds("ts") + F.pmod(F.col("pos").cast("long") * 7919, F.lit(600)))
    cuts = p.agg(F.percentile_approx("_at", [k / parts for k in range(1, parts)])).first()[0]
    which = sum((F.col("_at") > c).cast("int") for c in cuts)
    last = p.agg((F.max("ts") + F.expr("INTERVAL 8 DAYS")).alias("ts")).select(F.lit(-1).alias("apid"), F.lit(0).alias("seq_count"), F.lit(0).alias("pos"), F.lit(0).alias("data_len"), "ts")
    return [*[p.where(which == k).drop("_at") for k in range(parts)], last]


@query("str_01_gap_monitor", sql(PACKET, "l AS (SELECT *, lag(seq_count) OVER (PARTITION BY apid ORDER BY pos) AS previous FROM packet)", "SELECT apid, previous, seq_count, CAST((seq_count - (previous + 1) % 16384 + 16384) % 16384 AS INT) AS missing FROM l WHERE previous IS NOT NULL AND seq_count <> (previous + 1) % 16384"))
def str_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery is taken in by a run of its own, all from one checkpoint."""
    source, at = new_path(spark, "deliveries"), new_path(spark, "gaps")
    for d in deliveries(spark, sf_dir, 3):
        d.write.mode("append").parquet(source)
        found = S.drained(S.gap_monitor(spark.readStream.schema(d.schema).parquet(source), "10 minutes", "7 days"), "gaps", at)
    return S.closed_gaps(found.where("apid >= 0"))


@query("str_02_counts", sql(PACKET, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, apid, count(*) AS n, CAST(sum(data_len + 6) AS BIGINT) AS bytes FROM packet GROUP BY ALL"))
def str_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.counts(packet_stream(spark, sf_dir), "1 day", late="400 days"), "counts").where("apid >= 0")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_02_sliding_counts", sql(PACKET, "SELECT CAST(date_trunc('day', ts) - INTERVAL (k) DAY AS TIMESTAMP) AS start, apid, count(*) AS n, CAST(sum(data_len + 6) AS BIGINT) AS bytes FROM packet, range(2) r(k) GROUP BY ALL"))
def str_02_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drained(S.counts(packet_stream(spark, sf_dir), "2 days", "1 day", "400 days"), "sliding").where("apid >= 0")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_03_idempotent_arrivals", sql(LISTING, "SELECT page_id, size FROM listing"))
def str_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object arrives twice, in two deliveries, each taken in by a run of its own from one checkpoint; each is kept once."""
    ls = listing(spark, sf_dir).select("page_id", "size")
    source, target, checkpoint = (new_path(spark, n) for n in ("arrivals", "store-items", "arrivals-state"))
    for _ in range(2):
        ls.write.mode("append").parquet(source)
        S.arrivals_into(spark.readStream.schema(ls.schema).option("maxFilesPerTrigger", 8).parquet(source), "page_id", target, checkpoint)
    return S.arrived(spark, target)
