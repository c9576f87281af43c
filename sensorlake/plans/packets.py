"""Queries on packet streams (WIN-05..08, AGG-17, SCA-09..11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import PACKET, packets, sql
from sensorlake.functions import packets as P
from sensorlake.functions.numbers import steady
from sensorlake.functions.times import cuc, cuc_seconds, gps_seconds
from sensorlake.operators import sequence
from sensorlake.plans.registry import query

_OFF = "off AS (SELECT *, sum(data_len + 6) OVER (PARTITION BY apid ORDER BY pos ROWS UNBOUNDED PRECEDING) - (data_len + 6) AS o FROM packet)"
# Parts of segments: each run of five positions of a stream is one segment.
_SEG = "sg AS (SELECT *, pos // 5 AS seg, row_number() OVER (PARTITION BY apid, pos // 5 ORDER BY pos) AS i, count(*) OVER (PARTITION BY apid, pos // 5) AS n FROM packet), fg AS (SELECT *, CASE WHEN n = 1 THEN 3 WHEN i = 1 THEN 1 WHEN i = n THEN 2 ELSE 0 END AS seq_flags FROM sg)"


SPAN = 256  # positions; the tables have few packets an id


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("seg", F.floor(F.col("pos") / 5).cast("int"))
    return sequence.segment_flags(p, ["apid", "seg"], ["pos"])


@query("win_05_seq_gaps", sql(PACKET, "l AS (SELECT *, lag(seq_count) OVER (PARTITION BY apid ORDER BY pos) AS previous FROM packet)", "SELECT apid, pos, seq_count, previous, CAST((seq_count - (previous + 1) % 16384 + 16384) % 16384 AS INT) AS missing FROM l WHERE previous IS NOT NULL AND seq_count <> (previous + 1) % 16384"))
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gaps(packets(spark, sf_dir), ["apid"], "pos", SPAN).select("apid", "pos", "seq_count", "previous", "missing")


@query("win_06_offsets", sql(PACKET, _OFF, "SELECT apid, pos, CAST(o AS BIGINT) AS \"offset\", coalesce(lead(o) OVER (PARTITION BY apid ORDER BY pos) = o + data_len + 6, true) AS tiles FROM off"))
def win_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.offsets(packets(spark, sf_dir), ["apid"], "pos", SPAN).select("apid", "pos", "offset", "tiles")


@query("win_07_segment_flags", sql(PACKET, _SEG, "SELECT apid, pos, CAST(seq_flags AS INT) AS seq_flags FROM fg"))
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("apid", "pos", "seq_flags")


@query("win_08_reassembly", sql(PACKET, _SEG, "dr AS (SELECT * FROM fg WHERE pos % 23 <> 0)", "isl AS (SELECT *, sum(CASE WHEN seq_flags IN (1, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY apid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM dr)", "SELECT apid, CAST(segment AS BIGINT) AS segment, count(*) AS n, CAST(sum(data_len) AS BIGINT) AS bytes, segment > 0 AND ((count(*) FILTER (seq_flags = 3) = 1 AND count(*) = 1) OR (count(*) FILTER (seq_flags = 1) = 1 AND count(*) FILTER (seq_flags = 2) = 1 AND count(*) FILTER (seq_flags = 3) = 0 AND arg_max(seq_flags, pos) = 2)) AS ok FROM isl GROUP BY apid, segment"))
def win_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequence.reassemble(flagged(spark, sf_dir).where("pos % 23 <> 0"), ["apid"], "pos", SPAN)
    return r.select("apid", "segment", "n", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"), "ok")


@query("agg_17_packet_profile", sql(PACKET, "c AS (SELECT apid % 4 AS member, apid, count(*) AS n, sum(data_len + 6) AS b, min(data_len) AS lo, max(data_len) AS hi FROM packet GROUP BY apid)", "SELECT CAST(member AS INT) AS member, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes, min(lo) AS shortest, max(hi) AS longest, string_agg(apid || '=' || n, ',' ORDER BY apid) AS by_apid FROM c GROUP BY member"))
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.stream_profile(packets(spark, sf_dir).withColumn("member", F.col("apid") % 4), ["member"])


@query("sca_08_gps_seconds", sql(PACKET, "SELECT apid, pos, round(epoch_us(ts) / 1e6 - 315964800 + 18, 6) AS gps FROM packet"))
def sca_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("apid", "pos", steady(gps_seconds(F.col("ts"))).alias("gps"))


@query("sca_09_time_code", sql(PACKET, "t AS (SELECT apid, pos, pos * 1000003 % 4000000000 + (data_len % 97) / 128.0::DOUBLE AS s FROM packet)", "SELECT apid, pos, lpad(printf('%X', CAST(floor(s) AS BIGINT)), 8, '0') || lpad(printf('%X', CAST(round_even((s - floor(s)) * 65536, 0) AS BIGINT) & 65535), 4, '0') AS code, round(s, 6) AS seconds FROM t"))
def sca_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = packets(spark, sf_dir).withColumn("s", (F.col("pos").cast("long") * 1000003 % 4000000000) + (F.col("data_len") % 97) / 128.0)
    return t.withColumn("code", cuc(F.col("s"))).select("apid", "pos", "code", steady(cuc_seconds(F.col("code"))).alias("seconds"))


@query("sca_10_packet_header", sql(PACKET, _SEG, "SELECT apid, pos, lpad(printf('%X', CAST(2048 | (apid & 2047) AS BIGINT)), 4, '0') || lpad(printf('%X', CAST((seq_flags << 14) | seq_count AS BIGINT)), 4, '0') || lpad(printf('%X', CAST(data_len - 1 AS BIGINT)), 4, '0') AS header, CAST(apid AS INT) AS id, CAST(seq_flags AS INT) AS seq_flags, seq_count, data_len FROM fg"))
def sca_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = flagged(spark, sf_dir).withColumn("header", P.pack_header(F.col("apid"), F.col("seq_flags"), F.col("seq_count"), F.col("data_len")))
    back = h.withColumn("u", P.unpack_header(F.col("header")))
    return back.select("apid", "pos", "header", F.col("u.apid").alias("id"), F.col("u.seq_flags").alias("seq_flags"), F.col("u.seq_count").alias("seq_count"), F.col("u.data_len").alias("data_len"))


@query("sca_11_stream_id", sql(PACKET, "SELECT apid, pos, CAST((1280 + (pos % 12 + 1) * 16 + pos % 13) & 2047 AS INT) AS stream FROM packet"))
def sca_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("apid", "pos", P.stream_id(F.lit(1280), F.col("pos") % 12 + 1, F.col("pos") % 13).alias("stream"))
