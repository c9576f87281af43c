"""Times: tolerant parsing, formatting, GPS seconds, time codes, line times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds between the Unix and the GPS epoch, and leap seconds since.
GPS_EPOCH, LEAP_SECONDS = 315964800, 18


def parse_utc(text: Column) -> Column:
    """Timestamp of an ISO or compact text; null for anything else, the text 'null' included."""
    t = F.regexp_replace(F.trim(text), "Z$", "")
    formats = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def iso_millis(ts: Column) -> Column:
    """ISO text with milliseconds, truncated, and a Z."""
    return F.date_format(F.date_trunc("millisecond", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def gps_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6 - GPS_EPOCH + LEAP_SECONDS


def cuc(seconds: Column) -> Column:
    """Four octets of seconds and two of 1/65536 seconds as hexadecimal text; a fraction that rounds up to 65536 is masked to 0."""
    coarse = F.floor(seconds)
    fine = F.rint((seconds - coarse) * 65536.0).cast("long").bitwiseAND(F.lit(65535))
    return F.concat(F.lpad(F.hex(coarse.cast("long")), 8, "0"), F.lpad(F.hex(fine), 4, "0"))


def cuc_seconds(text: Column) -> Column:
    part = lambda s, n: F.conv(F.substring(text, s, n), 16, 10).cast("double")
    return part(1, 8) + part(9, 4) / 65536.0


def line_times(lines: DataFrame, keys: list[str], *, epoch: float, period: float, shift: Column) -> DataFrame:
    """t of each line, whether it lies after the line before, and whether a segment of eight lines begins."""
    w = Window.partitionBy(*keys).orderBy("line")
    x = lines.withColumn("t", epoch + F.col("line") * period + shift)
    return x.withColumn("monotone", F.coalesce(F.col("t") > F.lag("t").over(w), F.lit(True))).withColumn("segment_start", F.col("line") % 8 == 0)


def first_line_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, times: map from band number to (unit, value)."""
    entry = F.struct(F.col("band").alias("key"), F.struct(F.lit("s").alias("unit"), F.col("t").alias("value")).alias("value"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("times"))
