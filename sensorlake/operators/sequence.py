"""Packet streams: continuity, offsets, segment flags, reassembly, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions.packets import SEQUENCE

# Segment flags of packet headers.
CONTINUATION, FIRST, LAST, STANDALONE = 0, 1, 2, 3
PRIMARY = 6  # octets before the data field


WIDTH = 1 << 16  # positions of a stream that one task orders


def _spans(packets: DataFrame, keys: list[str], order: str, width: int, **summaries: Column) -> DataFrame:
    """The packets with _span, a stretch of positions, and for each summary what the spans before it give (_before_...). Packets are ordered inside
    spans only; across spans there is one row a span, so no task holds a whole stream."""
    x = packets.withColumn("_span", F.floor(F.col(order) / width))
    one = x.groupBy(*keys, "_span").agg(*[c.alias(n) for n, c in summaries.items()])
    w = Window.partitionBy(*keys).orderBy("_span")
    total = w.rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_before_{n}": F.coalesce(F.sum(n).over(total), F.lit(0)) if n.startswith("n_") else F.lag(n).over(w) for n in summaries}
    return x.join(one.select(*keys, "_span", *[v.alias(k) for k, v in before.items()]), [*keys, "_span"])


def gaps(packets: DataFrame, keys: list[str], order: str, width: int = WIDTH) -> DataFrame:
    """Packets whose counter does not follow the one before, with how many are missing."""
    x = _spans(packets, keys, order, width, last=F.max_by("seq_count", order))
    w = Window.partitionBy(*keys, "_span").orderBy(order)
    x = x.withColumn("previous", F.coalesce(F.lag("seq_count").over(w), "_before_last"))
    expected = F.pmod(F.col("previous") + 1, F.lit(SEQUENCE))
    x = x.where(F.col("previous").isNotNull() & (F.col("seq_count") != expected)).withColumn("missing", F.pmod(F.col("seq_count") - expected, F.lit(SEQUENCE)))
    return x.drop("_span", "_before_last")


def offsets(packets: DataFrame, keys: list[str], order: str, width: int = WIDTH) -> DataFrame:
    """Byte position of each packet, and whether the next one begins where it ends: by running sums, as they tile where nothing is missing."""
    size = F.col("data_len") + PRIMARY
    x = _spans(packets, keys, order, width, n_bytes=F.sum(size))
    w = Window.partitionBy(*keys, "_span").orderBy(order)
    x = x.withColumn("offset", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size + F.col("_before_n_bytes"))
    return x.withColumn("tiles", F.coalesce(F.lead("offset").over(w) == F.col("offset") + size, F.lit(True))).drop("_span", "_before_n_bytes")


def segment_flags(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Column seq_flags from the place of a part in its segment (keys)."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return parts.withColumn("seq_flags", F.when(n == 1, STANDALONE).when(i == 1, FIRST).when(i == n, LAST).otherwise(CONTINUATION))


def reassemble(packets: DataFrame, keys: list[str], order: str, width: int = WIDTH) -> DataFrame:
    """keys, segment, n, lengths, ok: parts between one first (or standalone) packet and the next, in order, with the grammar checked."""
    begins = F.when(F.col("seq_flags").isin(FIRST, STANDALONE), 1).otherwise(0)
    x = _spans(packets, keys, order, width, n_segments=F.sum(begins))
    w = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("segment", F.sum(begins).over(w) + F.col("_before_n_segments"))
    is_ = lambda f: F.count_if(F.col("seq_flags") == f)
    parts = F.array_sort(F.collect_list(F.struct(order, "data_len", "seq_flags")))
    g = x.groupBy(*keys, "segment").agg(parts.alias("parts"), F.count("*").alias("n"), is_(FIRST).alias("f"), is_(LAST).alias("l"), is_(STANDALONE).alias("s"))
    whole = (F.col("f") == 1) & (F.col("l") == 1) & (F.col("s") == 0) & (F.element_at("parts", -1)["seq_flags"] == LAST)
    return g.select(*keys, "segment", "n", F.transform("parts", lambda p: p["data_len"]).alias("lengths"), ((F.col("segment") > 0) & (((F.col("s") == 1) & (F.col("n") == 1)) | whole)).alias("ok"))


def stream_profile(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets, bytes and length range, and how many packets each id has."""
    per = packets.groupBy(*keys, "apid").agg(F.count("*").alias("n"), F.sum(F.col("data_len") + PRIMARY).alias("bytes"), F.min("data_len").alias("lo"), F.max("data_len").alias("hi"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("apid", "n"))), lambda x: F.concat_ws("=", x["apid"], x["n"])), ",")
    return per.groupBy(*keys).agg(F.sum("n").alias("packets"), F.sum("bytes").alias("bytes"), F.min("lo").alias("shortest"), F.max("hi").alias("longest"), counts.alias("by_apid"))


def member_profile(headers: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys, packets, coverage (octets up to the end of the last packet), tiles_exactly, broke_off_at (null where the member is read to its end),
    continuous (each id's counter), by_apid, by_flag, shortest, longest. headers: keys, size, offset, apid, seq_flags, seq_count, data_len; a member
    without packets has one row with nulls. Offsets of a walk tile by construction, so the end of the last packet is what was covered."""
    there = headers.where("offset IS NOT NULL")
    follows = F.lag("seq_count").over(Window.partitionBy(*keys, "apid").orderBy("offset"))
    marked = there.withColumn("_gap", F.coalesce(F.col("seq_count") != F.pmod(follows + 1, F.lit(SEQUENCE)), F.lit(False)))
    count = lambda c: marked.groupBy(*keys, c).agg(F.count("*").alias("n"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "n"))), lambda x: F.concat_ws("=", x[c], x["n"])), ",")
    by_apid, by_flag = (count(c).groupBy(*keys).agg(text(c).alias(n)) for c, n in (("apid", "by_apid"), ("seq_flags", "by_flag")))
    ends = F.col("offset") + F.col("data_len") + PRIMARY
    sums = marked.groupBy(*keys).agg(F.count("*").alias("packets"), F.max(ends).alias("coverage"), (~F.bool_or("_gap")).alias("continuous"), F.min("data_len").alias("shortest"), F.max("data_len").alias("longest"))
    x = headers.groupBy(*keys).agg(F.max(size).alias("bytes")).join(sums, keys, "left").join(by_apid, keys, "left").join(by_flag, keys, "left")
    x = x.fillna(0, ["packets", "coverage"]).fillna("", ["by_apid", "by_flag"]).withColumn("continuous", F.coalesce("continuous", F.lit(True)))
    whole = F.col("coverage") == F.col("bytes")
    return x.withColumns({"tiles_exactly": whole, "broke_off_at": F.when(~whole, F.col("coverage"))})
