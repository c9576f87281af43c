"""Validity in time, epochs, line matching and equality of several frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, right_id: str) -> DataFrame:
    """Each row with the latest right row that starts at or before its time (the smallest id of a start); null where there is none.

    Times become dates. Both sides are put on one time line by day, and the last start is carried forward: a window over distinct days,
    of which the calendar has few (36,525 in a century) however many rows there are.
    """
    left = left.withColumn(left_time, F.col(left_time).cast("date"))
    starts = right.groupBy(F.col(right_time).cast("date").alias("_t")).agg(F.min(right_id).alias(right_id))
    days = left.select(F.col(left_time).alias("_t")).distinct().join(starts, "_t", "full_outer")
    w = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(right_id).isNotNull(), F.struct(F.col("_t").alias("s"), right_id)), ignorenulls=True).over(w)
    line = days.withColumn("_l", last).select(F.col("_t").alias(left_time), F.col("_l.s").alias(right_time), F.col(f"_l.{right_id}").alias(right_id))
    return left.join(line, left_time, "left")


def applicable(left: DataFrame, files: DataFrame, time: str, file_id: str, kind: str, warn_years: float = 1.0) -> DataFrame:
    """left with, for each type of file, the one that applies: the last that starts at or before the day (the smallest id of a start), or the
    first of its type where all start later. files: file_id, kind, start, stop. Adds within_validity (the day is in [start, stop]), gap_days,
    gap_years (two decimals) and warn (outside, or a gap of more than warn_years).

    Each file of a type holds the interval to the next start; intervals are dealt out to their days, and rows meet them by an equi join
    on the day, so that a busy month is many keys; an interval is cut to the days that rows have. Windows run within a type over its distinct starts. Rows without a day have no file and are kept.
    """
    own = Window.partitionBy(kind).orderBy("start")
    first = files.where(F.col("start").isNotNull()).groupBy(kind, F.col("start").cast("date").alias("start")).agg(F.min(F.struct(file_id, F.col("stop").cast("date").alias("stop"))).alias("f"))
    held = first.select(kind, "start", f"f.{file_id}", "f.stop", F.when(F.lag("start").over(own).isNull(), F.lit("1900-01-01").cast("date")).otherwise(F.col("start")).alias("_lo"), F.coalesce(F.lead("start").over(own), F.lit("2200-01-01").cast("date")).alias("_hi"))
    x = left.withColumn("_d", F.col(time).cast("date"))
    span = x.agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))  # one row
    held = held.join(F.broadcast(span), (F.col("_lo") <= F.col("_b")) & (F.col("_hi") > F.col("_a")))
    held = held.withColumn("_d", F.explode(F.sequence(F.greatest("_lo", "_a"), F.least(F.date_sub("_hi", 1), "_b")))).drop("_lo", "_hi", "_a", "_b")
    x = x.join(held, "_d", "left")
    days = F.abs(F.datediff("_d", "start"))
    x = x.withColumns({"within_validity": F.col("_d").between(F.col("start"), F.col("stop")), "gap_days": days, "gap_years": F.round(days / 365.25, 2)})
    return x.withColumn("warn", F.coalesce((F.col("gap_years") > warn_years) | ~F.col("within_validity"), F.lit(True))).drop("_d")


def gap(rows: DataFrame, time: str, start: str, warn_days: int) -> DataFrame:
    """gap_days, gap_years, and warn where the gap is longer than wanted or nothing is valid."""
    days = F.abs(F.datediff(time, start))
    return rows.withColumns({"gap_days": days, "gap_years": days / 365.25, "warn": F.coalesce(days > warn_days, F.lit(True))})


def within_days(rows: DataFrame, epochs: DataFrame, time: str, epoch: str, days: int) -> DataFrame:
    """Rows paired with every epoch of which they are at most `days` after: one equi join on the day, epochs spread over their days."""
    spread = epochs.withColumn(time, F.explode(F.sequence(F.col(epoch), F.date_add(epoch, days))))
    return rows.join(spread, time)


def epoch_change(a: DataFrame, b: DataFrame, keys: list[str], index: list[str], value: str) -> DataFrame:
    """keys, n, mean_abs, mean_relative over the index that both epochs have."""
    x = a.select(*keys, *index, F.col(value).alias("a")).join(b.select(*keys, *index, F.col(value).alias("b")), [*keys, *index])
    d = F.abs(F.col("b") - F.col("a"))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_abs"), F.avg(d / (F.abs("a") + 1e-12)).alias("mean_relative"))


def shape_mismatch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b of those whose numbers of coefficients differ between two epochs, or that one of them lacks."""
    n = lambda x, name: x.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(a, "n_a").join(n(b, "n_b"), keys, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.where("n_a <> n_b")


def line_stride(fine: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups: keys, n (fine lines), m (lines of the group). keys, line, fine_line: each line of the group with the fine line it is sampled from."""
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("m")))
    x = fine.join(F.broadcast(groups.withColumn("_s", stride)), keys).where(F.col("line") % F.col("_s") == 0)
    return x.select(*keys, F.floor(F.col("line") / F.col("_s")).cast("int").alias("line"), F.col("line").alias("fine_line"), "m").where("line < m").drop("m")


def line_loss(reference: DataFrame, kept: DataFrame, tail: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kept_lines, lost_lines, loss_explained (the lost lines are the zero tail), identical (all kept pixels are equal)."""
    at = [*keys, "line", "col"]
    both = reference.select(*at, F.col("dn").alias("x")).join(kept.select(*at, F.col("dn").alias("y")), at)
    same = both.groupBy(*keys).agg((F.max("line") + 1).alias("kept_lines"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("identical"))
    lost = F.col("n_lines") - F.col("kept_lines")
    return same.join(tail, keys).select(*keys, "kept_lines", lost.alias("lost_lines"), (lost == F.col("lost")).alias("loss_explained"), "identical")


def three_way(source: DataFrame, decoded: DataFrame, consumer: DataFrame, keys: list[str]) -> DataFrame:
    """keys, decoded_equal, consumer_equal: source against decoded, decoded against consumer, pixel by pixel."""
    at = [*keys, "line", "col"]
    x = source.select(*at, F.col("dn").alias("a")).join(decoded.select(*at, F.col("dn").alias("b")), at, "full_outer").join(consumer.select(*at, F.col("dn").alias("c")), at, "full_outer")
    return x.groupBy(*keys).agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("decoded_equal"), F.bool_and(F.col("b").eqNullSafe(F.col("c"))).alias("consumer_equal"))
