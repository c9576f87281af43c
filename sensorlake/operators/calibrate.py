"""Calibration from dark and flat acquisitions: two-level aggregations over columns and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_dark(acq: DataFrame, keys: list[str]) -> DataFrame:
    return acq.where("kind = 'dark'").groupBy(*keys, "col").agg(F.avg("dn").alias("dark"))


def column_means(acq: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, d (mean dark), f (mean flat): one pass for both kinds."""
    return acq.groupBy(*keys, "col").agg(F.avg(F.when(F.col("kind") == "dark", F.col("dn"))).alias("d"), F.avg(F.when(F.col("kind") == "flat", F.col("dn"))).alias("f"))


def relative_response(acq: DataFrame, keys: list[str], radiance: float) -> DataFrame:
    """keys, col, response (mean 1; 1 where the signal is not positive), abs_coef."""
    w = Window.partitionBy(*keys)
    s = column_means(acq, keys).withColumn("signal", F.when(F.col("f") > F.col("d"), F.col("f") - F.col("d")))
    raw = 1.0 / F.col("signal")
    return s.select(*keys, "col", F.coalesce(raw / F.avg(raw).over(w), F.lit(1.0)).alias("response"), (F.avg("signal").over(w) / radiance).alias("abs_coef"))


def two_point(acq: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, gain, offset (single precision, null where a column cannot be told), dark (of the band)."""
    w = Window.partitionBy(*keys)
    m = column_means(acq, keys).withColumns({"md": F.avg("d").over(w), "mf": F.avg("f").over(w)})
    g = F.try_divide(F.col("mf") - F.col("md"), F.col("f") - F.col("d"))
    return m.withColumn("g", g).select(*keys, "col", F.col("g").cast("float").alias("gain"), (F.col("mf") - F.col("g") * F.col("f")).cast("float").alias("offset"), F.col("md").alias("dark"))


def radiance_gain(acq: DataFrame, keys: list[str], radiance: float) -> DataFrame:
    """keys, gain: radiance over the mean signal; null where it is not positive."""
    m = acq.groupBy(*keys).agg(F.avg(F.when(F.col("kind") == "flat", F.col("dn"))).alias("f"), F.avg(F.when(F.col("kind") == "dark", F.col("dn"))).alias("d"))
    return m.select(*keys, F.when(F.col("f") > F.col("d"), radiance / (F.col("f") - F.col("d"))).alias("gain"))


def running_mean(profile: DataFrame, keys: list[str], value: str, width: int, out: str) -> DataFrame:
    """Mean of `width` neighbours (odd, clamped to the profile's size) with reflected ends, by an index join on the profile."""
    n = profile.groupBy(*keys).agg((F.max("col") + 1).alias("_n"))
    k = F.greatest(F.lit(3), F.least(F.lit(width), F.floor(F.col("_n") / 2) * 2 + 1)).cast("int")
    x = profile.join(F.broadcast(n), keys).withColumn("_k", k)
    half = F.floor(F.col("_k") / 2).cast("int")
    around = x.select(*keys, "col", "_n", "_k", F.explode(F.sequence(F.col("col") - half, F.col("col") + half)).alias("_i"))
    i = F.when(F.col("_i") < 0, -F.col("_i")).when(F.col("_i") >= F.col("_n"), 2 * (F.col("_n") - 1) - F.col("_i")).otherwise(F.col("_i"))
    source = profile.select(*keys, F.col("col").alias("_j"), F.col(value).alias("_v"))
    means = around.withColumn("_j", i).join(source, [*keys, "_j"]).groupBy(*keys, "col").agg((F.sum("_v") / F.max("_k")).alias(out))
    return profile.join(means, [*keys, "col"])


def column_prnu(pixels: DataFrame, keys: list[str], width: int = 33) -> DataFrame:
    """keys, col, prnu: column medians over their trend, scaled to a median of 1."""
    med = pixels.groupBy(*keys, "col").agg(F.percentile("dn", F.lit(0.5)).alias("m"))
    r = running_mean(med, keys, "m", width, "trend").withColumn("r", F.coalesce(F.try_divide(F.col("m"), F.col("trend")), F.lit(1.0)))
    mid = r.groupBy(*keys).agg(F.percentile("r", F.lit(0.5)).alias("_mid"))
    return r.join(F.broadcast(mid), keys).select(*keys, "col", (F.col("r") / F.col("_mid")).alias("prnu"))


def column_floor(pixels: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """keys, col, dark: a low percentile of each column."""
    return pixels.groupBy(*keys, "col").agg(F.percentile("dn", F.lit(share)).alias("dark"))


def column_fpn(pixels: DataFrame, keys: list[str], value: str = "dn", width: int = 31) -> DataFrame:
    """keys, fpn: deviation of column means of positive pixels around their trend, relative to it."""
    col = pixels.groupBy(*keys, "col").agg(F.avg(F.when(F.col(value) > 0, F.col(value))).alias("_m"))
    fill = F.coalesce(F.avg("_m").over(Window.partitionBy(*keys)), F.lit(0.0))
    col = col.withColumn("_m", F.coalesce("_m", fill))
    r = running_mean(col, keys, "_m", width, "_t").withColumn("_r", (F.col("_m") - F.col("_t")) / F.greatest(F.abs("_t"), F.lit(1e-6)))
    return r.groupBy(*keys).agg(F.stddev_pop("_r").alias("fpn"))


def collapse_sublines(dark: DataFrame, keys: list[str]) -> DataFrame:
    """Dark values of several sub-lines as their mean by column."""
    return dark.groupBy(*keys, "col").agg(F.avg("dark").alias("dark"))


def recovery(estimate: DataFrame, truth: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, mean_error, std_error, correlation of an estimated column vector to the truth."""
    x = estimate.select(*keys, "col", F.col(name).cast("double").alias("e")).join(truth.select(*keys, "col", F.col(name).cast("double").alias("t")), [*keys, "col"])
    return x.groupBy(*keys).agg(F.avg(F.col("e") - F.col("t")).alias("mean_error"), F.stddev_pop(F.col("e") - F.col("t")).alias("std_error"), F.corr("e", "t").alias("correlation"))
