"""Frame profiles and comparison metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.radiometry import DN_MAX, SATURATED, noise_sigma
from sensorlake.operators import lineblocks


def frame_profile(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Shape, range, out-of-range and saturated counts and the bit depth that holds the values: one pass."""
    return pixels.groupBy(*keys).agg(
        (F.max("line") + 1).alias("n_lines"), (F.max("col") + 1).alias("n_cols"), F.min("dn").alias("dn_min"), F.max("dn").alias("dn_max"),
        F.count_if(F.col("dn") > DN_MAX).alias("n_above"), F.count_if(F.col("dn") == SATURATED).alias("n_saturated"), bit_depth(F.max("dn")).alias("bit_depth"),
    )


def bit_depth(highest: Column) -> Column:
    return F.when(highest <= DN_MAX, 12).otherwise(16)


def zero_tail(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_lines, lost: lines after the last one with data; all of an empty frame."""
    return pixels.groupBy(*keys).agg((F.max("line") + 1).alias("n_lines"), F.max(F.when(F.col("dn") != 0, F.col("line"))).alias("_l")).select(*keys, "n_lines", F.coalesce(F.col("n_lines") - 1 - F.col("_l"), F.col("n_lines")).alias("lost"))


def entropy(pixels: DataFrame, keys: list[str], value: str = "dn") -> DataFrame:
    """keys, entropy in bits a pixel: a histogram, then a sum over it."""
    h = pixels.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = h.groupBy(*keys).agg(F.sum("n").alias("_t"))
    p = F.col("n") / F.col("_t")
    return h.join(F.broadcast(total), keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def stage_row(pixels: DataFrame, keys: list[str], value: str = "dn") -> DataFrame:
    """Range, mean, deviation and signal-to-noise in decibels (null where the deviation is 0)."""
    s = pixels.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return s.withColumn("snr_db", F.when((F.col("std") > 0) & (F.col("mean") > 0), 20 * F.log10(F.col("mean") / F.col("std"))))


def compare(a: DataFrame, b: DataFrame, keys: list[str], peak: float = 4095.0) -> DataFrame:
    """Median |difference|, RMSE, PSNR, bias and percent error of pixels that both sides have."""
    at = [*keys, "line", "col"]
    x = a.select(*at, F.col("dn").cast("double").alias("x")).join(b.select(*at, F.col("dn").cast("double").alias("y")), at).withColumn("d", F.col("x") - F.col("y"))
    m = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.abs("d"), F.lit(0.5)).alias("median_abs"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("bias"), F.avg("y").alias("_m"))
    return m.withColumns({"psnr": F.when(F.col("rmse") > 0, 20 * F.log10(peak / F.col("rmse"))), "percent_error": 100 * F.try_divide(F.col("rmse"), F.col("_m"))}).drop("_m")


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_different: pixels of either side, and those that differ or have no partner."""
    at = [*keys, "line", "col"]
    x = a.select(*at, F.col("dn").alias("x")).join(b.select(*at, F.col("dn").alias("y")), at, "full_outer")
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("n_different"))


def framed(a: DataFrame, b: DataFrame, begin: DataFrame, keys: list[str]) -> DataFrame:
    """compare() of frame a with the part of b that begins at a line of b (keys, begin); a missing entry means 0."""
    moved = b.join(F.broadcast(begin), keys, "left").withColumn("line", F.col("line") - F.coalesce("begin", F.lit(0))).where("line >= 0")
    return compare(a, moved, keys)


def drift(a: DataFrame, b: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, shift, correlation of the best line shift within +-reach; the smallest shift wins a tie."""
    s = lineblocks.shifted_sums(a, b, keys, reach)
    vx, vy = (F.col("n") * F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") for v in "xy")
    c = s.where((vx > 0) & (vy > 0)).withColumn("cc", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy))
    best = F.max(F.struct(F.round("cc", 9).alias("cc"), (-F.col("shift")).alias("s")))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.s")).alias("shift"), F.col("b.cc").alias("correlation"))


def line_checksums(lines: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """keys, checksum: order-free over lines, from the CRC of each line's samples as text."""
    return lines.groupBy(*keys).agg(F.bit_xor(F.crc32(F.concat_ws(",", F.col("line").cast("string"), F.array_join(F.transform(samples, lambda v: v.cast("string")), ",")).cast("binary"))).alias("checksum"), F.count("*").alias("n_lines"))


def root_mean_square(pixels: DataFrame, keys: list[str], error: Column, out: str) -> DataFrame:
    """keys, n, the root of the mean squared error; nulls take no part."""
    return pixels.groupBy(*keys).agg(F.count(error).alias("n"), F.sqrt(F.avg(error * error)).alias(out))


def noise_check(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, sigma_measured (of noise over gain), sigma_model (mean of the noise model at the signal). pixels: noise, gain, signal, alpha, beta."""
    model = noise_sigma(F.col("signal"), F.col("alpha") * F.col("alpha"), F.col("beta"))
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(F.col("noise") / F.col("gain")).alias("sigma_measured"), F.avg(model).alias("sigma_model"))
