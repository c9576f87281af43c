"""Compositions of radiometric steps, and small table operators around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions import radiometry as R
from sensorlake.operators import align, resample


def dark_shape(coef: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, shape: dark over its mean, taken over the whole vector before any crop."""
    return coef.select(*keys, "col", (F.col("dark") / F.avg("dark").over(Window.partitionBy(*keys))).alias("shape"))


def reverse_chain(pixels: DataFrame, coef: DataFrame, keys: list[str], *, dark_level: float, offset: float = R.L1B_OFFSET, onboard: DataFrame | None = None, unbin_factor: int = 1, shifts: DataFrame | None = None, kernel: tuple[float, float, float] | None = None, dead_cols: DataFrame | None = None) -> DataFrame:
    """Corrected counts to raw counts: offset, inverse response, on-board knee, dark pedestal, un-binning, re-staggering, defects, quantization.

    A step whose table is absent is left out. onboard: keys, col, o1, o2, os; shifts: keys, col, shift; dead_cols: keys, col (both by
    un-binned columns). With a kernel the shift is a three-tap convolution instead of a roll.
    """
    shape = dark_shape(coef, keys)
    x = align.with_coefficients(pixels, coef.join(shape, [*keys, "col"]), keys)
    x = R.inverse_equalize(x, R.add_offset(F.col("dn").cast("double"), offset), "v")
    if onboard is not None:
        x = align.with_coefficients(x, onboard, keys).withColumn("v", R.bilinear(F.col("v"), F.col("o1"), F.col("o2"), F.col("os")))
    x = x.select(*keys, "line", "col", (F.col("v") + dark_level * F.col("shape")).alias("dn"))
    if unbin_factor > 1:
        x = resample.unbin(x, unbin_factor)
    if shifts is not None:
        x = resample.restagger(x, shifts, keys) if kernel is None else resample.interpolate_lines(x, shifts, kernel, keys)
    value = R.quantize(F.round("dn", 9))
    if dead_cols is not None:
        x = x.join(F.broadcast(dead_cols.select(*keys, "col", F.lit(1).alias("_d")).distinct()), [*keys, "col"], "left")
        value = F.when(F.col("_d").isNotNull(), 0).otherwise(value)
    return x.select(*keys, F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), value.alias("dn"))


def deterministic_chain(pixels: DataFrame, column: DataFrame, keys: list[str], *, shifts: DataFrame | None = None, dead_cols: DataFrame | None = None) -> DataFrame:
    """Radiance (column radiance) to raw counts without noise and blur. column: keys, col, gain, response, dark, eq_gain, eq_offset."""
    x = pixels.join(F.broadcast(column), [*keys, "col"]).withColumn("dn", R.impress_response(R.radiance_to_counts(F.col("radiance"), F.col("gain")), F.col("response")))
    if shifts is not None:
        x = resample.restagger(x, shifts, keys)
    value = R.quantize(F.round(R.reapply_linear_eq(R.reapply_dark(F.col("dn"), F.col("dark")), F.col("eq_gain"), F.col("eq_offset")), 9))
    if dead_cols is not None:
        x = x.join(F.broadcast(dead_cols.select(*keys, "col", F.lit(1).alias("_d")).distinct()), [*keys, "col"], "left")
        value = F.when(F.col("_d").isNotNull(), 0).otherwise(value)
    return x.select(*keys, "line", "col", value.alias("dn"))


def apply_nuc(dn: Column, gain: Column, offset: Column, dark: Column, radiance_gain: Column) -> Column:
    """Two-point correction, dark, then radiance."""
    return (gain * dn + offset - dark) * radiance_gain


def reflectance(radiance: Column, solar: Column, zenith: Column, distance: float) -> Column:
    return F.lit(math.pi) * radiance * distance * distance / (solar * F.cos(zenith))


def percentile_stretch(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with their grey value between the 2nd and 98th percentile of their frame."""
    p = pixels.groupBy(*keys).agg(F.percentile("dn", F.array(F.lit(0.02), F.lit(0.98))).alias("_p"))
    return pixels.join(F.broadcast(p), keys).withColumn("grey", R.stretch(F.col("dn"), F.col("_p")[0], F.col("_p")[1])).drop("_p")


def composite(grey: DataFrame, channels: dict[int, str]) -> DataFrame:
    """line, col and a column for each channel, from the bands named."""
    x = grey.where(F.col("band").isin(*channels)).groupBy("line", "col").pivot("band", list(channels)).agg(F.max("grey"))
    return x.select("line", "col", *[F.col(str(b)).alias(name) for b, name in channels.items()])


def swap_estimates(truth: DataFrame, estimate: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The truth with the named columns replaced where an estimate exists."""
    e = estimate.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return truth.join(e, keys, "left").withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the dimension does not have."""
    return rows.select(key).distinct().join(F.broadcast(known), key, "left_anti")
