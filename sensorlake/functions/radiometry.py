"""Radiometric steps as column expressions. Inputs are columns of one row: a pixel and its coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DN_MAX = 4095
SATURATED = 32768  # sentinel kept out of valid masks
L1B_OFFSET = -100.0
NEWTON_STEPS = 6


def radiance_to_counts(radiance: Column, gain: Column) -> Column:
    return radiance * gain


def impress_response(dn: Column, response: Column) -> Column:
    return dn / response


def reapply_dark(dn: Column, dark: Column) -> Column:
    return dn + dark


def reapply_linear_eq(dn: Column, gain: Column, offset: Column) -> Column:
    return dn / gain + offset


def quantize(x: Column, dn_max: int = DN_MAX) -> Column:
    """Half-even rounding, then clipping."""
    return F.greatest(F.least(F.rint(x), F.lit(float(dn_max))), F.lit(0.0)).cast("int")


def undo_offset(dn: Column, offset: float = L1B_OFFSET) -> Column:
    """The step form: the product offset is taken off."""
    return dn - F.lit(offset)


def add_offset(dn: Column, offset: float = L1B_OFFSET) -> Column:
    """The chain form: the (negative) offset is added before the response is undone."""
    return dn + F.lit(offset)


def reverse_radiometric(radiance: Column, gain: Column, response: Column, dark: Column, eq_gain: Column, eq_offset: Column) -> Column:
    """Radiance to unquantized raw counts: gain, response, dark, linear equalization."""
    return reapply_linear_eq(reapply_dark(impress_response(radiance_to_counts(radiance, gain), response), dark), eq_gain, eq_offset)


def forward_radiometric(dn: Column, gain: Column, response: Column, dark: Column, eq_gain: Column, eq_offset: Column) -> Column:
    """The exact inverse of reverse_radiometric."""
    return ((dn - eq_offset) * eq_gain - dark) * response / gain


def bilinear(z: Column, a1: Column, a2: Column, zs: Column) -> Column:
    """A line with a knee at z = zs."""
    return F.when(z <= zs, a1 * z).otherwise(a2 * z + (a1 - a2) * zs)


def forward_equalize(z: Column) -> Column:
    """Relative response; coefficients are the columns a, b, c, a1, a2, zs, model."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return F.when(F.col("model") == "CUBIC", a * z * z * z + b * z * z + c * z).otherwise(bilinear(z, F.col("a1"), F.col("a2"), F.col("zs")))


def inverse_equalize(df: DataFrame, y: Column, out: str) -> DataFrame:
    """Column `out` with the inverse response: Newton steps from y / c for the cubic, the closed form for the knee."""
    a, b, c, a1, a2, zs = (F.col(x) for x in ("a", "b", "c", "a1", "a2", "zs"))
    df = df.withColumn("_y", y).withColumn("_z", F.col("_y") / c)
    z = F.col("_z")
    for _ in range(NEWTON_STEPS):
        df = df.withColumn("_z", z - (a * z * z * z + b * z * z + c * z - F.col("_y")) / (3.0 * a * z * z + 2.0 * b * z + c))
    knee = F.when(F.col("_y") <= a1 * zs, F.col("_y") / a1).otherwise((F.col("_y") - (a1 - a2) * zs) / a2)
    return df.withColumn(out, F.when(F.col("model") == "CUBIC", z).otherwise(knee)).drop("_y", "_z")


def forward_correct(x: Column) -> Column:
    """Dark is the column dark."""
    return forward_equalize(x - F.col("dark"))


def reverse_impress(df: DataFrame, y: Column, out: str) -> DataFrame:
    return inverse_equalize(df, y, out).withColumn(out, F.col(out) + F.col("dark"))


def noise_sigma(dn: Column, a: Column, b: Column) -> Column:
    """Standard deviation sqrt(a + b * dn); a is already a square."""
    return F.sqrt(F.greatest(a + b * F.greatest(dn, F.lit(0.0)), F.lit(0.0)))


def reference_count(snr: Column, alpha: Column, beta: Column) -> Column:
    """The count at which the noise model has this signal-to-noise ratio: the positive root of a quadratic."""
    s2 = snr * snr
    return (s2 * beta + F.sqrt(s2 * s2 * beta * beta + 4.0 * s2 * alpha * alpha)) / 2.0


def noise_split(dn_ref: Column, snr: Column, read_fraction: float = 0.1) -> tuple[Column, Column]:
    """a and b of the noise model from a signal-to-noise ratio, with a given share of read noise."""
    ratio = dn_ref / snr
    var = ratio * ratio
    a = F.lit(read_fraction) * var
    return a, (var - a) / dn_ref


def stretch(dn: Column, lo: Column, hi: Column) -> Column:
    """Grey value 0..255 between two percentiles; an empty span counts as one."""
    top = F.when(hi <= lo, lo + 1).otherwise(hi)
    return F.floor(F.greatest(F.least((dn - lo) / (top - lo), F.lit(1.0)), F.lit(0.0)) * 255.0).cast("int")


def stretch_to(dn: Column, p2: Column, p98: Column) -> Column:
    """Position between another frame's percentiles, clipped to 0..1."""
    return F.greatest(F.least((dn - p2) / (p98 - p2 + F.lit(1e-9)), F.lit(1.0)), F.lit(0.0))
