"""Resampling and stencils on long pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.operators import lineblocks


def unbin(pixels: DataFrame, factor: int, axis: str = "col") -> DataFrame:
    """Each pixel repeated `factor` times along an axis."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    x = pixels.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return x.withColumn(axis, F.col(axis) * factor + F.col("_i")).drop("_i")


def bin_mean(pixels: DataFrame, factor: int, keys: list[str], value: str = "dn", axis: str = "col") -> DataFrame:
    other = "line" if axis == "col" else "col"
    return pixels.groupBy(*keys, other, F.floor(F.col(axis) / factor).cast("int").alias(axis)).agg(F.avg(value).alias(value))


def blur(pixels: DataFrame, kernel: DataFrame, keys: list[str], value: str = "dn") -> DataFrame:
    """Circular convolution with a small kernel (dy, dx, w), by blocks of lines."""
    return lineblocks.convolve(pixels, kernel, keys, value)


def integrate_psf(matrix: DataFrame, keys: list[str], centre: int, oversampling: int) -> DataFrame:
    """keys, dy, dx, w: an oversampled kernel (r, c, w) summed to the detector grid and normalised."""
    k = matrix.groupBy(*keys, F.rint((F.col("r") - centre) / float(oversampling)).cast("int").alias("dy"), F.rint((F.col("c") - centre) / float(oversampling)).cast("int").alias("dx")).agg(F.sum("w").alias("w"))
    total = k.groupBy(*keys).agg(F.sum("w").alias("_t"))
    return k.join(total, keys).withColumn("w", F.col("w") / F.when(F.col("_t") != 0, F.col("_t")).otherwise(1.0)).drop("_t")


def quarter_turn(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Frames turned by a quarter: (line, col) goes to (width - 1 - col, line)."""
    w = pixels.groupBy(*keys).agg(F.max("col").alias("_w"))
    return pixels.join(F.broadcast(w), keys).withColumns({"line": F.col("_w") - F.col("col"), "col": F.col("line")}).drop("_w")


def to_blocks(pixels: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    """keys, by, bx, samples: values of each size x size block in row order."""
    cell = F.struct((F.col("line") % size * size + F.col("col") % size).alias("i"), "dn")
    g = pixels.groupBy(*keys, F.floor(F.col("line") / size).cast("int").alias("by"), F.floor(F.col("col") / size).cast("int").alias("bx")).agg(F.array_sort(F.collect_list(cell)).alias("s"))
    return g.select(*keys, "by", "bx", F.transform("s", lambda x: x["dn"]).alias("samples"))


def from_blocks(blocks: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    x = blocks.select(*keys, "by", "bx", F.posexplode("samples").alias("i", "dn"))
    return x.select(*keys, (F.col("by") * size + F.floor(F.col("i") / size)).cast("int").alias("line"), (F.col("bx") * size + F.col("i") % size).cast("int").alias("col"), "dn")


def restagger(pixels: DataFrame, shifts: DataFrame, keys: list[str], back: bool = False) -> DataFrame:
    """Columns rolled along the lines by their shift; back undoes it."""
    h = pixels.groupBy(*keys).agg((F.max("line") + 1).alias("_h"))
    s = -F.col("shift") if back else F.col("shift")
    x = pixels.join(h, keys).join(F.broadcast(shifts), [*keys, "col"], "left")
    return x.withColumn("line", F.pmod(F.col("line") + F.coalesce(s, F.lit(0)), F.col("_h"))).drop("_h", "shift")


def interpolate_lines(pixels: DataFrame, shifts: DataFrame, kernel: tuple[float, float, float], keys: list[str], value: str = "dn") -> DataFrame:
    """Columns with a shift convolved along the lines by three taps (reversed for a negative shift), zero outside of the frame."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "col").orderBy("line")
    x = pixels.join(F.broadcast(shifts), [*keys, "col"], "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    v = F.col(value).cast("double")
    after, before = F.lead(v, 1, 0.0).over(w), F.lag(v, 1, 0.0).over(w)
    k0, k1, k2 = kernel
    return x.withColumn(value, F.when(F.col("shift") > 0, k0 * after + k1 * v + k2 * before).when(F.col("shift") < 0, k2 * after + k1 * v + k0 * before).otherwise(v)).drop("shift")


def crosstalk(pixels: DataFrame, matrix: DataFrame, keys: list[str], value: str = "dn") -> DataFrame:
    """Each band gets the sum of its coefficients (k, l, coef) times the other bands at the same pixel; bands of another shape do not mix."""
    shape = pixels.groupBy(*keys, "band").agg((F.max("line") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    x = pixels.join(shape, [*keys, "band"])
    same = [*keys, "_h", "_w", "line", "col"]
    given = x.join(F.broadcast(matrix.where("coef <> 0").withColumnRenamed("l", "band")), "band").groupBy(*same, F.col("k").alias("band")).agg(F.sum(F.col("coef") * F.col(value)).alias("_x"))
    return x.join(given, [*same, "band"], "left").withColumn(value, F.col(value) + F.coalesce("_x", F.lit(0.0))).drop("_x", "_h", "_w")


def uniform_crosstalk(pixels: DataFrame, keys: list[str], coef: float, value: str = "dn") -> DataFrame:
    """One coefficient between all bands of a group: the total is a window over the bands of a pixel."""
    from pyspark.sql import Window

    total = F.sum(value).over(Window.partitionBy(*keys, "line", "col"))
    return pixels.withColumn(value, F.col(value) + coef * (total - F.col(value)))
