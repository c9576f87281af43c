"""Coefficients to frames: widths, blind strips, defective columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_coefficients(pixels: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with the coefficients of their column. A wider vector is cropped around its centre, a narrower one repeats its last value."""
    width = pixels.groupBy(*keys).agg((F.max("col") + 1).alias("_w"))
    n = coef.groupBy(*keys).agg((F.max("col") + 1).alias("_n"))
    shift = F.broadcast(width.join(n, keys).select(*keys, F.greatest(F.floor((F.col("_n") - F.col("_w")) / 2), F.lit(0)).alias("_s"), "_n"))
    x = pixels.join(shift, keys).withColumn("_k", F.least(F.col("col") + F.col("_s"), F.col("_n") - 1).cast("int"))
    return x.join(F.broadcast(coef.withColumnRenamed("col", "_k")), [*keys, "_k"]).drop("_k", "_s", "_n")


def strip_blind(coef: DataFrame, blind: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients without blind columns, numbered densely. Where the width still differs from the frame's (keys, w), a centred window of the unstripped vector."""
    w = Window.partitionBy(*keys).orderBy("col")
    bare = coef.join(F.broadcast(blind), [*keys, "col"], "left_anti").withColumn("col", F.row_number().over(w) - 1)
    fits = bare.groupBy(*keys).agg(F.count("*").alias("_n")).join(widths, keys).where(F.col("_n") == F.col("w")).select(*keys)
    total = coef.groupBy(*keys).agg(F.count("*").alias("_n")).join(widths, keys)
    window = coef.join(fits, keys, "left_anti").join(total, keys).withColumn("col", (F.col("col") - F.greatest(F.floor((F.col("_n") - F.col("w")) / 2), F.lit(0))).cast("int")).where((F.col("col") >= 0) & (F.col("col") < F.col("w"))).drop("_n", "w")
    return bare.join(fits, keys, "left_semi").unionByName(window)


def insert_blind(pixels: DataFrame, blind: DataFrame, physical_width: int, keys: list[str], fill: int) -> DataFrame:
    """Frames with their blind columns put back; unchanged where active and blind columns do not add up to the physical width."""
    spark = pixels.sparkSession
    cols = spark.range(physical_width).select(F.col("id").cast("int").alias("p"))
    groups = pixels.groupBy(*keys).agg((F.max("col") + 1).alias("_w"))
    n_blind = groups.join(blind, keys, "left").groupBy(*keys, "_w").agg(F.count("col").alias("_b"))
    good = n_blind.where(F.col("_w") + F.col("_b") == physical_width).select(*keys)
    active = F.broadcast(good).crossJoin(cols).join(blind.withColumnRenamed("col", "p"), [*keys, "p"], "left_anti")
    active = active.withColumn("col", F.row_number().over(Window.partitionBy(*keys).orderBy("p")) - 1)
    moved = pixels.join(F.broadcast(active), [*keys, "col"]).drop("col").withColumnRenamed("p", "col")
    lines = pixels.join(F.broadcast(good), keys, "left_semi").select(*keys, "line").distinct()
    filled = lines.join(F.broadcast(blind), keys).withColumn("dn", F.lit(fill))
    rest = pixels.join(F.broadcast(good), keys, "left_anti")
    columns = [*keys, "line", "col", "dn"]
    return moved.select(columns).unionByName(filled.select(columns)).unionByName(rest.select(columns))


def stamp_defects(pixels: DataFrame, dead_cols: DataFrame, hot: DataFrame, keys: list[str], dn_max: int = 4095) -> DataFrame:
    """Dead columns to 0 and hot pixels to the maximum, with qa bits 1 and 2. Places outside of the frame have no pixel to match."""
    x = pixels.join(F.broadcast(dead_cols.select(*keys, "col", F.lit(1).alias("_d")).distinct()), [*keys, "col"], "left")
    x = x.join(hot.select(*keys, "line", "col", F.lit(2).alias("_h")).distinct(), [*keys, "line", "col"], "left")  # as many as there are frames: no hint
    dn = F.when(F.col("_h").isNotNull(), dn_max).when(F.col("_d").isNotNull(), 0).otherwise(F.col("dn"))
    return x.withColumn("qa", F.coalesce("_d", F.lit(0)).bitwiseOR(F.coalesce("_h", F.lit(0)))).withColumn("dn", dn).drop("_d", "_h")


def width_contract(pixels: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame_width, coef_width, ok."""
    a = pixels.groupBy(*keys).agg(F.count_distinct("col").alias("frame_width"))
    b = coef.groupBy(*keys).agg(F.count_distinct("col").alias("coef_width"))
    return a.join(b, keys, "full_outer").withColumn("ok", F.col("frame_width").eqNullSafe(F.col("coef_width")))
