"""Quality flags as integer bit fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.radiometry import DN_MAX

# Flag bits, and bits of the eight-plane mask.
NO_DATA, LOST, SATURATED, DEFECTIVE = 1, 2, 4, 8
MASK_LOST, MASK_DEFECTIVE, MASK_NODATA, MASK_SATURATED = 4, 16, 32, 128


def bit_if(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def all_bits(*bits: Column) -> Column:
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def seed_flags(pixels: DataFrame, dead_cols: DataFrame, hot: DataFrame, keys: list[str], dn_max: int = DN_MAX) -> DataFrame:
    """pixels with column qa. dead_cols: keys, col; hot: keys, line, col. Lines after the last one with data are lost; none are where all is zero."""
    last = pixels.where("dn <> 0").groupBy(*keys).agg(F.max("line").alias("_last"))
    x = pixels.join(F.broadcast(last), keys, "left")
    x = x.join(F.broadcast(dead_cols.select(*keys, "col", F.lit(True).alias("_dead")).distinct()), [*keys, "col"], "left")
    x = x.join(hot.select(*keys, "line", "col", F.lit(True).alias("_hot")).distinct(), [*keys, "line", "col"], "left")  # as many as there are frames: no hint
    qa = all_bits(
        bit_if(F.col("dn") >= dn_max, SATURATED), bit_if(F.col("dn") == 0, NO_DATA), bit_if(F.col("_dead").isNotNull() | F.col("_hot").isNotNull(), DEFECTIVE), bit_if(F.col("line") > F.col("_last"), LOST)
    )
    return x.withColumn("qa", qa).drop("_last", "_dead", "_hot")


def injected_to_flags(qa: Column) -> Column:
    """Bits of injected defects (1 dead, 2 hot) as flags."""
    return all_bits(bit_if(qa.bitwiseAND(1) != 0, DEFECTIVE), bit_if(qa.bitwiseAND(2) != 0, SATURATED))


def to_mask(qa: Column) -> Column:
    """Flags as the eight-plane mask."""
    has = lambda b: qa.bitwiseAND(b) != 0
    return all_bits(bit_if(has(NO_DATA), MASK_NODATA), bit_if(has(LOST), MASK_LOST), bit_if(has(SATURATED), MASK_SATURATED), bit_if(has(DEFECTIVE), MASK_DEFECTIVE))
