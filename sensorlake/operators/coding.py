"""Sizes and statistics around lossless coding: accounting, histograms, decode checks, Rice parameters, wavelets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accounting(parts: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """parts: keys, coded (bytes), px. Raw and coded bytes, ratio, bits a pixel and the best ratio of a part."""
    raw = F.ceil(F.col("px") * bits / 8)
    return parts.groupBy(*keys).agg(F.sum(raw).alias("raw_bytes"), F.sum("coded").alias("coded_bytes"), (F.sum(raw) / F.sum("coded")).alias("ratio"), (8.0 * F.sum("coded") / F.sum("px")).alias("bits_per_px"), F.max(raw / F.col("coded")).alias("best_ratio"))


def density(pixels: DataFrame, keys: list[str], top: float, bins: int) -> DataFrame:
    """keys, bin, count, density of a histogram over 0..top."""
    b = F.least(F.floor(F.col("dn") * bins / top), F.lit(bins - 1)).cast("int")
    h = pixels.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    n = h.groupBy(*keys).agg(F.sum("count").alias("_n"))
    return h.join(F.broadcast(n), keys).withColumn("density", F.col("count") / (F.col("_n") * (top / bins))).drop("_n")


def decode_qa(pixels: DataFrame, keys: list[str], dn_max: int = 4095) -> DataFrame:
    q = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("dn") == 0).alias("n_zero"), F.count_if(F.col("dn") >= dn_max).alias("n_saturated"))
    return q.withColumns({"pct_zero": 100.0 * F.col("n_zero") / F.col("n"), "pct_saturated": 100.0 * F.col("n_saturated") / F.col("n")})


def array_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    clean = F.nanvl(value, F.lit(None).cast("double"))
    return values.groupBy(*keys).agg(F.min(clean).alias("lo"), F.max(clean).alias("hi"), F.avg(clean).alias("mean"), F.count_if(F.isnan(value)).alias("n_nan"))


def zigzag(d: Column) -> Column:
    """Signed differences as non-negative integers."""
    return F.when(d >= 0, 2 * d).otherwise(-2 * d - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor((v + 1) / 2))


def delta_zigzag(pixels: DataFrame, keys: list[str], order: list[str], value: str = "dn") -> DataFrame:
    """Column v: zigzag of the difference to the value before, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pixels.withColumn("v", zigzag(F.col(value) - F.lag(value, 1, 0).over(w)))


def undelta_zigzag(mapped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return mapped.withColumn("back", F.sum(unzigzag(F.col("v"))).over(w))


def rice_choice(mapped: DataFrame, keys: list[str], position: str, raw_bits: int, gaggle: int = 16) -> DataFrame:
    """keys, gaggle, n, k, cost: the cheapest Rice parameter of each group of values; 31 is the raw escape, which wins ties, then the smallest k."""
    g = mapped.withColumn("gaggle", F.floor(F.col(position) / gaggle).cast("int"))
    ks = [(k, F.sum(F.shiftright("v", k)) + F.count("*") * (1 + k)) for k in range(min(raw_bits, 30) + 1)]
    costs = g.groupBy(*keys, "gaggle").agg(F.count("*").alias("n"), *[c.alias(f"_{k}") for k, c in ks])
    options = [F.struct(F.col(f"_{k}").cast("long").alias("cost"), F.lit(1).alias("o"), F.lit(k).alias("k")) for k, _ in ks]
    raw = F.struct((F.col("n") * raw_bits).cast("long").alias("cost"), F.lit(0).alias("o"), F.lit(31).alias("k"))
    return costs.withColumn("_b", F.array_min(F.array(raw, *options))).select(*keys, "gaggle", "n", F.col("_b.k").alias("k"), F.col("_b.cost").alias("cost"))


def bits_needed(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bits: width of the largest magnitude; 0 for all zero."""
    m = values.groupBy(*keys).agg(F.max(F.abs(value)).cast("long").alias("m"))
    return m.select(*keys, F.when(F.col("m") == 0, 0).otherwise(F.length(F.bin("m"))).alias("bits"))


def wavelet(samples: DataFrame, keys: list[str], axis: str, value: str = "x") -> DataFrame:
    """One forward 9/7 integer level along an axis of even length (0-based): keys, j, s (low), d (high). Ends are reflected."""
    j = F.floor(F.col(axis) / 2).cast("int")
    pair = samples.groupBy(*keys, j.alias("j")).agg(F.max(F.when(F.col(axis) % 2 == 0, F.col(value))).cast("long").alias("e"), F.max(F.when(F.col(axis) % 2 == 1, F.col(value))).cast("long").alias("o"))
    w = Window.partitionBy(*keys).orderBy("j")
    pair = pair.withColumn("m", F.count("*").over(Window.partitionBy(*keys)))
    at = lambda k: F.lead("e", k).over(w) if k >= 0 else F.lag("e", -k).over(w)
    x = pair.withColumns({"b1": at(-1), "f1": at(1), "f2": at(2)})
    # The even samples are mirrored around their first and last one.
    x = x.withColumns({"b1": F.coalesce("b1", "f1"), "f2": F.when(F.col("j") + 2 == F.col("m"), F.col("e")).when(F.col("j") + 1 == F.col("m"), F.lag("e", 2).over(w)).otherwise(F.col("f2")), "f1": F.coalesce("f1", "b1")})
    d = F.col("o") - F.shiftright(9 * (F.col("e") + F.col("f1")) - (F.col("b1") + F.col("f2")) + 8, 4)
    x = x.withColumn("d", d).withColumn("dm", F.coalesce(F.lag("d").over(w), F.col("d")))
    return x.withColumn("s", F.col("e") - F.shiftright(-(F.col("dm") + F.col("d")) + 2, 2)).select(*keys, "j", "s", "d")


def unwavelet(bands: DataFrame, keys: list[str], axis: str, value: str = "x") -> DataFrame:
    """The exact inverse of wavelet()."""
    w = Window.partitionBy(*keys).orderBy("j")
    x = bands.withColumn("dm", F.coalesce(F.lag("d").over(w), F.col("d")))
    x = x.withColumn("e", F.col("s") + F.shiftright(-(F.col("dm") + F.col("d")) + 2, 2)).withColumn("m", F.count("*").over(Window.partitionBy(*keys)))
    x = x.withColumns({"b1": F.lag("e").over(w), "f1": F.lead("e").over(w), "f2": F.lead("e", 2).over(w)})
    x = x.withColumns({"b1": F.coalesce("b1", "f1"), "f2": F.when(F.col("j") + 2 == F.col("m"), F.col("e")).when(F.col("j") + 1 == F.col("m"), F.lag("e", 2).over(w)).otherwise(F.col("f2")), "f1": F.coalesce("f1", "b1")})
    o = F.col("d") + F.shiftright(9 * (F.col("e") + F.col("f1")) - (F.col("b1") + F.col("f2")) + 8, 4)
    both = F.explode(F.array(F.struct((2 * F.col("j")).alias(axis), F.col("e").alias(value)), F.struct((2 * F.col("j") + 1).alias(axis), o.alias(value))))
    return x.select(*keys, both.alias("_x")).select(*keys, f"_x.{axis}", f"_x.{value}")
