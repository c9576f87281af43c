"""Frame tables: one row for each image line, partitioned by product, band and detector; sinks with a check on re-reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.sources.shared import new_path

PARTITIONS = ["product_id", "band", "detector"]


def to_lines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels as line rows with an array of samples in column order."""
    cells = F.array_sort(F.collect_list(F.struct("col", "dn")))
    return pixels.groupBy(*keys, "line").agg(F.transform(cells, lambda c: c["dn"]).alias("samples"))


def to_pixels(lines: DataFrame) -> DataFrame:
    rest = [c for c in lines.columns if c != "samples"]
    return lines.select(*rest, F.posexplode("samples").alias("col", "dn"))


def scan(spark: SparkSession, path: str, *, bands: list | None = None, detectors: list | None = None, lines: tuple[int, int] | None = None) -> DataFrame:
    """Lines of some frames: bands and detectors prune partitions, line numbers prune row groups."""
    df = spark.read.parquet(path)
    if bands is not None:
        df = df.where(F.col("band").isin(bands))
    if detectors is not None:
        df = df.where(F.col("detector").isin(detectors))
    if lines is not None:
        df = df.where(F.col("line").between(*lines))
    return df


def write_frames(lines: DataFrame, path: str) -> DataFrame:
    """Write line rows sorted by line, then compare with what is read back: band, detector, n_lines, dn_min, dn_max, n_different."""
    out = lines if "product_id" in lines.columns else lines.withColumn("product_id", F.lit("p"))
    out.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "line").write.partitionBy(*PARTITIONS).parquet(path)
    back = lines.sparkSession.read.parquet(path)
    at = [*PARTITIONS, "line"]
    x = out.select(*at, F.col("samples").alias("a")).join(back.select(*at, F.col("samples").alias("b")), at, "full_outer")
    return x.groupBy("band", "detector").agg(F.count("*").alias("n_lines"), F.min(F.array_min("b")).alias("dn_min"), F.max(F.array_max("b")).alias("dn_max"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


def write_product(tables: dict[str, DataFrame], path: str, *, store_frames: bool = True) -> dict[str, str]:
    """Frames, masks, packets, telemetry and metadata of products, each as a table under the path."""
    out = {}
    for name, df in tables.items():
        if name != "frames" or store_frames:
            df.write.parquet(f"{path}/{name}")
            out[name] = f"{path}/{name}"
    return out


def fresh(spark: SparkSession, name: str = "frames") -> str:
    return new_path(spark, name)
