"""Calibration database: five tables a release, published at once by a manifest that is written last.

A release is a folder of Parquet tables that nobody reads until the manifest names it, so a job that is lost on the way leaves nothing that counts, and
running it again is safe. Tables: nuc (band, col, gain, offset), dark (band, dark_offset), radiometric (band, gain, offset), spectral (band, esun), noise
(band, alpha, beta); values in single precision, each row with its provenance. Names of bands and columns are those of the given tables. An empty acquisition gives
empty tables; a gain that cannot be told is null. spectral and noise may be left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The kind of file that each table stands for.
KINDS = {"nuc": "ADF_REQOG", "dark": "ADF_REOB2", "radiometric": "ADF_RABCA", "spectral": "ADF_SPECT", "noise": "ADF_RNOMO"}
CONTENT = {
    "nuc": "gain and offset of each column", "dark": "mean dark of the band", "radiometric": "counts to radiance: gain and offset",
    "spectral": "solar irradiance, W m-2 um-1", "noise": "sqrt(alpha^2 + beta * dn)",
}
CONVENTION = "two points: gain * dn + offset - dark; radiometric gain from the diffuser"
MANIFEST = "release int, name string, path string, rows long, unit string"


def _single(*names: str) -> list[Column]:
    return [F.col(n).cast("float").alias(n) for n in names]


def tables(nuc: DataFrame, radiometric: DataFrame, bands: DataFrame, solar: DataFrame, unit: str, *, spectral: bool = True, noise: bool = True) -> dict[str, DataFrame]:
    """The tables of a unit. nuc: band, col, gain, offset, dark; radiometric: band, gain; bands: band, band_name, alpha, beta; solar: unit, band, esun.
    A band that nuc holds and that has no irradiance for this unit raises an error where spectral is asked for."""
    used = nuc.select("band").distinct().join(bands, "band")  # a row a band
    out = {
        "nuc": nuc.select("band", "col", *_single("gain", "offset")),
        "dark": nuc.groupBy("band").agg(F.max("dark").cast("float").alias("dark_offset")),
        "radiometric": radiometric.select("band", *_single("gain"), F.lit(0.0).cast("float").alias("offset")),
    }
    if spectral:
        missing = F.raise_error(F.concat(F.lit(f"no solar irradiance for {unit}, "), F.col("band_name")))
        esun = used.join(solar.where(F.col("unit") == unit).drop("unit"), "band", "left")
        out["spectral"] = esun.select("band", F.coalesce("esun", missing).cast("float").alias("esun"))
    if noise:
        out["noise"] = used.select("band", *_single("alpha", "beta"))
    return out


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(made: dict[str, DataFrame], folder: str, release: int, *, unit: str, source: str, processor: str = "sensorlake", version: str = "1") -> DataFrame:
    """Write the tables of a release, then its manifest (release, name, path, rows, unit), which is returned. A release that is published already raises an error."""
    spark = next(iter(made.values())).sparkSession
    if not _manifest(spark, folder).where(F.col("release") == release).isEmpty():
        raise ValueError(f"release {release} is published already")
    run = f"{folder}/release-{release}-{uuid.uuid4().hex}"
    rows = None
    for name, df in made.items():
        about = {"processor": processor, "processor_version": version, "unit": unit, "adf_type": KINDS[name], "content": CONTENT[name], "source": source, "convention": CONVENTION}
        df.withColumns({k: F.lit(v) for k, v in about.items()}).write.parquet(f"{run}/{name}")
        entry = spark.read.parquet(f"{run}/{name}").agg(F.lit(release).alias("release"), F.lit(name).alias("name"), F.lit(f"{run}/{name}").alias("path"), F.count("*").alias("rows"), F.lit(unit).alias("unit"))
        rows = entry if rows is None else rows.unionByName(entry)
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")  # one file: all entries of a release appear together
    return _manifest(spark, folder).where(F.col("release") == release)


def read(spark: SparkSession, folder: str, release: int | None = None) -> dict[str, DataFrame]:
    """The tables of a release, of the newest by default. Folders that no manifest names are not seen."""
    known = _manifest(spark, folder)
    wanted = known.agg(F.max("release")).first()[0] if release is None else release
    entries = known.where(F.col("release") == wanted).collect()  # at most five rows
    if not entries:
        raise ValueError(f"no release {'' if wanted is None else wanted} in {folder}")
    return {e["name"]: spark.read.parquet(e["path"]) for e in entries}


def long_form(found: dict[str, DataFrame]) -> DataFrame:
    """table, adf_type, unit, band, col (null for values of a band), name, value of all tables."""
    out = None
    for table, df in found.items():
        values = [c for c in df.columns if c in ("gain", "offset", "dark_offset", "esun", "alpha", "beta")]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in values])).alias("_v")
        col = F.col("col") if "col" in df.columns else F.lit(None).cast("int").alias("col")
        part = df.select(F.lit(table).alias("table"), "adf_type", "unit", "band", col, pairs).select("table", "adf_type", "unit", "band", "col", "_v.*")
        out = part if out is None else out.unionByName(part)
    return out
