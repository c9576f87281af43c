"""Open container of decoded frames: frames and flags a line, conditions of each line time, and the root metadata document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.sources.dimensions import LINE_PERIOD_MS, NUC_TABLE, sensor_dim

CONDITIONS = {"position": 3, "velocity": 3, "quaternion": 4}


def require_widths(lines: DataFrame, coefficients: DataFrame, keys: list[str]) -> None:
    """Raise an error unless every line of a frame (keys, line, samples) is as wide as the coefficients (keys, col) of its frame. One row a frame is compared."""
    width = lines.groupBy(*keys).agg(F.min(F.size("samples")).alias("_least"), F.max(F.size("samples")).alias("_most"))
    want = coefficients.groupBy(*keys).agg(F.count_distinct("col").alias("_want"))
    wrong = width.join(want, keys, "left").where((F.col("_least") != F.col("_most")) | ~F.col("_most").eqNullSafe(F.col("_want")))
    shown = wrong.select(F.to_json(F.struct(*keys, F.col("_least").alias("least"), F.col("_most").alias("most"), F.col("_want").alias("wanted")))).take(5)
    if shown:
        raise ValueError(f"frames and coefficients differ in width: {'; '.join(r[0] for r in shown)}")


def line_conditions(frame_lines: DataFrame, series: DataFrame, *, epoch: float, period: float = LINE_PERIOD_MS / 1000) -> DataFrame:
    """line, t and the position, velocity and attitude of each line number that the frames hold. series: line and the arrays position, velocity, quaternion, once a
    line; a line without them gets nulls, an array of another length raises an error."""
    x = frame_lines.select("line").distinct().join(series.select("line", *CONDITIONS), "line", "left")
    checked = [F.when(F.col(c).isNull() | (F.size(c) == n), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} needs {n} components"))).alias(c) for c, n in CONDITIONS.items()]
    return x.select("line", (epoch + F.col("line") * period).alias("t"), *checked)


def write_open_container(flagged: DataFrame, conditions: DataFrame, coefficients: DataFrame, metadata: DataFrame, folder: str, keys: list[str]) -> dict[str, str]:
    """Write frames (keys, line, samples), flags (keys, line, flags), conditions and metadata under the folder. flagged: keys, line, col, dn, qa.
    The widths of frames and coefficients must agree. Frames and flags come from one shuffle of pixels into lines."""
    spark = flagged.sparkSession
    cells = F.array_sort(F.collect_list(F.struct("col", "dn", "qa")))
    both = flagged.groupBy(*keys, "line").agg(cells.alias("_c")).select(*keys, "line", F.col("_c.dn").alias("samples"), F.col("_c.qa").alias("flags"))
    at = {n: f"{folder}/{n}" for n in ("lines", "conditions", "metadata")}
    both.write.partitionBy(*keys).parquet(at["lines"])
    require_widths(spark.read.parquet(at["lines"]), coefficients, keys)
    conditions.write.parquet(at["conditions"])
    metadata.write.parquet(at["metadata"])
    return at


def read_open_container(spark: SparkSession, at: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (keys, line, samples, flags), conditions and metadata of a container."""
    return spark.read.parquet(at["lines"]), spark.read.parquet(at["conditions"]), spark.read.parquet(at["metadata"])


def band_information(spark: SparkSession) -> DataFrame:
    """unit, bands (a map from the band's number to its constants), tdi (a map of the bands that add lines): a row a unit."""
    quantity = lambda unit, c: F.struct(F.lit(unit).alias("unit"), F.col(c).alias("value"))
    number = F.substring("band_name", 2, 2)
    about = F.struct(
        F.col("compression_rate"), quantity("ms", "integration_ms").alias("integration_time"), F.col("physical_gain").alias("physical_gains"), quantity("nm", "centre_nm").alias("central_wavelength"),
        quantity("nm", "bandwidth_nm").alias("bandwidth"), quantity("nm", "equivalent_nm").alias("equivalent_wavelength"),
    )
    entry = F.struct(number.alias("key"), about.alias("value"))
    applied = F.when(F.col("tdi"), F.struct(number.alias("key"), F.lit("APPLIED").alias("value")))
    return sensor_dim(spark).groupBy("unit").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("bands"), F.map_from_entries(F.array_sort(F.collect_list(applied))).alias("tdi"))


def _tai(t: Column) -> Column:
    return t + F.expr("INTERVAL 37 SECONDS")


def _iso(t: Column) -> Column:
    from sensorlake.functions.times import iso_millis

    return iso_millis(t)


def root_document(products: DataFrame) -> Column:
    """The root metadata document of a product as JSON text. Columns of products: kind, platform, level, datastrip, relative_orbit, absolute_orbit, orbit_state, operation_mode, bbox
    (west, south, east, north), start, stop (timestamps), epoch_gps, detectors (array), band_times (map from a band's number to GPS seconds), position and velocity (arrays a of start and
    stop), bands and tdi of its unit. Null fields are left out."""
    c = F.col
    west, south, east, north = (c("bbox")[i] for i in range(4))
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    point = lambda t, i: F.struct(_iso(_tai(c(t))).alias("TAI"), _iso(c(t)).alias("UTC"), _iso(c(t)).alias("UT1"), c("position")[i].alias("position"), c("velocity")[i].alias("velocity"))
    properties = F.struct(
        c("platform"), F.lit("sentinel-2").alias("constellation"), F.lit("Multi Spectral Imager MSI").alias("instrument"), c("kind").alias("eopf:type"), c("datastrip").alias("eopf:datastrip_id"), c("kind").alias("product:type"),
        F.concat(F.lit("INS-"), "operation_mode").alias("msi:datatake_type"), c("level").alias("processing:level"), c("relative_orbit").alias("sat:relative_orbit"), c("absolute_orbit").alias("sat:absolute_orbit"),
        c("orbit_state").alias("sat:orbit_state"), _iso(c("start")).alias("datetime"), _iso(c("start")).alias("start_datetime"), _iso(c("stop")).alias("end_datetime"),
    )
    discovery = F.struct(F.lit("Feature").alias("type"), c("bbox"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    acquired = F.struct(
        c("operation_mode"), F.array_join(F.array_sort(F.transform("detectors", lambda d: F.lpad(d.cast("string"), 2, "0"))), ",").alias("active_detectors_list"), F.lit(True).alias("compress_mode"), F.lit(True).alias("equalization_mode"),
        F.lit(NUC_TABLE).alias("nuc_table_id"), c("bands").alias("spectral_band_info"), c("tdi").alias("tdi_configuration_list"),
    )
    stamps = F.transform_values("band_times", lambda k, v: F.struct(F.lit("s (GPS)").alias("unit"), v.alias("value")))
    stamp = F.struct(F.lit(LINE_PERIOD_MS).alias("line_period"), _iso(c("start")).alias("acquisition_epoch_utc"), c("epoch_gps").alias("acquisition_epoch_gps_s"), stamps.alias("band_time_stamp"))
    other = F.struct(
        F.lit(NUC_TABLE).alias("NUC_table_ID"), F.lit(True).alias("onboard_compression_flag"), F.lit(True).alias("onboard_equalization_flag"), point("start", 0).alias("orbit_ephemeris_start"), point("stop", 1).alias("orbit_ephemeris_stop"),
        F.struct(acquired.alias("acquisition_configuration"), stamp.alias("time_stamp")).alias("sensor_configuration"),
    )
    history = F.struct(F.lit("sensorlake").alias("processor"), F.lit("1").alias("processor_version"))
    return F.to_json(F.struct(discovery.alias("stac_discovery"), other.alias("other_metadata"), history.alias("processing_history")))
