"""Queries on whole products: sensor dimension, open container, calibration database, root metadata, structure counts, blur and noise checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import ACQ, COEF, FRAME, NAMES, acquisition, coefficients, frame, product_names, sql, table
from sensorlake.functions import flags, names as N, times
from sensorlake.functions.numbers import steady
from sensorlake.operators import calibrate, profile, resample, stores
from sensorlake.plans.pixels import _KERNEL
from sensorlake.plans.registry import query
from sensorlake.sources import caldb, containers
from sensorlake.sources.dimensions import BANDS, BANDS_SQL, LINE_PERIOD_MS, SENSOR_SQL, SOLAR_SQL, band_dim, sensor_dim, solar_dim
from sensorlake.sources.files import folder_of
from sensorlake.sources.shared import new_path, written


@query("src_15_sensor_dimension", sql(NAMES, SENSOR_SQL, "p AS (SELECT 'S2' || substr('ABC', CAST(1 + o_orderkey % 3 AS INT), 1) AS unit, CAST(o_custkey % 13 AS INT) AS band_index, count(*) AS n FROM pn GROUP BY ALL)",
    "SELECT p.unit, p.band_index, band_name, integration_ms, compression_rate, tdi, swir, centre_nm, bandwidth_nm, equivalent_nm, n, round(n * integration_ms, 6) AS exposed_ms FROM p JOIN sensor s ON s.unit = p.unit AND s.band_index = p.band_index"))
def src_15_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by unit and band with all constants of the sensor."""
    unit = F.concat(F.lit("S2"), F.expr("substr('ABC', cast(1 + o_orderkey % 3 as int), 1)"))
    p = product_names(spark, sf_dir).groupBy(unit.alias("unit"), (F.col("o_custkey") % 13).cast("int").alias("band_index")).agg(F.count("*").alias("n"))
    x = p.join(F.broadcast(sensor_dim(spark)), ["unit", "band_index"])
    return x.select(*[c for c in x.columns if c != "physical_gain"], steady(F.col("n") * F.col("integration_ms")).alias("exposed_ms"))


_CONDITIONS = "cd AS (SELECT line, " + ", ".join(f"max(CAST(embedding[{i + 1}] AS DOUBLE)) AS c{i}" for i in range(10)) + " FROM fl GROUP BY line)"
_NAMES = ["x", "y", "z", "vx", "vy", "vz", "q0", "q1", "q2", "q3"]
_INJECTED = "CASE dn % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 12 END"
_CONTAINER_SQL = sql(
    FRAME, _CONDITIONS, "la AS (SELECT band, max(line) FILTER (dn <> 0) AS last FROM frame GROUP BY band)",
    f"fq AS (SELECT band, line, col, dn, CASE WHEN dn >= 4095 THEN 4 ELSE 0 END | CASE WHEN dn = 0 THEN 1 ELSE 0 END | CASE WHEN col = 7 OR (line = 2 AND col = 5) THEN 8 ELSE 0 END | CASE WHEN line > last THEN 2 ELSE 0 END | {_INJECTED} AS qa FROM frame JOIN la USING (band))",
    "ln AS (SELECT band, line, CAST(count(*) AS INT) AS n_cols, CAST(sum(dn) AS BIGINT) AS total, CAST(count(*) FILTER (qa <> 0) AS INT) AS n_flagged, CAST(sum(qa * (col + 1)) AS BIGINT) AS flag_sum FROM fq GROUP BY band, line)",
    f"SELECT 'S2MSIL0_' AS kind, band, line, n_cols, total, n_flagged, flag_sum, round(1360000000.0::DOUBLE + line * {LINE_PERIOD_MS / 1000!r}::DOUBLE, 6) AS t, " + ", ".join(f"round(c{i}, 6) AS {n}" for i, n in enumerate(_NAMES)) + " FROM ln JOIN cd USING (line)",
)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the flags of their values and of injected defects."""
    frames = spark.range(10).select(F.lit(5).alias("detector"), F.col("id").cast("int").alias("band"))
    seeded = flags.seed_flags(frame(spark, sf_dir), frames.withColumn("col", F.lit(7)), frames.withColumns({"line": F.lit(2), "col": F.lit(5)}), ["detector", "band"])
    return seeded.withColumn("qa", F.col("qa").bitwiseOR(flags.injected_to_flags(F.col("dn").bitwiseAND(3))))


@query("snk_05_open_container", _CONTAINER_SQL)
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container with frames, flags, line times, orbit and attitude, read back; frames must be as wide as their coefficients."""
    from sensorlake.fixtures import frame_lines

    keys = ["detector", "band"]
    part = lambda first, n: F.array(*[F.max(F.col("embedding")[i].cast("double")) for i in range(first, first + n)])
    series = frame_lines(spark, sf_dir).groupBy("line").agg(part(0, 3).alias("position"), part(3, 3).alias("velocity"), part(6, 4).alias("quaternion"))
    flagged = _flagged(spark, sf_dir)
    conditions = containers.line_conditions(flagged, series, epoch=1360000000.0)
    coefs = coefficients(spark).select(F.lit(5).alias("detector"), "band", "col")
    metadata = spark.createDataFrame([('{"stac_discovery":{"properties":{"eopf:type":"S2MSIL0_"}}}',)], "document string")
    at = containers.write_open_container(flagged, conditions, coefs, metadata, new_path(spark, "container"), keys)
    lines, found, document = containers.read_open_container(spark, at)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    summed = lines.select(
        "band", "line", F.size("samples").alias("n_cols"), total("samples").alias("total"), F.size(F.filter("flags", lambda q: q != 0)).alias("n_flagged"), total(F.transform("flags", lambda q, i: q * (i + 1))).alias("flag_sum"),
    )
    values = [steady(F.concat("position", "velocity", "quaternion")[i]).alias(n) for i, n in enumerate(_NAMES)]
    kind = document.select(F.get_json_object("document", "$.stac_discovery.properties['eopf:type']")).first()[0]  # one document a container
    return summed.join(found, "line").select(F.lit(kind).alias("kind"), "band", "line", "n_cols", "total", "n_flagged", "flag_sum", steady("t").alias("t"), *values)


_VALUE = lambda x: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 6)"
_CALDB_SQL = sql(
    ACQ, BANDS_SQL, SOLAR_SQL, "cm AS (SELECT band, col, avg(dn) FILTER (kind = 'dark') AS d, avg(dn) FILTER (kind = 'flat') AS f FROM acq GROUP BY band, col)",
    "cg AS (SELECT *, avg(f) OVER (PARTITION BY band) AS mf, avg(d) OVER (PARTITION BY band) AS md FROM cm)", "cn AS (SELECT band, col, (mf - md) / nullif(f - d, 0) AS gain, mf - (mf - md) / nullif(f - d, 0) * f AS off, md FROM cg)",
    "cs AS (SELECT band, avg(dn) FILTER (kind = 'flat') AS f, avg(dn) FILTER (kind = 'dark') AS d FROM acq GROUP BY band)", "cb AS (SELECT DISTINCT band, band_name, lref, alpha, beta FROM acq JOIN bands ON band_index = band)",
    f"""SELECT 'nuc' AS "table", 'ADF_REQOG' AS adf_type, 'S2B' AS unit, band, col, 'gain' AS name, {_VALUE('gain')} AS value FROM cn
    UNION ALL SELECT 'nuc', 'ADF_REQOG', 'S2B', band, col, 'offset', {_VALUE('off')} FROM cn
    UNION ALL SELECT 'dark', 'ADF_REOB2', 'S2B', band, NULL, 'dark_offset', {_VALUE('max(md)')} FROM cn GROUP BY band
    UNION ALL SELECT 'radiometric', 'ADF_RABCA', 'S2B', band, NULL, 'gain', {_VALUE('CASE WHEN f > d THEN 1 / (f - d) END * lref')} FROM cs JOIN cb USING (band)
    UNION ALL SELECT 'radiometric', 'ADF_RABCA', 'S2B', band, NULL, 'offset', 0 FROM cb
    UNION ALL SELECT 'spectral', 'ADF_SPECT', 'S2B', band, NULL, 'esun', {_VALUE('esun')} FROM cb JOIN solar s ON s.unit = 'S2B' AND s.band_index = band
    UNION ALL SELECT 'noise', 'ADF_RNOMO', 'S2B', band, NULL, 'alpha', {_VALUE('alpha')} FROM cb
    UNION ALL SELECT 'noise', 'ADF_RNOMO', 'S2B', band, NULL, 'beta', {_VALUE('beta')} FROM cb""",
)


def calibration_tables(acq: DataFrame, unit: str, **parts: bool) -> dict[str, DataFrame]:
    """The tables of a calibration database from dark and flat acquisitions, with the bands' reference radiance for the diffuser's."""
    spark = acq.sparkSession
    bands = band_dim(spark).withColumnRenamed("band_index", "band")
    diffuser = calibrate.radiance_gain(acq, ["band"], 1.0).join(F.broadcast(bands), "band").select("band", (F.col("gain") * F.col("lref")).alias("gain"))
    return caldb.tables(calibrate.two_point(acq, ["band"]), diffuser, bands, solar_dim(spark).withColumnRenamed("band_index", "band"), unit, **parts)


@query("snk_06_calibration_tables", _CALDB_SQL)
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases of a calibration database are published, the first with the three mandatory tables; the newest is read back whole."""
    acq, folder = acquisition(spark, sf_dir), folder_of(spark, "caldb")
    caldb.publish(calibration_tables(acq.where("line % 2 = 0"), "S2A", spectral=False, noise=False), folder, 1, unit="S2A", source="first half")
    caldb.publish(calibration_tables(acq, "S2B"), folder, 2, unit="S2B", source="dark and diffuser acquisitions")
    return caldb.long_form(caldb.read(spark, folder)).withColumn("value", steady(F.col("value").cast("double")))


@query("snk_06_releases", sql(ACQ, "c AS (SELECT line % 2 = 0 AS even, band, col FROM acq)", """SELECT r.release, r.unit, t.name, CAST(CASE WHEN t.name = 'nuc' THEN r.n_cols ELSE r.n_bands END AS BIGINT) AS "rows" FROM (
    SELECT 1 AS release, 'S2A' AS unit, count(DISTINCT (band, col)) AS n_cols, count(DISTINCT band) AS n_bands FROM c WHERE even UNION ALL SELECT 2, 'S2B', count(DISTINCT (band, col)), count(DISTINCT band) FROM c) r
    JOIN (VALUES ('nuc', 1), ('dark', 1), ('radiometric', 1), ('spectral', 2), ('noise', 2)) t(name, since) ON t.since <= r.release"""))  # fmt: skip
def snk_06_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests of both releases."""
    acq, folder = acquisition(spark, sf_dir), folder_of(spark, "caldb")
    first = caldb.publish(calibration_tables(acq.where("line % 2 = 0"), "S2A", spectral=False, noise=False), folder, 1, unit="S2A", source="first half")
    second = caldb.publish(calibration_tables(acq, "S2B"), folder, 2, unit="S2B", source="dark and diffuser acquisitions")
    return first.unionByName(second).distinct().select("release", "unit", "name", "rows")


_ISO = lambda t: f"strftime({t}, '%Y-%m-%dT%H:%M:%S') || '.000Z'"
_DOCUMENT_SQL = sql(
    NAMES, SENSOR_SQL,
    "pr AS (SELECT o_orderkey, o_custkey, kind, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(1 + o_custkey % 143 AS INT) AS orbit, substr('ABC', CAST(1 + o_orderkey % 3 AS INT), 1) AS letter, CAST(o_custkey % 13 AS INT) AS band_index, CAST(o_orderkey % 40 AS INT) AS seconds, CAST(1 + o_custkey % 12 AS INT) AS det FROM pn)",
    f"""SELECT o_orderkey, kind, kind AS product_type, 'Sentinel-2' || letter AS platform, 'S2' || letter || '_OPER_MSI_L0__DS_' || strftime(t, '%Y%m%dT%H%M%S') || '_A' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS datastrip, orbit AS relative_orbit,
    CAST(o_custkey AS INT) AS absolute_orbit, 'descending' AS orbit_state, 'INS-NOBS' AS datatake_type, {_ISO('t')} AS start_datetime, {_ISO('t + to_seconds(seconds)')} AS end_datetime, {_ISO('t + to_seconds(37)')} AS start_tai, CAST(orbit / 4.0 AS DOUBLE) AS stop_y,
    CAST(orbit / 2.0 + 1 AS DOUBLE) AS east, CAST(orbit / 2.0 AS DOUBLE) AS ring_end_west, CASE WHEN det = 12 THEN '01,12' ELSE lpad(CAST(det AS VARCHAR), 2, '0') || ',12' END AS detectors, CAST(epoch(t) - 315964800 + 18 AS DOUBLE) AS epoch_gps, 1.5658736::DOUBLE AS line_period, CAST(epoch(t) - 315964800 + 18 + s.band_index AS DOUBLE) AS band_time,
    compression_rate, integration_ms, physical_gain, centre_nm, bandwidth_nm, equivalent_nm, tdi, CAST(13 AS INT) AS n_bands, CAST(4 AS INT) AS n_tdi, CAST(3 AS INT) AS table_id
    FROM pr JOIN sensor s ON s.unit = 'S2' || letter AND s.band_index = pr.band_index""",
)

_DISCOVERY = """stac_discovery struct<bbox: array<double>, geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<platform: string, `eopf:type`: string, `product:type`: string, `eopf:datastrip_id`: string,
`sat:relative_orbit`: int, `sat:absolute_orbit`: int, `sat:orbit_state`: string, `msi:datatake_type`: string, start_datetime: string, end_datetime: string>>"""
_POINT = "struct<TAI: string, UTC: string, position: array<double>>"
_QUANTITY = "struct<unit: string, value: double>"
_OTHER = f"""other_metadata struct<NUC_table_ID: int, orbit_ephemeris_start: {_POINT}, orbit_ephemeris_stop: {_POINT}, sensor_configuration: struct<acquisition_configuration: struct<active_detectors_list: string, tdi_configuration_list: map<string, string>,
spectral_band_info: map<string, struct<compression_rate: double, integration_time: {_QUANTITY}, physical_gains: double, central_wavelength: {_QUANTITY}, bandwidth: {_QUANTITY}, equivalent_wavelength: {_QUANTITY}>>>,
time_stamp: struct<line_period: double, acquisition_epoch_gps_s: double, band_time_stamp: map<string, {_QUANTITY}>>>>"""


@query("snk_10_root_metadata", _DOCUMENT_SQL)
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole root document of each product, written and parsed back once."""
    orbit, letter = (1 + F.col("o_custkey") % 143).cast("int"), F.expr("substr('ABC', cast(1 + o_orderkey % 3 as int), 1)")
    start = F.col("o_orderdate").cast("timestamp")
    detector = (1 + F.col("o_custkey") % 12).cast("int")
    west = orbit / 2.0
    gps = times.gps_seconds(start)
    numbers = F.array(*[F.lit(b[0][1:]) for b in BANDS])
    p = product_names(spark, sf_dir).select(
        "o_orderkey", (F.col("o_custkey") % 13).cast("int").alias("band_index"), "kind", F.concat(F.lit("S2"), letter).alias("unit"), F.concat(F.lit("Sentinel-2"), letter).alias("platform"), F.lit("L0").alias("level"),
        N.datastrip_id(letter, start, F.col("o_custkey")).alias("datastrip"), orbit.alias("relative_orbit"), F.col("o_custkey").cast("int").alias("absolute_orbit"), F.lit("descending").alias("orbit_state"), F.lit("NOBS").alias("operation_mode"),
        F.array(west, F.lit(-10.0), west + 1, F.lit(10.0)).alias("bbox"), start.alias("start"), (start + F.make_dt_interval(secs=F.col("o_orderkey") % 40)).alias("stop"), gps.alias("epoch_gps"),
        F.array(F.lit(12), F.when(detector == 12, F.lit(1)).otherwise(detector)).alias("detectors"), F.map_from_entries(F.transform(numbers, lambda b, i: F.struct(b.alias("key"), (gps + i).alias("value")))).alias("band_times"),
        *[F.array(F.array(west, orbit / 3.0, F.lit(0.0)), F.array(west, orbit / 4.0, F.lit(1.0))).alias(c) for c in ("position", "velocity")],
    )
    x = p.join(F.broadcast(containers.band_information(spark)), "unit")
    stored = written(x.select("o_orderkey", "band_index", containers.root_document(x).alias("text")), "metadata")
    d = stored.select("o_orderkey", F.element_at(numbers, F.col("band_index") + 1).alias("number"), F.from_json("text", f"{_DISCOVERY}, {_OTHER}").alias("d"))
    s = d.select("o_orderkey", "number", F.col("d.stac_discovery").alias("s"), F.col("d.stac_discovery.properties").alias("p"), F.col("d.other_metadata").alias("m"), F.col("d.other_metadata.sensor_configuration.acquisition_configuration").alias("a"), F.col("d.other_metadata.sensor_configuration.time_stamp").alias("t"))
    info = lambda f: F.col("a.spectral_band_info")[F.col("number")].getField(f)
    return s.select(
        "o_orderkey", F.col("p.eopf:type").alias("kind"), F.col("p.product:type").alias("product_type"), "p.platform", F.col("p.eopf:datastrip_id").alias("datastrip"), F.col("p.sat:relative_orbit").alias("relative_orbit"), F.col("p.sat:absolute_orbit").alias("absolute_orbit"),
        F.col("p.sat:orbit_state").alias("orbit_state"), F.col("p.msi:datatake_type").alias("datatake_type"), "p.start_datetime", "p.end_datetime", F.col("m.orbit_ephemeris_start.TAI").alias("start_tai"), F.col("m.orbit_ephemeris_stop.position")[1].alias("stop_y"),
        F.col("s.bbox")[2].alias("east"), F.col("s.geometry.coordinates")[0][4][0].alias("ring_end_west"), F.col("a.active_detectors_list").alias("detectors"), F.col("t.acquisition_epoch_gps_s").alias("epoch_gps"), "t.line_period", F.col("t.band_time_stamp")[F.col("number")].getField("value").alias("band_time"),
        info("compression_rate").alias("compression_rate"), info("integration_time").getField("value").alias("integration_ms"), info("physical_gains").alias("physical_gain"), info("central_wavelength").getField("value").alias("centre_nm"), info("bandwidth").getField("value").alias("bandwidth_nm"),
        info("equivalent_wavelength").getField("value").alias("equivalent_nm"), F.map_contains_key("a.tdi_configuration_list", F.col("number")).alias("tdi"), F.size("a.spectral_band_info").alias("n_bands"), F.size("a.tdi_configuration_list").alias("n_tdi"), F.col("m.NUC_table_ID").alias("table_id"),
    )


@query("agg_21_structure_counts", """WITH e AS (SELECT user_id % 50 AS product, event_id % 5 AS k, user_id % 12 + 1 AS d, event_type AS b, event_id % 3 AS a FROM events)
    SELECT 'l0/P' || product || '.zarr' AS product, count(DISTINCT d * 10 + CASE WHEN k = 1 THEN 1 ELSE 0 END) FILTER (k < 3) AS detectors, count(DISTINCT upper(b)) FILTER (k < 3) AS bands, count(DISTINCT (d, k = 1, b, a)) FILTER (k < 3) AS arrays FROM e GROUP BY product""")  # fmt: skip
def agg_21_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors, bands and arrays of each product, from the paths of its files."""
    k, detector = F.col("event_id") % 5, F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0")
    inside = F.concat(F.when(k == 1, "measurements/DD").otherwise("measurements/d"), detector, F.lit("/"), "event_type", F.lit("/array"), (F.col("event_id") % 3).cast("string"), F.lit("/0.0"))
    below = F.when(k < 3, inside).when(k == 3, "measurements/other/b01/x").otherwise(F.lit("conditions/time/0"))
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("l0/P"), (F.col("user_id") % 50).cast("string"), F.lit(".zarr/"), below).alias("path"))
    return stores.structure(paths)


@query("agg_24_blur_rmse", sql(FRAME, f"k(dy, dx, w) AS (VALUES {', '.join(f'({y}, {x}, {w}::DOUBLE)' for y, x, w in _KERNEL)})", "s AS (SELECT band, max(line) + 1 AS h FROM frame GROUP BY band)",
    "bl AS (SELECT band, CAST((line + dy + h) % h AS INT) AS line, CAST((col + dx + 64) % 64 AS INT) AS col, sum(dn * w) AS v FROM frame JOIN s USING (band), k GROUP BY ALL)",
    "SELECT band, count(*) AS n, round(sqrt(avg((v - dn) * (v - dn))), 6) AS blur_rmse FROM bl JOIN frame USING (band, line, col) GROUP BY band"))
def agg_24_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the blur by the kernel takes a frame from itself."""
    f = frame(spark, sf_dir).select("band", "line", "col", F.col("dn").cast("double").alias("dn"))
    blurred = resample.blur(f, spark.createDataFrame(_KERNEL, "dy int, dx int, w double"), ["band"]).select("band", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), F.col("dn").alias("blurred"))
    return profile.root_mean_square(f.join(blurred, ["band", "line", "col"]), ["band"], F.col("blurred") - F.col("dn"), "blur_rmse").select("band", "n", steady("blur_rmse").alias("blur_rmse"))


@query("agg_24_noise_check", sql(ACQ, COEF, BANDS_SQL, "m AS (SELECT *, avg(dn) OVER (PARTITION BY band, col) AS mean FROM acq WHERE kind = 'flat')",
    "SELECT band, count(*) AS n, round(stddev_pop((dn - mean) / c), 6) AS sigma_measured, round(avg(sqrt(alpha * alpha + beta * greatest(mean, 0))), 6) AS sigma_model FROM m JOIN coef USING (band, col) JOIN bands ON band_index = band GROUP BY band"))
def agg_24_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of flat acquisitions, with each column's gain taken out, beside that of the noise model at the same signal."""
    flat = acquisition(spark, sf_dir).where("kind = 'flat'")
    signal = flat.groupBy("band", "col").agg(F.avg("dn").alias("signal"))
    gains = coefficients(spark).select("band", "col", F.col("c").alias("gain"))
    model = band_dim(spark).select(F.col("band_index").alias("band"), "alpha", "beta")
    x = flat.join(signal, ["band", "col"]).join(F.broadcast(gains), ["band", "col"]).join(F.broadcast(model), "band")
    return profile.noise_check(x.withColumn("noise", F.col("dn") - F.col("signal")), ["band"]).select("band", "n", steady("sigma_measured").alias("sigma_measured"), steady("sigma_model").alias("sigma_model"))
