"""Band dimension: a few rows that are broadcast into every job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the 13 spectral bands: name, ground sampling in metres, reference radiance, signal-to-noise at it, noise alpha and
# beta, physical gain.
BANDS = [
    ("B01", 60, 129.11, 129.0, 0.560, 0.00054, 4.10503),
    ("B02", 10, 128.00, 154.0, 0.567, 0.04696, 3.75138),
    ("B03", 10, 128.00, 168.0, 0.488, 0.03482, 4.17678),
    ("B04", 10, 108.00, 142.0, 0.489, 0.04047, 4.50915),
    ("B05", 20, 74.60, 117.0, 0.578, 0.03123, 5.19263),
    ("B06", 20, 68.23, 89.0, 0.576, 0.04388, 4.85731),
    ("B07", 20, 66.70, 105.0, 0.576, 0.04220, 4.52068),
    ("B08", 10, 103.00, 174.0, 0.571, 0.04447, 6.14137),
    ("B8A", 20, 52.39, 72.0, 0.574, 0.08714, 5.11991),
    ("B09", 60, 8.77, 114.0, 0.563, 0.10258, 8.50206),
    ("B10", 60, 6.00, 50.0, 1.067, 0.00961, 55.05589),
    ("B11", 20, 4.00, 100.0, 0.683, 0.09292, 35.29882),
    ("B12", 20, 1.70, 100.0, 0.704, 0.08259, 106.15880),
]
# Solar irradiance of each band in the order above; the third unit has none.
SOLAR = {
    "S2A": [1884.69, 1959.66, 1823.24, 1512.06, 1424.64, 1287.61, 1162.08, 1041.63, 955.32, 812.92, 367.15, 245.59, 85.25],
    "S2B": [1874.30, 1959.75, 1824.93, 1512.79, 1425.78, 1291.13, 1175.57, 1041.28, 953.93, 817.58, 365.41, 247.08, 87.75],
}
SWIR = ("B10", "B11", "B12")
TDI = ("B03", "B04", "B11", "B12")
UNITS = ("S2A", "S2B", "S2C")
# Fixed values of each band in the order above: integration time in milliseconds, compression rate.
INTEGRATION_MS = [7.4473767, 1.2821506, 1.3230393, 1.3872929, 2.844058, 2.7251472, 2.7489293, 1.2704681, 2.5586717, 7.593408, 5.6989655, 1.4035684, 1.5003662]
COMPRESSION = [2.655, 2.97, 2.97, 2.97, 2.655, 2.655, 2.655, 2.97, 2.655, 2.655, 2.655, 2.4, 2.4]
# Fixed values of each unit, in the order above, in nanometres: wavelength at mid-bandwidth, bandwidth, equivalent wavelength.
CENTRE_NM = {
    "S2A": [443.0, 492.0, 560.5, 665.0, 705.0, 741.0, 784.0, 842.0, 865.0, 946.0, 1374.0, 1614.0, 2197.5],
    "S2B": [443.0, 491.5, 559.5, 665.5, 704.5, 740.0, 781.0, 840.5, 865.0, 944.0, 1378.0, 1611.5, 2184.5],
    "S2C": [444.5, 489.5, 561.0, 667.0, 707.5, 741.5, 785.5, 844.0, 866.0, 948.0, 1372.5, 1611.5, 2193.0],
}
BANDWIDTH_NM = {
    "S2A": [20, 64, 35, 30, 14, 14, 20, 118, 20, 20, 30, 88, 179],
    "S2B": [20, 65, 35, 31, 15, 14, 20, 115, 20, 20, 30, 93, 181],
    "S2C": [21, 65, 36, 30, 15, 15, 21, 114, 20, 20, 33, 89, 182],
}
EQUIVALENT_NM = {
    "S2A": [442.695, 492.715, 559.849, 664.622, 704.115, 740.492, 782.753, 832.790, 864.711, 945.054, 1373.456, 1613.681, 2202.368],
    "S2B": [442.246, 492.339, 558.949, 664.948, 703.824, 739.128, 779.706, 832.948, 863.972, 943.165, 1376.878, 1610.414, 2185.707],
    "S2C": [444.224, 489.028, 560.632, 666.529, 707.065, 741.071, 784.660, 834.613, 865.574, 947.202, 1372.177, 1612.004, 2191.270],
}
# Line period in milliseconds and the number of the on-board table.
LINE_PERIOD_MS, NUC_TABLE = 1.5658736, 3

BANDS_SQL = "bands(band_index, band_name, gsd_m, lref, snr, alpha, beta, physical_gain) AS (VALUES " + ", ".join(f"({i}, '{b[0]}', {b[1]}, " + ", ".join(f"{v}::DOUBLE" for v in b[2:]) + ")" for i, b in enumerate(BANDS)) + ")"
SOLAR_SQL = "solar(unit, band_index, esun) AS (VALUES " + ", ".join(f"('{u}', {i}, {v}::DOUBLE)" for u, vs in SOLAR.items() for i, v in enumerate(vs)) + ")"


def _sensor_rows() -> list[tuple]:
    return [
        (u, i, b[0], INTEGRATION_MS[i], COMPRESSION[i], b[0] in TDI, b[0] in SWIR, CENTRE_NM[u][i], float(BANDWIDTH_NM[u][i]), EQUIVALENT_NM[u][i], b[6])
        for u in UNITS for i, b in enumerate(BANDS)
    ]


_SENSOR_COLUMNS = "unit, band_index, band_name, integration_ms, compression_rate, tdi, swir, centre_nm, bandwidth_nm, equivalent_nm, physical_gain"
SENSOR_SQL = f"sensor({_SENSOR_COLUMNS}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in _sensor_rows()) + ")"


def sensor_dim(spark: SparkSession) -> DataFrame:
    """A row a unit and band: integration time, compression, time delay integration, wavelengths, bandwidth, gain."""
    kinds = "unit string, band_index int, band_name string, integration_ms double, compression_rate double, tdi boolean, swir boolean, centre_nm double, bandwidth_nm double, equivalent_nm double, physical_gain double"
    return spark.createDataFrame(_sensor_rows(), kinds)


def band_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BANDS)], "band_index int, band_name string, gsd_m int, lref double, snr double, alpha double, beta double, physical_gain double")


def solar_dim(spark: SparkSession) -> DataFrame:
    """unit, band_index, esun. Join it with left_anti to find units and bands that have no value."""
    return spark.createDataFrame([(u, i, v) for u, vs in SOLAR.items() for i, v in enumerate(vs)], "unit string, band_index int, esun double")
