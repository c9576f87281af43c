"""Open containers, the calibration database, root documents and structure counts: awkward input."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import profile, stores
from sensorlake.sources import caldb, containers, dimensions
from sensorlake.sources.files import folder_of
from sensorlake.sources.shared import new_path

NUC = "band int, col int, gain float, offset float, dark double"


def given(spark, rows=((0, 0, 1.5, -2.0, 480.0), (0, 1, None, None, 480.0), (2, 0, 1.0, 0.5, 470.0)), unit="S2B", **parts):
    bands = dimensions.band_dim(spark).withColumnRenamed("band_index", "band")
    solar = dimensions.solar_dim(spark).withColumnRenamed("band_index", "band")
    return caldb.tables(spark.createDataFrame(list(rows), NUC), spark.createDataFrame([(0, 0.3), (2, None)], "band int, gain double"), bands, solar, unit, **parts)


def test_a_release_is_read_back_whole(spark):
    folder = folder_of(spark, "caldb")
    entries = caldb.publish(given(spark), folder, 1, unit="S2B", source="test")
    assert {(r["name"], r["rows"]) for r in entries.collect()} == {("nuc", 3), ("dark", 2), ("radiometric", 2), ("spectral", 2), ("noise", 2)}
    found = caldb.read(spark, folder)
    assert sorted(map(tuple, found["dark"].select("band", "dark_offset").collect())) == [(0, 480.0), (2, 470.0)]
    assert {r["band"]: r["esun"] for r in found["spectral"].collect()} == pytest.approx({0: 1874.30, 2: 1824.93}, rel=1e-6)
    assert dict(found["spectral"].dtypes)["esun"] == "float"
    assert {r["adf_type"] for r in caldb.long_form(found).collect()} == set(caldb.KINDS.values())
    assert caldb.long_form(found).where("table = 'nuc' AND band = 0 AND col = 1 AND value IS NULL").count() == 2


def test_optional_tables_and_releases(spark):
    folder = folder_of(spark, "caldb")
    caldb.publish(given(spark, spectral=False, noise=False), folder, 1, unit="S2B", source="test")
    assert set(caldb.read(spark, folder)) == {"nuc", "dark", "radiometric"}
    caldb.publish(given(spark), folder, 2, unit="S2B", source="test")
    assert len(caldb.read(spark, folder)) == 5 and len(caldb.read(spark, folder, 1)) == 3
    with pytest.raises(ValueError, match="published already"):
        caldb.publish(given(spark), folder, 2, unit="S2B", source="test")


def test_a_lost_publication_is_not_seen(spark):
    folder = folder_of(spark, "caldb")
    with pytest.raises(ValueError, match="no release"):
        caldb.read(spark, folder)
    with pytest.raises(Exception, match="no solar irradiance for S2C, B0[13]"):  # nuc is written already when spectral fails
        caldb.publish(given(spark, unit="S2C"), folder, 1, unit="S2C", source="test")
    with pytest.raises(ValueError, match="no release"):
        caldb.read(spark, folder)
    caldb.publish(given(spark, unit="S2C", spectral=False), folder, 1, unit="S2C", source="again")
    assert set(caldb.read(spark, folder)) == {"nuc", "dark", "radiometric", "noise"}


def test_an_empty_database(spark):
    folder = folder_of(spark, "caldb")
    caldb.publish(given(spark, rows=()), folder, 1, unit="S2A", source="test")
    assert caldb.read(spark, folder)["nuc"].count() == 0


@pytest.mark.parametrize(("line", "columns"), [(1, [0, 1]), (2, [0, 1]), (1, [0])])
def test_container_width(spark, line, columns):
    """Frames of two columns; a line that lacks one, or coefficients of another width, are refused."""
    pixels = [(5, 1, x, c, 7, 0) for x in range(3) for c in range(2) if (x, c) != (2, 1) or line == 1]
    flagged = spark.createDataFrame(pixels, "detector int, band int, line int, col int, dn int, qa int")
    coefs = spark.createDataFrame([(5, 1, c) for c in columns], "detector int, band int, col int")
    series = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [0.0] * 3, [1.0, 0.0, 0.0, 0.0])], "line int, position array<double>, velocity array<double>, quaternion array<double>")
    conditions = containers.line_conditions(flagged, series, epoch=100.0, period=0.5)
    write = lambda: containers.write_open_container(flagged, conditions, coefs, spark.createDataFrame([("{}",)], "document string"), new_path(spark, "box"), ["detector", "band"])
    if line == 2 or len(columns) == 1:
        with pytest.raises(ValueError, match="differ in width"):
            write()
        return
    lines, found, _ = containers.read_open_container(spark, write())
    assert lines.count() == 3 and lines.first()["samples"] == [7, 7]
    assert sorted((r["line"], r["t"], r["position"]) for r in found.collect()) == [(0, 100.0, [1.0, 2.0, 3.0]), (1, 100.5, None), (2, 101.0, None)]


def test_conditions_of_another_length_are_refused(spark):
    lines = spark.createDataFrame([(0,)], "line int")
    series = spark.createDataFrame([(0, [1.0], [0.0] * 3, [1.0] * 4)], "line int, position array<double>, velocity array<double>, quaternion array<double>")
    with pytest.raises(Exception, match="position needs 3 components"):
        containers.line_conditions(lines, series, epoch=0.0).collect()


def test_root_document(spark):
    """Nulls are left out, and both ends have their times and positions."""
    row = ("S2MSIL0_", "S2C", "Sentinel-2C", None, "d", 45, None, "descending", "NOBS", [8.0, 44.0, 10.0, 45.0], datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 9), 5.0, [3, 11], {"8A": 6.5}, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], None)
    kinds = "kind string, unit string, platform string, level string, datastrip string, relative_orbit int, absolute_orbit int, orbit_state string, operation_mode string, bbox array<double>, start timestamp, stop timestamp, epoch_gps double, detectors array<int>, band_times map<string, double>, position array<array<double>>, velocity array<array<double>>"
    x = spark.createDataFrame([row], kinds).join(containers.band_information(spark), "unit")
    doc = json.loads(x.select(containers.root_document(x)).first()[0])
    properties, other = doc["stac_discovery"]["properties"], doc["other_metadata"]
    assert "sat:absolute_orbit" not in properties and "processing:level" not in properties and properties["eopf:type"] == "S2MSIL0_"
    assert doc["stac_discovery"]["geometry"]["coordinates"] == [[[8.0, 44.0], [10.0, 44.0], [10.0, 45.0], [8.0, 45.0], [8.0, 44.0]]]
    assert other["orbit_ephemeris_start"] == {"TAI": "2024-01-01T00:00:37.000Z", "UTC": "2024-01-01T00:00:00.000Z", "UT1": "2024-01-01T00:00:00.000Z", "position": [1.0, 2.0, 3.0]}
    assert other["orbit_ephemeris_stop"]["position"] == [4.0, 5.0, 6.0]
    acquired = other["sensor_configuration"]["acquisition_configuration"]
    assert acquired["active_detectors_list"] == "03,11" and acquired["tdi_configuration_list"] == dict.fromkeys(("03", "04", "11", "12"), "APPLIED")
    assert acquired["spectral_band_info"]["8A"]["central_wavelength"] == {"unit": "nm", "value": 866.0} and len(acquired["spectral_band_info"]) == 13
    assert other["sensor_configuration"]["time_stamp"]["band_time_stamp"] == {"8A": {"unit": "s (GPS)", "value": 6.5}}


def test_structure_counts(spark):
    paths = ["a.zarr/measurements/d01/b02/img/0", "a.zarr/measurements/d01/b02/img/1", "a.zarr/measurements/d01/B02/mask/0", "a.zarr/measurements/DD1/b03/img/0", "b.zarr/conditions/x", "c.zarr", None, "other.json"]
    got = stores.structure(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(map(tuple, got.collect())) == [("a.zarr", 1, 1, 2), ("b.zarr", 0, 0, 0), ("c.zarr", 0, 0, 0)]


def test_errors_and_noise(spark):
    x = spark.createDataFrame([(1, 3.0), (1, -4.0), (1, None), (2, None)], "band int, e double")
    assert sorted(map(tuple, profile.root_mean_square(x, ["band"], F.col("e"), "rmse").collect())) == [(1, 2, pytest.approx(12.5**0.5)), (2, 0, None)]
    y = spark.createDataFrame([(1, 2.0, 2.0, 10.0, 3.0, 1.6), (1, -2.0, 2.0, -5.0, 3.0, 1.6)], "band int, noise double, gain double, signal double, alpha double, beta double")
    assert tuple(profile.noise_check(y, ["band"]).first()) == (1, 2, 1.0, 4.0)
