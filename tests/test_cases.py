"""Small literal cases and plan checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sensorlake.functions import flags, metadata, names, times
from sensorlake.functions import radiometry as R
from sensorlake.operators import align, calibrate, chain, coding, profile, resample, sequence


def pixels(spark, rows, band=1):
    return spark.createDataFrame([(band, i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)], "band int, line int, col int, dn int")


def identity(spark, width, dark=440.0):
    return spark.createDataFrame([(1, c, dark, 0.0, 0.0, 1.0, 1.0, 1.0, 600.0, "CUBIC") for c in range(width)], "band int, col int, dark double, a double, b double, c double, a1 double, a2 double, zs double, model string")


def values(df, col="dn"):
    return [r[col] for r in df.orderBy("line", "col").collect()]


def test_dark_level(spark):
    out = chain.reverse_chain(pixels(spark, [[390] * 4] * 2), identity(spark, 4), ["band"], dark_level=51.0)
    assert set(values(out)) == {341}


def test_unbin_then_bin_gives_the_input(spark):
    p = pixels(spark, [[1, 2], [3, 4]])
    u = resample.unbin(p, 3)
    assert u.count() == 12
    assert values(resample.bin_mean(u, 3, ["band"])) == [1.0, 2.0, 3.0, 4.0]


def test_kernel_impulse(spark):
    rows = [[0, 0] for _ in range(64)]
    rows[32] = [1, 1]
    shifts = spark.createDataFrame([(1, 0, 1), (1, 1, -1)], "band int, col int, shift int")
    out = {(r["line"], r["col"]): r["dn"] for r in resample.interpolate_lines(pixels(spark, rows), shifts, (0.0, 0.667, 0.333), ["band"]).collect()}
    assert out[32, 0] == 0.667 and out[33, 0] == 0.333 and out[31, 1] == 0.333


def test_knee(spark):
    df = spark.createDataFrame([(50.0,), (100.0,), (300.0,)], "z double")
    got = [r[0] for r in df.select(R.bilinear(F.col("z"), F.lit(1.005), F.lit(0.995), F.lit(100.0))).collect()]
    assert [round(x, 9) for x in got] == [50.25, 100.5, 299.5]


def test_crosstalk_only_between_equal_shapes(spark):
    a, b = pixels(spark, [[100, 100]], 1), pixels(spark, [[200, 200]], 2)
    c = pixels(spark, [[500]], 3)
    matrix = spark.createDataFrame([(1, 2, 0.01), (1, 3, 0.5)], "k int, l int, coef double")
    out = resample.crosstalk(a.union(b).union(c), matrix, [])
    assert values(out.where("band = 1")) == [102.0, 102.0]
    assert values(out.where("band = 3")) == [500.0]


def test_line_stride_keeps_all_lines_of_long_frames(spark, tmp_path):
    from sensorlake.plans.joins import join_18

    long = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.lit(0.1).cast("float")).alias("embedding"))
    long.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["band"]: (r["n"], r["last"]) for r in join_18(spark, str(tmp_path)).groupBy("band").agg(F.count("*").alias("n"), F.max("fine_line").alias("last")).collect()}
    assert got == {0: (1500, 1499), 1: (750, 1498)}


def test_all_lines_of_crosstalk_and_composite(spark):
    from conftest import SF

    from sensorlake.fixtures import frame
    from sensorlake.plans.registry import QUERIES, load_all

    load_all()
    f = frame(spark, SF)
    for name in ("join_05_crosstalk_all_lines", "join_06_uniform_crosstalk_all_lines"):
        assert QUERIES[name](spark, SF).count() == f.count()
    last = f.where("band IN (2, 3, 4)").agg(F.max("line")).first()[0]
    assert last > 40 and QUERIES["res_05_composite_all_lines"](spark, SF).agg(F.max("line")).first()[0] == last // 2


def test_whole_listing_has_a_place_for_every_name(spark):
    from conftest import SF

    from sensorlake.fixtures import product_names
    from sensorlake.plans.registry import QUERIES, load_all

    load_all()
    rows = QUERIES["top_01_ordered_listing_whole"](spark, SF).collect()
    assert [r["place"] for r in rows] == list(range(1, product_names(spark, SF).count() + 1))
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)


def test_blind_columns_come_back(spark):
    blind = spark.createDataFrame([(1, 0), (1, 3)], "band int, col int")
    p = pixels(spark, [[7, 8]])
    assert values(align.insert_blind(p, blind, 4, ["band"], 51)) == [51, 7, 8, 51]
    assert values(align.insert_blind(p, blind, 9, ["band"], 51)) == [7, 8]


def test_flags_of_a_small_frame(spark):
    p = pixels(spark, [[480, 4095, 5], [480, 480, 480], [0, 0, 0]])
    dead = spark.createDataFrame([(1, 0)], "band int, col int")
    hot = spark.createDataFrame([(1, 0, 2)], "band int, line int, col int")
    qa = flags.seed_flags(p, dead, hot, ["band"])
    assert values(qa, "qa") == [8, 4, 8, 8, 0, 0, 11, 3, 3]
    assert values(qa.withColumn("m", flags.to_mask(F.col("qa"))), "m") == [16, 128, 16, 16, 0, 0, 52, 36, 36]
    empty = pixels(spark, [[0, 0]])
    none = dead.limit(0)
    assert values(flags.seed_flags(empty, none, hot.limit(0), ["band"]), "qa") == [1, 1]
    assert profile.zero_tail(empty, ["band"]).first()["lost"] == 1


def test_segment_flags_and_grammar(spark):
    parts = spark.createDataFrame([(0, 0, 10), (1, 1, 64), (1, 2, 64), (1, 3, 64), (1, 4, 8), (2, 5, 64)], "seg int, pos int, data_len int")
    f = sequence.segment_flags(parts, ["seg"], ["pos"]).orderBy("pos")
    assert [r["seq_flags"] for r in f.collect()] == [3, 1, 0, 0, 2, 3]
    ok = sequence.reassemble(f.withColumn("apid", F.lit(1)).where("pos <> 4"), ["apid"], "pos").orderBy("segment")
    assert [r["ok"] for r in ok.collect()] == [True, False, True]


def test_names(spark):
    row = spark.createDataFrame([("S02MSIL0_", dt.datetime(2024, 4, 3, 10, 24, 15))], "t string, s timestamp")
    name = row.select(names.build_name(F.col("t"), F.col("s"), F.lit(33.0), F.lit("A"), F.lit(45))).first()[0]
    assert name == "S02MSIL0__20240403T102415_0033_A045_TC42.zarr"
    texts = spark.createDataFrame([(name,), ("bad",), (None,), ("S02MSIL0__20240403T102415_0000_A999_TC42",)], "n string")
    got = [(r[0]["valid"], r[0]["buildable"], r[0]["relative_orbit"]) for r in texts.select(names.parse_name(F.col("n"))).collect()]
    assert got == [(True, True, 45), (False, False, None), (False, False, None), (True, False, 999)]
    parsed = lambda f, n: tuple(spark.createDataFrame([(n,)], "n string").select(f(F.col("n")).alias("p")).select("p.*").first())
    fields = ("S02MSIL0_", "20240403T102415", 33, "A", 45, "T", "C42")
    assert parsed(names.parse_name, name) == (*fields, None, ".zarr", True, True)
    assert parsed(names.parse_name, name[:-5]) == (*fields, None, "", True, True)
    assert parsed(names.parse_name, name[:-5] + "_X_1.zarr.zip") == (*fields, "X_1", ".zarr.zip", True, True)
    assert parsed(names.parse_name, "S02MSIXX_" + name[9:]) == (None,) * 9 + (False, False)
    old = "S2A_OPER_MSI_L0__DS_20230216T150621_V20230216T150621_20230216T150700_A039976_T31TCJ"
    assert parsed(names.parse_lenient, old) == (False, "MSI_L0__DS", "20230216T150621", None, 39976, "S2A")
    assert parsed(names.parse_lenient, old[:35])[2:5] == ("20230216T150621", None, None)
    orbit = spark.createDataFrame([("GS2A_20230216T150621_039976_N04.00",)], "t string").select(names.orbit_of_data_take(F.col("t"))).first()[0]
    assert orbit == 39976
    assert spark.range(1).select(names.range_list(F.lit("1-3,7"))).first()[0] == [1, 2, 3, 7]


def test_times(spark):
    t = spark.createDataFrame([("2024-04-17T00:00:00Z",), ("20240417T000000",), ("null",), (None,)], "t string").select(times.parse_utc(F.col("t")).alias("t"))
    assert [r[0] for r in t.collect()] == [dt.datetime(2024, 4, 17)] * 2 + [None, None]
    code = spark.range(1).select(times.cuc(F.lit(5.5)).alias("c")).select("c", times.cuc_seconds(F.col("c"))).first()
    assert tuple(code) == ("000000058000", 5.5)


def test_wavelet_and_zigzag_are_lossless_at_the_ends(spark):
    p = pixels(spark, [[(7 * c * c + 3 * r) % 4096 for c in range(8)] for r in range(3)])
    back = coding.unwavelet(coding.wavelet(p, ["band", "line"], "col", "dn"), ["band", "line"], "col", "dn")
    assert values(back) == values(p)
    z = coding.undelta_zigzag(coding.delta_zigzag(p, ["band", "line"], ["col"]), ["band", "line"], ["col"])
    assert values(z, "back") == values(p)


def test_running_mean_reflects_and_clamps(spark):
    p = spark.createDataFrame([(1, c, float(v)) for c, v in enumerate([1, 2, 4, 8])], "band int, col int, m double")
    got = [r["t"] for r in calibrate.running_mean(p, ["band"], "m", 3, "t").orderBy("col").collect()]
    assert [round(x, 6) for x in got] == [1.666667, 2.333333, 4.666667, 5.333333]


def test_sublines(spark):
    rows = spark.createDataFrame([(1, 0, 441.1 + 0.1 * k) for k in range(6)], "band int, col int, dark double")
    assert round(calibrate.collapse_sublines(rows, ["band"]).first()["dark"], 6) == 441.35


def test_coefficients_are_broadcast_and_newton_stays_small(spark):
    p, c = pixels(spark, [[1000, 2000]]), identity(spark, 2)
    x = R.inverse_equalize(align.with_coefficients(p, c, ["band"]), F.col("dn").cast("double"), "z")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and len(plan) < 30_000


def test_frame_scan_prunes(spark):
    from sensorlake.sources import frames

    path = frames.fresh(spark)
    frames.write_frames(frames.to_lines(pixels(spark, [[1, 2], [3, 4]]).withColumn("detector", F.lit(5)), ["detector", "band"]), path)
    plan = frames.scan(spark, path, bands=[1], lines=(1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan or "band#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(line,1)" in plan


def test_documents(spark):
    docs = [
        '{"stac_discovery":{"properties":{"sat:relative_orbit":7,"platform":"Sentinel-2A","sat:absolute_orbit":12}}}',
        '{"stac_discovery":{"properties":{"platform":"x"},"stac_discovery":{"properties":{"sat:relative_orbit":"/x/ORBIT","eopf:data_take_id":"GS2A_20230216T150621_039976_N04.00"}}}}',
        '{"stac_discovery":{"properties":null}}', "{broken", "", None,
    ]
    got = [tuple(r["i"]) for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "k int, d string").select("k", metadata.identity("d").alias("i")).orderBy("k").collect()]
    assert got[0] == (7, 12, "Sentinel-2A", None, "stac_discovery", [])
    assert got[1] == (None, 39976, "x", "GS2A_20230216T150621_039976_N04.00", "stac_discovery", ["stac_discovery_double_nested", "relative_orbit_not_int", "absolute_orbit_from_datatake_id"])
    assert got[2:5] == [(None, None, None, None, "stac_discovery", [])] * 3 and got[5] == (None, None, None, None, "none", [])
