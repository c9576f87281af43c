"""Queries on statistics: calibration, profiles, comparison (AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorlake.fixtures import ACQ, COEF, FRAME, NAMES, acquisition, coefficients, frame, frame_lines, product_names, sql
from sensorlake.functions import radiometry as R
from sensorlake.functions.numbers import steady
from sensorlake.operators import align, calibrate, profile
from sensorlake.plans.pixels import newton_sql
from sensorlake.plans.registry import query

BAND = ["band"]
def dn() -> Column:
    return F.col("dn").cast("double")


_M = "m AS (SELECT band, col, avg(dn) FILTER (kind = 'dark') AS d, avg(dn) FILTER (kind = 'flat') AS f FROM acq GROUP BY band, col)"


@query("agg_01_dark", sql(ACQ, "SELECT band, col, round(avg(dn), 6) AS dark FROM acq WHERE kind = 'dark' GROUP BY band, col"))
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.column_dark(acquisition(spark, sf_dir), BAND).select("band", "col", steady("dark").alias("dark"))


@query("agg_02_relative_response", sql(ACQ, _M, "s AS (SELECT *, CASE WHEN f > d THEN f - d END AS signal FROM m)", "SELECT band, col, round(coalesce(1 / signal / avg(1 / signal) OVER (PARTITION BY band), 1), 6) AS response, round(avg(signal) OVER (PARTITION BY band) / 150, 6) AS abs_coef FROM s"))
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = calibrate.relative_response(acquisition(spark, sf_dir), BAND, 150.0)
    return r.select("band", "col", steady("response").alias("response"), steady("abs_coef").alias("abs_coef"))


@query("agg_03_nuc_two_point", sql(ACQ, _M, "g AS (SELECT *, avg(f) OVER (PARTITION BY band) AS mf, avg(d) OVER (PARTITION BY band) AS md FROM m)", "SELECT band, col, round((mf - md) / nullif(f - d, 0), 6) AS gain, round(mf - (mf - md) / nullif(f - d, 0) * f, 6) AS \"offset\", round(md, 6) AS dark FROM g"))
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("band")
    m = calibrate.column_means(acquisition(spark, sf_dir), BAND).withColumns({"mf": F.avg("f").over(w), "md": F.avg("d").over(w)})
    g = F.try_divide(F.col("mf") - F.col("md"), F.col("f") - F.col("d"))
    return m.select("band", "col", steady(g).alias("gain"), steady(F.col("mf") - g * F.col("f")).alias("offset"), steady("md").alias("dark"))


@query("agg_03_nuc_single_precision", sql(ACQ, _M, "g AS (SELECT *, avg(f) OVER (PARTITION BY band) AS mf, avg(d) OVER (PARTITION BY band) AS md FROM m)", "SELECT band, count(*) AS n, count(CAST((mf - md) / nullif(f - d, 0) AS FLOAT)) AS n_gain, round(max(md), 6) AS dark FROM g GROUP BY band"))
def agg_03_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.two_point(acquisition(spark, sf_dir), BAND).groupBy("band").agg(F.count("*").alias("n"), F.count("gain").alias("n_gain"), steady(F.max("dark")).alias("dark"))


@query("agg_04_radiance_gain", sql(ACQ, "s AS (SELECT band, avg(dn) FILTER (kind = 'flat') AS f, avg(dn) FILTER (kind = 'dark') AS d FROM acq GROUP BY band)", "SELECT band, round(CASE WHEN f > d THEN 150 / (f - d) END, 6) AS gain FROM s"))
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.radiance_gain(acquisition(spark, sf_dir), BAND, 150.0).select("band", steady("gain").alias("gain"))


def running_mean_sql(source: str, value: str, width: int, out: str) -> str:
    """A common table expression: the reflected running mean of a profile (band, col, value) with 64 columns."""
    half = width // 2
    return f"{out} AS (SELECT p.band, p.col, any_value(p.{value}) AS {value}, sum(q.{value}) / {width} AS trend FROM {source} p, range(-{half}, {half + 1}) o(o) JOIN {source} q ON q.band = p.band AND q.col = CASE WHEN p.col + o < 0 THEN -(p.col + o) WHEN p.col + o > 63 THEN 126 - (p.col + o) ELSE p.col + o END GROUP BY p.band, p.col)"


@query("agg_05_column_prnu", sql(ACQ, "md AS (SELECT band, col, quantile_cont(dn, 0.5) AS m FROM acq WHERE kind = 'flat' GROUP BY band, col)", running_mean_sql("md", "m", 33, "t"), "r AS (SELECT *, coalesce(m / nullif(trend, 0), 1) AS r FROM t)", "SELECT band, col, round(r / quantile_cont(r, 0.5) OVER (PARTITION BY band), 6) AS prnu FROM r"))
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.column_prnu(acquisition(spark, sf_dir).where("kind = 'flat'"), BAND).select("band", "col", steady("prnu").alias("prnu"))


@query("agg_06_column_floor", sql(ACQ, "SELECT band, col, round(quantile_cont(dn, 0.01), 6) AS dark FROM acq GROUP BY band, col"))
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.column_floor(acquisition(spark, sf_dir), BAND).select("band", "col", steady("dark").alias("dark"))


def fpn_sql(source: str, value: str, name: str) -> list[str]:
    return [
        f"{name}_c AS (SELECT band, col, coalesce(m, coalesce(avg(m) OVER (PARTITION BY band), 0)) AS m FROM (SELECT band, col, avg({value}) FILTER ({value} > 0) AS m FROM {source} GROUP BY band, col))",
        running_mean_sql(f"{name}_c", "m", 31, f"{name}_t"),
        f"{name} AS (SELECT band, stddev_pop((m - trend) / greatest(abs(trend), 1e-6::DOUBLE)) AS fpn FROM {name}_t GROUP BY band)",
    ]


@query("agg_07_column_fpn", sql(FRAME, *fpn_sql("frame", "dn", "p"), "SELECT band, round(fpn, 6) AS fpn FROM p"))
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.column_fpn(frame(spark, sf_dir), BAND).select("band", steady("fpn").alias("fpn"))


_COR = "cor AS (SELECT f.band, f.line, f.col, f.dn, CASE WHEN model = 'CUBIC' THEN a * (dn - dark) * (dn - dark) * (dn - dark) + b * (dn - dark) * (dn - dark) + c * (dn - dark) WHEN dn - dark <= zs THEN a1 * (dn - dark) ELSE a2 * (dn - dark) + (a1 - a2) * zs END AS y FROM frame f JOIN coef USING (band, col))"


@query("agg_07_fpn_before_after", sql(FRAME, COEF, _COR, *fpn_sql("frame", "dn", "p"), *fpn_sql("cor", "y", "q"), "SELECT p.band, round(p.fpn, 6) AS fpn_before, round(q.fpn, 6) AS fpn_after FROM p JOIN q USING (band)"))
def fpn_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    y = align.with_coefficients(f, coefficients(spark), BAND).withColumn("y", R.forward_correct(dn()))
    a, b = calibrate.column_fpn(f, BAND), calibrate.column_fpn(y, BAND, "y")
    return a.join(b.withColumnRenamed("fpn", "after"), "band").select("band", steady("fpn").alias("fpn_before"), steady("after").alias("fpn_after"))


@query("agg_08_frame_profile", sql(FRAME, "SELECT detector, band, max(line) + 1 AS n_lines, max(col) + 1 AS n_cols, min(dn) AS dn_min, max(dn) AS dn_max, count(*) FILTER (dn > 4095) AS n_above, count(*) FILTER (dn = 32768) AS n_saturated, CASE WHEN max(dn) <= 4095 THEN 12 ELSE 16 END AS bit_depth FROM frame GROUP BY detector, band"))
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frame_profile(frame(spark, sf_dir), ["detector", "band"])


@query("agg_08_profile_rollup", sql(FRAME, "SELECT detector, band, min(dn) AS dn_min, max(dn) AS dn_max, count(*) AS n FROM frame GROUP BY ROLLUP (detector, band)"))
def agg_08_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).rollup("detector", "band").agg(F.min("dn").alias("dn_min"), F.max("dn").alias("dn_max"), F.count("*").alias("n"))


@query("agg_09_zero_tail", sql(FRAME, "SELECT band, max(line) + 1 AS n_lines, coalesce(max(line) - max(line) FILTER (dn <> 0), max(line) + 1) AS lost FROM frame GROUP BY band"))
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.zero_tail(frame(spark, sf_dir), BAND)


_H = "h AS (SELECT band, dn, count(*) AS n FROM frame GROUP BY band, dn), t AS (SELECT band, sum(n) AS t FROM h GROUP BY band)"


@query("agg_10_entropy", sql(FRAME, _H, "SELECT band, round(-sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)), 6) AS entropy FROM h JOIN t USING (band) GROUP BY band"))
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entropy(frame(spark, sf_dir), BAND).select("band", steady("entropy").alias("entropy"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with a known change, for comparisons."""
    return frame(spark, sf_dir).withColumn("dn", F.col("dn") + (F.col("line") * 3 + F.col("col")) % 7 - 2)


_SHIFTED = "other AS (SELECT band, line, col, dn + (line * 3 + col) % 7 - 2 AS dn FROM frame)"
_DIFF = "d AS (SELECT f.band, CAST(f.dn AS DOUBLE) AS x, CAST(o.dn AS DOUBLE) AS y, CAST(f.dn - o.dn AS DOUBLE) AS d FROM frame f JOIN other o USING (band, line, col))"


@query("agg_11_compare", sql(FRAME, _SHIFTED, _DIFF, "SELECT band, round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(sqrt(avg(d * d)), 6) AS rmse FROM d GROUP BY band"))
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.compare(frame(spark, sf_dir), _shifted(spark, sf_dir), BAND).select("band", steady("median_abs").alias("median_abs"), steady("rmse").alias("rmse"))


@query("agg_12_psnr_bias", sql(FRAME, _SHIFTED, _DIFF, "SELECT band, round(20 * log10(4095 / sqrt(avg(d * d))), 6) AS psnr, round(avg(d), 6) AS bias, round(100 * sqrt(avg(d * d)) / avg(y), 6) AS percent_error FROM d GROUP BY band"))
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.compare(frame(spark, sf_dir), _shifted(spark, sf_dir), BAND)
    return c.select("band", *[steady(n).alias(n) for n in ("psnr", "bias", "percent_error")])


@query("agg_13_stage_row", sql(FRAME, "SELECT band, min(dn) AS lo, max(dn) AS hi, round(avg(dn), 6) AS mean, round(stddev_pop(dn), 6) AS std, round(20 * log10(avg(dn) / nullif(stddev_pop(dn), 0)), 6) AS snr_db FROM frame GROUP BY band"))
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stage_row(frame(spark, sf_dir), BAND).select("band", "lo", "hi", *[steady(n).alias(n) for n in ("mean", "std", "snr_db")])


@query("agg_13_stage_row_entropy", sql(FRAME, _H, "e AS (SELECT band, -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)) AS entropy FROM h JOIN t USING (band) GROUP BY band)", "s AS (SELECT band, min(dn) AS lo, max(dn) AS hi, avg(dn) AS mean, stddev_pop(dn) AS std FROM frame GROUP BY band)", "SELECT band, lo, hi, round(mean, 6) AS mean, round(std, 6) AS std, round(20 * log10(mean / nullif(std, 0)), 6) AS snr_db, round(entropy, 6) AS entropy FROM s JOIN e USING (band)"))
def agg_13_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    whole = profile.stage_row(f, BAND).join(profile.entropy(f, BAND), "band")
    return whole.select("band", "lo", "hi", *[steady(n).alias(n) for n in ("mean", "std", "snr_db", "entropy")])


@query("agg_14_bit_depth", sql(FRAME, "SELECT band, CASE WHEN max(dn) * 2 <= 4095 THEN 12 ELSE 16 END AS bit_depth FROM frame GROUP BY band"))
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).groupBy("band").agg(profile.bit_depth(F.max("dn") * 2).alias("bit_depth"))


@query("agg_15_frame_checksum")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.line_checksums(frame_lines(spark, sf_dir), BAND, "embedding")


@query("agg_16_compression", sql(FRAME, "l AS (SELECT band, line, sum(CASE WHEN dn = 0 THEN 1 ELSE 2 END) AS coded, count(*) AS px FROM frame GROUP BY band, line)", "SELECT band, CAST(sum(ceil(px * 12 / 8)) AS BIGINT) AS raw_bytes, CAST(sum(coded) AS BIGINT) AS coded_bytes, round(sum(ceil(px * 12 / 8)) / sum(coded), 6) AS ratio, round(8.0::DOUBLE * sum(coded) / sum(px), 6) AS bits_per_px, round(max(ceil(px * 12 / 8) / coded), 6) AS best_ratio FROM l GROUP BY band"))
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.coding import accounting

    lines = frame(spark, sf_dir).groupBy("band", "line").agg(F.sum(F.when(F.col("dn") == 0, 1).otherwise(2)).alias("coded"), F.count("*").alias("px"))
    a = accounting(lines, BAND, 12)
    return a.select("band", "raw_bytes", "coded_bytes", *[steady(n).alias(n) for n in ("ratio", "bits_per_px", "best_ratio")])


@query("agg_18_median_percent", sql(FRAME, _SHIFTED, _DIFF, "SELECT band, round(100 * abs(quantile_cont(y, 0.5) - quantile_cont(x, 0.5)) / greatest(quantile_cont(x, 0.5), 1e-6::DOUBLE), 6) AS percent FROM d GROUP BY band"))
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = frame(spark, sf_dir).groupBy("band").agg(F.percentile("dn", F.lit(0.5)).alias("x"))
    y = _shifted(spark, sf_dir).groupBy("band").agg(F.percentile("dn", F.lit(0.5)).alias("y"))
    return x.join(y, "band").select("band", steady(100 * F.abs(F.col("y") - F.col("x")) / F.greatest("x", F.lit(1e-6))).alias("percent"))


@query("agg_19_count_statistics", sql(FRAME, "SELECT band, round(avg(dn), 6) AS mean, round(stddev_pop(dn), 6) AS std, round(quantile_cont(dn, 0.02), 6) AS p2, round(quantile_cont(dn, 0.98), 6) AS p98, max(dn) AS hi FROM frame GROUP BY band"))
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("dn", F.array(F.lit(0.02), F.lit(0.98)))
    s = frame(spark, sf_dir).groupBy("band").agg(F.avg("dn").alias("mean"), F.stddev_pop("dn").alias("std"), p.alias("p"), F.max("dn").alias("hi"))
    return s.select("band", steady("mean").alias("mean"), steady("std").alias("std"), steady(F.col("p")[0]).alias("p2"), steady(F.col("p")[1]).alias("p98"), "hi")


@query("agg_19_density_histogram", sql(FRAME, "n AS (SELECT band, count(*) AS n FROM frame GROUP BY band)", "b AS (SELECT band, least(dn * 120 // 4096, 119) AS bin, count(*) AS c FROM frame GROUP BY ALL)", "SELECT band, CAST(bin AS INT) AS bin, c AS count, round(c / (n * (4096.0::DOUBLE / 120)), 6) AS density FROM b JOIN n USING (band)"))
def agg_19_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.coding import density

    return density(frame(spark, sf_dir), BAND, 4096.0, 120).select("band", "bin", "count", steady("density").alias("density"))


@query("agg_20_positive_only", sql(FRAME, "SELECT band, col, round(coalesce(avg(dn) FILTER (dn > 2048), avg(dn)), 6) AS mean FROM frame GROUP BY band, col"))
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.coalesce(F.avg(F.when(F.col("dn") > 2048, F.col("dn"))), F.avg("dn"))
    return frame(spark, sf_dir).groupBy("band", "col").agg(steady(m).alias("mean"))


@query("agg_22_product_envelope", sql(NAMES, "SELECT kind, max(o_orderkey % 21384) AS n_lines, string_agg(DISTINCT lpad(CAST(1 + o_custkey % 12 AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(1 + o_custkey % 12 AS VARCHAR), 2, '0')) AS detectors, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS stop FROM pn GROUP BY kind"))
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.stores import envelope

    n = product_names(spark, sf_dir).select("kind", (F.col("o_orderkey") % 21384).alias("line"), (1 + F.col("o_custkey") % 12).cast("int").alias("detector"), F.col("o_orderdate").cast("date").alias("t"))
    return envelope(n, ["kind"])


@query("agg_23_decode_qa", sql(FRAME, "SELECT band, count(*) AS n, count(*) FILTER (dn = 0) AS n_zero, count(*) FILTER (dn >= 4095) AS n_saturated, round(100.0::DOUBLE * count(*) FILTER (dn = 0) / count(*), 6) AS pct_zero, round(100.0::DOUBLE * count(*) FILTER (dn >= 4095) / count(*), 6) AS pct_saturated FROM frame GROUP BY band"))
def agg_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.coding import decode_qa

    q = decode_qa(frame(spark, sf_dir), BAND)
    return q.select("band", "n", "n_zero", "n_saturated", steady("pct_zero").alias("pct_zero"), steady("pct_saturated").alias("pct_saturated"))


@query("agg_24_quantization", sql(FRAME, COEF, "q AS (SELECT band, dn * c AS x, CAST(greatest(least(round_even(dn * c, 0), 4095), 0) AS DOUBLE) AS y FROM frame JOIN coef USING (band, col))", "SELECT band, round(CAST(count(*) FILTER (y >= 4095) AS DOUBLE) / count(*), 6) AS saturated, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse FROM q GROUP BY band"))
def agg_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.with_coefficients(frame(spark, sf_dir), coefficients(spark), BAND).withColumn("x", dn() * F.col("c")).withColumn("y", R.quantize(F.col("x")))
    d = F.col("x") - F.col("y")
    return x.groupBy("band").agg(steady(F.avg(F.when(F.col("y") >= R.DN_MAX, 1.0).otherwise(0.0))).alias("saturated"), steady(F.sqrt(F.avg(d * d))).alias("rmse"))


@query("agg_26_collapse_sublines", sql(COEF, FRAME, "s AS (SELECT band, col, dark + i * 0.1::DOUBLE AS dark FROM coef, range(6) r(i) WHERE band IN (SELECT band FROM frame))", "SELECT band, col, round(avg(dark), 6) AS dark FROM s GROUP BY band, col"))
def agg_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = frame(spark, sf_dir).select("band").distinct()
    lines = coefficients(spark).join(F.broadcast(used), "band", "left_semi").select("band", "col", F.col("dark"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return calibrate.collapse_sublines(lines.withColumn("dark", F.col("dark") + F.col("i") * 0.1), BAND).select("band", "col", steady("dark").alias("dark"))


@query("agg_27_snr_at_reference", sql(FRAME, "SELECT band, round(avg(dn) / sqrt(1.44::DOUBLE + 0.03::DOUBLE * avg(dn)), 6) AS snr, abs(avg(dn) / sqrt(1.44::DOUBLE + 0.03::DOUBLE * avg(dn)) - 250) <= 20 AS within FROM frame WHERE dn > 0 GROUP BY band"))
def agg_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame(spark, sf_dir).where("dn > 0").groupBy("band").agg(F.avg("dn").alias("m"))
    snr = F.col("m") / R.noise_sigma(F.col("m"), F.lit(1.44), F.lit(0.03))
    return m.select("band", steady(snr).alias("snr"), (F.abs(snr - 250) <= 20).alias("within"))


@query("agg_28_recovery", sql(ACQ, "e AS (SELECT band, col, avg(dn) AS e FROM acq WHERE kind = 'dark' GROUP BY band, col)", "SELECT band, round(avg(e - (442 + col % 7)), 6) AS mean_error, round(stddev_pop(e - (442 + col % 7)), 6) AS std_error, round(corr(e, 442 + col % 7), 6) AS correlation FROM e GROUP BY band"))
def agg_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calibrate.column_dark(acquisition(spark, sf_dir), BAND)
    truth = e.select("band", "col", (442 + F.col("col") % 7).alias("dark"))
    r = calibrate.recovery(e, truth, BAND, "dark")
    return r.select("band", *[steady(n).alias(n) for n in ("mean_error", "std_error", "correlation")])


@query("agg_29_acquisition_summary", sql(ACQ, "SELECT band, round(avg(dn) FILTER (kind = 'dark'), 6) AS dark_mean, round(avg(dn) FILTER (kind = 'flat'), 6) AS flat_mean, max(dn) FILTER (kind = 'flat') AS flat_max FROM acq GROUP BY band"))
def agg_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.when(F.col("kind") == kind, F.col("dn"))
    return acquisition(spark, sf_dir).groupBy("band").agg(steady(F.avg(of("dark"))).alias("dark_mean"), steady(F.avg(of("flat"))).alias("flat_mean"), F.max(of("flat")).alias("flat_max"))


@query("agg_30_round_trip", sql(FRAME, COEF, "px AS (SELECT c.*, f.line, f.dn FROM frame f JOIN coef c USING (band, col))", "cr AS (SELECT *, CASE WHEN model = 'CUBIC' THEN a * (dn - dark) * (dn - dark) * (dn - dark) + b * (dn - dark) * (dn - dark) + c * (dn - dark) WHEN dn - dark <= zs THEN a1 * (dn - dark) ELSE a2 * (dn - dark) + (a1 - a2) * zs END AS w FROM px)", *newton_sql("cr", "w", "iv"), "SELECT band, count(*) AS n, max(abs(inv + dark - dn)) < 1e-6 AS exact FROM iv WHERE dn > 0 AND dn < 32768 GROUP BY band"))
def agg_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.with_coefficients(frame(spark, sf_dir), coefficients(spark), BAND).withColumn("w", R.forward_correct(dn()))
    x = R.reverse_impress(x, F.col("w"), "back").where("dn > 0 AND dn < 32768")
    return x.groupBy("band").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("back") - F.col("dn"))) < 1e-6).alias("exact"))


@query("agg_30_round_trip_error", sql(FRAME, COEF, "px AS (SELECT c.*, f.line, f.dn FROM frame f JOIN coef c USING (band, col))", "cr AS (SELECT *, CASE WHEN model = 'CUBIC' THEN a * (dn - dark) * (dn - dark) * (dn - dark) + b * (dn - dark) * (dn - dark) + c * (dn - dark) WHEN dn - dark <= zs THEN a1 * (dn - dark) ELSE a2 * (dn - dark) + (a1 - a2) * zs END AS w FROM px)", *newton_sql("cr", "w", "iv"), *fpn_sql("frame", "dn", "p"), *fpn_sql("cr", "w", "q"), "e AS (SELECT band, count(*) AS n, sqrt(avg((inv + dark - dn) * (inv + dark - dn))) AS rmse FROM iv WHERE dn > 0 AND dn < 32768 GROUP BY band)", "SELECT band, n, round(rmse, 6) AS rmse, round(p.fpn, 6) AS fpn_before, round(q.fpn, 6) AS fpn_after FROM e JOIN p USING (band) JOIN q USING (band)"))
def agg_30_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of forward and back on valid pixels, and column noise of the counts and of the corrected values."""
    f = frame(spark, sf_dir)
    x = align.with_coefficients(f, coefficients(spark), BAND).withColumn("w", R.forward_correct(dn()))
    d = F.col("back") - F.col("dn")
    error = R.reverse_impress(x, F.col("w"), "back").where("dn > 0 AND dn < 32768").groupBy("band").agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))
    noise = calibrate.column_fpn(f, BAND).join(calibrate.column_fpn(x, BAND, "w").withColumnRenamed("fpn", "after"), "band")
    return error.join(noise, "band").select("band", "n", steady("rmse").alias("rmse"), steady("fpn").alias("fpn_before"), steady("after").alias("fpn_after"))


@query("agg_31_array_summary", "SELECT label AS band, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, count(*) FILTER (isnan(v)) AS n_nan FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label")
def agg_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.coding import array_summary

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("band"), F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return array_summary(e, BAND, "v").select("band", "lo", "hi", steady("mean").alias("mean"), "n_nan")


@query("udf_01_entropy_function", sql(FRAME, _H, "SELECT band, round(-sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)), 6) AS entropy FROM h JOIN t USING (band) GROUP BY band"))
def udf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).transform(profile.entropy, BAND).select("band", steady("entropy").alias("entropy"))


@query("src_23_acquisition_scan", sql(ACQ, "SELECT band, kind, count(*) AS n, min(dn) AS lo, max(dn) AS hi FROM acq WHERE kind = 'flat' GROUP BY band, kind"))
def src_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition(spark, sf_dir).where("kind = 'flat'").groupBy("band", "kind").agg(F.count("*").alias("n"), F.min("dn").alias("lo"), F.max("dn").alias("hi"))
