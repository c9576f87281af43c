"""Queries on pixels: projections, flags, resampling (PRJ, FLG, RES)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import COEF, FRAME, coef_sql, coefficients, frame, sql
from sensorlake.functions import flags, radiometry as R
from sensorlake.operators import align, resample
from sensorlake.functions.numbers import steady
from sensorlake.plans.registry import query
from sensorlake.sources.dimensions import BANDS, BANDS_SQL, band_dim

KEYS = ["detector", "band"]
PIXEL = "SELECT band, line, col"
JOINED = "px AS (SELECT f.detector, f.band, f.line, f.col, f.dn, c.dark, c.a, c.b, c.c, c.a1, c.a2, c.zs, c.model FROM frame f JOIN coef c USING (band, col))"
def dn() -> Column:
    return F.col("dn").cast("double")



def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.with_coefficients(frame(spark, sf_dir), coefficients(spark), ["band"])


def pixel_query(name: str, value: Callable[[], Column], expression: str) -> None:
    """A query that gives one rounded value a pixel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return joined(spark, sf_dir).select("band", "line", "col", steady(value()).alias("value"))

    query(name, sql(FRAME, COEF, JOINED, f"{PIXEL}, round(CAST({expression} AS DOUBLE), 6) AS value FROM px"))(run)


C = F.col
KNEE = "CASE WHEN {z} <= zs THEN a1 * {z} ELSE a2 * {z} + (a1 - a2) * zs END"
FORWARD = "CASE WHEN model = 'CUBIC' THEN a * {z} * {z} * {z} + b * {z} * {z} + c * {z} ELSE " + KNEE + " END"
RAD = "dn * 0.05::DOUBLE"

pixel_query("prj_01_radiance_to_counts", lambda: R.radiance_to_counts(dn() * 0.05, C("c")), f"{RAD} * c")
pixel_query("prj_02_impress_response", lambda: R.impress_response(dn(), C("c")), "dn / c")
pixel_query("prj_03_reapply_dark", lambda: R.reapply_dark(dn(), C("dark")), "dn + dark")
pixel_query("prj_04_linear_eq", lambda: R.reapply_linear_eq(dn(), C("c"), C("dark")), "dn / c + dark")
pixel_query("prj_05_quantize", lambda: R.quantize(dn() * C("c") + C("dark")).cast("double"), "greatest(least(round_even(dn * c + dark, 0), 4095), 0)")
pixel_query("prj_06_undo_offset", lambda: R.undo_offset(dn()) + 2 * R.add_offset(dn()), "(dn + 100) + 2 * (dn - 100)")
pixel_query("prj_07_reverse_radiometric", lambda: R.reverse_radiometric(dn() * 0.05, F.lit(20.5), C("c"), C("dark"), C("a2"), F.lit(3.0)), f"({RAD} * 20.5::DOUBLE / c + dark) / a2 + 3")
pixel_query("prj_08_forward_radiometric", lambda: R.forward_radiometric(dn(), F.lit(20.5), C("c"), C("dark"), C("a2"), F.lit(3.0)), "((dn - 3.0::DOUBLE) * a2 - dark) * c / 20.5::DOUBLE")
pixel_query("prj_09_forward_equalize", lambda: R.forward_equalize(dn()), FORWARD.format(z="CAST(dn AS DOUBLE)"))
pixel_query("prj_11_forward_correct", lambda: R.forward_correct(dn()), FORWARD.format(z="(dn - dark)"))
pixel_query("prj_13_onboard_knee", lambda: R.bilinear(dn(), C("a1"), C("a2"), C("zs")), KNEE.format(z="CAST(dn AS DOUBLE)"))
pixel_query("prj_16_noise_sigma", lambda: R.noise_sigma(dn() - C("dark"), F.lit(1.44), C("c") / 10), "sqrt(greatest(1.44::DOUBLE + c / 10 * greatest(dn - dark, 0), 0))")
pixel_query("prj_22_valid_pixels", lambda: F.when((C("dn") > 0) & (C("dn") < R.SATURATED), 1).otherwise(0) + F.when(C("dn").between(0, R.DN_MAX), 2).otherwise(0), "CASE WHEN dn > 0 AND dn < 32768 THEN 1 ELSE 0 END + CASE WHEN dn BETWEEN 0 AND 4095 THEN 2 ELSE 0 END")


def newton_sql(source: str, y: str, final: str) -> list[str]:
    """Common table expressions for the inverse response of column y."""
    steps = [f"z0 AS MATERIALIZED (SELECT *, ({y}) AS y, ({y}) / c AS z FROM {source})"]
    for k in range(6):
        steps.append(f"z{k + 1} AS MATERIALIZED (SELECT * REPLACE (z - (a * z * z * z + b * z * z + c * z - y) / (3.0::DOUBLE * a * z * z + 2.0::DOUBLE * b * z + c) AS z) FROM z{k})")
    steps.append(f"{final} AS (SELECT *, CASE WHEN model = 'CUBIC' THEN z WHEN y <= a1 * zs THEN y / a1 ELSE (y - (a1 - a2) * zs) / a2 END AS inv FROM z6)")
    return steps


@query("prj_10_inverse_equalize", sql(FRAME, COEF, JOINED, *newton_sql("px", "CAST(dn AS DOUBLE)", "iv"), f"{PIXEL}, round(inv, 6) AS value FROM iv"))
def prj_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inverse_equalize(joined(spark, sf_dir), dn(), "v").select("band", "line", "col", steady("v").alias("value"))


@query("prj_12_reverse_impress", sql(FRAME, COEF, JOINED, *newton_sql("px", "CAST(dn AS DOUBLE)", "iv"), f"{PIXEL}, round(inv + dark, 6) AS value FROM iv"))
def prj_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reverse_impress(joined(spark, sf_dir), dn(), "v").select("band", "line", "col", steady("v").alias("value"))


_SHAPE = "sh AS (SELECT band, col, dark / avg(dark) OVER (PARTITION BY band) AS shape FROM coef)"


@query("prj_15_dark_shape", sql(COEF, _SHAPE, "SELECT band, col, round(50.0::DOUBLE * shape, 6) AS pedestal FROM sh WHERE band IN (SELECT label FROM embeddings)"))
def prj_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import dark_shape

    used = frame(spark, sf_dir).select("band").distinct()
    return dark_shape(coefficients(spark), ["band"]).join(F.broadcast(used), "band", "left_semi").select("band", "col", steady(50.0 * F.col("shape")).alias("pedestal"))


_CHAIN = [
    *newton_sql("px", "dn - 100.0::DOUBLE", "iv"),
    "ob AS (SELECT *, CASE WHEN inv <= 600 THEN 1.005::DOUBLE * inv ELSE 0.995::DOUBLE * inv + (1.005::DOUBLE - 0.995::DOUBLE) * 600 END AS z2 FROM iv)",
    _SHAPE,
    "rw AS (SELECT o.band, o.line, o.col, z2 + 51.0::DOUBLE * shape AS v FROM ob o JOIN sh USING (band, col))",
    "un AS (SELECT band, line, CAST(col * 3 + i AS INT) AS col, v FROM rw, range(3) r(i))",
    "hh AS (SELECT band, max(line) + 1 AS h FROM un GROUP BY band)",
    "rs AS (SELECT band, CAST(((line + CASE WHEN col % 5 = 0 THEN 1 WHEN col % 7 = 0 THEN -1 ELSE 0 END) % h + h) % h AS INT) AS line, col, v FROM un JOIN hh USING (band))",
]


@query("prj_14_reverse_chain", sql(FRAME, COEF, JOINED, *_CHAIN, f"{PIXEL}, CAST(CASE WHEN col IN (3, 77) THEN 0 ELSE greatest(least(round_even(round(v, 9), 0), 4095), 0) END AS INT) AS dn FROM rs"))
def prj_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import reverse_chain

    cols = spark.range(192).select(F.col("id").cast("int").alias("col"))
    bands = spark.range(10).select(F.col("id").cast("int").alias("band"))
    shifts = bands.crossJoin(cols).select("band", "col", F.when(F.col("col") % 5 == 0, 1).when(F.col("col") % 7 == 0, -1).otherwise(0).alias("shift"))
    dead = bands.crossJoin(cols.where("col IN (3, 77)"))
    onboard = coefficients(spark).select("band", "col", F.lit(1.005).alias("o1"), F.lit(0.995).alias("o2"), F.lit(600.0).alias("os"))
    return reverse_chain(frame(spark, sf_dir), coefficients(spark), ["band"], dark_level=51.0, onboard=onboard, unbin_factor=3, shifts=shifts, dead_cols=dead).select("band", "line", "col", "dn")


@query("prj_19_deterministic_chain", sql(FRAME, COEF, JOINED, "s AS (SELECT band, line, col, CAST(col % 2 AS INT) AS sh, dn * 0.05::DOUBLE * 20.5::DOUBLE / c AS v, dark, a2, max(line) OVER (PARTITION BY band) + 1 AS h FROM px)", f"SELECT band, CAST((line + sh) % h AS INT) AS line, col, CAST(CASE WHEN col = 9 THEN 0 ELSE greatest(least(round_even(round((v + dark) / a2 + 3, 9), 0), 4095), 0) END AS INT) AS dn FROM s"))
def prj_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import deterministic_chain

    coef = coefficients(spark)
    shifts = coef.select("band", "col", (F.col("col") % 2).alias("shift"))
    x = deterministic_chain(frame(spark, sf_dir).withColumn("radiance", dn() * 0.05), coef.select("band", "col", F.lit(20.5).alias("gain"), F.col("c").alias("response"), "dark", F.col("a2").alias("eq_gain"), F.lit(3.0).alias("eq_offset")), ["band"], shifts=shifts, dead_cols=coef.where("col = 9").select("band", "col"))
    return x.select("band", "line", "col", "dn")


@query("prj_17_reference_count", sql(BANDS_SQL, "u AS (SELECT DISTINCT label % 13 AS k FROM embeddings)", "SELECT band_name, round((snr*snr*beta + sqrt(snr*snr*snr*snr*beta*beta + 4*snr*snr*alpha*alpha)) / 2, 6) AS dn_ref, round((snr*snr*beta + sqrt(snr*snr*snr*snr*beta*beta + 4*snr*snr*alpha*alpha)) / 2 / lref, 6) AS gain FROM bands JOIN u ON band_index = k"))
def prj_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = frame(spark, sf_dir).select((F.col("band") % len(BANDS)).alias("band_index")).distinct()
    ref = R.reference_count(C("snr"), C("alpha"), C("beta"))
    return band_dim(spark).join(F.broadcast(used), "band_index").select("band_name", steady(ref).alias("dn_ref"), steady(ref / C("lref")).alias("gain"))


_REF = "rf AS (SELECT *, (snr*snr*beta + sqrt(snr*snr*snr*snr*beta*beta + 4*snr*snr*alpha*alpha)) / 2 AS dn_ref FROM bands)"


@query("prj_18_noise_split", sql(BANDS_SQL, _REF, "u AS (SELECT DISTINCT label % 13 AS k FROM embeddings)", "SELECT band_name, round(0.1::DOUBLE * (dn_ref / snr) * (dn_ref / snr), 6) AS a, round(((dn_ref / snr) * (dn_ref / snr) - 0.1::DOUBLE * (dn_ref / snr) * (dn_ref / snr)) / dn_ref, 6) AS b FROM rf JOIN u ON band_index = k"))
def prj_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = frame(spark, sf_dir).select((F.col("band") % len(BANDS)).alias("band_index")).distinct()
    a, b = R.noise_split(R.reference_count(C("snr"), C("alpha"), C("beta")), C("snr"))
    return band_dim(spark).join(F.broadcast(used), "band_index").select("band_name", steady(a).alias("a"), steady(b).alias("b"))


@query("prj_20_nuc_to_radiance", sql(FRAME, COEF, JOINED, f"{PIXEL}, round((c * dn + 2 - dark) * 0.05::DOUBLE, 6) AS radiance, round(pi() * ((c * dn + 2 - dark) * 0.05::DOUBLE) * 1.01::DOUBLE * 1.01::DOUBLE / (1800 * cos(0.5::DOUBLE)), 6) AS reflectance FROM px"))
def prj_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import apply_nuc, reflectance

    x = joined(spark, sf_dir).withColumn("rad", apply_nuc(dn(), C("c"), F.lit(2.0), C("dark"), F.lit(0.05)))
    return x.select("band", "line", "col", steady("rad").alias("radiance"), steady(reflectance(C("rad"), F.lit(1800.0), F.lit(0.5), 1.01)).alias("reflectance"))


@query("prj_21_line_window", sql(FRAME, "SELECT detector, band, line, col, dn FROM frame WHERE line BETWEEN 8 AND 31 AND line % 8 = 0"))
def prj_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).where(F.col("line").between(8, 31) & (F.col("line") % 8 == 0))


_P = "p AS (SELECT band, quantile_cont(dn, 0.02) AS lo, quantile_cont(dn, 0.98) AS hi FROM frame GROUP BY band)"


@query("prj_23_percentile_stretch", sql(FRAME, _P, f"{PIXEL}, CAST(floor(greatest(least((dn - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo), 1), 0) * 255) AS INT) AS grey FROM frame JOIN p USING (band)"))
def prj_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import percentile_stretch

    return percentile_stretch(frame(spark, sf_dir), ["band"]).select("band", "line", "col", "grey")


@query("prj_24_stretch_to_reference", sql(FRAME, _P, "SELECT f.band, line, col, round(greatest(least((dn - lo) / (hi - lo + 1e-9::DOUBLE), 1), 0), 6) AS v FROM frame f JOIN p ON p.band = (f.band + 1) % 10"))
def prj_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    p = f.groupBy("band").agg(F.percentile("dn", F.array(F.lit(0.02), F.lit(0.98))).alias("p")).select(((F.col("band") + 9) % 10).alias("band"), F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    return f.join(F.broadcast(p), "band").select("band", "line", "col", steady(R.stretch_to(dn(), C("lo"), C("hi"))).alias("v"))


@query("prj_25_swap_estimates", sql(FRAME, COEF, "e AS (SELECT band, col, avg(dn) / 4 AS d FROM frame WHERE col % 2 = 0 GROUP BY band, col)", "SELECT band, col, round(coalesce(d, dark), 6) AS dark, c AS response FROM coef LEFT JOIN e USING (band, col)"))
def prj_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import swap_estimates

    est = frame(spark, sf_dir).where("col % 2 = 0").groupBy("band", "col").agg((F.avg("dn") / 4).alias("dark"))
    return swap_estimates(coefficients(spark), est, ["band", "col"], ["dark"]).select("band", "col", steady("dark").alias("dark"), F.col("c").alias("response"))


@query("prj_26_coefficient_set", sql(FRAME, COEF, "SELECT DISTINCT c.band, c.col, CASE WHEN model = 'CUBIC' THEN c.c ELSE a1 END AS gain, c.dark, 1.0::DOUBLE AS eq_gain, 0.0::DOUBLE AS eq_offset FROM coef c JOIN frame f USING (band, col)"))
def prj_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = frame(spark, sf_dir).select("band", "col").distinct()
    gain = F.coalesce(F.when(C("model") == "CUBIC", C("c")), C("a1"))
    return used.join(F.broadcast(coefficients(spark)), ["band", "col"]).select("band", "col", gain.alias("gain"), "dark", F.lit(1.0).alias("eq_gain"), F.lit(0.0).alias("eq_offset"))


@query("prj_27_unknown_bands", sql(FRAME, "SELECT DISTINCT band, 'unknown band' AS reason FROM frame WHERE band NOT IN (SELECT * FROM range(8))"))
def prj_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import unknown

    known = spark.range(8).select(F.col("id").cast("int").alias("band"))
    return unknown(frame(spark, sf_dir), known, "band").select("band", F.lit("unknown band").alias("reason"))


_QA = "q AS (SELECT band, line, col, dn, CASE WHEN dn >= 4095 THEN 4 ELSE 0 END | CASE WHEN dn = 0 THEN 1 ELSE 0 END | CASE WHEN col = 7 OR (line = 2 AND col = 5) THEN 8 ELSE 0 END | CASE WHEN line > max(CASE WHEN dn <> 0 THEN line END) OVER (PARTITION BY band) THEN 2 ELSE 0 END AS qa FROM frame)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(10).select(F.lit(5).alias("detector"), F.col("id").cast("int").alias("band"))
    return flags.seed_flags(frame(spark, sf_dir), bands.withColumn("col", F.lit(7)), bands.withColumns({"line": F.lit(2), "col": F.lit(5)}), KEYS)


@query("flg_01_seed", sql(FRAME, _QA, f"{PIXEL}, CAST(qa AS INT) AS qa FROM q"))
def flg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("band", "line", "col", "qa")


@query("flg_02_injected_bits", sql(FRAME, f"{PIXEL}, CASE dn % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 12 END AS qa FROM frame"))
def flg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).select("band", "line", "col", flags.injected_to_flags(F.col("dn").bitwiseAND(3)).alias("qa"))


@query("flg_03_mask_planes", sql(FRAME, _QA, f"{PIXEL}, CASE WHEN qa & 1 <> 0 THEN 32 ELSE 0 END | CASE WHEN qa & 2 <> 0 THEN 4 ELSE 0 END | CASE WHEN qa & 4 <> 0 THEN 128 ELSE 0 END | CASE WHEN qa & 8 <> 0 THEN 16 ELSE 0 END AS mask FROM q"))
def flg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("band", "line", "col", flags.to_mask(F.col("qa")).alias("mask"))


@query("set_06_mask_union", sql(FRAME, _QA, "SELECT band, CAST(bit_or(qa | CASE dn % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 12 END) AS INT) AS bits, count(*) FILTER (qa <> 0) AS flagged FROM q GROUP BY band"))
def set_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _flagged(spark, sf_dir).withColumn("all", F.col("qa").bitwiseOR(flags.injected_to_flags(F.col("dn").bitwiseAND(3))))
    return x.groupBy("band").agg(F.bit_or("all").alias("bits"), F.count_if(F.col("qa") != 0).alias("flagged"))


@query("res_01_unbin", sql(FRAME, "SELECT band, line, CAST(col * 3 + i AS INT) AS col, dn FROM frame, range(3) r(i)"))
def res_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.unbin(frame(spark, sf_dir), 3).select("band", "line", "col", "dn")


@query("res_02_bin_mean", sql(FRAME, "SELECT band, line, CAST(col // 4 AS INT) AS col, round(avg(dn), 6) AS dn FROM frame GROUP BY band, line, col // 4"))
def res_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bin_mean(frame(spark, sf_dir), 4, ["band"]).select("band", "line", "col", steady("dn").alias("dn"))


_KERNEL = [(dy, dx, float((2 - abs(dy)) * (2 - abs(dx))) / 16.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query("res_03_blur", sql(FRAME, f"k(dy, dx, w) AS (VALUES {', '.join(f'({y}, {x}, {w}::DOUBLE)' for y, x, w in _KERNEL)})", "s AS (SELECT band, max(line) + 1 AS h FROM frame GROUP BY band)", "SELECT band, CAST((line + dy + h) % h AS INT) AS line, CAST((col + dx + 64) % 64 AS INT) AS col, round(sum(dn * w), 6) AS dn FROM frame JOIN s USING (band), k GROUP BY ALL"))
def res_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = spark.createDataFrame(_KERNEL, "dy int, dx int, w double")
    return resample.blur(frame(spark, sf_dir), kernel, ["band"]).select("band", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), steady("dn").alias("dn"))


@query("res_04_psf_integrate", sql("e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, abs(unnest(embedding)::DOUBLE) AS w FROM embeddings)", "m AS (SELECT label AS band, i // 8 AS r, i % 8 AS c, sum(w) AS w FROM e GROUP BY ALL)", "k AS (SELECT band, CAST(round_even((r - 4) / 5.0::DOUBLE, 0) AS INT) AS dy, CAST(round_even((c - 4) / 5.0::DOUBLE, 0) AS INT) AS dx, sum(w) AS w FROM m GROUP BY ALL)", "SELECT band, dy, dx, round(w / sum(w) OVER (PARTITION BY band), 6) AS w FROM k"))
def res_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("band"), F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("band", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c")).agg(F.sum(F.abs(F.col("v").cast("double"))).alias("w"))
    return resample.integrate_psf(m, ["band"], 4, 5).select("band", "dy", "dx", steady("w").alias("w"))


_COMPOSITE_SQL = sql(FRAME, _P, "g AS (SELECT band, line, col, CAST(floor(greatest(least((dn - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo), 1), 0) * 255) AS INT) AS grey FROM frame JOIN p USING (band) WHERE line % 2 = 0 AND col % 2 = 0)", "SELECT CAST(line // 2 AS INT) AS line, CAST(col // 2 AS INT) AS col, max(grey) FILTER (band = 4) AS red, max(grey) FILTER (band = 3) AS green, max(grey) FILTER (band = 2) AS blue FROM g WHERE band IN (2, 3, 4) GROUP BY ALL")


@query("res_05_composite", _COMPOSITE_SQL)
@query("res_05_composite_all_lines", _COMPOSITE_SQL)  # the name of an earlier round
def res_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import composite, percentile_stretch

    grey = percentile_stretch(frame(spark, sf_dir), ["band"]).where("line % 2 = 0 AND col % 2 = 0").withColumns({"line": F.floor(F.col("line") / 2).cast("int"), "col": F.floor(F.col("col") / 2).cast("int")})
    return composite(grey, {4: "red", 3: "green", 2: "blue"})


@query("res_06_quarter_turn", sql(FRAME, "SELECT band, CAST(63 - col AS INT) AS line, line AS col, dn FROM frame"))
def res_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.quarter_turn(frame(spark, sf_dir), ["band"]).select("band", "line", "col", "dn")


@query("res_07_blocks", sql(FRAME, "SELECT band, CAST(line // 8 AS INT) AS by, CAST(col // 8 AS INT) AS bx, CAST(list_extract(list(dn ORDER BY line, col), 1) AS INT) AS dc, CAST(sum(dn * ((line % 8) * 8 + col % 8)) AS BIGINT) AS weighted, CAST(count(*) AS INT) AS n FROM frame GROUP BY ALL"))
def res_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = resample.to_blocks(frame(spark, sf_dir), ["band"])
    weighted = F.aggregate(F.transform("samples", lambda v, i: v.cast("long") * i), F.lit(0).cast("long"), lambda a, v: a + v)
    return b.select("band", "by", "bx", F.col("samples")[0].alias("dc"), weighted.alias("weighted"), F.size("samples").alias("n"))


@query("join_01_wide_coefficients", sql(FRAME, coef_sql(80), "SELECT f.band, line, f.col, round(dn * c.c, 6) AS value FROM frame f JOIN coef c ON c.band = f.band AND c.col = f.col + 8"))
def join_01_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.with_coefficients(frame(spark, sf_dir), coefficients(spark, 80), ["band"])
    return x.select("band", "line", "col", steady(dn() * C("c")).alias("value"))


@query("join_01_narrow_coefficients", sql(FRAME, coef_sql(50), "SELECT f.band, line, f.col, round(dn * c.c, 6) AS value FROM frame f JOIN coef c ON c.band = f.band AND c.col = least(f.col, 49)"))
def join_01_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.with_coefficients(frame(spark, sf_dir), coefficients(spark, 50), ["band"])
    return x.select("band", "line", "col", steady(dn() * C("c")).alias("value"))


