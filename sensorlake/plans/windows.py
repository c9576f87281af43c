"""Queries on neighbourhoods: staggering, running means, wavelets, Rice choice (WIN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorlake.fixtures import FRAME, frame, sql
from sensorlake.functions.numbers import steady
from sensorlake.operators import calibrate, coding, resample
from sensorlake.plans.calibration import running_mean_sql
from sensorlake.plans.registry import query
from sensorlake.sources import frames
from sensorlake.sources.shared import written

BAND = ["band"]
_SHIFT = "CASE WHEN col % 3 = 0 THEN 1 WHEN col % 3 = 1 THEN -1 ELSE 0 END"
_HEIGHT = "hh AS (SELECT band, max(line) + 1 AS h FROM frame GROUP BY band)"


def shifts(spark: SparkSession) -> DataFrame:
    g = spark.range(640).select(F.floor(F.col("id") / 64).cast("int").alias("band"), (F.col("id") % 64).cast("int").alias("col"))
    return g.withColumn("shift", F.when(F.col("col") % 3 == 0, 1).when(F.col("col") % 3 == 1, -1).otherwise(0))


@query("win_01_restagger", sql(FRAME, _HEIGHT, f"SELECT band, CAST((line + {_SHIFT} + h) % h AS INT) AS line, col, dn FROM frame JOIN hh USING (band)"))
def win_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.restagger(frame(spark, sf_dir), shifts(spark), BAND).select("band", F.col("line").cast("int").alias("line"), "col", "dn")


@query("win_01_restagger_back", sql(FRAME, "SELECT band, count(*) AS n, CAST(0 AS BIGINT) AS changed FROM frame GROUP BY band"))
def win_01_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import profile

    f = frame(spark, sf_dir)
    back = resample.restagger(resample.restagger(f, shifts(spark), BAND), shifts(spark), BAND, back=True)
    return profile.differing(f, back.withColumn("line", F.col("line").cast("int")), BAND).withColumnRenamed("n_different", "changed")


@query("win_02_kernel", sql(FRAME, f"n AS (SELECT *, {_SHIFT} AS s, coalesce(lead(dn) OVER w, 0) AS nx, coalesce(lag(dn) OVER w, 0) AS pv FROM frame WINDOW w AS (PARTITION BY band, col ORDER BY line))", "SELECT band, line, col, round(CASE WHEN s > 0 THEN 0.1::DOUBLE * nx + 0.6::DOUBLE * dn + 0.3::DOUBLE * pv WHEN s < 0 THEN 0.3::DOUBLE * nx + 0.6::DOUBLE * dn + 0.1::DOUBLE * pv ELSE dn END, 6) AS v FROM n"))
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.interpolate_lines(frame(spark, sf_dir), shifts(spark), (0.1, 0.6, 0.3), BAND).select("band", "line", "col", steady("dn").alias("v"))


@query("win_03_running_mean", sql(FRAME, "p AS (SELECT band, col, avg(dn) AS m FROM frame GROUP BY band, col)", running_mean_sql("p", "m", 31, "t"), "SELECT band, col, round(trend, 6) AS trend FROM t"))
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir).groupBy("band", "col").agg(F.avg("dn").alias("m"))
    return calibrate.running_mean(p, BAND, "m", 31, "trend").select("band", "col", steady("trend").alias("trend"))


@query("win_04_high_pass", sql(FRAME, "p AS (SELECT band, col, avg(dn) AS m FROM frame GROUP BY band, col)", "h AS (SELECT band, col, m - sum(m) OVER (PARTITION BY band ORDER BY col ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9 AS hp FROM p)", "SELECT band, round(stddev_pop(hp), 6) AS sigma, count(*) AS n FROM h WHERE col BETWEEN 4 AND 59 GROUP BY band"))
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("band").orderBy("col").rowsBetween(-4, 4)
    p = frame(spark, sf_dir).groupBy("band", "col").agg(F.avg("dn").alias("m"))
    hp = p.withColumn("hp", F.col("m") - F.sum("m").over(w) / 9).where("col BETWEEN 4 AND 59")
    return hp.groupBy("band").agg(steady(F.stddev_pop("hp")).alias("sigma"), F.count("*").alias("n"))


@query("win_09_lost_lines", sql(FRAME, "l AS (SELECT *, max(CASE WHEN dn <> 0 THEN line END) OVER (PARTITION BY band) AS last FROM frame)", "SELECT band, count(DISTINCT line) FILTER (line > last) AS lost FROM l GROUP BY band"))
def win_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    last = f.groupBy("band").agg(F.max(F.when(F.col("dn") != 0, F.col("line"))).alias("last"))
    return f.select("band", "line").distinct().join(F.broadcast(last), "band").groupBy("band").agg(F.count_if(F.col("line") > F.col("last")).alias("lost"))


_DELTA = "dz AS (SELECT band, line, col, dn, dn - coalesce(lag(dn) OVER (PARTITION BY band, line ORDER BY col), 0) AS d FROM frame), zz AS (SELECT band, line, col, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS v FROM dz)"


@query("win_10_delta_zigzag", sql(FRAME, _DELTA, "SELECT band, line, col, CAST(v AS INT) AS v FROM zz"))
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.delta_zigzag(frame(spark, sf_dir), ["band", "line"], ["col"]).select("band", "line", "col", "v")


@query("win_10_delta_zigzag_back", sql(FRAME, "SELECT band, line, col, CAST(dn AS BIGINT) AS back FROM frame"))
def win_10_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = coding.delta_zigzag(frame(spark, sf_dir), ["band", "line"], ["col"])
    return coding.undelta_zigzag(z, ["band", "line"], ["col"]).select("band", "line", "col", "back")


@query("win_11_rice_choice", sql(FRAME, _DELTA, "g AS (SELECT band, line, col // 16 AS gaggle, v FROM zz)", "c AS (SELECT band, line, gaggle, k, sum(v >> k) + count(*) * (1 + k) AS cost, 1 AS o FROM g, range(14) r(k) GROUP BY band, line, gaggle, k UNION ALL SELECT band, line, gaggle, 31, count(*) * 13, 0 FROM g GROUP BY band, line, gaggle)", "SELECT band, line, CAST(gaggle AS INT) AS gaggle, CAST(arg_min(k, cost * 1000 + o * 100 + k) AS INT) AS k, CAST(min(cost) AS BIGINT) AS cost FROM c GROUP BY ALL"))
def win_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = coding.delta_zigzag(frame(spark, sf_dir), ["band", "line"], ["col"])
    return coding.rice_choice(z, ["band", "line"], "col", 13).select("band", "line", "gaggle", "k", "cost")


def _wavelet_sql() -> list[str]:
    return [
        "ev AS (SELECT band, line, CAST(col // 2 AS INT) AS j, CAST(max(dn) FILTER (col % 2 = 0) AS BIGINT) AS e, CAST(max(dn) FILTER (col % 2 = 1) AS BIGINT) AS o FROM frame GROUP BY ALL)",
        "en AS (SELECT a.*, b.e AS b1, f1.e AS f1, f2.e AS f2 FROM ev a JOIN ev b ON b.band = a.band AND b.line = a.line AND b.j = abs(a.j - 1) JOIN ev f1 ON f1.band = a.band AND f1.line = a.line AND f1.j = CASE WHEN a.j + 1 > 31 THEN 62 - (a.j + 1) ELSE a.j + 1 END JOIN ev f2 ON f2.band = a.band AND f2.line = a.line AND f2.j = CASE WHEN a.j + 2 > 31 THEN 62 - (a.j + 2) ELSE a.j + 2 END)",
        "dd AS (SELECT band, line, j, e, CAST(o - floor((9 * (e + f1) - (b1 + f2) + 8) / 16.0::DOUBLE) AS BIGINT) AS d FROM en)",
        "wv AS (SELECT band, line, j, CAST(e - floor((-(coalesce(lag(d) OVER (PARTITION BY band, line ORDER BY j), d) + d) + 2) / 4.0::DOUBLE) AS BIGINT) AS s, d FROM dd)",
    ]


@query("win_12_wavelet", sql(FRAME, *_wavelet_sql(), "SELECT band, line, j, s, d FROM wv"))
def win_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.wavelet(frame(spark, sf_dir), ["band", "line"], "col", "dn")


@query("win_12_wavelet_back", sql(FRAME, "SELECT band, line, col, CAST(dn AS BIGINT) AS dn FROM frame"))
def win_12_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = coding.wavelet(frame(spark, sf_dir), ["band", "line"], "col", "dn")
    return coding.unwavelet(bands, ["band", "line"], "col", "dn").select("band", "line", "col", "dn")


def _lift_sql(source: str, name: str, axis: str, other: str) -> list[str]:
    """One level along an axis: {name} with band, {other}, j, s (low), d (high). source: band, line, col, v."""
    mirror = lambda k: f"CASE WHEN a.m = 1 THEN 0 WHEN abs(a.j + {k}) > a.m - 1 THEN 2 * (a.m - 1) - abs(a.j + {k}) ELSE abs(a.j + {k}) END"
    joins = " ".join(f"JOIN {name}_e {t} ON {t}.band = a.band AND {t}.{other} = a.{other} AND {t}.j = {mirror(k)}" for t, k in (("b1", -1), ("f1", 1), ("f2", 2)))
    return [
        f"{name}_p AS (SELECT band, {other}, {axis} // 2 AS j, max(v) FILTER ({axis} % 2 = 0) AS e, max(v) FILTER ({axis} % 2 = 1) AS o FROM {source} GROUP BY ALL)",
        f"{name}_e AS (SELECT *, count(*) OVER (PARTITION BY band, {other}) AS m FROM {name}_p)",
        f"{name}_d AS (SELECT a.band, a.{other}, a.j, a.e, a.o - CAST(floor((9 * (a.e + f1.e) - (b1.e + f2.e) + 8) / 16.0::DOUBLE) AS BIGINT) AS d FROM {name}_e a {joins})",
        f"{name} AS (SELECT band, {other}, j, e - CAST(floor((-(coalesce(lag(d) OVER (PARTITION BY band, {other} ORDER BY j), d) + d) + 2) / 4.0::DOUBLE) AS BIGINT) AS s, d FROM {name}_d)",
    ]


def _levels_sql(levels: int) -> list[str]:
    """Frames filled up to multiples of eight lines (their width is one already), and every level along both axes."""
    out = [
        "fh AS (SELECT band, max(line) AS last FROM frame GROUP BY band)",
        "l0 AS (SELECT band, line, col, CAST(dn AS BIGINT) AS v FROM frame UNION ALL SELECT f.band, r.n, col, dn FROM frame f JOIN fh USING (band) JOIN range(100000) r(n) ON f.line = last AND r.n > last AND r.n <= (last // 8) * 8 + 7)",
    ]
    for k in range(1, levels + 1):
        out += _lift_sql(f"l{k - 1}", f"x{k}", "col", "line")
        out += [f"{n}{k} AS (SELECT band, line, j AS col, {c} AS v FROM x{k})" for n, c in (("lo", "s"), ("hi", "d"))]
        out += [*_lift_sql(f"lo{k}", f"yl{k}", "line", "col"), *_lift_sql(f"hi{k}", f"yh{k}", "line", "col")]
        out += [f"l{k} AS (SELECT band, j AS line, col, s AS v FROM yl{k})"]
    return out


_BANDS_SQL = " UNION ALL ".join([f"SELECT band, '{n}{k}' AS subband, j AS line, col, {c} AS v FROM {t}{k}" for k in (1, 2, 3) for n, t, c in (("HL", "yh", "s"), ("LH", "yl", "d"), ("HH", "yh", "d"))] + ["SELECT band, 'LL3', line, col, v FROM l3"])


@query("win_12_three_levels", sql(FRAME, *_levels_sql(3), f"SELECT band, subband, line, CAST(col AS INT) AS col, v FROM ({_BANDS_SQL})"))
def win_12_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both axes and three levels of whole frames."""
    from sensorlake.operators import wavelets

    b = wavelets.forward(frames.to_lines(frame(spark, sf_dir), ["band"]), ["band"])
    return b.select("band", "subband", "line", F.posexplode("samples").alias("col", "v"))


@query("win_12_three_levels_back", sql(FRAME, "SELECT band, CAST(line AS BIGINT) AS line, col, CAST(dn AS BIGINT) AS dn FROM frame"))
def win_12_levels_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import wavelets

    lines = frames.to_lines(frame(spark, sf_dir), ["band"])
    back = wavelets.inverse(written(wavelets.forward(lines, ["band"]), "subbands"), ["band"])
    return back.select("band", "line", F.posexplode("samples").alias("col", "dn"))


@query("win_13_bits_needed", sql(FRAME, *_wavelet_sql(), "SELECT band, CAST(j // 8 AS INT) AS block, CASE WHEN max(abs(d)) = 0 THEN 0 ELSE length(ltrim(bin(CAST(max(abs(d)) AS BIGINT)), '0')) END AS bits FROM wv GROUP BY ALL"))
def win_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = coding.wavelet(frame(spark, sf_dir), ["band", "line"], "col", "dn").withColumn("block", F.floor(F.col("j") / 8).cast("int"))
    return coding.bits_needed(bands, ["band", "block"], "d").select("band", "block", F.col("bits").cast("long").alias("bits"))


@query("win_14_line_times", sql(FRAME, "l AS (SELECT DISTINCT band, line FROM frame)", "t AS (SELECT band, line, 1360000000.0::DOUBLE + line * 0.0015::DOUBLE + band * 0.01::DOUBLE AS t FROM l)", "SELECT band, line, round(t, 6) AS t, coalesce(t > lag(t) OVER (PARTITION BY band ORDER BY line), true) AS monotone, line % 8 = 0 AS segment_start FROM t"))
def win_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.functions.times import line_times

    lines = frame(spark, sf_dir).select("band", "line").distinct()
    return line_times(lines, BAND, epoch=1360000000.0, period=0.0015, shift=F.col("band") * 0.01).select("band", "line", steady("t").alias("t"), "monotone", "segment_start")


@query("win_15_line_headers", sql(FRAME, "SELECT band, line, CAST((1280 + 5 * 16 + band) & 2047 AS INT) AS apid, CAST(line % 16384 AS INT) AS seq_count, 6 + 2 * count(*) AS data_len FROM frame GROUP BY band, line"))
def win_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.functions.packets import stream_id

    n = frame(spark, sf_dir).groupBy("detector", "band", "line").agg(F.count("*").alias("n"))
    return n.select("band", "line", stream_id(F.lit(1280), F.col("detector"), F.col("band")).alias("apid"), (F.col("line") % 16384).alias("seq_count"), (6 + 2 * F.col("n")).alias("data_len"))
