"""Queries that join frames, coefficients, names and listings (JOIN, SET, TOP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import ADF, ATTRS, COEF, FRAME, LISTING, NAMES, attributes, coef_sql, coefficient_files, coefficients, frame, listing, product_names, sql
from sensorlake.functions.numbers import steady
from sensorlake.operators import align, profile, resample, validity
from sensorlake.plans.registry import query

BAND = ["band"]
_BLIND = "blind AS (SELECT CAST(b AS INT) AS band, CAST(c AS INT) AS col FROM range(10) x(b), range(72) y(c) WHERE c < 4 OR c >= 68)"


def blind(spark: SparkSession, width: int = 72, edge: int = 4) -> DataFrame:
    g = spark.range(10 * width).select(F.floor(F.col("id") / width).cast("int").alias("band"), (F.col("id") % width).cast("int").alias("col"))
    return g.where((F.col("col") < edge) | (F.col("col") >= width - edge))


@query("join_02_strip_blind", sql(FRAME, coef_sql(72), _BLIND, "SELECT c.band, CAST(col - 4 AS INT) AS col, dark, c FROM coef c WHERE col BETWEEN 4 AND 67 AND band IN (SELECT band FROM frame)"))
def join_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = frame(spark, sf_dir).groupBy("band").agg((F.max("col") + 1).alias("w"))
    return align.strip_blind(coefficients(spark, 72), blind(spark), widths, BAND).select("band", "col", "dark", "c")


@query("join_02_strip_blind_fallback", sql(FRAME, coef_sql(80), "SELECT c.band, CAST(col - 8 AS INT) AS col, dark, c FROM coef c WHERE col BETWEEN 8 AND 71 AND band IN (SELECT band FROM frame)"))
def join_02_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = frame(spark, sf_dir).groupBy("band").agg((F.max("col") + 1).alias("w"))
    return align.strip_blind(coefficients(spark, 80), blind(spark), widths, BAND).select("band", "col", "dark", "c")


@query("join_03_insert_blind", sql(FRAME, "SELECT band, line, CAST(col + 4 AS INT) AS col, dn FROM frame UNION ALL SELECT band, line, CAST(c AS INT), 51 FROM (SELECT DISTINCT band, line FROM frame), range(72) y(c) WHERE c < 4 OR c >= 68"))
def join_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.insert_blind(frame(spark, sf_dir), blind(spark), 72, BAND, 51)


@query("join_03_insert_blind_unchanged", sql(FRAME, "SELECT band, line, col, dn FROM frame"))
def join_03_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.insert_blind(frame(spark, sf_dir), blind(spark), 99, BAND, 51)


@query("join_04_defect_stamp", sql(FRAME, "SELECT band, line, col, CASE WHEN line = 2 AND col = 5 THEN 4095 WHEN col IN (7, 500) THEN 0 ELSE dn END AS dn, CASE WHEN col = 7 THEN 1 ELSE 0 END | CASE WHEN line = 2 AND col = 5 THEN 2 ELSE 0 END AS qa FROM frame"))
def join_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(10).select(F.col("id").cast("int").alias("band"))
    dead = bands.withColumn("col", F.explode(F.array(F.lit(7), F.lit(500))))
    return align.stamp_defects(frame(spark, sf_dir), dead, bands.withColumns({"line": F.lit(2), "col": F.lit(5)}), BAND).select("band", "line", "col", "dn", "qa")


def shaped(f: DataFrame) -> DataFrame:
    return f.join(f.groupBy("detector", "band").agg((F.max("line") + 1).alias("h"), (F.max("col") + 1).alias("w")), ["detector", "band"])


_SHAPED = "sh AS (SELECT band, max(line) + 1 AS h, max(col) + 1 AS w FROM frame GROUP BY band), fs AS (SELECT * FROM frame JOIN sh USING (band)), cw AS (SELECT CAST(k AS INT) AS k, CAST(l AS INT) AS l, ((k * 3 + l) % 5) / 1000.0::DOUBLE AS coef FROM range(10) a(k), range(10) b(l) WHERE k <> l)"


_CROSSTALK_SQL = sql(FRAME, _SHAPED, "SELECT f.band, f.line, f.col, round(any_value(f.dn) + coalesce(sum(coef * g.dn), 0), 6) AS dn FROM fs f LEFT JOIN (SELECT * FROM cw JOIN fs ON fs.band = l) g ON g.k = f.band AND g.h = f.h AND g.w = f.w AND g.line = f.line AND g.col = f.col GROUP BY f.band, f.line, f.col")


@query("join_05_crosstalk", _CROSSTALK_SQL)
@query("join_05_crosstalk_all_lines", _CROSSTALK_SQL)  # the name of an earlier round
def join_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames; as in the source, only bands of equal shape mix."""
    matrix = spark.range(100).select((F.col("id") / 10).cast("int").alias("k"), (F.col("id") % 10).cast("int").alias("l")).where("k <> l").withColumn("coef", ((F.col("k") * 3 + F.col("l")) % 5) / 1000.0)
    return resample.crosstalk(frame(spark, sf_dir), matrix, ["detector"]).select("band", "line", "col", steady("dn").alias("dn"))


_UNIFORM_CROSSTALK_SQL = sql(FRAME, _SHAPED, "SELECT band, line, col, round(dn + 0.002::DOUBLE * (sum(dn) OVER (PARTITION BY h, w, line, col) - dn), 6) AS dn FROM fs")


@query("join_06_uniform_crosstalk", _UNIFORM_CROSSTALK_SQL)
@query("join_06_uniform_crosstalk_all_lines", _UNIFORM_CROSSTALK_SQL)  # the name of an earlier round
def join_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.uniform_crosstalk(shaped(frame(spark, sf_dir)), ["detector", "h", "w"], 0.002).select("band", "line", "col", steady("dn").alias("dn"))


@query("join_07_framing_compare", sql(FRAME, "o AS (SELECT band, line - (band % 4) AS line, col, dn + col % 3 AS dn FROM frame WHERE line >= band % 4)", "d AS (SELECT f.band, CAST(f.dn - o.dn AS DOUBLE) AS d FROM frame f JOIN o USING (band, line, col))", "SELECT band, count(*) AS n, round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(sqrt(avg(d * d)), 6) AS rmse FROM d GROUP BY band"))
def join_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = spark.range(10).select(F.col("id").cast("int").alias("band"), (F.col("id") % 4).cast("int").alias("begin")).where("begin > 0")
    f = frame(spark, sf_dir)
    return profile.framed(f, f.withColumn("dn", F.col("dn") + F.col("col") % 3), begin, BAND).select("band", "n", steady("median_abs").alias("median_abs"), steady("rmse").alias("rmse"))


@query("join_08_differing_pixels", sql(FRAME, "SELECT band, count(*) AS n, count(*) FILTER (col % 9 = 0 OR line >= 40) AS n_different FROM frame GROUP BY band"))
def join_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    changed = f.where("line < 40").withColumn("dn", F.col("dn") + F.when(F.col("col") % 9 == 0, 1).otherwise(0))
    return profile.differing(f, changed, BAND)


@query("join_09_line_loss", sql(FRAME, "k AS (SELECT band, max(line) FILTER (dn <> 0) AS last, max(line) AS top FROM frame GROUP BY band)", "SELECT k.band, last + 1 AS kept_lines, top - last AS lost_lines, true AS loss_explained, true AS identical FROM k"))
def join_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    tail = profile.zero_tail(f, BAND)
    kept = f.join(F.broadcast(tail), "band").where("line < n_lines - lost").select("band", "line", "col", "dn")
    return validity.line_loss(f, kept, tail, BAND)


_ASOF = "st AS (SELECT start, min(adf_id) AS adf_id FROM adf GROUP BY start)"


@query("join_10_validity", sql(NAMES, ADF, _ASOF, "SELECT o_orderkey, s.adf_id, s.start, CAST(date_diff('day', s.start, CAST(o_orderdate AS DATE)) AS INT) AS gap_days, round(date_diff('day', s.start, CAST(o_orderdate AS DATE)) / 365.25::DOUBLE, 6) AS gap_years, coalesce(date_diff('day', s.start, CAST(o_orderdate AS DATE)) > 365, true) AS warn FROM pn ASOF LEFT JOIN st s ON CAST(o_orderdate AS DATE) >= s.start"))
def join_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    acq = product_names(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    v = validity.as_of(acq, coefficient_files(spark, sf_dir), "day", "start", "adf_id")
    return validity.gap(v, "day", "start", 365).select("o_orderkey", "adf_id", "start", "gap_days", steady("gap_years").alias("gap_years"), "warn")


_STOPS = "st AS (SELECT type, start, min({'id': adf_id, 'stop': CASE WHEN adf_id % 5 = 0 THEN DATE '2100-01-01' ELSE start + CAST(200 + adf_id % 400 AS INT) END}) AS f FROM adf GROUP BY ALL)"
_HELD = "held AS (SELECT type, start, f.id AS adf_id, f.stop AS stop, CASE WHEN lag(start) OVER w IS NULL THEN DATE '1900-01-01' ELSE start END AS lo, coalesce(lead(start) OVER w, DATE '2200-01-01') AS hi FROM st WINDOW w AS (PARTITION BY type ORDER BY start))"
_CHOSEN = "ch AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, h.* FROM pn JOIN held h ON CAST(o_orderdate AS DATE) >= h.lo AND CAST(o_orderdate AS DATE) < h.hi)"
_JUDGED = "j AS (SELECT *, day BETWEEN start AND stop AS within_validity, CAST(abs(date_diff('day', start, day)) AS INT) AS gap_days FROM ch)"


@query("join_10_outside_window", sql(NAMES, ADF, _STOPS, _HELD, _CHOSEN, _JUDGED, "SELECT o_orderkey, type, adf_id, start, stop, within_validity, gap_days, round(gap_days / 365.25::DOUBLE, 2) AS gap_years, round(gap_days / 365.25::DOUBLE, 2) > 1 OR NOT within_validity AS warn FROM j"))
def join_10_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each acquisition and type of coefficient file the one that applies, and whether the acquisition lies in its window."""
    acq = product_names(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").alias("day"))
    stop = F.when(F.col("adf_id") % 5 == 0, F.lit("2100-01-01").cast("date")).otherwise(F.expr("date_add(start, cast(200 + adf_id % 400 as int))"))
    files = coefficient_files(spark, sf_dir).withColumn("stop", stop)
    return validity.applicable(acq, files, "day", "adf_id", "type").select("o_orderkey", "type", "adf_id", "start", "stop", "within_validity", "gap_days", "gap_years", "warn")


@query("join_11_within_days", sql(NAMES, ADF, "e AS (SELECT type, min(start) AS epoch FROM adf GROUP BY type)", "h AS (SELECT type, kind, min(CAST(o_orderdate AS DATE)) AS first, count(*) AS n FROM e JOIN pn ON CAST(o_orderdate AS DATE) BETWEEN epoch AND epoch + 30 GROUP BY ALL)", "SELECT type, kind, first, n FROM h"))
def join_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    acq = product_names(spark, sf_dir).select("kind", F.col("o_orderdate").cast("date").alias("day"))
    epochs = coefficient_files(spark, sf_dir).groupBy("type").agg(F.min("start").alias("epoch"))
    return validity.within_days(acq, epochs, "day", "epoch", 30).groupBy("type", "kind").agg(F.min("day").alias("first"), F.count("*").alias("n"))


@query("join_12_name_mismatch", sql(NAMES, ATTRS, "i AS (SELECT event_id, TRY_CAST(coalesce(attrs ->> '$.stac_discovery.stac_discovery.properties.\"sat:relative_orbit\"', attrs ->> '$.stac_discovery.properties.\"sat:relative_orbit\"') AS INT) AS orbit FROM attrs)", "SELECT o_orderkey, CAST(substr(name, 33, 3) AS INT) AS name_orbit, orbit FROM pn JOIN i ON event_id = o_orderkey WHERE orbit IS NOT NULL AND CAST(substr(name, 33, 3) AS INT) <> orbit"))
def join_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.functions.metadata import property_of
    from sensorlake.functions.names import parse_name

    ident = attributes(spark, sf_dir).select(F.col("event_id").alias("o_orderkey"), property_of("attrs", "sat:relative_orbit").try_cast("int").alias("orbit"))
    names = product_names(spark, sf_dir).select("o_orderkey", parse_name(F.col("name"))["relative_orbit"].alias("name_orbit"))
    return names.join(ident, "o_orderkey").where("orbit IS NOT NULL AND name_orbit <> orbit")


@query("join_13_same_acquisition", sql(NAMES, "g AS (SELECT name, kind, substr(name, 11, 15) || '|R' || CAST(substr(name, 33, 3) AS INT) AS grp FROM pn)", "o AS (SELECT *, count(*) FILTER (kind = 'S02MSIL0_') OVER (PARTITION BY grp) AS ours FROM g)", "SELECT name, grp AS \"group\", CASE WHEN kind = 'S02MSIL1A' AND ours > 0 THEN 'same-scene' WHEN kind = 'S02MSIL1A' THEN 'distribution-level only' ELSE 'same acquisition group' END AS comparable FROM o"))
def join_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import stores

    n = product_names(spark, sf_dir).select("name", F.when(F.col("kind") == "S02MSIL1A", "external-l0-public").when(F.col("kind") == "S02MSIL0_", "our-l0-canonical").otherwise("other").alias("kind"), stores.group_key(F.col("name")).alias("group"))
    return stores.comparability(n).select("name", "group", "comparable")


@query("join_14_foreign_acquisitions", sql(NAMES, "g AS (SELECT name, kind, substr(name, 11, 8) AS day FROM pn)", "SELECT name FROM g WHERE kind = 'S02MSIL1A' AND day NOT IN (SELECT day FROM g WHERE kind = 'S02MSIL0_') AND EXISTS (SELECT 1 FROM g WHERE kind = 'S02MSIL0_')"))
def join_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import stores

    n = product_names(spark, sf_dir).select("name", "kind", F.substring("name", 11, 8).alias("group"))
    return stores.foreign(n.where("kind = 'S02MSIL1A'"), n.where("kind = 'S02MSIL0_'")).select("name")


@query("join_15_sync_plan", sql(LISTING, "SELECT page_id, key, size, CASE WHEN page_id % 3 = 0 THEN 'changed' ELSE 'missing' END AS reason FROM listing WHERE page_id % 2 = 1 OR (page_id % 3 = 0)"))
def join_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import stores

    ls = listing(spark, sf_dir).select("page_id", "key", "size", F.col("content_md5").alias("sum"))
    local = ls.where("page_id % 2 = 0 OR page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("sum")).alias("sum"))
    return stores.sync_plan(ls, local, "page_id").select("page_id", "key", "size", "reason")


@query("join_16_verify", sql(LISTING, "SELECT page_id, key, size, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN etag <> content_md5 THEN 'md5' ELSE 'ok' END AS verify FROM listing"))
def join_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators import stores

    ls = listing(spark, sf_dir)
    local = ls.where("page_id % 5 <> 0").select("page_id", F.col("size").alias("local_size"), F.col("content_md5").alias("local_md5"))
    return stores.verify(ls, local, "page_id").select("page_id", "key", "size", "verify")




@query("join_17_epoch_change", sql(COEF, FRAME, "e AS (SELECT band, col, avg(dn) FILTER (line % 2 = 0) AS a, avg(dn) FILTER (line % 2 = 1) AS b FROM frame GROUP BY band, col)", "SELECT band, count(*) AS n, round(avg(abs(b - a)), 6) AS mean_abs, round(avg(abs(b - a) / (abs(a) + 1e-12::DOUBLE)), 6) AS mean_relative FROM e GROUP BY band"))
def join_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir).groupBy("band", "col", (F.col("line") % 2).alias("epoch")).agg(F.avg("dn").alias("v"))
    x = validity.epoch_change(c.where("epoch = 0"), c.where("epoch = 1"), BAND, ["col"], "v")
    return x.select("band", "n", steady("mean_abs").alias("mean_abs"), steady("mean_relative").alias("mean_relative"))


@query("join_17_shape_mismatch", sql(FRAME, "n AS (SELECT band, count(DISTINCT col) AS n_a, count(DISTINCT col) FILTER (band % 2 = 0 OR col < 60) AS n_b FROM frame GROUP BY band)", "SELECT * FROM n WHERE n_a <> n_b"))
def join_17_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir).groupBy("band", "col").agg(F.avg("dn").alias("v"))
    return validity.shape_mismatch(c, c.where("band % 2 = 0 OR col < 60"), BAND)


@query("join_18_line_stride", sql(FRAME, "n AS (SELECT band, max(line) + 1 AS n FROM frame GROUP BY band)", "s AS (SELECT band, 6 - band % 3 AS g, greatest(1, n // (n // (1 + band % 3))) AS stride, n // (1 + band % 3) AS m FROM n)", "SELECT band, CAST(r AS INT) AS line, CAST(r * stride AS INT) AS fine_line FROM (SELECT s.band, stride, m, n, unnest(range(m)) AS r FROM s JOIN n USING (band)) WHERE r * stride < n"))
def join_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = frame(spark, sf_dir).select("band", "line").distinct()
    n = fine.groupBy("band").agg((F.max("line") + 1).alias("n"))
    group = n.select("band", "n", F.floor(F.col("n") / (1 + F.col("band") % 3)).cast("int").alias("m"))
    return validity.line_stride(fine, group, BAND).select("band", "line", "fine_line")


_DRIFT = "o AS (SELECT band, line + band % 3 AS line, col, dn FROM frame), sh AS (SELECT f.band, s, corr(CAST(f.dn AS DOUBLE), CAST(o.dn AS DOUBLE)) AS cc FROM frame f, range(-4, 5) r(s) JOIN o ON o.band = f.band AND o.line = f.line + s AND o.col = f.col GROUP BY f.band, s)"


@query("join_19_drift", sql(FRAME, _DRIFT, "SELECT band, CAST(arg_max(s, cc) AS INT) AS shift, round(max(cc), 6) AS correlation FROM sh WHERE cc IS NOT NULL AND NOT isnan(cc) GROUP BY band"))
def join_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    return profile.drift(f, f.withColumn("line", F.col("line") + F.col("band") % 3), BAND, 4).select("band", "shift", steady("correlation").alias("correlation"))


@query("top_05_best_shift", sql(FRAME, _DRIFT, "SELECT band, CAST(arg_max(s, cc) AS INT) AS shift FROM sh WHERE cc IS NOT NULL AND NOT isnan(cc) GROUP BY band"))
def top_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    return profile.drift(f, f.withColumn("line", F.col("line") + F.col("band") % 3), BAND, 4).select("band", "shift")


@query("join_20_width_contract", sql(FRAME, "SELECT band, count(DISTINCT col) AS frame_width, CASE WHEN band < 8 THEN 64 END AS coef_width, band < 8 AS ok FROM frame GROUP BY band"))
def join_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = frame(spark, sf_dir).select("band").distinct()
    return align.width_contract(frame(spark, sf_dir), coefficients(spark).where("band < 8").join(F.broadcast(used), "band", "left_semi"), BAND).select("band", "frame_width", F.col("coef_width").cast("int").alias("coef_width"), "ok")


@query("join_21_crosswalk", sql(NAMES, "SELECT o_orderkey, name, 'GS2' || substr(name, 32, 1) || '_' || substr(name, 11, 15) || '_' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '_N04.00' AS foreign_id, regexp_matches('GS2' || substr(name, 32, 1) || '_' || substr(name, 11, 15) || '_' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '_N04.00', '^GS2[AB]_') AS matches FROM pn"))
def join_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.functions.names import data_take_id, parse_name

    p = product_names(spark, sf_dir).withColumn("p", parse_name(F.col("name")))
    x = p.withColumn("foreign_id", data_take_id(F.col("p.unit"), F.col("p.start"), F.col("o_orderkey") % 1000000))
    return x.select("o_orderkey", "name", "foreign_id", F.col("foreign_id").rlike("^GS2[AB]_").alias("matches"))


@query("join_22_three_way", sql(FRAME, "SELECT band, true AS decoded_equal, count(*) FILTER (col = 3 AND dn <> 0) = 0 AS consumer_equal FROM frame GROUP BY band"))
def join_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir).select("band", "line", "col", "dn")
    consumer = f.withColumn("dn", F.when(F.col("col") == 3, 0).otherwise(F.col("dn")))
    return validity.three_way(f, f, consumer, BAND)


@query("set_01_union_columns", sql(FRAME, "SELECT DISTINCT band, col FROM frame WHERE col < 4 OR dn >= 4095"))
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    return f.where("col < 4").select("band", "col").union(f.where("dn >= 4095").select("band", "col")).distinct()


@query("set_02_column_difference", sql(FRAME, "SELECT DISTINCT band, col FROM frame WHERE NOT (col < 4 OR col >= 68)"))
def set_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).select("band", "col").distinct().join(F.broadcast(blind(spark)), ["band", "col"], "left_anti")


@query("set_03_shared_types", sql(ADF, "SELECT type FROM adf WHERE adf_id % 2 = 0 INTERSECT SELECT type FROM adf WHERE adf_id % 2 = 1"))
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = coefficient_files(spark, sf_dir)
    return a.where("adf_id % 2 = 0").select("type").intersect(a.where("adf_id % 2 = 1").select("type"))


@query("set_05_unknown_items", sql(NAMES, "SELECT DISTINCT kind FROM pn WHERE kind NOT IN ('S02MSIL1A', 'S02MSIL0_')"))
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.chain import unknown

    allowed = spark.createDataFrame([("S02MSIL1A",), ("S02MSIL0_",)], "kind string")
    return unknown(product_names(spark, sf_dir), allowed, "kind")


@query("top_02_most_changed", sql(FRAME, "e AS (SELECT band, col, avg(dn) FILTER (line % 2 = 0) AS a, avg(dn) FILTER (line % 2 = 1) AS b FROM frame GROUP BY band, col)", "SELECT band, col, round(abs(b - a), 6) AS change FROM e ORDER BY round(abs(b - a), 6) DESC, band, col LIMIT 12"))
def top_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, sf_dir).groupBy("band", "col").agg(F.avg(F.when(F.col("line") % 2 == 0, F.col("dn"))).alias("a"), F.avg(F.when(F.col("line") % 2 == 1, F.col("dn"))).alias("b"))
    return e.select("band", "col", steady(F.abs(F.col("b") - F.col("a"))).alias("change")).orderBy(F.desc("change"), "band", "col").limit(12)
