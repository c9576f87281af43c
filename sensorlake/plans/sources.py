"""Queries on sources and sinks (SRC, SNK, UDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import ACQ, ADF, FRAME, LISTING, NAMES, PACKET, coefficient_files, frame, listing, packets, product_names, sql, table
from sensorlake.functions.numbers import steady
from sensorlake.operators import profile, stores
from sensorlake.plans.calibration import running_mean_sql
from sensorlake.plans.registry import query
from sensorlake.sources import coefficients as S, frames
from sensorlake.sources.dimensions import BANDS_SQL, SOLAR_SQL, UNITS, band_dim, solar_dim
from sensorlake.sources.shared import new_path, written


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = frames.fresh(spark)
    frames.write_frames(frames.to_lines(frame(spark, sf_dir), ["detector", "band"]), path)
    return path


@query("src_01_frame_scan", sql(FRAME, "SELECT detector, band, line, col, dn FROM frame WHERE detector = 5 AND band IN (2, 3) AND line BETWEEN 8 AND 15"))
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = frames.scan(spark, _stored(spark, sf_dir), bands=[2, 3], detectors=[5], lines=(8, 15))
    return frames.to_pixels(x).select("detector", "band", "line", "col", "dn")


@query("src_02_raw_scan", sql(FRAME, "SELECT band, line, CAST(sum(dn) AS BIGINT) AS total FROM frame WHERE band = 1 GROUP BY band, line"))
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = frames.scan(spark, _stored(spark, sf_dir), bands=[1])
    return x.select("band", "line", F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("src_03_layout_resolution", "SELECT CAST(user_id % 12 + 1 AS INT) AS detector, event_type AS band, min(CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 2 ELSE 3 END) AS layout, count(*) AS n FROM events GROUP BY ALL")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    d = F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0")
    path = F.when(k == 0, F.concat(F.lit("measurements/d"), d, F.lit("/"), "event_type", F.lit("/img"))).when(k == 1, F.concat(F.lit("measurements/DD"), d, F.lit("/"), "event_type", F.lit("/l1a_raw_image"))).otherwise(F.concat(F.lit("img/"), d, F.lit("/"), "event_type"))
    x = table(spark, sf_dir, "events").select(path.alias("path"))
    return stores.layouts(x).groupBy("detector", "band").agg(F.min("layout").alias("layout"), F.count("*").alias("n"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of vectors: four number lists for each vector."""
    text = lambda a, b: F.array_join(F.transform(F.slice("embedding", a, b), lambda v: F.rint(v.cast("double") * 1000).cast("long").cast("string")), " ")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit("05").alias("DETECTOR_ID"), text(1, 8).alias("COEFF_A"), text(9, 8).alias("COEFF_B"), text(17, 8).alias("COEFF_C"), F.concat(text(25, 8), F.lit(" x")).alias("COEFF_D")).alias("n"))


_COEF_SQL = "SELECT vec_id, 5 AS detector, CAST(i AS INT) AS col, round_even(CAST(embedding[i + 1] AS DOUBLE) * 1000, 0) + 0 AS a, round_even(CAST(embedding[i + 9] AS DOUBLE) * 1000, 0) + 0 AS b, round_even(CAST(embedding[i + 17] AS DOUBLE) * 1000, 0) + 0 AS c, round_even(CAST(embedding[i + 25] AS DOUBLE) * 1000, 0) + 0 AS dark FROM embeddings, range(8) r(i)"


@query("src_04_json_coefficients", _COEF_SQL)
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _lists(spark, sf_dir).select("vec_id", F.to_json(F.struct(F.array("n").alias("COEFFICIENTS"))).alias("text"))
    return S.from_json_documents(docs, ["vec_id"], "text")


@query("src_05_xml_coefficients", _COEF_SQL)
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t: F.concat(F.lit(f"<{t}>"), F.col(f"n.{t}"), F.lit(f"</{t}>"))
    text = F.concat(F.lit('<GIPP><COEFFICIENTS id="05">'), *[tag(f"COEFF_{x}") for x in "ABCD"], F.lit("</COEFFICIENTS></GIPP>"))
    return S.from_xml_documents(_lists(spark, sf_dir).select("vec_id", text.alias("text")), ["vec_id"], "text")


@query("src_06_array_json", "SELECT vec_id, CAST(d AS INT) AS detector, CAST(i AS INT) AS col, CAST(embedding[d * 32 + i + 1] AS DOUBLE) AS value FROM embeddings, range(2) x(d), range(32) y(i)")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    doc = F.to_json(F.struct(F.struct(F.struct(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)).alias("data")).alias("b03/coeff_c")).alias("data_vars")))
    return S.from_array_json(table(spark, sf_dir, "embeddings").select("vec_id", doc.alias("text")), ["vec_id"], "text", "b03/coeff_c")


def _column_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *x: F.concat_ws(" ", *[v.cast("string") for v in x])
    node = F.struct(F.lit("7").alias("ID"), text(k % 50, k % 20, k % 50).alias("VALID"), text(k % 30).alias("NOT_VALID"))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(node).alias("DETECTORS"))).alias("text"))


@query("src_07_defective_columns", "SELECT DISTINCT p_partkey, 7 AS detector, CAST(c AS INT) AS col FROM (SELECT part.p_partkey, unnest([p_partkey % 50, p_partkey % 20]) AS c FROM part)")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.columns_of(_column_docs(spark, sf_dir), ["p_partkey"], "text", ["VALID"])


@query("src_08_blind_columns", "SELECT DISTINCT p_partkey, 7 AS detector, CAST(c AS INT) AS col FROM (SELECT part.p_partkey, unnest([p_partkey % 50, p_partkey % 20, p_partkey % 30]) AS c FROM part)")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.columns_of(_column_docs(spark, sf_dir), ["p_partkey"], "text", ["VALID", "NOT_VALID"])


@query("src_09_radiometric_parameters", "SELECT part.p_partkey, CAST(p_partkey % 13 AS INT) AS band, -100.0::DOUBLE AS offset_l1b, CAST(p_size AS DOUBLE) AS offset_l1c, p_partkey % 2 = 0 AS dark, true AS response, false AS crosstalk FROM part")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct((F.col("p_partkey") % 13).cast("int").alias("BAND_ID"), F.lit(-100.0).alias("OFFSET_L1B"), F.col("p_size").cast("double").alias("OFFSET_L1C"), F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("false").alias("DARK"), F.lit("FALSE").alias("CROSSTALK"))
    docs = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.array(node).alias("BANDS"))).alias("text"))
    return S.radiometric_parameters(docs, ["p_partkey"], "text")


@query("src_10_crosstalk_rows", "SELECT part.p_partkey, CAST(i AS INT) AS l, CASE i WHEN 0 THEN CAST(p_partkey % 7 + p_size AS DOUBLE) ELSE CAST(p_size + 1 AS DOUBLE) END AS coef FROM part, range(2) r(i)")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", (F.col("p_partkey") % 7).cast("string"), F.col("p_size").cast("string")).alias("o"), F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("1")).alias("e"))
    return S.crosstalk_rows(docs, ["p_partkey"], "o", "e")


@query("src_11_swir_shift_map", sql(FRAME, BANDS_SQL, "SELECT band_name, col, CAST(round_even(greatest(least((avg(dn) - 2048) / 40, 1), -1), 0) AS INT) AS shift, CASE WHEN band_name = 'B10' THEN 'interp' ELSE 'shift' END AS method FROM frame JOIN bands ON band_index = band + 3 WHERE band_name IN ('B10', 'B11', 'B12') GROUP BY ALL"))
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = band_dim(spark).where("band_name IN ('B10', 'B11', 'B12')").select((F.col("band_index") - 3).alias("band"), "band_name")
    m = frame(spark, sf_dir).join(F.broadcast(d), "band").groupBy("band_name", "col").agg(F.avg("dn").alias("m"))
    shift = F.rint(F.greatest(F.least((F.col("m") - 2048) / 40, F.lit(1.0)), F.lit(-1.0))).cast("int")
    return m.select("band_name", "col", shift.alias("shift"), F.when(F.col("band_name") == "B10", "interp").otherwise("shift").alias("method"))


@query("src_12_onboard_table", sql(FRAME, "SELECT band, col, round(1 + min(dn) / 1e5::DOUBLE, 6) AS a1, round(1 - min(dn) / 1e5::DOUBLE, 6) AS a2 FROM frame WHERE line % 2 = 1 GROUP BY band, col"))
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frame(spark, sf_dir).withColumn("table", F.when(F.col("line") % 2 == 1, "new_table").otherwise("old_table"))
    return t.where("table = 'new_table'").groupBy("band", "col").agg(steady(1 + F.min("dn") / 1e5).alias("a1"), steady(1 - F.min("dn") / 1e5).alias("a2"))


@query("src_14_psf_matrix", "SELECT vec_id, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(round_even(CAST(embedding[i + 1] AS DOUBLE) * 1000, 0) AS DOUBLE) + 0 AS w FROM embeddings, range(64) x(i)")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("long").cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_join(F.slice(v, r * 8 + 1, F.lit(8)), ",")), "\n")
    return S.psf_matrix(table(spark, sf_dir, "embeddings").select("vec_id", text.alias("text")), ["vec_id"], "text")


@query("src_15_band_dimension", sql(FRAME, BANDS_SQL, "SELECT band_index, band_name, gsd_m, count(*) AS pixels FROM frame JOIN bands ON band_index = band GROUP BY ALL"))
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir).withColumnRenamed("band", "band_index")
    return f.join(F.broadcast(band_dim(spark)), "band_index").groupBy("band_index", "band_name", "gsd_m").agg(F.count("*").alias("pixels"))


@query("src_15_solar_irradiance", sql(FRAME, BANDS_SQL, SOLAR_SQL, "u(unit) AS (VALUES ('S2A'), ('S2B'), ('S2C'))", "SELECT u.unit, band_name, esun, esun IS NULL AS unknown FROM (SELECT DISTINCT band FROM frame) f JOIN bands b ON b.band_index = f.band CROSS JOIN u LEFT JOIN solar s ON s.unit = u.unit AND s.band_index = b.band_index"))
def src_15_solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame([(u,) for u in UNITS], "unit string")
    used = frame(spark, sf_dir).select(F.col("band").alias("band_index")).distinct().join(F.broadcast(band_dim(spark)), "band_index")
    x = used.crossJoin(F.broadcast(units)).join(F.broadcast(solar_dim(spark)), ["unit", "band_index"], "left")
    return x.select("unit", "band_name", "esun", F.col("esun").isNull().alias("unknown"))


@query("src_16_framing_offsets", sql(FRAME, "SELECT band, CAST(min(line) FILTER (dn > 2100) AS INT) AS begin FROM frame GROUP BY band"))
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = frame(spark, sf_dir).groupBy("band").agg(F.min(F.when(F.col("dn") > 2100, F.col("line"))).alias("begin"))
    doc = begin.select("band", F.to_json(F.create_map(F.concat(F.lit("b"), F.lpad(F.col("band").cast("string"), 2, "0")), F.col("begin"))).alias("text"))
    x = doc.select(F.explode(F.from_json("text", "map<string,int>")).alias("k", "begin"))
    return x.select(F.substring("k", 2, 2).cast("int").alias("band"), "begin")


_PATHS = "ph AS (SELECT page_id, size, CASE page_id % 8 WHEN 0 THEN 'l0/S02MSIL0__' || page_id || '.zarr/img/0' WHEN 1 THEN 'l0/S02MSIL0__' || page_id || '_OC.zarr/img/0' WHEN 2 THEN 'inputs/public-data/level-0/S02MSIL0__' || page_id || '.zarr/x' WHEN 3 THEN 'report/r' || page_id || '.json' WHEN 4 THEN 'caldb/S02MSIDCA' || page_id || '.zarr/a' WHEN 5 THEN 'caldb/c' || page_id || '.zarr.zip' WHEN 6 THEN 'inputs/real_l0/t' || page_id || '.tar' ELSE 'inputs/gipp/g' || page_id || '.json' END AS path FROM listing)"
_KIND = "CASE page_id % 8 WHEN 0 THEN 'our-l0-canonical' WHEN 1 THEN 'our-l0-oc' WHEN 2 THEN 'external-l0-public' WHEN 3 THEN 'report' WHEN 4 THEN 'our-cal-l0' WHEN 5 THEN 'caldb-adf' WHEN 6 THEN 'external-psd-tar' ELSE 'reference-gipp' END"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 8
    p = [("l0/S02MSIL0__", ".zarr/img/0"), ("l0/S02MSIL0__", "_OC.zarr/img/0"), ("inputs/public-data/level-0/S02MSIL0__", ".zarr/x"), ("report/r", ".json"), ("caldb/S02MSIDCA", ".zarr/a"), ("caldb/c", ".zarr.zip"), ("inputs/real_l0/t", ".tar"), ("inputs/gipp/g", ".json")]
    path = F.coalesce(*[F.when(k == n, F.concat(F.lit(a), i, F.lit(b))) for n, (a, b) in enumerate(p)])
    return listing(spark, sf_dir).select("page_id", "size", path.alias("path"))


@query("src_17_store_walk", sql(LISTING, _PATHS, "SELECT page_id, regexp_replace(path, '(\\.zarr)/.*$', '\\1') AS item, CAST(sum(size) AS BIGINT) AS bytes FROM ph GROUP BY ALL"))
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.items(paths(spark, sf_dir), ["page_id"]).select("page_id", "item", "bytes")


@query("sca_20_classification", sql(LISTING, _PATHS, f"SELECT path, {_KIND} AS kind FROM ph"))
def sca_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("path", stores.classify(F.col("path")).alias("c")).select("path", "c.kind")


@query("src_18_root_attributes", "SELECT event_id // 3 AS product, arg_min(event_id, CASE event_id % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END) AS event_id FROM events WHERE event_id % 3 > 0 GROUP BY ALL")
def src_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    docs = table(spark, sf_dir, "events").where(k > 0).select(F.floor(F.col("event_id") / 3).alias("product"), F.when(k == 1, ".zattrs").otherwise(".zmetadata").alias("file"), F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")).alias("text"))
    return stores.root_attributes(docs, ["product"]).select("product", F.get_json_object("attrs", "$.id").cast("long").alias("event_id"))


@query("src_19_listing_pages", sql(LISTING, "SELECT page_id, size, etag FROM listing"))
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<Contents><Key>"), F.col("page_id").cast("string"), F.lit("</Key><Size>"), F.col("size").cast("string"), F.lit("</Size><ETag>"), "etag", F.lit("</ETag></Contents>"))
    pages = listing(spark, sf_dir).groupBy(F.floor(F.col("page_id") / 1000).alias("p")).agg(F.concat(F.lit("<ListBucketResult><NextContinuationToken>t</NextContinuationToken>"), F.array_join(F.collect_list(row), ""), F.lit("</ListBucketResult>")).alias("text"))
    return stores.listing_pages(pages, "text").select(F.col("key").cast("long").alias("page_id"), "size", "etag")


@query("src_20_packet_files", sql(PACKET, "SELECT apid, seq_count, data_len % 40 + 1 AS data_len FROM packet"))
def src_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets are written as bytes, one content for each stream and hundred packets, and their headers read back."""
    from sensorlake.functions.packets import pack_header
    from sensorlake.sources.telemetry import register

    register(spark)
    n = F.col("data_len") % 40 + 1
    bytes_ = F.concat(pack_header(F.col("apid"), F.lit(3), F.col("seq_count"), n), F.repeat(F.lit("00"), n))
    files = packets(spark, sf_dir).groupBy("apid", F.floor(F.col("pos") / 100).alias("part")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", bytes_.alias("b")))), lambda x: x["b"]), "")).alias("content"))
    files.createOrReplaceTempView("packet_files")
    return spark.sql("SELECT h.apid, h.seq_count, h.data_len FROM packet_files, LATERAL packet_headers(content, true) h")


@query("udf_04_tar_members", sql(LISTING, "SELECT CAST(page_id AS VARCHAR) || '.txt' AS name, CAST(length(CAST(page_id AS VARCHAR)) AS INT) AS n FROM listing"))
def udf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.sources.telemetry import register, tar_of

    register(spark)
    member = F.struct(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("name"), F.col("page_id").cast("string").cast("binary").alias("content"))
    listing(spark, sf_dir).select(tar_of(F.array(member)).alias("content")).createOrReplaceTempView("tar_files")
    return spark.sql("SELECT m.name, cast(length(m.content) AS int) AS n FROM tar_files, LATERAL tar_members(content) m")


@query("src_21_layout_detection", sql(LISTING, _PATHS, "SELECT split_part(path, '/', 1) AS root, bool_or(path LIKE '%/img/%') AS band_folders FROM ph GROUP BY ALL"))
def src_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.bool_or(F.col("path").contains("/img/")).alias("band_folders"))


@query("src_22_newest_file", sql(ADF, "SELECT type, arg_max(adf_id, CAST(strftime(start, '%Y%m%d') AS BIGINT) * 1000000 + adf_id) AS newest, min(adf_id) AS first FROM adf GROUP BY type"))
def src_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficient_files(spark, sf_dir).groupBy("type").agg(F.max_by("adf_id", F.struct("start", "adf_id")).alias("newest"), F.min("adf_id").alias("first"))


@query("src_24_raw_readable_bands", sql(NAMES, "b AS (SELECT kind, count(DISTINCT o_custkey % 13) AS n_bands FROM pn WHERE o_orderkey % 3 = 0 GROUP BY kind)", "SELECT kind, n_bands FROM b WHERE kind = (SELECT arg_max(kind, n_bands * 10 + CASE kind WHEN 'S02MSIL1B' THEN 3 WHEN 'S02MSIL1A' THEN 2 ELSE 1 END) FROM b)"))
def src_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = product_names(spark, sf_dir).where("o_orderkey % 3 = 0").groupBy("kind").agg(F.count_distinct(F.col("o_custkey") % 13).alias("n_bands"))
    return b.agg(F.max(F.struct("n_bands", "kind")).alias("b")).select("b.kind", "b.n_bands")


@query("snk_01_write_frames", sql(FRAME, "SELECT band, detector, max(line) + 1 AS n_lines, min(dn) AS dn_min, max(dn) AS dn_max, CAST(0 AS BIGINT) AS n_different FROM frame GROUP BY band, detector"))
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frames.write_frames(frames.to_lines(frame(spark, sf_dir), ["detector", "band"]), frames.fresh(spark))
    return r.withColumn("n_lines", F.col("n_lines").cast("int"))


@query("snk_02_import_detector", sql(FRAME, "SELECT band, count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM frame WHERE detector = 5 GROUP BY band"))
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir).where("detector = 5").withColumn("source", F.lit("import"))
    back = written(f, "imported", "band", "detector")
    return profile.differing(f, back, ["band"])


@query("snk_03_decoded_frames", sql(FRAME, "SELECT band, count(*) AS n, count(*) FILTER (dn = 0) AS n_zero, count(*) FILTER (dn >= 4095) AS n_saturated FROM frame GROUP BY band"))
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.coding import decode_qa

    back = written(frames.to_lines(frame(spark, sf_dir), ["detector", "band"]), "decoded", "band", "detector")
    return written(decode_qa(frames.to_pixels(back), ["band"]), "decode-qa").select("band", "n", "n_zero", "n_saturated")


@query("snk_04_canonical_product", sql(FRAME, PACKET, "SELECT 'frames' AS name, CAST(count(DISTINCT (band, line)) AS BIGINT) AS n FROM frame UNION ALL SELECT 'mask', count(*) FROM frame WHERE dn = 0 OR dn >= 4095 UNION ALL SELECT 'packets', count(*) FROM packet"))
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    tables = {"frames": frames.to_lines(f, ["detector", "band"]), "mask": f.where("dn = 0 OR dn >= 4095").select("band", "line", "col"), "packets": packets(spark, sf_dir)}
    made = frames.write_product(tables, new_path(spark, "product"))
    out = None
    for name, path in made.items():
        part = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "n")


@query("snk_07_column_tables", "SELECT CAST(l_linenumber - 1 AS INT) AS band, CAST(l_partkey % 64 AS INT) AS col FROM lineitem GROUP BY ALL")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.fixtures import acquisition
    from sensorlake.operators import calibrate

    a = acquisition(spark, sf_dir)
    prnu = calibrate.column_prnu(a.where("kind = 'flat'"), ["band"])
    dark = calibrate.column_floor(a, ["band"])
    return written(dark.join(prnu, ["band", "col"], "left"), "column-adf").select("band", "col")


@query("snk_07_column_values", sql(ACQ, "f AS (SELECT band, col, quantile_cont(dn, 0.01) AS dark FROM acq GROUP BY band, col)", "md AS (SELECT band, col, quantile_cont(dn, 0.5) AS m FROM acq WHERE kind = 'flat' GROUP BY band, col)", running_mean_sql("md", "m", 33, "t"), "r AS (SELECT *, coalesce(m / nullif(trend, 0), 1) AS r FROM t)", "p AS (SELECT band, col, r / quantile_cont(r, 0.5) OVER (PARTITION BY band) AS prnu FROM r)", "SELECT band, col, round(dark, 6) AS dark, round(prnu, 6) AS prnu FROM f LEFT JOIN p USING (band, col)"))
def snk_07_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written column table with its values."""
    from sensorlake.fixtures import acquisition
    from sensorlake.operators import calibrate

    a = acquisition(spark, sf_dir)
    both = calibrate.column_floor(a, ["band"]).join(calibrate.column_prnu(a.where("kind = 'flat'"), ["band"]), ["band", "col"], "left")
    return written(both, "column-adf").select("band", "col", steady("dark").alias("dark"), steady("prnu").alias("prnu"))


@query("snk_08_run_report", sql(FRAME, "m AS (SELECT 'profile' AS phase, band, 'dn_max' AS name, CAST(max(dn) AS DOUBLE) AS value FROM frame GROUP BY band UNION ALL SELECT 'validate', band, 'lines', CAST(max(line) + 1 AS DOUBLE) FROM frame GROUP BY band)", "SELECT p.phase, band, name, value, m.phase IS NULL AS missing FROM (VALUES ('profile'), ('validate'), ('decode')) p(phase) LEFT JOIN m ON m.phase = p.phase"))
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    a = f.groupBy("band").agg(F.max("dn").cast("double").alias("value")).select(F.lit("profile").alias("phase"), "band", F.lit("dn_max").alias("name"), "value")
    b = f.groupBy("band").agg((F.max("line") + 1).cast("double").alias("value")).select(F.lit("validate").alias("phase"), "band", F.lit("lines").alias("name"), "value")
    return stores.run_report(["profile", "validate", "decode"], written(a.unionByName(b), "metrics"))


@query("snk_09_inventory", sql(LISTING, _PATHS, f"SELECT {_KIND} AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ph GROUP BY ALL"))
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stores.items(paths(spark, sf_dir), ["page_id"]).withColumn("kind", stores.classify(F.col("item"))["kind"])
    return written(items, "inventory").groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("snk_11_manifest_upsert", sql(ADF, "SELECT type AS name, adf_id % 4 AS version, CASE WHEN max(CASE WHEN adf_id % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN max(adf_id) FILTER (adf_id % 2 = 0) ELSE max(adf_id) END AS bytes FROM adf GROUP BY ALL"))
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = coefficient_files(spark, sf_dir).select(F.col("type").alias("name"), (F.col("adf_id") % 4).alias("version"), F.col("adf_id").alias("bytes"))
    latest = lambda df: df.groupBy("name", "version").agg(F.max("bytes").alias("bytes"))
    return written(stores.upsert(latest(a.where("bytes % 2 = 1")), latest(a.where("bytes % 2 = 0")), ["name", "version"]), "manifest")


@query("snk_12_qc_documents", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND 1 + o_custkey % 150 <= 143 AND o_totalprice > 1000 THEN 'OK' ELSE 'KO' END AS overall FROM orders")
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.plans.names import qc_input

    doc = stores.qc_report(qc_input(spark, sf_dir)).select("o_orderkey", F.to_json(F.struct("checks", "overall")).alias("text"))
    return written(doc, "qc").select("o_orderkey", F.get_json_object("text", "$.overall").alias("overall"))


@query("snk_13_fetch_manifest", sql(LISTING, "SELECT CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN etag <> content_md5 THEN 'md5' ELSE 'ok' END AS verify, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM listing GROUP BY ALL"))
def snk_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = listing(spark, sf_dir)
    local = ls.where("page_id % 5 <> 0").select("page_id", F.col("size").alias("local_size"), F.col("content_md5").alias("local_md5"))
    return written(stores.verify(ls, local, "page_id"), "fetch").groupBy("verify").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("src_13_coefficient_bundle", sql(FRAME, "SELECT band, col, round(avg(dn) * any_value(1 + (col * 13 + band * 5) % 61 / 1000.0::DOUBLE), 6) AS v, bool_or(col < 4) AS blind FROM frame WHERE band IN (1, 8) GROUP BY band, col"))
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient tables as views of one bundle; only what a query asks for is read."""
    from sensorlake.fixtures import coefficients
    from sensorlake.plans.joins import blind

    S.register_bundle({"eq_coef": coefficients(spark), "blind_col": blind(spark, 64, 4).where("col < 4"), "radio_param": None})
    frame(spark, sf_dir).createOrReplaceTempView("bundle_frame")
    x = spark.sql("SELECT f.band, f.col, avg(dn) * (any_value(c.c) + 0.03D) AS v, bool_or(b.col IS NOT NULL) AS blind FROM bundle_frame f JOIN eq_coef c ON c.band = f.band AND c.col = f.col LEFT JOIN blind_col b ON b.band = f.band AND b.col = f.col WHERE f.band IN (1, 8) GROUP BY f.band, f.col")
    return x.select("band", "col", steady("v").alias("v"), "blind")


@query("str_02_batch_definition", sql(PACKET, "SELECT apid, count(*) AS n, CAST(sum(data_len + 6) AS BIGINT) AS bytes FROM packet GROUP BY apid"))
def str_02_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).groupBy("apid").agg(F.count("*").alias("n"), F.sum(F.col("data_len") + 6).alias("bytes"))
