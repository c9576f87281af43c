"""Queries on names, times and metadata (SCA, PRJ-28, FLG-04, AGG-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import ATTRS, NAMES, attributes, product_names, sql, table
from sensorlake.functions import metadata as M, names as N, times as T
from sensorlake.plans.registry import query

_TAKE = "coalesce(attrs ->> '$.stac_discovery.stac_discovery.properties.\"eopf:data_take_id\"', attrs ->> '$.stac_discovery.properties.\"eopf:data_take_id\"')"
_REL = "coalesce(attrs ->> '$.stac_discovery.stac_discovery.properties.\"sat:relative_orbit\"', attrs ->> '$.stac_discovery.properties.\"sat:relative_orbit\"')"
_PLAT = "coalesce(attrs ->> '$.stac_discovery.stac_discovery.properties.platform', attrs ->> '$.stac_discovery.properties.platform')"
_DOUBLE = "(attrs -> '$.stac_discovery.stac_discovery') IS NOT NULL"


@query("sca_01_build_name", sql(NAMES, "SELECT o_orderkey, CASE WHEN 1 + o_custkey % 150 <= 143 THEN kind || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || lpad(CAST(CAST(greatest(floor(o_orderkey % 700 / 10.0::DOUBLE + 0.5), 1) AS INT) AS VARCHAR), 4, '0') || '_' || substr('ABC', CAST(1 + o_orderkey % 3 AS INT), 1) || lpad(CAST(1 + o_custkey % 150 AS VARCHAR), 3, '0') || '_T' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3)) || '.zarr' END AS name FROM pn"))
def sca_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = product_names(spark, sf_dir)
    name = N.build_name(F.col("kind"), F.col("o_orderdate"), F.col("o_orderkey") % 700 / 10.0, F.expr("substr('ABC', cast(1 + o_orderkey % 3 as int), 1)"), 1 + F.col("o_custkey") % 150, F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 3)))
    return p.select("o_orderkey", name.alias("name"))


@query("sca_01_checksum_discriminator")
def sca_01_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = N.build_name(F.col("kind"), F.col("o_orderdate"), F.lit(33.0), F.lit("A"), 1 + F.col("o_custkey") % 143)
    return product_names(spark, sf_dir).select("o_orderkey", name.alias("name"))


_PARSE = "substr(name, 1, 9) AS product_type, substr(name, 11, 15) AS start, CAST(substr(name, 27, 4) AS INT) AS duration_s, substr(name, 32, 1) AS unit, CAST(substr(name, 33, 3) AS INT) AS relative_orbit, substr(name, 37, 1) AS consolidation, substr(name, 38, 3) AS discriminator, '.zarr' AS ext"


@query("sca_02_parse_name", sql(NAMES, f"SELECT o_orderkey, {_PARSE}, true AS valid, true AS buildable FROM pn"))
def sca_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = product_names(spark, sf_dir).withColumn("p", N.parse_name(F.col("name")))
    return p.select("o_orderkey", *[F.col(f"p.{f}").alias(f) for f in ("product_type", "start", "duration_s", "unit", "relative_orbit", "consolidation", "discriminator", "ext", "valid", "buildable")])


@query("sca_03_lenient_parse", sql(NAMES, "m AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, name FROM pn)", "SELECT o_orderkey, k = 0 AS psfd, CASE k WHEN 0 THEN substr(name, 1, 9) WHEN 1 THEN 'X99' || substr(name, 4, 6) WHEN 2 THEN 'MSI_L0__DS_VGS2' END AS product_type, CASE WHEN k < 3 THEN substr(name, 11, 15) END AS start, CASE WHEN k < 2 THEN CAST(substr(name, 33, 3) AS INT) END AS relative_orbit, CASE WHEN k < 2 THEN substr(name, 32, 1) WHEN k = 2 THEN 'S2B' END AS unit, CASE WHEN k = 2 THEN CAST(o_custkey % 1000000 AS INT) END AS absolute_orbit FROM m"))
def sca_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit("X99"), F.expr("substr(name, 4)"))).when(k == 2, F.concat(F.lit("S2B_OPER_MSI_L0__DS_VGS2_"), F.substring("name", 11, 15), F.format_string("_A%06d", F.col("o_custkey") % 1_000_000))).otherwise("something.zarr")
    p = product_names(spark, sf_dir).withColumn("p", N.parse_lenient(text))
    return p.select("o_orderkey", *[F.col(f"p.{f}").alias(f) for f in ("psfd", "product_type", "start", "relative_orbit", "unit", "absolute_orbit")])


@query("sca_04_datastrip_id", sql(NAMES, "SELECT o_orderkey, 'S2A_OPER_MSI_L0__DS_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_A' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS id FROM pn"))
def sca_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_names(spark, sf_dir).select("o_orderkey", N.datastrip_id(F.lit("A"), F.col("o_orderdate"), F.col("o_custkey")).alias("id"))


@query("sca_05_coefficient_file", sql(NAMES, "SELECT o_orderkey, 'S2B' AS platform, 'REQOG' AS type, CAST(o_orderdate AS TIMESTAMP) AS start, TIMESTAMP '2099-01-01 00:00:00' AS stop FROM pn"))
def sca_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("S02B_ADF_REQOG_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_20990101T000000_20240101T000000.json"))
    p = product_names(spark, sf_dir).withColumn("p", N.parse_coefficient_file(text))
    return p.select("o_orderkey", "p.platform", "p.type", F.col("p.start").cast("timestamp_ntz").alias("start"), F.col("p.stop").cast("timestamp_ntz").alias("stop"))


@query("sca_06_tolerant_time", sql(NAMES, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS t FROM pn"))
def sca_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("null")
    return product_names(spark, sf_dir).select("o_orderkey", T.parse_utc(text).cast("timestamp_ntz").alias("t"))


@query("sca_07_iso_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events")
def sca_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.iso_millis(F.col("ts").cast("timestamp")).alias("iso"))


@query("sca_12_payload_decode", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {n}" for k, n in enumerate("t px py pz vx vy vz q0 q1 q2 q3".split())) + " FROM embeddings")
def sca_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.sources.telemetry import aocs_payload, payload_of

    e = table(spark, sf_dir, "embeddings").select("vec_id", payload_of(F.slice("embedding", 1, 11)).alias("body"))
    return e.select("vec_id", aocs_payload("body").alias("p")).select("vec_id", "p.*")


@query("sca_13_metadata", sql(ATTRS, f"SELECT event_id, {_REL} AS orbit, {_PLAT} AS platform, {_DOUBLE} AS double_nested FROM attrs"))
def sca_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(spark, sf_dir).select("event_id", M.property_of("attrs", "sat:relative_orbit").alias("orbit"), M.property_of("attrs", "platform").alias("platform"), M.doubly_nested("attrs").alias("double_nested"))


@query("sca_14_whole_number", sql(ATTRS, f"SELECT event_id, TRY_CAST({_REL} AS INT) AS orbit, {_REL} IS NOT NULL AND TRY_CAST({_REL} AS INT) IS NULL AS malformed FROM attrs"))
def sca_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    orbit, bad = M.whole_number(M.property_of("attrs", "sat:relative_orbit"))
    return attributes(spark, sf_dir).select("event_id", orbit.alias("orbit"), bad.alias("malformed"))


@query("sca_15_orbit_of_data_take", sql(ATTRS, f"SELECT event_id, TRY_CAST(regexp_extract({_TAKE}, 'GS2[ABC]_[A-Z0-9_]+?_(\\d{{6}})_N', 1) AS INT) AS orbit FROM attrs"))
def sca_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(spark, sf_dir).select("event_id", N.orbit_of_data_take(M.property_of("attrs", "eopf:data_take_id")).alias("orbit"))


@query("sca_16_identity", sql(ATTRS, f"SELECT event_id, TRY_CAST({_REL} AS INT) AS relative_orbit, CAST(event_id % 1000000 AS INT) AS absolute_orbit, 'stac_discovery' AS source, concat_ws(',', CASE WHEN {_DOUBLE} THEN 'stac_discovery_double_nested' END, CASE WHEN {_REL} IS NOT NULL AND TRY_CAST({_REL} AS INT) IS NULL THEN 'relative_orbit_not_int' END, 'absolute_orbit_from_datatake_id') AS flags FROM attrs"))
def sca_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute orbits count up to 999999 and begin anew: documents of later events have the last six digits of their ids."""
    i = attributes(spark, sf_dir, F.col("event_id") % 1_000_000).withColumn("i", M.identity("attrs"))
    return i.select("event_id", "i.relative_orbit", "i.absolute_orbit", "i.source", F.array_join("i.flags", ",").alias("flags"))


_CTX = f"SELECT event_id, coalesce(TRY_CAST({_REL} AS INT), 1) AS relative_orbit, right(upper({_PLAT}), 1) AS unit, {_PLAT} AS platform, CASE WHEN TRY_CAST({_REL} AS INT) IS NULL THEN 'sat:relative_orbit' ELSE '' END AS defaults FROM attrs"


@query("sca_17_context", sql(ATTRS, _CTX))
def sca_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = attributes(spark, sf_dir).withColumn("c", M.context("attrs"))
    return c.select("event_id", "c.relative_orbit", "c.unit", "c.platform", F.array_join("c.defaults", ",").alias("defaults"))


@query("prj_28_defaults", sql(ATTRS, f"c AS ({_CTX})", "SELECT defaults, count(*) AS n FROM c GROUP BY defaults"))
def prj_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sca_17(spark, sf_dir).groupBy("defaults").agg(F.count("*").alias("n"))


@query("sca_18_unit", sql(ATTRS, f"SELECT event_id, CASE WHEN regexp_matches(right(upper(trim({_PLAT})), 1), '^[A-Z]$') THEN right(upper(trim({_PLAT})), 1) END AS unit FROM attrs"))
def sca_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(spark, sf_dir).select("event_id", N.unit_of(M.property_of("attrs", "platform")).alias("unit"))


@query("sca_19_band_key", "SELECT part.p_partkey, 'b' || lower(substr(CASE WHEN p_partkey % 14 = 13 THEN 'B8A' ELSE 'B' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') END, 2, 2)) AS key FROM part")
def sca_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 14
    band = F.when(k == 13, "B8A").otherwise(F.concat(F.lit("B"), F.lpad(k.cast("string"), 2, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", N.band_key(band).alias("key"))


@query("sca_21_number_list", "SELECT part.p_partkey, CAST(p_partkey AS VARCHAR) || '.0|' || CAST(p_size AS VARCHAR) || '.0' AS numbers FROM part")
def sca_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("  ", F.col("p_partkey").cast("string"), F.lit("x1"), F.col("p_size").cast("string"), F.lit("n/a"))
    numbers = F.array_join(F.transform(N.number_list(text), lambda x: F.concat(x.cast("long").cast("string"), F.lit(".0"))), "|")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.alias("numbers"))


@query("sca_22_accessors", "SELECT part.p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS v FROM part")
def sca_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    node = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_brand").alias("@v"), F.col("p_type").alias("v")))).otherwise(F.to_json(F.struct(F.col("p_type").alias("v"))))
    return p.withColumn("node", node).select("p_partkey", F.coalesce(F.get_json_object("node", "$['@v']"), F.get_json_object("node", "$.v")).alias("v"))


@query("sca_23_range_list", "SELECT part.p_partkey, list_sum(range(1 + p_partkey % 5, 4 + p_partkey % 5)) + 12 AS total, 4 AS n FROM part")
def sca_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.concat((1 + k).cast("string"), F.lit("-"), (3 + k).cast("string"), F.lit(",12"))
    p = table(spark, sf_dir, "part").withColumn("l", N.range_list(text))
    return p.select("p_partkey", F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("total"), F.size("l").alias("n"))


@query("sca_24_key_search", sql(ATTRS, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '$.stac_discovery.stac_discovery.properties.platform' ELSE '$.stac_discovery.properties.platform' END AS path FROM attrs"))
def sca_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.stores import key_paths

    return key_paths(attributes(spark, sf_dir), ["event_id"], "attrs", depth=4).where("key = 'platform'").select("event_id", "path")


@query("sca_25_sensing_date", sql(NAMES, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM pn"))
def sca_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("x/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/y")))
    return product_names(spark, sf_dir).select("o_orderkey", N.sensing_date(text).alias("d"))


@query("sca_26_product_root", sql(NAMES, "SELECT o_orderkey, 'in/' || name AS root FROM pn"))
def sca_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_names(spark, sf_dir).select("o_orderkey", N.product_root(F.concat(F.lit("in/"), F.col("name"), F.lit("/measurements/d05/img")), ".zarr").alias("root"))


_DATED = "k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 0 THEN 'S2A' WHEN 1 THEN 'S02B' WHEN 2 THEN 'S2C' ELSE 'S3A' END || '/' || name AS key FROM pn), s AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'S2A' WHEN 1 THEN 'S2B' WHEN 2 THEN 'S2C' ELSE '?' END AS satellite FROM k)"


def _dated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("S2A", "S02B", "S2C", "S3A"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return product_names(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.concat_ws("/", unit, "name").alias("key"))


@query("sca_26_satellite", sql(NAMES, _DATED, "SELECT o_orderkey, key, satellite FROM s"))
def sca_26_satellite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_keys(spark, sf_dir).select("o_orderkey", "key", N.satellite(F.col("key")).alias("satellite"))


@query("top_01_by_date", sql(NAMES, _DATED, "SELECT day, CAST(date_diff('day', DATE '1992-01-01', day) AS INT) AS days, satellite, key FROM s WHERE day >= DATE '1992-01-01'"))
def top_01_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys from a first day on, in the order of date, satellite and key, with the days since then. The sort is by ranges, in many tasks."""
    first = F.lit("1992-01-01").cast("date")
    k = _dated_keys(spark, sf_dir).where(F.col("day") >= first)
    return k.select("day", F.datediff("day", first).alias("days"), N.satellite(F.col("key")).alias("satellite"), "key").orderBy("day", "satellite", "key")


@query("sca_27_first_line_map", "SELECT CAST(event_id % 50 AS INT) AS product, string_agg(b || '=' || t, ',' ORDER BY b) AS times FROM (SELECT event_id % 50 AS event_id, user_id % 13 AS b, CAST(min(epoch_us(ts) // 1000000) AS BIGINT) AS t FROM events GROUP BY ALL) GROUP BY event_id")
def sca_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    rows = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).cast("int").alias("product"), (F.col("user_id") % 13).alias("band")).agg(F.min(t).alias("t"))
    m = T.first_line_map(rows, ["product"])
    return m.select("product", F.array_join(F.transform(F.array_sort(F.map_entries("times")), lambda e: F.concat_ws("=", e["key"], e["value"]["value"])), ",").alias("times"))


_QC = "q AS (SELECT o_orderkey, o_orderkey % 7 <> 0 AS ring, o_orderdate IS NOT NULL AS times, o_orderkey % 5 <> 0 AS iso, 1 + o_custkey % 150 BETWEEN 1 AND 143 AS orbit, o_totalprice > 1000 AS epoch FROM orders)"


def qc_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows with a footprint ring, times, orbits and an epoch."""
    point = lambda x, y: F.array(F.lit(x), F.lit(y))
    ring = F.array(point(0.0, 0.0), point(1.0, 0.0), point(1.0, 1.0))
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    closed = F.when(F.col("o_orderkey") % 7 != 0, F.array_append(ring, point(0.0, 0.0))).otherwise(ring)
    z = F.when(F.col("o_orderkey") % 5 != 0, F.lit("Z")).otherwise(F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", closed.alias("ring"), F.concat(start, z).alias("start"), F.concat(start, z).alias("stop"), (1 + F.col("o_custkey") % 150).cast("int").alias("relative_orbit"), F.col("o_custkey").cast("int").alias("absolute_orbit"), (F.col("o_totalprice").cast("double") - 1000).alias("epoch"), F.lit(True).alias("has_measurements"))


@query("flg_04_qc_predicates", sql(_QC, "SELECT o_orderkey, ring, times, iso, orbit, epoch FROM q"))
def flg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.stores import qc_predicates

    q = qc_predicates(qc_input(spark, sf_dir))
    return q.select("o_orderkey", F.col("Geometry_Ring").alias("ring"), F.col("Sensing_Time").alias("times"), F.col("ISO_Time").alias("iso"), F.col("Relative_Orbit").alias("orbit"), F.col("Datation_Sync").alias("epoch"))


@query("agg_25_qc_checks", sql(_QC, "SELECT o_orderkey, CAST(NOT ring AS INT) + CAST(NOT times AS INT) + CAST(NOT iso AS INT) + CAST(NOT orbit AS INT) + CAST(NOT epoch AS INT) AS failed, CASE WHEN ring AND times AND iso AND orbit AND epoch THEN 'OK' ELSE 'KO' END AS overall FROM q"))
def agg_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.operators.stores import qc_report

    r = qc_report(qc_input(spark, sf_dir))
    return r.select("o_orderkey", F.size(F.filter("checks", lambda c: c["result"] == "fail")).alias("failed"), F.col("overall"))


_LISTING_SQL = sql(NAMES, "SELECT row_number() OVER (ORDER BY name, o_orderkey) AS place, name, o_orderkey FROM pn")


@query("top_01_ordered_listing", _LISTING_SQL)
@query("top_01_ordered_listing_whole", _LISTING_SQL)  # the name of an earlier round
def top_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names in order. A range is a kind and a month, the first 16 characters; only the counts of ranges are summed in one place."""
    from pyspark.sql import Window

    n = product_names(spark, sf_dir).select("name", "o_orderkey", F.substring("name", 1, 16).alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("name", "o_orderkey")) + F.col("offset")
    return n.join(F.broadcast(offsets), "range").select(place.cast("long").alias("place"), "name", "o_orderkey").orderBy("place")


@query("top_03_newest", sql(NAMES, "SELECT kind, arg_max(name, strftime(o_orderdate, '%Y%m%d') || name) AS newest FROM pn GROUP BY kind"))
def top_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_names(spark, sf_dir).groupBy("kind").agg(F.max_by("name", F.struct("o_orderdate", "name")).alias("newest"))


@query("top_04_first_ids", sql(NAMES, "SELECT kind, array_to_string(list_slice(list_sort(list(DISTINCT CAST(o_orderdate AS DATE))), 1, 5), ',') AS first_days FROM pn GROUP BY kind"))
def top_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.slice(F.sort_array(F.collect_set(F.col("o_orderdate").cast("date"))), 1, 5)
    return product_names(spark, sf_dir).groupBy("kind").agg(F.array_join(F.transform(days, lambda d: d.cast("string")), ",").alias("first_days"))
