"""Queries on stores: roll-ups and findings (AGG-21, AGG-32, RUL, SET-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import ATTRS, LISTING, NAMES, attributes, listing, product_names, sql
from sensorlake.functions.metadata import property_of
from sensorlake.functions.names import parse_name
from sensorlake.functions.numbers import steady
from sensorlake.operators import stores
from sensorlake.plans.registry import query


@query("agg_21_listing_rollup", sql(LISTING, "SELECT split_part(split_part(key, '://', 2), '/', 2) AS type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1e6, 6) AS mb, count(DISTINCT etag) AS n_tags FROM listing GROUP BY ALL"))
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split_part(F.split_part("key", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2))
    return listing(spark, sf_dir).groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), steady(F.sum("size") / 1e6).alias("mb"), F.count_distinct("etag").alias("n_tags"))


@query("agg_32_fetch_totals", sql(LISTING, "e AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN etag <> content_md5 THEN 'md5' ELSE 'ok' END AS v, count(*) AS n, sum(size) AS b FROM listing GROUP BY ALL)", "SELECT CAST(sum(n) AS BIGINT) AS objects, CAST(sum(b) AS BIGINT) AS bytes, string_agg(v || ' ' || n, '; ' ORDER BY v) FILTER (v <> 'ok') AS errors FROM e"))
def agg_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = listing(spark, sf_dir)
    local = ls.where("page_id % 5 <> 0").select("page_id", F.col("size").alias("local_size"), F.col("content_md5").alias("local_md5"))
    e = stores.verify(ls, local, "page_id").groupBy("verify").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    errors = F.array_join(F.array_sort(F.collect_list(F.when(F.col("verify") != "ok", F.concat_ws(" ", "verify", "n")))), "; ")
    return e.agg(F.sum("n").alias("objects"), F.sum("b").alias("bytes"), errors.alias("errors"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the identity of an event of the same number: path, kind, group, flags, name_orbit, orbit, identity_source."""
    n = product_names(spark, sf_dir)
    ident = attributes(spark, sf_dir).select(F.col("event_id").alias("o_orderkey"), property_of("attrs", "sat:relative_orbit").try_cast("int").alias("orbit"))
    kind = F.when(F.col("kind") == "S02MSIL1A", "external-l0-public").when(F.col("kind") == "S02MSIL0_", "our-l0-canonical").otherwise("external-l1a")
    flags = F.when(F.col("o_orderkey") % 1000 == 7, F.array(F.lit("no_zarr_attrs"))).otherwise(F.array().cast("array<string>"))
    return n.join(ident, "o_orderkey", "left").select(F.col("name").alias("path"), kind.alias("kind"), F.substring("name", 11, 8).alias("group"), flags.alias("flags"), parse_name(F.col("name"))["relative_orbit"].alias("name_orbit"), "orbit", F.lit("stac_discovery").alias("identity_source"))


_REC = """id AS (SELECT event_id, TRY_CAST(coalesce(attrs ->> '$.stac_discovery.stac_discovery.properties."sat:relative_orbit"', attrs ->> '$.stac_discovery.properties."sat:relative_orbit"') AS INT) AS orbit FROM attrs),
rec AS (SELECT name AS path, CASE kind WHEN 'S02MSIL1A' THEN 'external-l0-public' WHEN 'S02MSIL0_' THEN 'our-l0-canonical' ELSE 'external-l1a' END AS kind, substr(name, 11, 8) AS grp, o_orderkey % 1000 = 7 AS bare, CAST(substr(name, 33, 3) AS INT) AS name_orbit, orbit FROM pn LEFT JOIN id ON event_id = o_orderkey)"""
_RUL1 = "SELECT 'orbit-name-stac-mismatch' AS id, 'HIGH' AS severity, path || ': name R' || name_orbit || ' vs STAC R' || orbit AS evidence FROM rec WHERE name_orbit <> orbit"
_RUL2 = "SELECT DISTINCT 'pdi-stac-missing' AS id, 'HIGH' AS severity, 'the main input has no readable attributes' AS evidence FROM rec WHERE kind = 'external-l1a' AND bare"
_RUL3 = "SELECT 'public-l0-different-datatake' AS id, 'CRITICAL' AS severity, path || ' groups as ' || grp AS evidence FROM rec WHERE kind = 'external-l0-public' AND grp NOT IN (SELECT grp FROM rec WHERE kind LIKE 'our-l0%') AND EXISTS (SELECT 1 FROM rec WHERE kind LIKE 'our-l0%')"


def _rule(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    none = spark.createDataFrame([], "path string, text string")
    return stores.findings(records(spark, sf_dir) if rows is None else rows, none, setting_given=True).where(F.col("id") == name)


@query("rul_01_orbit_mismatch", sql(NAMES, ATTRS, _REC, _RUL1))
def rul_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "orbit-name-stac-mismatch")


@query("rul_02_input_without_attributes", sql(NAMES, ATTRS, _REC, _RUL2))
def rul_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "pdi-stac-missing")


@query("rul_03_foreign_acquisition", sql(NAMES, ATTRS, _REC, _RUL3))
def rul_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "public-l0-different-datatake")


def _with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    other = F.col("kind") == "external-l1a"
    return r.withColumns({"kind": F.when(other, "external-l0p-annotation").otherwise(F.col("kind")), "identity_source": F.when(other, "none").otherwise(F.col("identity_source"))})


@query("rul_04_annotations_without_metadata", sql(NAMES, "SELECT DISTINCT 'l0p-annotations-no-stac' AS id, 'LOW' AS severity, 'annotation products have no properties' AS evidence FROM pn WHERE kind = 'S02MSIL1B'"))
def rul_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "l0p-annotations-no-stac", _with_annotations(spark, sf_dir))


@query("rul_05_setting_unset", sql(NAMES, "SELECT DISTINCT 'radiometric-vv-gipp-skipped' AS id, 'MEDIUM' AS severity, 'the payload exists but its setting is unset' AS evidence FROM pn"))
def rul_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("path", F.lit(".publish-stage/gipp.zip"))
    none = spark.createDataFrame([], "path string, text string")
    return stores.findings(r, none, setting_given=False).where("id = 'radiometric-vv-gipp-skipped'")


@query("rul_06_group_overcount", sql(LISTING, "SELECT DISTINCT 'l0-decode-empty-group-count' AS id, 'INFO' AS severity, 'a report counts four groups' AS evidence FROM listing WHERE page_id % 9 = 4"))
def rul_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = listing(spark, sf_dir).select(F.lit("report/l0_decode.json").alias("path"), F.to_json(F.struct((F.col("page_id") % 9).alias("groups"))).alias("text"))
    return stores.findings(records(spark, sf_dir), reports, setting_given=True).where("id = 'l0-decode-empty-group-count'")


@query("rul_07_nothing_found", sql(NAMES, "SELECT DISTINCT 'inventory-no-blockers' AS id, 'INFO' AS severity, 'no inconsistency was found' AS evidence FROM pn"))
def rul_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = records(spark, sf_dir).where("kind = 'our-l0-canonical' AND (orbit IS NULL OR orbit = name_orbit)")
    return stores.findings(clean, spark.createDataFrame([], "path string, text string"), setting_given=True)


@query("set_04_union_of_findings", sql(NAMES, ATTRS, _REC, f"{_RUL1} UNION ALL {_RUL2} UNION ALL {_RUL3}"))
def set_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.findings(records(spark, sf_dir), spark.createDataFrame([], "path string, text string"), setting_given=True)
