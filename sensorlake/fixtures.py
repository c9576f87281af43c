"""The driver tables seen as sensor tables: as DataFrames, and as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64
BANDS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, line and the samples of the line. Lines are numbered before anything is exploded."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("band"), (F.row_number().over(w) - 1).alias("line"), "embedding")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detector, band, line, col, dn: long pixel form with clipped values and trailing zero lines in every third band."""
    x = frame_lines(spark, sf_dir).select("band", "line", F.posexplode("embedding").alias("col", "v"))
    value = F.greatest(F.least(F.rint(F.lit(2048.0) + F.lit(8000.0) * F.col("v").cast("double")), F.lit(4095.0)), F.lit(0.0))
    dn = F.when((F.col("band") % 3 == 0) & (F.col("line") >= 44), F.lit(0.0)).otherwise(value)
    return x.select(F.lit(5).alias("detector"), "band", "line", "col", dn.cast("int").alias("dn"))


FRAME = """
fl AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS line, embedding FROM embeddings),
fx AS (SELECT label, line, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM fl),
frame AS (SELECT 5 AS detector, label AS band, line, col,
  CAST(CASE WHEN label % 3 = 0 AND line >= 44 THEN 0 ELSE greatest(least(round_even(2048.0::DOUBLE + 8000.0::DOUBLE * v, 0), 4095), 0) END AS INT) AS dn FROM fx)"""


def coefficients(spark: SparkSession, width: int = WIDTH) -> DataFrame:
    """eq_coef: one wide row for each column of a band; cubic below band 7, bilinear from there on."""
    g = spark.range(BANDS * width).select((F.col("id") / width).cast("int").alias("band"), (F.col("id") % width).cast("int").alias("col"))
    c = F.lit(0.97) + ((F.col("col") * 13 + F.col("band") * 5) % 61).cast("double") / 1000
    g = g.select("band", "col", (F.lit(440.0) + ((F.col("col") * 7 + F.col("band") * 3) % 40).cast("double") / 10).alias("dark"), c.alias("c"))
    return g.select("band", "col", "dark", F.lit(1e-8).alias("a"), F.lit(-3e-5).alias("b"), "c", F.col("c").alias("a1"), (F.col("c") + 0.01).alias("a2"), F.lit(600.0).alias("zs"), F.when(F.col("band") < 7, "CUBIC").otherwise("BILINEAR").alias("model"))


def coef_sql(width: int = WIDTH, name: str = "coef") -> str:
    return f"""
{name}_g AS (SELECT CAST(b AS INT) AS band, CAST(k AS INT) AS col FROM range({BANDS}) x(b), range({width}) y(k)),
{name}_h AS (SELECT band, col, 440.0::DOUBLE + CAST((col * 7 + band * 3) % 40 AS DOUBLE) / 10 AS dark, 0.97::DOUBLE + CAST((col * 13 + band * 5) % 61 AS DOUBLE) / 1000 AS c FROM {name}_g),
{name} AS (SELECT band, col, dark, 1e-8::DOUBLE AS a, -3e-5::DOUBLE AS b, c, c AS a1, c + 0.01::DOUBLE AS a2, 600.0::DOUBLE AS zs,
  CASE WHEN band < 7 THEN 'CUBIC' ELSE 'BILINEAR' END AS model FROM {name}_h)"""


COEF = coef_sql()


def acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind (dark, flat), band, col, line, dn."""
    dark = F.col("l_linestatus") == "O"
    k = F.col("l_partkey") % 64
    dn = F.when(dark, 440 + k % 7 + F.col("l_quantity").cast("double") % 5).otherwise(1800 + 10 * (k % 11) + F.floor(F.col("l_extendedprice").cast("double")) % 97)
    return table(spark, sf_dir, "lineitem").select(F.when(dark, "dark").otherwise("flat").alias("kind"), (F.col("l_linenumber") - 1).cast("int").alias("band"), k.cast("int").alias("col"), F.col("l_orderkey").alias("line"), dn.cast("int").alias("dn"))


ACQ = """
acq AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'dark' ELSE 'flat' END AS kind, CAST(l_linenumber - 1 AS INT) AS band, CAST(l_partkey % 64 AS INT) AS col, l_orderkey AS line,
  CAST(trunc(CASE WHEN l_linestatus = 'O' THEN 440 + (l_partkey % 64) % 7 + CAST(l_quantity AS DOUBLE) % 5
            ELSE 1800 + 10 * ((l_partkey % 64) % 11) + floor(CAST(l_extendedprice AS DOUBLE)) % 97 END) AS INT) AS dn FROM lineitem)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apid, seq_count, pos, data_len, ts: counters wrap, and packets of errors are missing."""
    w = Window.partitionBy(F.col("user_id") % 16).orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select((1024 + F.col("user_id") % 16).cast("int").alias("apid"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "value", F.row_number().over(w).alias("pos"))
    return p.where("event_type <> 'error'").select("apid", ((16380 + F.col("pos")) % 16384).cast("int").alias("seq_count"), "pos", (7 + F.floor("value")).cast("int").alias("data_len"), "ts")


PACKET = """
pk AS (SELECT CAST(1024 + user_id % 16 AS INT) AS apid, event_type, ts, value, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS INT) AS pos FROM events),
packet AS (SELECT apid, CAST((16380 + pos) % 16384 AS INT) AS seq_count, pos, CAST(7 + floor(value) AS INT) AS data_len, ts FROM pk WHERE event_type <> 'error')"""


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_orderdate, name, and the fields that the name was made of."""
    o = table(spark, sf_dir, "orders")
    kind = F.concat(F.lit("S02MSI"), F.when(F.col("o_orderstatus") == "F", "L1A").when(F.col("o_orderstatus") == "O", "L1B").otherwise("L0_"))
    name = F.concat(kind, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.lpad((1 + F.col("o_orderkey") % 9999).cast("string"), 4, "0"), F.lit("_"), F.expr("substr('ABC', cast(1 + o_orderkey % 3 as int), 1)"), F.lpad((1 + F.col("o_custkey") % 143).cast("string"), 3, "0"), F.lit("_T"), F.upper(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 3)), F.lit(".zarr"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", kind.alias("kind"), name.alias("name"))


NAMES = """
pn AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, 'S02MSI' || CASE o_orderstatus WHEN 'F' THEN 'L1A' WHEN 'O' THEN 'L1B' ELSE 'L0_' END AS kind,
 'S02MSI' || CASE o_orderstatus WHEN 'F' THEN 'L1A' WHEN 'O' THEN 'L1B' ELSE 'L0_' END || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_'
 || lpad(CAST(1 + o_orderkey % 9999 AS VARCHAR), 4, '0') || '_' || substr('ABC', CAST(1 + o_orderkey % 3 AS INT), 1) || lpad(CAST(1 + o_custkey % 143 AS VARCHAR), 3, '0')
 || '_T' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3)) || '.zarr' AS name FROM orders)"""


def coefficient_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adf_id, type, start."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("adf_id"), F.col("p_brand").alias("type"), F.expr("date_add(DATE '1995-01-01', cast(p_partkey % 2400 as int))").alias("start"))


ADF = "adf AS (SELECT p_partkey AS adf_id, p_brand AS type, DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT) AS start FROM part)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, size, etag, and the content's checksum; every 17th etag is wrong."""
    etag = F.when(F.col("page_id") % 17 == 0, "bad").otherwise(F.md5("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("key"), F.length("html").cast("long").alias("size"), etag.alias("etag"), F.md5("html").alias("content_md5"))


LISTING = "listing AS (SELECT page_id, url AS key, length(html) AS size, CASE WHEN page_id % 17 = 0 THEN 'bad' ELSE md5(html) END AS etag, md5(html) AS content_md5 FROM pages)"


def attributes(spark: SparkSession, sf_dir: str, absolute: Column | None = None) -> DataFrame:
    """event_id, attrs: metadata documents, some doubly nested, with absent, null and malformed orbits. Data takes have six digits of the absolute orbit
    given, or else of the event's id: the first six, as in ATTRS."""
    orbit = F.when(F.col("event_id") % 11 == 0, F.lit('"/x/ORBIT"')).when(F.col("event_id") % 13 == 0, F.lit("null")).otherwise((1 + F.col("event_id") % 143).cast("string"))
    unit: Column = F.expr("substr('ABC', cast(1 + event_id % 3 as int), 1)")
    props = F.concat(F.lit('{"properties":{"sat:relative_orbit":'), orbit, F.lit(',"platform":"Sentinel-2'), unit, F.lit('","eopf:data_take_id":"GS2A_20230216T150621_'), F.lpad((F.col("event_id") if absolute is None else absolute).cast("string"), 6, "0"), F.lit('_N04.00"}}'))
    inner = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"stac_discovery":'), props, F.lit("}"))).otherwise(props)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"stac_discovery":'), inner, F.lit("}")).alias("attrs"))


ATTRS = """
ap AS (SELECT event_id, '{"properties":{"sat:relative_orbit":' || CASE WHEN event_id % 11 = 0 THEN '"/x/ORBIT"' WHEN event_id % 13 = 0 THEN 'null' ELSE CAST(1 + event_id % 143 AS VARCHAR) END
 || ',"platform":"Sentinel-2' || substr('ABC', CAST(1 + event_id % 3 AS INT), 1) || '","eopf:data_take_id":"GS2A_20230216T150621_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '_N04.00"}}' AS props FROM events),
attrs AS (SELECT event_id, '{"stac_discovery":' || CASE WHEN event_id % 7 = 0 THEN '{"stac_discovery":' || props || '}' ELSE props END || '}' AS attrs FROM ap)"""


def sql(*parts: str) -> str:
    """WITH the given expressions, all but the last part, SELECT the last."""
    return ("WITH " + ", ".join(parts[:-1]) if len(parts) > 1 else "") + " " + parts[-1]
