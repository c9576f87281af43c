"""Coefficient documents (JSON, XML, arrays in JSON) as rows of one column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.names import number_list

_NODE = "struct<DETECTOR_ID:string,COEFF_A:string,COEFF_B:string,COEFF_C:string,COEFF_D:string>"
_XML_NODE = "STRUCT<_id: STRING, COEFF_A: STRING, COEFF_B: STRING, COEFF_C: STRING, COEFF_D: STRING>"


def _columns(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Number lists of a node side by side, one row a column; names in lower case."""
    zipped = nodes.select(*keys, F.col("detector").cast("int").alias("detector"), *[number_list(F.col(f"n.COEFF_{x}")).alias(x.lower()) for x in "ABCD"])
    return zipped.select(*keys, "detector", F.posexplode(F.arrays_zip("a", "b", "c", "d")).alias("col", "z")).select(*keys, "detector", "col", *[F.col(f"z.{x}").alias(x if x != "d" else "dark") for x in "abcd"])


def from_json_documents(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, detector, col, a, b, c, dark from {"COEFFICIENTS": [{"DETECTOR_ID", "COEFF_A": "1 2 3", ...}]}."""
    x = docs.select(*keys, F.explode(F.from_json(text, f"COEFFICIENTS array<{_NODE}>")["COEFFICIENTS"]).alias("n"))
    return _columns(x.withColumn("detector", F.col("n.DETECTOR_ID")), keys)


def from_xml_documents(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The same from <GIPP><COEFFICIENTS id="05"><COEFF_A>1 2 3</COEFF_A>...; attributes arrive with an underscore."""
    x = docs.select(*keys, F.explode(F.from_xml(F.col(text), f"COEFFICIENTS ARRAY<{_XML_NODE}>")["COEFFICIENTS"]).alias("n"))
    return _columns(x.withColumn("detector", F.col("n._id")), keys)


def from_array_json(docs: DataFrame, keys: list[str], text: str, variable: str) -> DataFrame:
    """keys, detector, col, value of one variable in {"data_vars": {name: {"data": [detector][column]}}}; sub-lines are averaged."""
    data = F.from_json(text, "data_vars map<string, struct<data: array<array<double>>>>")["data_vars"][variable]["data"]
    x = docs.select(*keys, F.posexplode(data).alias("detector", "_d")).select(*keys, "detector", F.posexplode("_d").alias("col", "value"))
    return x.groupBy(*keys, "detector", "col").agg(F.avg("value").alias("value"))


def columns_of(docs: DataFrame, keys: list[str], text: str, tags: list[str]) -> DataFrame:
    """keys, detector, col: distinct columns listed under the tags of {"DETECTORS": [{"ID", tag: "1 2 3"}]}; valid and not valid are united."""
    node = "struct<ID:string," + ",".join(f"{t}:string" for t in tags) + ">"
    x = docs.select(*keys, F.explode(F.from_json(text, f"DETECTORS array<{node}>")["DETECTORS"]).alias("n"))
    parts = F.array_distinct(F.flatten(F.array(*[F.coalesce(number_list(F.col(f"n.{t}")), F.array().cast("array<double>")) for t in tags])))
    return x.select(*keys, F.col("n.ID").cast("int").alias("detector"), F.explode(F.transform(parts, lambda x: x.cast("int"))).alias("col")).distinct()


def radiometric_parameters(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, band, offset_l1b, offset_l1c and three flags of which a missing one is true."""
    node = "struct<BAND_ID:int,OFFSET_L1B:double,OFFSET_L1C:double,DARK:string,RESPONSE:string,CROSSTALK:string>"
    x = docs.select(*keys, F.explode(F.from_json(text, f"BANDS array<{node}>")["BANDS"]).alias("n"))
    flag = lambda f: F.coalesce(F.lower(F.trim(F.col(f"n.{f}"))) == "true", F.lit(True)).alias(f.lower())
    return x.select(*keys, F.col("n.BAND_ID").alias("band"), F.col("n.OFFSET_L1B").alias("offset_l1b"), F.col("n.OFFSET_L1C").alias("offset_l1c"), flag("DARK"), flag("RESPONSE"), flag("CROSSTALK"))


def crosstalk_rows(docs: DataFrame, keys: list[str], optical: str, electrical: str) -> DataFrame:
    """keys, l, coef: two number lists added place by place."""
    x = docs.select(*keys, number_list(F.col(optical)).alias("o"), number_list(F.col(electrical)).alias("e"))
    return x.select(*keys, F.posexplode(F.zip_with("o", "e", lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))).alias("l", "coef"))


def psf_matrix(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, r, c, w of comma-separated matrices, one text a file."""
    rows = files.select(*keys, F.posexplode(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("r", "_row"))
    return rows.select(*keys, "r", F.posexplode(F.split("_row", ",")).alias("c", "_w")).select(*keys, "r", "c", F.col("_w").cast("double").alias("w"))


def register_bundle(tables: dict[str, DataFrame | None]) -> list[str]:
    """Register the tables that there are as temporary views of their names; absent ones are left out. Nothing is read before a query asks."""
    there = [name for name, df in tables.items() if df is not None]
    for name in there:
        tables[name].createOrReplaceTempView(name)
    return there
