"""Queries on real files: each writes its files under the shared folder and reads them back (SRC-04..12, SRC-17, SRC-18, SRC-20, JOIN-16, AGG-17, SCA-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.fixtures import PACKET, packets, sql, table
from sensorlake.functions.packets import pack_header
from sensorlake.functions.times import cuc, cuc_seconds
from sensorlake.operators import sequence, stores
from sensorlake.plans.registry import query
from sensorlake.plans.sources import paths
from sensorlake.sources import documents as D
from sensorlake.sources import files as X
from sensorlake.sources.telemetry import packet_files, tar_of, zip_of

# Equalization documents: a document holds twelve detectors, vectors give the number lists; every seventh document is cut off.


def _joined(a: int, n: int = 8) -> Column:
    return F.array_join(F.transform(F.slice("embedding", a, n), lambda v: F.rint(v.cast("double") * 1000).cast("long").cast("string")), " ")


def _element(form: str, name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"' if form == "json" else f"<{name}>"), text, F.lit('"' if form == "json" else f"</{name}>"))


def _around(form: str, name: str, inner: Column) -> Column:
    return F.concat(F.lit(f'"{name}":{{' if form == "json" else f"<{name}>"), inner, F.lit("}" if form == "json" else f"</{name}>"))


def _between(form: str, *parts: Column) -> Column:
    return F.concat_ws("," if form == "json" else "", *parts)


def _listed(nodes: Column) -> Column:
    """JSON nodes as the tools write them: a list, or one object alone."""
    return F.when(F.size(nodes) == 1, F.element_at(nodes, 1)).otherwise(F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]")))


def equalization_documents(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    doc, detector = F.floor(F.col("vec_id") / 12), (F.col("vec_id") % 12 + 1).cast("string")
    dark = F.when(doc % 3 == 0, _between(form, _element(form, "LINE_1", _joined(25)), _element(form, "LINE_2", _joined(33))))
    wrapped = F.coalesce(_around(form, "COEFF_D", _around(form, "A_10M_BAND", dark)), _around(form, "COEFF_D", _element(form, "A_10M_BAND", _joined(25))))
    cubic = _around(form, "CUBIC", _between(form, *[_element(form, f"COEFF_{x}", _joined(8 * i + 1)) for i, x in enumerate("ABC")], wrapped))
    bilinear = _around(form, "BI-LINEAR", _between(form, *[_element(form, f"COEFF_{x}", _joined(8 * i + 1)) for i, x in enumerate(("A1", "A2", "Zs"))], wrapped))
    ground = _around(form, "GROUND_EQUALIZATION", F.when(doc % 2 == 0, cubic).otherwise(bilinear))
    if form == "json":
        node = F.concat(F.lit("{"), F.when(doc % 4 < 2, '"@detector_id":"').otherwise('"detector_id":"'), detector, F.lit('",'), ground, F.lit("}"))
    else:
        node = F.concat(F.lit('<COEFFICIENTS detector_id="'), detector, F.lit('">'), ground, F.lit("</COEFFICIENTS>"))
    x = table(spark, sf_dir, "embeddings").select(doc.alias("doc"), node.alias("node")).groupBy("doc").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    tdi = F.when(F.col("doc") % 5 == 0, "APPLIED").otherwise("NO_TDI")
    if form == "json":
        text = F.concat(F.lit('{"ADF_REQOG":{"DATA":{"COEFFICIENTS_LIST":{"@tdi_config":"'), tdi, F.lit('","COEFFICIENTS":'), _listed(F.col("nodes")), F.lit("}}}}"))
        path = F.concat(F.lit("B03/S2A_ADF_REQOG_"), F.col("doc").cast("string"), F.lit(".json"))
    else:
        text = F.concat(F.lit('<?xml version="1.0"?><GIPP><DATA><COEFFICIENTS_LIST tdi_config="'), tdi, F.lit('">'), F.array_join("nodes", ""), F.lit("</COEFFICIENTS_LIST></DATA></GIPP>"))
        path = F.concat(F.lit("S2A_OPER_GIP_R2EQOG_"), F.col("doc").cast("string"), F.lit("_B03.xml"))
    return x.select(path.alias("path"), F.when(F.col("doc") % 7 == 3, F.substring(text, 1, 60)).otherwise(text).alias("content"))


def _documents(spark: SparkSession, made: DataFrame, name: str, glob: str) -> DataFrame:
    """The documents as files, read back: doc (the number in the file's name), text."""
    folder = X.folder_of(spark, name)
    X.store_files(made, folder)
    return X.read_texts(spark, folder, glob).select(F.regexp_extract("path", r"_(\d+)[._]", 1).cast("long").alias("doc"), "text")


_E = "round_even(CAST(embedding[i + {}] AS DOUBLE) * 1000, 0) + 0"
_EQ_SQL = f"""SELECT doc, doc % 5 = 0 AS tdi, detector, CASE WHEN doc % 2 = 0 THEN 'CUBIC' ELSE 'BILINEAR' END AS model, CAST(i AS INT) AS col,
  CASE WHEN doc % 2 = 0 THEN {_E.format(1)} END AS a, CASE WHEN doc % 2 = 0 THEN {_E.format(9)} END AS b, CASE WHEN doc % 2 = 0 THEN {_E.format(17)} END AS c,
  CASE WHEN doc % 2 = 1 THEN {_E.format(1)} END AS a1, CASE WHEN doc % 2 = 1 THEN {_E.format(9)} END AS a2, CASE WHEN doc % 2 = 1 THEN {_E.format(17)} END AS zs,
  CASE WHEN doc % 3 = 0 THEN ({_E.format(25)} + {_E.format(33)}) / 2 ELSE {_E.format(25)} END AS dark
FROM (SELECT vec_id // 12 AS doc, CAST(vec_id % 12 + 1 AS INT) AS detector, embedding FROM embeddings), range(8) r(i) WHERE doc % 7 <> 3"""


@query("src_04_json_files", _EQ_SQL)
def src_04_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.equalization(_documents(spark, equalization_documents(spark, sf_dir, "json"), "eq-json", "*_ADF_REQOG_*.json"), ["doc"], "text", "json")


@query("src_05_xml_files", _EQ_SQL)
def src_05_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.equalization(_documents(spark, equalization_documents(spark, sf_dir, "xml"), "eq-xml", "*GIP_R2EQOG_*_B03.xml"), ["doc"], "text", "xml")


@query("src_04_broken_documents", "SELECT DISTINCT vec_id // 12 AS doc, form, (vec_id // 12) % 7 = 3 AS broken FROM embeddings, (VALUES ('json'), ('xml')) f(form)")
def src_04_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_documents(spark, equalization_documents(spark, sf_dir, form), f"eq-{form}", f"*.{form}").select("doc", F.lit(form).alias("form"), D.broken(None, "text", form).alias("broken")) for form in ("json", "xml")]
    return parts[0].unionByName(parts[1])


# Column documents: a document holds the thirteen bands, a part gives the columns of a band.


def column_documents(spark: SparkSession, sf_dir: str, form: str, kind: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *x: F.concat_ws(" ", *[v.cast("string") for v in x])
    one, two = text(k % 50, k % 20, k % 50), text(k % 30)
    if kind == "defective":
        if form == "json":
            at = lambda d, v: F.concat(F.lit(f'{{"@detector_id":"{d}","COLUMNS":'), v, F.lit("}"))
            node = F.concat(F.lit('"SINGULARITY_LIST":{"SINGULARITY":{"POSITION":['), at(7, F.concat(F.lit('"'), one, F.lit('"'))), F.lit(","), at(8, F.concat(F.lit('{"#text":"'), two, F.lit('"}'))), F.lit("]}}"))
        else:
            at = lambda d, v: F.concat(F.lit(f'<POSITION detector_id="{d}"><COLUMNS>'), v, F.lit("</COLUMNS></POSITION>"))
            node = F.concat(F.lit("<SINGULARITY_LIST><SINGULARITY>"), at(7, one), at(8, two), F.lit("</SINGULARITY></SINGULARITY_LIST>"))
    else:
        both = _between(form, _element(form, "VALID_BLIND_PIXELS", one), _element(form, "NON_VALID_BLIND_PIXELS", two))
        more = _element(form, "VALID_BLIND_PIXELS", text(k % 11 + 60))
        if form == "json":
            node = F.concat(F.lit('"DETECTOR":{"detector_id":"7","SIDE":[{'), both, F.lit("},{"), more, F.lit("}]}"))
        else:
            node = F.concat(F.lit('<DETECTOR detector_id="7"><SIDE>'), both, F.lit("</SIDE><SIDE>"), more, F.lit("</SIDE></DETECTOR>"))
    doc, band = F.floor(k / 13), (k % 13).cast("string")
    element = F.concat(F.lit('{"@band_id":"'), band, F.lit('",'), node, F.lit("}")) if form == "json" else F.concat(F.lit('<BAND band_id="'), band, F.lit('">'), node, F.lit("</BAND>"))
    x = table(spark, sf_dir, "part").select(doc.alias("doc"), element.alias("node")).groupBy("doc").agg(F.collect_list("node").alias("nodes"))
    content = F.concat(F.lit('{"ADF":{"DATA":{"BAND":'), _listed(F.col("nodes")), F.lit("}}}")) if form == "json" else F.concat(F.lit("<GIPP><DATA>"), F.array_join("nodes", ""), F.lit("</DATA></GIPP>"))
    return x.select(F.concat(F.lit("B00/S2A_" if form == "json" else "S2A_OPER_GIP_"), F.lit(kind), F.lit("_"), F.col("doc").cast("string"), F.lit(f".{form}")).alias("path"), content.alias("content"))


_DEFECTIVE_SQL = "SELECT DISTINCT p_partkey // 13 AS doc, CAST(p_partkey % 13 AS INT) AS band, d AS detector, CAST(c AS INT) AS col FROM (SELECT part.p_partkey, 7 AS d, unnest([p_partkey % 50, p_partkey % 20]) AS c FROM part UNION ALL SELECT part.p_partkey, 8, p_partkey % 30 FROM part)"
_BLIND_SQL = "SELECT DISTINCT p_partkey // 13 AS doc, CAST(p_partkey % 13 AS INT) AS band, 7 AS detector, CAST(c AS INT) AS col FROM (SELECT part.p_partkey, unnest([p_partkey % 50, p_partkey % 20, p_partkey % 30, p_partkey % 11 + 60]) AS c FROM part)"


def _add_columns(name: str, form: str, kind: str, answer: str) -> None:
    @query(name, answer)
    def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _documents(spark, column_documents(spark, sf_dir, form, kind), f"{kind}-{form}", f"*_{kind}_*.{form}")
        return (D.defective_columns if kind == "defective" else D.blind_columns)(docs, ["doc"], "text", form)


for _n, _kind, _answer in ((7, "defective", _DEFECTIVE_SQL), (8, "blind", _BLIND_SQL)):
    for _form in ("json", "xml"):
        _add_columns(f"src_{_n:02}_{_kind}_{_form}_files", _form, _kind, _answer)


def parameter_documents(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    k = F.col("p_partkey")
    band = (k % 13).cast("string")
    if form == "json":
        offset = lambda v: F.concat(F.lit('{"@band_id":"'), band, F.lit('","#text":"'), v.cast("string"), F.lit('"}'))
        flag = lambda name, v: F.concat(F.lit(f',"{name}":"'), v, F.lit('"'))
        begin, end = F.concat(F.lit('{"BAND_ID":"'), band, F.lit('"')), F.lit("}")
    else:
        offset = lambda v: F.concat(F.lit('<RADIO_ADD_OFFSET band_id="'), band, F.lit('">'), v.cast("string"), F.lit("</RADIO_ADD_OFFSET>"))
        flag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
        begin, end = F.concat(F.lit('<BAND_EQUALIZATION band_id="'), band, F.lit('">')), F.lit("</BAND_EQUALIZATION>")
    none = F.lit("")
    flags = F.concat(begin, F.when(k % 2 == 1, flag("EQUALIZATION_FLAG", F.lit("false"))).otherwise(none), flag("OFFSET", F.lit("True")), F.when(k % 3 == 0, flag("DARK_SIGNAL_NON_UNIFORMITY", F.lit("FALSE"))).otherwise(none), end)
    x = table(spark, sf_dir, "part").select(F.floor(k / 13).alias("doc"), F.when(k % 5 > 0, offset(-100 - k % 3)).alias("l1b"), offset(F.concat((-1000 - F.col("p_size")).cast("string"), F.lit(".0"))).alias("l1c"), flags.alias("f"))
    x = x.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("l1b", "l1c", "f")])
    if form == "json":
        part = lambda name, c: F.concat(F.lit(f'"{name}":{{"RADIO_ADD_OFFSET":'), _listed(F.col(c)), F.lit("}"))
        text = F.concat(F.lit('{"ADF_RPARA":{"DATA":{"RADIOMETRIC_SHIFT":{'), part("RADIANCE_OFFSET_L1B", "l1b"), F.lit(","), part("REFLECTANCE_OFFSET_L1C", "l1c"), F.lit('},"NOMINAL_SCENARIO":{"EQUALIZATION":{"BAND_EQUALIZATION":'), _listed(F.col("f")), F.lit("}}}}}"))
    else:
        part = lambda name, c: F.concat(F.lit(f"<{name}>"), F.array_join(c, ""), F.lit(f"</{name}>"))
        text = F.concat(F.lit("<GIPP><DATA><RADIOMETRIC_SHIFT>"), part("RADIANCE_OFFSET_L1B", "l1b"), part("REFLECTANCE_OFFSET_L1C", "l1c"), F.lit("</RADIOMETRIC_SHIFT><NOMINAL_SCENARIO><EQUALIZATION>"), F.array_join("f", ""), F.lit("</EQUALIZATION></NOMINAL_SCENARIO></DATA></GIPP>"))
    return x.select(F.concat(F.lit("B00/S2A_ADF_RPARA_"), F.col("doc").cast("string"), F.lit(f".{form}")).alias("path"), text.alias("content"))


_PARAMETERS_SQL = "SELECT p_partkey // 13 AS doc, CAST(p_partkey % 13 AS INT) AS band, CAST(CASE WHEN p_partkey % 5 > 0 THEN -100 - p_partkey % 3 END AS INT) AS offset_l1b, CAST(-1000 - p_size AS INT) AS offset_l1c, p_partkey % 2 = 0 AS equalization, true AS \"offset\", p_partkey % 3 > 0 AS dsnu FROM part"


@query("src_09_json_files", _PARAMETERS_SQL)
def src_09_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.radiometric_parameters(_documents(spark, parameter_documents(spark, sf_dir, "json"), "parameters", "*.json"), ["doc"], "text", "json")


@query("src_09_xml_files", _PARAMETERS_SQL)
def src_09_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.radiometric_parameters(_documents(spark, parameter_documents(spark, sf_dir, "xml"), "parameters", "*.xml"), ["doc"], "text", "xml")


# Array documents.


def _rounded() -> Column:
    return F.transform("embedding", lambda v: F.rint(v.cast("double") * 1000) + 0.0)


@query("src_06_sub_lines", "SELECT vec_id, CAST(i // 32 + 1 AS INT) AS detector, CAST(CASE WHEN vec_id % 2 = 0 THEN i % 32 // 16 ELSE 0 END AS INT) AS line, CAST(CASE WHEN vec_id % 2 = 0 THEN i % 16 ELSE i % 32 END AS INT) AS col, round_even(CAST(embedding[i + 1] AS DOUBLE) * 1000, 0) + 0 AS value FROM embeddings, range(64) r(i)")
def src_06_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with a sub-line axis and without one; nothing is averaged."""
    e = _rounded()
    deep = F.to_json(F.array(*[F.array(F.slice(e, 32 * d + 1, 16), F.slice(e, 32 * d + 17, 16)) for d in range(2)]))
    flat = F.to_json(F.array(*[F.slice(e, 32 * d + 1, 32) for d in range(2)]))
    text = F.concat(F.lit('{"data_vars":{"b03/coeff_d":{"data":'), F.when(F.col("vec_id") % 2 == 0, deep).otherwise(flat), F.lit("}}}"))
    return D.array_variable(table(spark, sf_dir, "embeddings").select("vec_id", text.alias("text")), ["vec_id"], "text", "b03/coeff_d")


@query("src_11_swir_files", "SELECT vec_id // 36 AS doc, 'B' || (10 + vec_id % 36 // 12) AS band, CAST(vec_id % 12 + 1 AS INT) AS detector, CAST(i AS INT) AS col, CAST(greatest(least(round_even(CAST(embedding[i + 1] AS DOUBLE) * 8, 0), 1), -1) AS INT) AS shift, CASE WHEN vec_id % 36 // 12 = 0 THEN 'interp' ELSE 'shift' END AS method, 0.25::DOUBLE AS k0, 0.5::DOUBLE AS k1, CAST(vec_id // 36 AS DOUBLE) AS k2 FROM embeddings, range(64) r(i)")
def src_11_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift flags of three bands and twelve detectors, and the three taps, from one document a file."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 36).alias("doc"), F.floor(F.col("vec_id") % 36 / 12).alias("plane"), (F.col("vec_id") % 12).alias("row"), F.transform("embedding", lambda v: F.greatest(F.least(F.rint(v.cast("double") * 8), F.lit(1.0)), F.lit(-1.0))).alias("v"))
    inner = lambda c, k: F.transform(F.array_sort(F.collect_list(F.struct(k, c))), lambda x: x[c])
    docs = e.groupBy("doc", "plane").agg(inner("v", "row").alias("p")).groupBy("doc").agg(F.to_json(inner("p", "plane")).alias("cube"))
    text = F.concat(F.lit('{"data_vars":{"swir_band_list/swir_band/detector":{"data":'), "cube", F.lit('},"interpolation_filter/coefs":{"data":[0.25,0.5,'), F.col("doc").cast("string"), F.lit("]}}}"))
    made = docs.select(F.concat(F.lit("adf/S2B_ADF_RSWIR_"), F.col("doc").cast("string"), F.lit(".json")).alias("path"), text.alias("content"))
    x = D.swir_shifts(_documents(spark, made, "swir", "*_RSWIR_*.json"), ["doc"], "text")
    return x.select("doc", "band", "detector", "col", "shift", "method", *[F.col("kernel")[k].alias(f"k{k}") for k in range(3)])


@query("src_12_onboard_files", "SELECT vec_id // 12 AS doc, CAST(vec_id % 12 + 1 AS INT) AS detector, CAST(i AS INT) AS col, " + ", ".join(f"round_even(CAST(embedding[i + {16 * k + 1}] AS DOUBLE) * 1000, 0) + 0 AS {n}" for k, n in enumerate(("a1", "a2", "zs", "d"))) + " FROM embeddings, range(16) r(i)")
def src_12_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational one of two tables, all four coefficients."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("doc"), (F.col("vec_id") % 12).alias("row"), _rounded().alias("v"))
    of = lambda k: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: F.slice(x["v"], 16 * k + 1, 16)))
    docs = e.groupBy("doc").agg(*[of(k).alias(n) for k, n in enumerate(("a1", "a2", "zs", "d"))])
    entry = lambda t, n, c: F.concat(F.lit(f'"b11/{t}/coeff_{n}":{{"data":'), c, F.lit("}"))
    text = F.concat(F.lit('{"data_vars":{'), F.concat_ws(",", *[entry("old_table", n, F.lit("[[0]]")) for n in ("a1", "a2", "zs", "d")], *[entry("new_table", n, F.col(n)) for n in ("a1", "a2", "zs", "d")]), F.lit("}}"))
    made = docs.select(F.concat(F.lit("adf/S2B_ADF_REOB2_"), F.col("doc").cast("string"), F.lit(".json")).alias("path"), text.alias("content"))
    return D.onboard_table(_documents(spark, made, "onboard", "*_REOB2_*.json"), ["doc"], "text", "B11")


# Packet files: a tar archive an id, a member a hundred positions; every third member is cut off, every thirteenth is a file of its own.

_MEMBERS = """pf AS (SELECT apid, pos, pos // 100 AS part, seq_count, data_len % 40 + 6 AS n, pos * 1000003 % 4000000000 + (data_len % 97) / 128.0::DOUBLE AS t FROM packet),
po AS (SELECT *, CAST(sum(n + 6) OVER (PARTITION BY apid, part ORDER BY pos) - (n + 6) AS BIGINT) AS o, row_number() OVER (PARTITION BY apid, part ORDER BY pos DESC) AS back FROM pf),
pr AS (SELECT *, CASE WHEN part % 13 = 0 THEN 'm' || apid || '_' || part || '.bin' ELSE 'm' || part || '.bin' END AS member,
         CASE WHEN part % 13 = 0 THEN 'm' || apid || '_' || part || '.bin' ELSE 'id' || apid || '.tar' END AS path FROM po)"""


def packet_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("data_len") % 40 + 6
    seconds = (F.col("pos").cast("long") * 1000003 % 4000000000) + (F.col("data_len") % 97) / 128.0
    p = packets(spark, sf_dir).select("apid", "pos", F.floor(F.col("pos") / 100).alias("part"), F.concat(pack_header(F.col("apid"), F.lit(3), F.col("seq_count"), n), cuc(seconds), F.repeat(F.lit("00"), n - 6)).alias("b"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "")
    m = p.groupBy("apid", "part").agg(F.unhex(whole).alias("c")).withColumn("c", F.when(F.col("part") % 3 == 2, F.substring("c", F.lit(1), F.length("c") - 3)).otherwise(F.col("c")))
    number = lambda c: F.col(c).cast("string")
    alone = m.where("part % 13 = 0").select(F.concat(F.lit("m"), number("apid"), F.lit("_"), number("part"), F.lit(".bin")).alias("path"), F.col("c").alias("content"))
    member = F.struct(F.concat(F.lit("m"), number("part"), F.lit(".bin")).alias("name"), F.col("c").alias("content"))
    tars = m.where("part % 13 <> 0").groupBy("apid").agg(tar_of(F.collect_list(member)).alias("content")).select(F.concat(F.lit("id"), number("apid"), F.lit(".tar")).alias("path"), "content")
    return alone.unionByName(tars)


def packet_headers_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = X.folder_of(spark, "packets")
    X.store_files(packet_file_rows(spark, sf_dir), folder)
    return packet_files(X.read_files(spark, folder).select("path", "content"))


@query("src_20_packet_archives", sql(PACKET, _MEMBERS, "SELECT path, member, o AS \"offset\", apid, 3 AS seq_flags, seq_count, n AS data_len, round(t, 6) AS t FROM pr WHERE NOT (part % 3 = 2 AND back = 1)"))
def src_20_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorlake.functions.numbers import steady

    h = packet_headers_of_files(spark, sf_dir).where("offset IS NOT NULL")
    return h.select("path", "member", "offset", "apid", "seq_flags", "seq_count", "data_len", steady(cuc_seconds(F.col("cuc"))).alias("t"))


@query(
    "agg_17_member_profile",
    sql(PACKET, _MEMBERS, """sk AS (SELECT *, coalesce(seq_count <> (lag(seq_count) OVER (PARTITION BY apid, part ORDER BY pos) + 1) % 16384, false) AS gap, part % 3 = 2 AND back = 1 AS lost FROM pr)""",
        """SELECT path, member, CAST(max(o + n + 6) - CASE WHEN any_value(part) % 3 = 2 THEN 3 ELSE 0 END AS INT) AS bytes, count(*) FILTER (NOT lost) AS packets, coalesce(max(o + n + 6) FILTER (NOT lost), 0) AS coverage,
           any_value(part) % 3 <> 2 AS tiles_exactly, CASE WHEN any_value(part) % 3 = 2 THEN coalesce(max(o + n + 6) FILTER (NOT lost), 0) END AS broke_off_at, coalesce(NOT bool_or(gap) FILTER (NOT lost), true) AS continuous,
           CASE WHEN count(*) FILTER (NOT lost) > 0 THEN any_value(apid) || '=' || count(*) FILTER (NOT lost) ELSE '' END AS by_apid, CASE WHEN count(*) FILTER (NOT lost) > 0 THEN '3=' || count(*) FILTER (NOT lost) ELSE '' END AS by_flag,
           min(n) FILTER (NOT lost) AS shortest, max(n) FILTER (NOT lost) AS longest FROM sk GROUP BY path, member"""),
)
def agg_17_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.member_profile(packet_headers_of_files(spark, sf_dir), ["path", "member"], "bytes")


# Stores: pages as objects of a fetched folder and as files of a walked one; suppliers as products with attributes.

_FETCH = """ft AS (SELECT page_id, html, CASE page_id % 23 WHEN 1 THEN 'bucket/../' || page_id || '.html' WHEN 2 THEN 'bucket/' ELSE 'bucket/p' || page_id % 7 || '/' || page_id || '.html' END AS key,
  CAST(strlen(html) AS BIGINT) AS size, md5(html) || CASE WHEN page_id % 4 = 1 THEN '-2' ELSE '' END AS etag, page_id % 5 > 0 AND page_id % 23 NOT IN (1, 2) AS there,
  CASE WHEN page_id % 17 = 3 THEN html || '!' WHEN page_id % 17 = 5 THEN '~' || substr(html, 2) ELSE html END AS got FROM pages),
fe AS (SELECT *, CASE WHEN page_id % 23 = 2 THEN 'empty destination path' WHEN page_id % 23 = 1 THEN 'unsafe path (escapes destination)' WHEN NOT there THEN 'missing'
  WHEN strlen(got) <> size THEN 'received ' || strlen(got) || ' bytes, expected ' || size WHEN page_id % 4 <> 1 AND md5(got) <> etag THEN 'MD5 ' || md5(got) || ' != ETag ' || etag END AS error FROM ft)"""


def fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing of all pages, and the files of a fetch that lost some, cut some and spoiled some."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 23
    p = table(spark, sf_dir, "pages")
    inside = F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string"), F.lit("/"), i, F.lit(".html"))
    key = F.when(k == 1, F.concat(F.lit("bucket/../"), i, F.lit(".html"))).when(k == 2, "bucket/").otherwise(F.concat(F.lit("bucket/"), inside))
    listed = p.select("page_id", key.alias("key"), F.octet_length("html").cast("long").alias("size"), F.concat(F.md5("html"), F.when(F.col("page_id") % 4 == 1, "-2").otherwise("")).alias("etag"))
    got = F.when(F.col("page_id") % 17 == 3, F.concat("html", F.lit("!"))).when(F.col("page_id") % 17 == 5, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    folder = X.folder_of(spark, "fetched")
    X.store_files(p.where("page_id % 5 > 0 AND page_id % 23 NOT IN (1, 2)").select(inside.alias("path"), got.alias("content")), folder)
    return listed, X.read_files(spark, folder, "*.html")


@query("join_16_file_content", sql(_FETCH, "SELECT page_id, key, CASE WHEN error IS NULL THEN CASE WHEN page_id % 4 = 1 THEN 'size' ELSE 'md5' END END AS verify, error FROM fe"))
def join_16_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of each file against its listing, unsafe and empty places apart."""
    return stores.complete(*fetched(spark, sf_dir), "bucket/").select("page_id", "key", "verify", "error")


@query("join_16_resume", sql(_FETCH, "SELECT page_id, key, size, error FROM fe WHERE error IS NOT NULL AND page_id % 23 NOT IN (1, 2)"))
def join_16_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run has to fetch: whole files are skipped."""
    return stores.to_fetch(*fetched(spark, sf_dir), "bucket/").select("page_id", "key", "size", "error")


@query("src_17_walked_files", """WITH ph AS (SELECT page_id, html, CASE page_id % 8 WHEN 0 THEN 'l0/S02MSIL0__' || page_id || '.zarr' WHEN 1 THEN 'l0/S02MSIL0__' || page_id || '_OC.zarr' WHEN 2 THEN 'inputs/public-data/level-0/S02MSIL0__' || page_id || '.zarr' WHEN 3 THEN 'report/r' || page_id || '.json'
  WHEN 4 THEN 'caldb/S02MSIDCA' || page_id || '.zarr' WHEN 5 THEN 'caldb/c' || page_id || '.zarr.zip' WHEN 6 THEN 'inputs/real_l0/t' || page_id || '.tar' ELSE 'inputs/gipp/g' || page_id || '.json' END AS item FROM pages)
  SELECT item, CAST(strlen(html) AS BIGINT) AS bytes FROM ph""")  # fmt: skip
def src_17_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over real files reads their sizes only; caches and files of other kinds are left out."""
    p = table(spark, sf_dir, "pages").select("page_id", "html").join(paths(spark, sf_dir).select("page_id", "path"), "page_id")
    more = F.explode(F.array(F.struct(F.col("path").alias("p"), F.col("html").alias("c")), F.struct(F.concat(F.lit("l0/__pycache__/x"), F.col("page_id").cast("string"), F.lit(".json")).alias("p"), F.lit("{}").alias("c")), F.struct(F.concat(F.lit("notes/n"), F.col("page_id").cast("string"), F.lit(".txt")).alias("p"), F.lit("-").alias("c"))))
    folder = X.folder_of(spark, "walked")
    X.store_files(p.select(more.alias("f")).select(F.col("f.p").alias("path"), F.col("f.c").alias("content")), folder)
    return stores.items(X.walk(spark, folder), []).select("item", "bytes")


@query("src_18_attribute_files", """SELECT 'p/S' || s_suppkey || CASE WHEN s_suppkey % 5 = 4 THEN '.zarr.zip' ELSE '.zarr' END AS product, CASE s_suppkey % 5 WHEN 1 THEN '.zmetadata' ELSE '.zattrs' END AS source,
  CASE s_suppkey % 5 WHEN 3 THEN NULL WHEN 1 THEN s_suppkey + 1 ELSE s_suppkey END AS id FROM supplier""")
def src_18_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root attributes of folders and zip archives; one document of five is broken and counts as empty."""
    k, name = F.col("s_suppkey"), F.concat(F.lit("p/S"), F.col("s_suppkey").cast("string"))
    attrs, meta = F.concat(F.lit('{"id":'), k.cast("string"), F.lit("}")), F.concat(F.lit('{"metadata":{".zattrs":{"id":'), (k + 1).cast("string"), F.lit("}}}"))
    file = lambda end, text: F.struct(F.concat(name, F.lit(end)).alias("path"), text.cast("binary").alias("content"))
    member = lambda n, text: F.struct(F.lit(n).alias("name"), text.cast("binary").alias("content"))
    archive = zip_of(F.array(member("S/img/.zattrs", F.lit('{"id":-1}')), member("S/.zattrs", attrs), member("S/.zmetadata", meta)))
    files = F.when(k % 5 == 0, F.array(file(".zarr/.zattrs", attrs))).when(k % 5 == 1, F.array(file(".zarr/.zmetadata", meta))).when(k % 5 == 2, F.array(file(".zarr/.zattrs", attrs), file(".zarr/.zmetadata", meta)))
    files = files.when(k % 5 == 3, F.array(file(".zarr/.zattrs", F.lit('{"id":')))).otherwise(F.array(F.struct(F.concat(name, F.lit(".zarr.zip")).alias("path"), archive.alias("content"))))
    folder = X.folder_of(spark, "attributes")
    files = F.when(k % 5 < 4, F.array_append(files, file(".zarr/img/0", F.lit("pixels")))).otherwise(files)
    X.store_files(table(spark, sf_dir, "supplier").select(F.explode(files).alias("f")).select("f.*"), folder)
    products = stores.items(X.walk(spark, folder), []).where("item LIKE '%.zarr'").withColumnRenamed("item", "product")
    hidden = X.read_hidden(products, folder, [".zattrs", ".zmetadata"])
    found = stores.product_attributes(hidden.unionByName(X.read_files(spark, folder, "*.zip").select("path", "content")))
    return found.select("product", "source", F.get_json_object("attrs", "$.id").cast("long").alias("id"))


_TREE = """tr AS (SELECT event_id, '{"a":{"created":"' || event_id || '","list":[1,{"stop_date":' || event_id || '},3,4]},' || repeat('"n":{', CAST(event_id % 9 AS INT)) || '"version":' || event_id % 5 || ',"other":null' || repeat('}', CAST(event_id % 9 AS INT)) || '}' AS attrs FROM events)"""


@query("sca_24_date_like_keys", sql(_TREE, """SELECT event_id, 'a.created' AS path, CAST(event_id AS VARCHAR) AS value FROM tr UNION ALL SELECT event_id, 'a.list[1].stop_date', CAST(event_id AS VARCHAR) FROM tr
  UNION ALL SELECT event_id, repeat('n.', CAST(event_id % 9 AS INT)) || 'version', CAST(event_id % 5 AS VARCHAR) FROM tr"""))
def sca_24_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that name a date or a version anywhere in trees of up to ten levels, lists included."""
    i, depth = F.col("event_id").cast("string"), (F.col("event_id") % 9).cast("int")
    text = F.concat(F.lit('{"a":{"created":"'), i, F.lit('","list":[1,{"stop_date":'), i, F.lit('},3,4]},'), F.repeat(F.lit('"n":{'), depth), F.lit('"version":'), (F.col("event_id") % 5).cast("string"), F.lit(',"other":null'), F.repeat(F.lit("}"), depth), F.lit("}"))
    found = stores.leaves(table(spark, sf_dir, "events").select("event_id", text.alias("attrs")), ["event_id"], "attrs", list_items=3)
    return stores.date_like(found).select("event_id", "path", "value")
