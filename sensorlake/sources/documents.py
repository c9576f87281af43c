"""Instrument documents in their JSON and XML forms: equalization, defective and blind columns, radiometric parameters.

Both forms of a document give the same rows. In JSON an element may be one object or a list, an attribute has an @ or not, and a text may stand in
#text; in XML attributes arrive with an underscore. `broken` tells documents that cannot be read from those that hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.names import number_list


def _data(text: str) -> Column:
    """The DATA object of a JSON document, whatever its one root is called."""
    return F.get_json_object(F.element_at(F.map_values(F.from_json(text, "map<string,string>")), 1), "$.DATA")


def _listed(node: Column) -> Column:
    """An object or a list of them as the text of a list."""
    return F.when(F.ltrim(node).startswith("["), node).when(F.ltrim(node).startswith("{"), F.concat(F.lit("["), node, F.lit("]")))


def _many(node: Column, fields: str) -> Column:
    """An object or a list of them as an array; each field as text, attributes with and without @."""
    return F.from_json(_listed(node), "array<struct<" + ",".join(f"`{f}`:string" for f in fields.split()) + ">>")


def _attr(node: Column, name: str) -> Column:
    return F.coalesce(node[f"@{name}"], node[name])


def _text(value: Column) -> Column:
    """A text, or the #text of an object."""
    return F.coalesce(F.when(F.ltrim(value).startswith("{"), F.get_json_object(value, "$['#text']")), F.when(~F.ltrim(value).startswith("{"), value))


def broken(docs: DataFrame, text: str, form: str) -> Column:
    """Whether a document cannot be read at all."""
    if form == "json":
        return _data(text).isNull()
    return F.from_xml(F.col(text), "DATA STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["DATA"].isNull()


def _dark(raw: Column) -> Column:
    """COEFF_D in either form, still as text: along-track sub-lines are averaged place by place, otherwise its one list."""
    lines = F.concat(F.regexp_extract_all(raw, F.lit(r'"LINE[^"]*"\s*:\s*(?:\{\s*"#text"\s*:\s*)?"([^"]*)"'), F.lit(1)), F.regexp_extract_all(raw, F.lit(r"<LINE[^>]*>([^<]*)<"), F.lit(1)))
    lists = F.transform(lines, number_list)
    total = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.element_at(lists, 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    plain = number_list(F.regexp_replace(raw, r'<[^>]*>|"[^"]*"\s*:|[{}"]', " "))
    return F.when(F.size(lines) > 0, F.transform(total, lambda v: v / F.size(lines))).otherwise(plain)


_LISTS = ["COEFF_A", "COEFF_B", "COEFF_C", "COEFF_A1", "COEFF_A2", "COEFF_Zs"]


def _columns(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes: keys, tdi, detector, cubic and bilinear (structs of texts, one of them null). One row a column."""
    cubic = F.col("cubic").isNotNull()
    pick = lambda f: number_list(F.when(cubic, F.col(f"cubic.{f}")).otherwise(F.col(f"bilinear.{f}")))
    given = lambda x: F.coalesce(x, F.array().cast("array<double>"))  # noqa: E731  a list that the model lacks gives nulls
    lists = [given(pick(f)).alias(f.removeprefix("COEFF_").lower()) for f in _LISTS]
    dark = given(_dark(F.when(cubic, F.col("cubic.COEFF_D")).otherwise(F.col("bilinear.COEFF_D")))).alias("dark")
    x = nodes.select(*keys, "tdi", F.col("detector").cast("int").alias("detector"), F.when(cubic, "CUBIC").otherwise("BILINEAR").alias("model"), F.arrays_zip(dark, *lists).alias("z"))
    names = ["a", "b", "c", "a1", "a2", "zs", "dark"]
    return x.select(*keys, "tdi", "detector", "model", F.posexplode("z").alias("col", "z")).select(*keys, "tdi", "detector", "model", "col", *[F.col(f"z.{n}").alias(n) for n in names])


def equalization(docs: DataFrame, keys: list[str], text: str, form: str) -> DataFrame:
    """keys, tdi, detector, model, col, a, b, c (cubic) or a1, a2, zs (bilinear), dark."""
    if form == "json":
        docs = docs.select(*keys, F.get_json_object(_data(text), "$.COEFFICIENTS_LIST").alias("_list"))
        clist = F.col("_list")
        tdi = F.coalesce(F.get_json_object(clist, "$['@tdi_config']"), F.get_json_object(clist, "$.tdi_config"))
        x = docs.select(*keys, tdi.alias("tdi"), F.explode(_many(F.get_json_object(clist, "$.COEFFICIENTS"), "@detector_id detector_id GROUND_EQUALIZATION")).alias("n"))
        ground = lambda *names: F.from_json(F.coalesce(*[F.get_json_object("n.GROUND_EQUALIZATION", f"$['{n}']") for n in names]), "struct<" + ",".join(f"{f}:string" for f in [*_LISTS, "COEFF_D"]) + ">")
        x = x.select(*keys, "tdi", _attr(F.col("n"), "detector_id").alias("detector"), ground("CUBIC").alias("cubic"), ground("BI-LINEAR", "BI_LINEAR").alias("bilinear"))
        plain = lambda s: F.when(F.col(s).isNotNull(), F.struct(*[_text(F.col(f"{s}.{f}")).alias(f) for f in _LISTS], F.col(f"{s}.COEFF_D").alias("COEFF_D"))).alias(s)
        nodes = x.select(*keys, "tdi", "detector", plain("cubic"), plain("bilinear"))
    else:
        lists = "STRUCT<" + ", ".join(f"{f}: STRING" for f in [*_LISTS, "COEFF_D"]) + ">"
        schema = f"DATA STRUCT<COEFFICIENTS_LIST: STRUCT<_tdi_config: STRING, COEFFICIENTS: ARRAY<STRUCT<_detector_id: STRING, GROUND_EQUALIZATION: STRUCT<CUBIC: {lists}, `BI-LINEAR`: {lists}>>>>>"
        x = docs.select(*keys, F.from_xml(F.col(text), schema)["DATA"]["COEFFICIENTS_LIST"].alias("l"))
        x = x.select(*keys, F.col("l._tdi_config").alias("tdi"), F.explode("l.COEFFICIENTS").alias("n"))
        nodes = x.select(*keys, "tdi", F.col("n._detector_id").alias("detector"), F.col("n.GROUND_EQUALIZATION.CUBIC").alias("cubic"), F.col("n.GROUND_EQUALIZATION.`BI-LINEAR`").alias("bilinear"))
    return _columns(nodes.withColumn("tdi", F.upper(F.coalesce("tdi", F.lit("NO_TDI"))) == "APPLIED"), keys)


def _whole_numbers(text: Column) -> Column:
    return F.transform(number_list(text), lambda v: v.cast("int"))


def defective_columns(docs: DataFrame, keys: list[str], text: str, form: str) -> DataFrame:
    """keys, band, detector, col: distinct columns of all singularities."""
    if form == "json":
        x = docs.select(*keys, F.explode(_many(F.get_json_object(_data(text), "$.BAND"), "@band_id band_id SINGULARITY_LIST SINGULARITY")).alias("b"))
        own = F.coalesce(F.get_json_object("b.SINGULARITY_LIST", "$.SINGULARITY"), F.col("b.SINGULARITY"))
        x = x.select(*keys, _attr(F.col("b"), "band_id").alias("band"), F.explode(_many(own, "POSITION")).alias("s"))
        x = x.select(*keys, "band", F.explode(_many(F.col("s.POSITION"), "@detector_id detector_id COLUMNS")).alias("p"))
        x = x.select(*keys, "band", _attr(F.col("p"), "detector_id").alias("detector"), _text(F.col("p.COLUMNS")).alias("list"))
    else:
        positions = "ARRAY<STRUCT<POSITION: ARRAY<STRUCT<_detector_id: STRING, COLUMNS: STRING>>>>"
        x = docs.select(*keys, F.explode(F.from_xml(F.col(text), f"DATA STRUCT<BAND: ARRAY<STRUCT<_band_id: STRING, SINGULARITY_LIST: STRUCT<SINGULARITY: {positions}>, SINGULARITY: {positions}>>>")["DATA"]["BAND"]).alias("b"))
        x = x.select(*keys, F.col("b._band_id").alias("band"), F.explode(F.coalesce("b.SINGULARITY_LIST.SINGULARITY", "b.SINGULARITY")).alias("s")).select(*keys, "band", F.explode("s.POSITION").alias("p"))
        x = x.select(*keys, "band", F.col("p._detector_id").alias("detector"), F.col("p.COLUMNS").alias("list"))
    return _distinct(x, keys)


def blind_columns(docs: DataFrame, keys: list[str], text: str, form: str) -> DataFrame:
    """keys, band, detector, col: distinct columns, valid and not valid, of all sides."""
    if form == "json":
        x = docs.select(*keys, F.explode(_many(F.get_json_object(_data(text), "$.BAND"), "@band_id band_id DETECTOR")).alias("b"))
        x = x.select(*keys, _attr(F.col("b"), "band_id").alias("band"), F.explode(_many(F.col("b.DETECTOR"), "@detector_id detector_id SIDE")).alias("d"))
        x = x.select(*keys, "band", _attr(F.col("d"), "detector_id").alias("detector"), F.explode(_many(F.col("d.SIDE"), "VALID_BLIND_PIXELS NON_VALID_BLIND_PIXELS")).alias("s"))
        lists = [_text(F.col("s.VALID_BLIND_PIXELS")), _text(F.col("s.NON_VALID_BLIND_PIXELS"))]
    else:
        side = "ARRAY<STRUCT<VALID_BLIND_PIXELS: STRING, NON_VALID_BLIND_PIXELS: STRING>>"
        x = docs.select(*keys, F.explode(F.from_xml(F.col(text), f"DATA STRUCT<BAND: ARRAY<STRUCT<_band_id: STRING, DETECTOR: ARRAY<STRUCT<_detector_id: STRING, SIDE: {side}>>>>>")["DATA"]["BAND"]).alias("b"))
        x = x.select(*keys, F.col("b._band_id").alias("band"), F.explode("b.DETECTOR").alias("d")).select(*keys, "band", F.col("d._detector_id").alias("detector"), F.explode("d.SIDE").alias("s"))
        lists = [F.col("s.VALID_BLIND_PIXELS"), F.col("s.NON_VALID_BLIND_PIXELS")]
    return _distinct(x.select(*keys, "band", "detector", F.concat_ws(" ", *lists).alias("list")), keys)


def _distinct(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.select(*keys, F.col("band").cast("int").alias("band"), F.col("detector").cast("int").alias("detector"), F.explode(_whole_numbers(F.col("list"))).alias("col")).distinct()


def radiometric_parameters(docs: DataFrame, keys: list[str], text: str, form: str) -> DataFrame:
    """keys, band, offset_l1b, offset_l1c, equalization, offset, dsnu: what any of the three lists names; a flag that is missing is true."""
    flags = {"EQUALIZATION_FLAG": "equalization", "OFFSET": "offset", "DARK_SIGNAL_NON_UNIFORMITY": "dsnu"}
    if form == "json":
        at = lambda path: F.get_json_object(_data(text), path)
        offsets = lambda tag: F.transform(_many(at(f"$.RADIOMETRIC_SHIFT.{tag}.RADIO_ADD_OFFSET"), "@band_id band_id #text _text"), lambda e: F.struct(_attr(e, "band_id").cast("int").alias("band"), F.coalesce(e["#text"], e["_text"]).cast("double").cast("int").alias("v")))
        bands = _listed(F.coalesce(at("$.NOMINAL_SCENARIO.EQUALIZATION.BAND_EQUALIZATION"), at("$.EQUALIZATION.BAND_EQUALIZATION")))
        bands = F.from_json(bands, "array<map<string,string>>")
        bands = F.transform(bands, lambda e: F.struct(F.coalesce(e["BAND_ID"], e["@band_id"], e["band_id"]).cast("int").alias("band"), *[_text(e[f]).alias(f) for f in flags]))
        x = docs.select(*keys, offsets("RADIANCE_OFFSET_L1B").alias("l1b"), offsets("REFLECTANCE_OFFSET_L1C").alias("l1c"), bands.alias("bands"))
    else:
        offset = "STRUCT<RADIO_ADD_OFFSET: ARRAY<STRUCT<_band_id: STRING, _VALUE: STRING>>>"
        band = "BAND_EQUALIZATION: ARRAY<STRUCT<_band_id: STRING, BAND_ID: STRING, " + ", ".join(f"{f}: STRING" for f in flags) + ">>"
        schema = f"DATA STRUCT<RADIOMETRIC_SHIFT: STRUCT<RADIANCE_OFFSET_L1B: {offset}, REFLECTANCE_OFFSET_L1C: {offset}>, NOMINAL_SCENARIO: STRUCT<EQUALIZATION: STRUCT<{band}>>, EQUALIZATION: STRUCT<{band}>>"
        d = docs.select(*keys, F.from_xml(F.col(text), schema)["DATA"].alias("d"))
        offsets = lambda tag: F.transform(F.col(f"d.RADIOMETRIC_SHIFT.{tag}.RADIO_ADD_OFFSET"), lambda e: F.struct(e["_band_id"].cast("int").alias("band"), e["_VALUE"].cast("double").cast("int").alias("v")))
        bands = F.transform(F.coalesce("d.NOMINAL_SCENARIO.EQUALIZATION.BAND_EQUALIZATION", "d.EQUALIZATION.BAND_EQUALIZATION"), lambda e: F.struct(F.coalesce(e["_band_id"], e["BAND_ID"]).cast("int").alias("band"), *[e[f].alias(f) for f in flags]))
        x = d.select(*keys, offsets("RADIANCE_OFFSET_L1B").alias("l1b"), offsets("REFLECTANCE_OFFSET_L1C").alias("l1c"), bands.alias("bands"))
    none = F.lit(None).cast("int")
    flag = lambda v: F.coalesce(F.lower(F.trim(v)) == "true", F.lit(True))
    of = lambda part, b, c, f: F.transform(F.coalesce(part, F.array()), lambda e: F.struct(e["band"].alias("band"), b(e).alias("offset_l1b"), c(e).alias("offset_l1c"), *[f(e, k).alias(v) for k, v in flags.items()]))
    no = lambda e: none
    unset = lambda e, k: F.lit(None).cast("boolean")
    every = F.concat(of(F.col("l1b"), lambda e: e["v"], no, unset), of(F.col("l1c"), no, lambda e: e["v"], unset), of(F.col("bands"), no, no, lambda e, k: flag(e[k])))
    rows = x.select(*keys, F.explode(every).alias("r")).select(*keys, "r.*")
    return rows.groupBy(*keys, "band").agg(F.max("offset_l1b").alias("offset_l1b"), F.max("offset_l1c").alias("offset_l1c"), *[F.coalesce(F.bool_and(v), F.lit(True)).alias(v) for v in flags.values()])


def _variable(text: str, name: str) -> Column:
    """The data of one variable of an array document, still as text."""
    return F.from_json(text, "data_vars map<string, struct<data: string>>")["data_vars"][name]["data"]


def array_variable(docs: DataFrame, keys: list[str], text: str, variable: str) -> DataFrame:
    """keys, detector, line, col, value of one variable in {"data_vars": {name: {"data": [detector][column] or [detector][sub-line][column]}}}.
    Without a sub-line axis line is 0; averaging over lines gives one value a column."""
    raw = _variable(text, variable)
    deep = F.ltrim(raw).rlike(r"^\[\s*\[\s*\[")
    cube = F.coalesce(F.when(deep, F.from_json(raw, "array<array<array<double>>>")), F.transform(F.from_json(F.when(~deep, raw), "array<array<double>>"), lambda d: F.array(d)))
    x = docs.select(*keys, F.posexplode(cube).alias("detector", "_d")).select(*keys, (F.col("detector") + 1).alias("detector"), F.posexplode("_d").alias("line", "_l"))
    return x.select(*keys, "detector", "line", F.posexplode("_l").alias("col", "value"))


def swir_shifts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, band, detector, col, shift (-1, 0, 1), method, kernel (three taps) of the SWIR document."""
    kernel = F.from_json(_variable(text, "interpolation_filter/coefs"), "array<double>")
    x = array_cube(docs.withColumn("kernel", kernel), [*keys, "kernel"], text, "swir_band_list/swir_band/detector")
    band = F.element_at(F.array(*[F.lit(b) for b in ("B10", "B11", "B12")]), F.col("plane") + 1)
    out = x.select(*keys, band.alias("band"), F.col("row").alias("detector"), "col", F.rint("value").cast("int").alias("shift"), "kernel")
    return out.withColumn("method", F.when(F.col("band") == "B10", "interp").otherwise("shift"))


def array_cube(docs: DataFrame, keys: list[str], text: str, variable: str) -> DataFrame:
    """keys, plane (from 0), row (from 1), col, value of a variable of three axes."""
    x = docs.select(*keys, F.posexplode(F.from_json(_variable(text, variable), "array<array<array<double>>>")).alias("plane", "_p")).select(*keys, "plane", F.posexplode("_p").alias("row", "_r"))
    return x.select(*keys, "plane", (F.col("row") + 1).alias("row"), F.posexplode("_r").alias("col", "value"))


def onboard_table(docs: DataFrame, keys: list[str], text: str, band: str, table: str = "new_table") -> DataFrame:
    """keys, detector, col, a1, a2, zs, d of the on-board equalization of one band and table."""
    names = ["a1", "a2", "zs", "d"]
    arrays = [F.from_json(_variable(text, f"{band.lower()}/{table}/coeff_{n}"), "array<array<double>>").alias(n) for n in names]
    x = docs.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("detector", "z"))
    x = x.select(*keys, (F.col("detector") + 1).alias("detector"), F.posexplode(F.arrays_zip(*[F.col(f"z.{n}").alias(n) for n in names])).alias("col", "c"))
    return x.select(*keys, "detector", "col", *[F.col(f"c.{n}").alias(n) for n in names])
