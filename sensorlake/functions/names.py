"""Product names and other fixed-grammar strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of product names, its type codes, and older name patterns.
NAME = r"^([A-Z0-9_]{9})_(\d{8}T\d{6})_(\d{4})_([A-Z])(\d{3})_([T_S])([0-9A-F]{3})(?:_([A-Za-z0-9_]+))?(\.zarr\.zip|\.zarr)?$"
LENIENT = r"^([A-Z0-9_]{9})_(\d{8}T\d{6})_(\d{4})_([A-Z])(\d{3})_([T_S])([0-9A-F]{3})(?:_([A-Za-z0-9_]+))?(\.zarr\.zip|\.zarr|\.tar)?$"
TYPE_CODES = ("S02MSIL0_", "S02MSIL1A", "S02MSIL1B", "S02MSIL1C", "S02MSIL2A", "S02MSISCA", "S02MSIDCA", "S02MSIISP", "S02SADISP")
LEGACY = r"^(S2[ABC])_OPER_([A-Z0-9_]+?)_(\d{8}T\d{6})(?:_?(V\d{8}T\d{6}_\d{8}T\d{6}))?(?:.*?_A(\d{6}))?"
DATA_TAKE = r"GS2[ABC]_[A-Z0-9_]+?_(\d{6})_N"
COEF_FILE = r"S0?2([ABC])_ADF_([A-Z0-9]+)_(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{8}T\d{6})"
PLACES = {"product_type": (1, 9), "start": (11, 15), "duration_s": (27, 4), "unit": (32, 1), "relative_orbit": (33, 3), "consolidation": (37, 1), "discriminator": (38, 3)}
NUMBERS = ("duration_s", "relative_orbit")


def parse_name(name: Column) -> Column:
    """Struct of the nine fields (null where the grammar or the type code does not hold), valid, and whether the builder could make it. The grammar is matched once; the fields lie at fixed places."""
    valid = name.rlike(NAME) & F.substring(name, 1, 9).isin(*TYPE_CODES)
    kept = F.when(valid, F.rtrim(name, F.lit("\r\n")))
    stem = F.substring_index(kept, ".", 1)
    part = {f: F.substring(kept, at, n) for f, (at, n) in PLACES.items()}
    part |= {"z_suffix": F.nullif(F.substring(stem, 42, 1 << 20), F.lit("")), "ext": F.substring(kept, F.length(stem) + 1, F.lit(1 << 20))}
    part |= {f: part[f].cast("int") for f in NUMBERS}
    buildable = part["relative_orbit"].between(1, 143) & (part["duration_s"] >= 1)
    return F.struct(*[v.alias(f) for f, v in part.items()], F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(buildable, F.lit(False)).alias("buildable"))


def build_name(product_type: Column, start: Column, duration_s: Column, unit: Column, orbit: Column, discriminator: Column | None = None, ext: str = ".zarr") -> Column:
    """A name; null for a type, orbit or duration that the grammar cannot hold. Durations round half up, and are 1 at least."""
    seconds = F.greatest(F.floor(duration_s + 0.5), F.lit(1)).cast("int")
    when = F.date_format(start, "yyyyMMdd'T'HHmmss")
    if discriminator is None:
        seed = F.concat(product_type, when, seconds.cast("string"), unit, orbit.cast("string"))
        discriminator = F.right(F.concat(F.lit("00"), F.hex(F.crc32(seed.cast("binary")))), F.lit(3))
    name = F.concat(product_type, F.lit("_"), when, F.lit("_"), F.lpad(seconds.cast("string"), 4, "0"), F.lit("_"), unit, F.lpad(orbit.cast("string"), 3, "0"), F.lit("_T"), discriminator, F.lit(ext))
    return F.when(product_type.isin(*TYPE_CODES) & orbit.between(1, 143) & (seconds <= 9999) & unit.rlike("^[A-Z]$"), name)


def parse_lenient(name: Column) -> Column:
    """Struct psfd, product_type, start, relative_orbit, absolute_orbit, unit: the grammar with any type and archives, else the older pattern; psfd where the type is known."""
    part = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    loose, old = name.rlike(LENIENT), name.rlike(LEGACY)
    return F.struct(
        F.coalesce(loose & part(LENIENT, 1).isin(*TYPE_CODES), F.lit(False)).alias("psfd"), F.when(loose, part(LENIENT, 1)).when(old, part(LEGACY, 2)).alias("product_type"),
        F.when(loose, part(LENIENT, 2)).when(old, part(LEGACY, 3)).alias("start"), F.when(loose, part(LENIENT, 5).cast("int")).alias("relative_orbit"),
        F.when(~loose & old, part(LEGACY, 5).cast("int")).alias("absolute_orbit"), F.when(loose, part(LENIENT, 4)).when(old, part(LEGACY, 1)).alias("unit"),
    )


def data_take_id(unit: Column, start: Column, orbit: Column) -> Column:
    return F.concat(F.lit("GS2"), unit, F.lit("_"), start, F.lit("_"), F.lpad(orbit.cast("string"), 6, "0"), F.lit("_N04.00"))


def orbit_of_data_take(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DATA_TAKE, 1), F.lit("")).cast("int")


def datastrip_id(unit: Column, start: Column, orbit: Column) -> Column:
    """The older identifier of a data strip."""
    return F.concat(F.lit("S2"), unit, F.lit("_OPER_MSI_L0__DS_"), F.date_format(start, "yyyyMMdd'T'HHmmss"), F.lit("_A"), F.format_string("%06d", orbit.cast("int")))


def parse_coefficient_file(name: Column) -> Column:
    """Struct platform, type, start, stop, creation of a coefficient file's name."""
    part = lambda i: F.nullif(F.regexp_extract(name, COEF_FILE, i), F.lit(""))
    time = lambda i: F.try_to_timestamp(part(i), F.lit("yyyyMMdd'T'HHmmss"))
    return F.struct(F.concat(F.lit("S2"), part(1)).alias("platform"), part(2).alias("type"), time(3).alias("start"), time(4).alias("stop"), time(5).alias("creation"))


def unit_of(platform: Column) -> Column:
    """The last letter of a platform's name, or null."""
    last = F.right(F.upper(F.trim(platform)), F.lit(1))
    return F.when(last.rlike("^[A-Z]$"), last)


def band_key(band: Column) -> Column:
    """B8A -> b8a, B02 -> b02."""
    return F.concat(F.lit("b"), F.lower(F.substring(band, 2, 2)))


def sensing_date(name: Column) -> Column:
    """The date of a name by four patterns in order."""
    patterns = [(r"_(\d{8})T\d{6}_", "yyyyMMdd"), (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"V(\d{8})", "yyyyMMdd"), (r"(\d{8})", "yyyyMMdd")]
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(f)).cast("date") for p, f in patterns])


def product_root(key: Column, marker: str) -> Column:
    """The key up to and with its deepest segment that contains the marker."""
    parts = F.split(key, "/")
    at = F.aggregate(F.transform(parts, lambda x, i: F.when(x.contains(marker), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at), "/"))


def satellite(key: Column) -> Column:
    """S2A, S2B or S2C, whichever the key names first in this order; `?` for none."""
    unit = F.lit("?")
    for letter in "CBA":
        unit = F.when(key.rlike(f"S0?2{letter}"), f"S2{letter}").otherwise(unit)
    return unit


def number_list(text: Column) -> Column:
    """Numbers of a text with blanks between them; anything else is left out."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def range_list(text: Column) -> Column:
    """'1-3,7' as an array of whole numbers."""
    ends = lambda x: F.split(F.trim(x), "-")
    return F.flatten(F.transform(F.split(text, ","), lambda x: F.sequence(F.element_at(ends(x), 1).cast("int"), F.element_at(ends(x), -1).cast("int"))))
