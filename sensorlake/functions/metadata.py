"""Metadata documents as JSON text: nesting, properties, identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorlake.functions.names import orbit_of_data_take, unit_of


DOCUMENT = "stac_discovery struct<properties: map<string, string>, stac_discovery: struct<properties: map<string, string>>>"


def property_of(attrs: str, key: str) -> Column:
    """A property's text; a document that is nested twice is read at its inner level first. The document is parsed once for all of a row's properties."""
    outer = F.from_json(attrs, DOCUMENT)["stac_discovery"]
    return F.coalesce(outer["stac_discovery"]["properties"][key], outer["properties"][key])


def _raised(*flags: Column) -> Column:
    """The flags that are not null, as an array. Without a lambda, inside which each flag would parse the document again."""
    joined = F.concat_ws(",", *flags)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def doubly_nested(attrs: str) -> Column:
    return F.get_json_object(attrs, "$.stac_discovery.stac_discovery").isNotNull()


def whole_number(text: Column) -> tuple[Column, Column]:
    """The number, and whether a text was given that is none."""
    return text.try_cast("int"), text.isNotNull() & text.try_cast("int").isNull()


def accessor(node: str, key: str) -> Column:
    """A value of a converted document: an attribute (@key) before a child (key)."""
    return F.coalesce(F.get_json_object(node, f"$.@{key}"), F.get_json_object(node, f"$.{key}"))


def identity(attrs: str) -> Column:
    """Struct relative_orbit, absolute_orbit, platform, data_take, source and flags of an acquisition."""
    rel, bad_rel = whole_number(property_of(attrs, "sat:relative_orbit"))
    ab, bad_ab = whole_number(property_of(attrs, "sat:absolute_orbit"))
    take = F.coalesce(property_of(attrs, "eopf:data_take_id"), property_of(attrs, "eopf:datastrip_id"))
    flags = _raised(
        F.when(doubly_nested(attrs), "stac_discovery_double_nested"), F.when(bad_rel, "relative_orbit_not_int"), F.when(bad_ab, "absolute_orbit_unfilled_xpath"),
        F.when(ab.isNull() & orbit_of_data_take(take).isNotNull(), "absolute_orbit_from_datatake_id"),
    )
    return F.struct(rel.alias("relative_orbit"), F.coalesce(ab, orbit_of_data_take(take)).alias("absolute_orbit"), property_of(attrs, "platform").alias("platform"), take.alias("data_take"), F.when(F.col(attrs).isNull(), "none").otherwise("stac_discovery").alias("source"), flags.alias("flags"))


def context(attrs: str, default_orbit: int = 1, default_unit: str = "A") -> Column:
    """Struct relative_orbit, unit, platform, and the list of fields that fell back to a default."""
    rel = property_of(attrs, "sat:relative_orbit").try_cast("int")
    unit = unit_of(property_of(attrs, "platform"))
    defaults = _raised(F.when(rel.isNull(), "sat:relative_orbit"), F.when(unit.isNull(), "platform"))
    filled = F.coalesce(unit, F.lit(default_unit))
    return F.struct(F.coalesce(rel, F.lit(default_orbit)).alias("relative_orbit"), filled.alias("unit"), F.coalesce(property_of(attrs, "platform"), F.concat(F.lit("Sentinel-2"), filled)).alias("platform"), defaults.alias("defaults"))
