"""Packet headers as integer and hexadecimal expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE = 16384


def stream_id(base: Column, detector: Column, band: Column) -> Column:
    return (base + detector * 16 + band).bitwiseAND(0x7FF)


def pack_header(apid: Column, flags: Column, seq: Column, data_len: Column) -> Column:
    """Six octets as text: version 0, type 0, secondary header, id (11 bits); flags (2 bits) and counter (14 bits); length less one. Null for an id beyond 11 bits."""
    word = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    first = F.lit(0x0800).bitwiseOR(apid.cast("int").bitwiseAND(0x7FF))
    second = F.shiftleft(flags.cast("int"), 14).bitwiseOR(seq.cast("int").bitwiseAND(0x3FFF))
    return F.when(apid.between(0, 0x7FF), F.concat(word(first), word(second), word(data_len - 1)))


def unpack_header(text: Column) -> Column:
    """Struct of apid, seq_flags, seq_count, data_len from the text of six octets."""
    word = lambda s: F.conv(F.substring(text, s, 4), 16, 10).cast("int")
    return F.struct(
        word(1).bitwiseAND(0x7FF).alias("apid"), F.shiftright(word(5), 14).alias("seq_flags"), word(5).bitwiseAND(0x3FFF).alias("seq_count"), (word(9) + 1).alias("data_len")
    )
