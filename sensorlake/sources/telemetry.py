"""Bytes of packets and archives: the only places where Python reads what SQL cannot."""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AOCS = "t double, px double, py double, pz double, vx double, vy double, vz double, q0 double, q1 double, q2 double, q3 double"


def payload_of(values: Column) -> Column:
    """Eleven numbers as big-endian doubles."""

    @F.udf("binary", useArrow=True)
    def make(x: list) -> bytes | None:
        return None if x is None or len(x) != 11 else struct.pack(">11d", *x)

    return make(values)


def double_at(body: Column, k: int) -> Column:
    """The k-th (from 0) big-endian double of a binary value, by its sign, exponent and fraction: no Python."""
    bits = F.conv(F.hex(F.substring(body, 8 * k + 1, 8)), 16, -10).cast("long")
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF)).cast("int")
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1))
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = fraction.cast("double") * F.lit(2.0**-1074)
    usual = (fraction + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double"))
    # 2**-1075 is no double: the smallest exponents go in two exact steps
    low = (fraction + F.lit(1 << 52)).cast("double") * F.lit(2.0**-1000) * F.pow(F.lit(2.0), (exponent - 75).cast("double"))
    return F.when(exponent == 0x7FF, special).when(exponent == 0, sign * small).when(exponent < 60, sign * low).otherwise(sign * usual)


def aocs_payload(body: str) -> Column:
    """Struct of the eleven big-endian doubles of a telemetry record; null for a body that is too short."""
    names = [part.split()[0] for part in AOCS.split(", ")]
    return F.when(F.length(body) >= 8 * len(names), F.struct(*[double_at(F.col(body), k).alias(n) for k, n in enumerate(names)]))


class PacketHeaders:
    """Table function: a row for each packet header of a file's content. Where a packet is cut off, a scan ends with what it has and a strict
    walk raises an error. cuc: the six octets of the time code as hexadecimal text, where a secondary header is flagged and fits."""

    def eval(self, content: bytes, strict: bool) -> Iterator[tuple]:
        at = 0
        while content is not None and at < len(content):
            if at + 6 > len(content):
                if strict:
                    raise ValueError(f"a packet header is cut off at {at}")
                return
            first, second, size = struct.unpack_from(">HHH", content, at)
            if at + 7 + size > len(content):
                if strict:
                    raise ValueError(f"a packet is cut off at {at}")
                return
            cuc = bytes(content[at + 6 : at + 12]).hex().upper() if first & 0x0800 and size + 1 >= 6 else None
            yield at, first & 0x7FF, second >> 14, second & 0x3FFF, size + 1, cuc
            at += 7 + size


class ZipMembers:
    """Table function: name and bytes of each file of a zip archive; none of content that is no archive."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content and zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        yield m.filename, z.read(m)


class TarMembers:
    """Table function: name and bytes of each file of a tar archive."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content:
            with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                for m in tar:
                    if m.isfile():
                        yield m.name, tar.extractfile(m).read()


def register(spark: object) -> None:
    """packet_headers(content, strict), tar_members(content) and zip_members(content), for LATERAL joins in SQL."""
    spark.udtf.register("packet_headers", F.udtf(PacketHeaders, returnType="offset bigint, apid int, seq_flags int, seq_count int, data_len int, cuc string"))
    spark.udtf.register("tar_members", F.udtf(TarMembers, returnType="name string, content binary"))
    spark.udtf.register("zip_members", F.udtf(ZipMembers, returnType="name string, content binary"))


def packet_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """path, member, bytes, and offset, apid, seq_flags, seq_count, data_len, cuc of each packet of files (path, content). Tar archives are opened
    member by member, other files are one member. A member without packets gives one row with nulls."""
    register(files.sparkSession)
    view = f"packet_files_{uuid.uuid4().hex}"
    files.createOrReplaceTempView(view)
    members = f"""SELECT path, m.name AS member, m.content FROM {view}, LATERAL tar_members(CASE WHEN path LIKE '%.tar' THEN content END) m
        UNION ALL SELECT path, path AS member, content FROM {view} WHERE path NOT LIKE '%.tar'"""
    return files.sparkSession.sql(f"SELECT x.path, x.member, length(x.content) AS bytes, h.* FROM ({members}) x LEFT JOIN LATERAL packet_headers(x.content, {str(strict).lower()}) h ON true")


def tar_of(members: Column) -> Column:
    """A tar archive of an array of (name, content)."""

    @F.udf("binary", useArrow=True)
    def make(given: list) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for m in given:
                info = tarfile.TarInfo(m["name"])
                info.size = len(m["content"])
                tar.addfile(info, io.BytesIO(bytes(m["content"])))
        return out.getvalue()

    return make(members)


def zip_of(members: Column) -> Column:
    """A zip archive of an array of (name, content)."""

    @F.udf("binary", useArrow=True)
    def make(given: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for m in given:
                z.writestr(zipfile.ZipInfo(m["name"]), bytes(m["content"]))
        return out.getvalue()

    return make(members)
