"""Bytes, streams and schemas."""

from __future__ import annotations

import io
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from sensorlake.plans import streams
from sensorlake.sources import telemetry
from sensorlake.streaming import packets as S

SF = "/root/testdata/sf0.001"


def test_payload_round_trip(spark):
    body = struct.pack(">11d", *range(11))
    df = spark.createDataFrame([(body,), (body[:80],), (None,)], "body binary").select(telemetry.aocs_payload("body").alias("p"))
    got = [r["p"] for r in df.collect()]
    assert list(got[0]) == [float(x) for x in range(11)] and got[1] is None and got[2] is None


def test_packet_walk_modes():
    data = struct.pack(">HHH", 0x0800 | 5, 0xC000 | 7, 1) + b"ab" + struct.pack(">HHH", 0x0805, 0xC008, 9) + b"x"
    assert list(telemetry.PacketHeaders().eval(data, False)) == [(0, 5, 3, 7, 2, None)]
    with pytest.raises(ValueError, match="cut off"):
        list(telemetry.PacketHeaders().eval(data, True))


def test_tar_members():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("a/b.bin")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert list(telemetry.TarMembers().eval(out.getvalue())) == [("a/b.bin", b"abc")]


def test_sessions_and_first_arrivals(spark):
    stream = streams.packet_stream(spark, SF)
    batch = stream.schema
    sessions = S.drained(S.session_counts(stream, "12 hours", "400 days"), "sessions").where("apid >= 0")
    assert sessions.agg(F.sum("n")).first()[0] > 0 and batch.names == ["apid", "seq_count", "pos", "data_len", "ts"]
    once = S.drained(S.first_arrivals(streams.packet_stream(spark, SF), "apid", "400 days"), "once").where("apid >= 0")
    from sensorlake.fixtures import packets

    assert once.count() == packets(spark, SF).select("apid").distinct().count()


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["band", "fpn_before", "fpn_after"] and df.count() == 10
