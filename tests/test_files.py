"""File sources and sinks: round trips, awkward documents, packet walks and stores."""

from __future__ import annotations

import io
import math
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import sequence, stores
from sensorlake.sources import documents, files, telemetry


def packet(apid, seq, body, secondary=True):
    return struct.pack(">HHH", (0x0800 if secondary else 0) | apid, 0xC000 | seq, len(body) - 1) + body


def test_files_round_trip(spark):
    folder = files.folder_of(spark, "round")
    rows = spark.createDataFrame([("a/b.bin", b"\x00\n\xff"), ("c.txt", b""), ("d/e/f.json", None)], "path string, content binary")
    assert sorted(map(tuple, files.store_files(rows, folder).collect())) == [("a/b.bin", 3), ("c.txt", 0), ("d/e/f.json", 0)]
    files.store_files(rows, folder)  # a second run leaves the same files
    got = {r["path"]: bytes(r["content"]) for r in files.read_files(spark, folder).collect()}
    assert got == {"a/b.bin": b"\x00\n\xff"}  # empty files are passed over
    assert [r["path"] for r in files.read_files(spark, folder, "*.bin").collect()] == ["a/b.bin"]


def test_a_walk_does_not_read_content(spark):
    folder = files.folder_of(spark, "walk")
    files.store_files(spark.createDataFrame([("a.zarr/x", "12345"), ("__pycache__/y.json", "1"), (".hidden", "1")], "path string, content string"), folder)
    walked = files.walk(spark, folder)
    assert sorted(map(tuple, walked.collect())) == [("a.zarr/x", 5)]
    assert "ReadSchema: struct<path:string,length:bigint>" in walked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "", None])
def test_places_outside_the_folder_are_refused(spark, path):
    rows = spark.createDataFrame([(path, "x")], "path string, content string")
    with pytest.raises(Exception, match="not inside the folder"):
        files.store_files(rows, files.folder_of(spark, "outside"))


def test_packet_walks_of_files(spark):
    whole = packet(5, 7, b"\x00\x00\x00\x02\x80\x00rest") + packet(6, 1, b"ab", secondary=False) + packet(5, 9, b"x" * 6)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in (("m1", whole), ("m2", whole[:-2]), ("m3", b""), ("m4", b"abc")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([("x.tar", out.getvalue()), ("y.bin", whole), ("z.bin", None)], "path string, content binary")
    found = telemetry.packet_files(df)
    profile = {r["member"]: r for r in sequence.member_profile(found, ["path", "member"], "bytes").collect()}
    assert {m: (r["packets"], r["tiles_exactly"], r["broke_off_at"], r["continuous"], r["by_apid"]) for m, r in profile.items() if m != "z.bin"} == {
        "m1": (3, True, None, False, "5=2,6=1"), "m2": (2, False, 24, True, "5=1,6=1"), "m3": (0, True, None, True, ""), "m4": (0, False, 0, True, ""), "y.bin": (3, True, None, False, "5=2,6=1"),
    }
    first = found.where("member = 'y.bin'").orderBy("offset").collect()
    assert [(r["offset"], r["cuc"]) for r in first] == [(0, "000000028000"), (16, None), (24, "787878787878")]
    with pytest.raises(Exception, match="cut off at"):
        telemetry.packet_files(df, strict=True).collect()


def test_doubles_of_bytes(spark):
    values = [0.0, -0.0, 1.0, -1.5, math.pi, 5e-324, -2.2250738585072014e-308, 2.2250738585072009e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1e-300, 1e-290, 123456789.123]
    df = spark.createDataFrame([(struct.pack(">d", v),) for v in values], "b binary").select(telemetry.double_at(F.col("b"), 0).alias("v"))
    assert [struct.pack(">d", r["v"]) for r in df.collect()] == [struct.pack(">d", v) for v in values]


def test_documents_that_are_odd(spark):
    one = '{"R":{"DATA":{"BAND":{"band_id":"3","DETECTOR":{"@detector_id":"4","SIDE":{"VALID_BLIND_PIXELS":{"#text":" 9  2 x 2"}}}}}}}'
    empty, cut, none = '{"R":{"DATA":{"BAND":[]}}}', '{"R":{"DA', None
    docs = spark.createDataFrame([(1, one), (2, empty), (3, cut), (4, none)], "doc int, text string")
    assert sorted(map(tuple, documents.blind_columns(docs, ["doc"], "text", "json").collect())) == [(1, 3, 4, 2), (1, 3, 4, 9)]
    assert {r[0]: r[1] for r in docs.select("doc", documents.broken(docs, "text", "json")).collect()} == {1: False, 2: False, 3: True, 4: True}
    xml = "<G><DATA><BAND band_id='3'><DETECTOR detector_id='4'><SIDE><NON_VALID_BLIND_PIXELS>9 2 2</NON_VALID_BLIND_PIXELS></SIDE></DETECTOR></BAND></DATA></G>"
    docs = spark.createDataFrame([(1, xml), (2, "<G><DATA></DATA></G>"), (3, "<G><DA"), (4, None)], "doc int, text string")
    assert sorted(map(tuple, documents.blind_columns(docs, ["doc"], "text", "xml").collect())) == [(1, 3, 4, 2), (1, 3, 4, 9)]
    flat = '{"R":{"DATA":{"RADIOMETRIC_SHIFT":{"RADIANCE_OFFSET_L1B":{"RADIO_ADD_OFFSET":{"band_id":"0","#text":"-100.0"}}},"EQUALIZATION":{"BAND_EQUALIZATION":{"band_id":"1","OFFSET":"no"}}}}}'
    got = documents.radiometric_parameters(spark.createDataFrame([(1, flat)], "doc int, text string"), ["doc"], "text", "json").collect()
    assert sorted(map(tuple, got)) == [(1, 0, -100, None, True, True, True), (1, 1, None, None, True, False, True)]


def test_attributes_of_products(spark):
    def archive(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members:
                z.writestr(name, text)
        return out.getvalue()

    rows = [("a.zarr/.zattrs", b'{"x":1}'), ("a.zarr/.zmetadata", b'{"metadata":{".zattrs":{"x":2}}}'), ("b.zarr/.zmetadata", b'{"metadata":{}}'), ("c.zarr/.zattrs", b"{"), ("d.zarr/img/.zattrs", b"{}"), ("e.zip", archive(("e/img/.zattrs", '{"x":3}'), ("e/.zattrs", '{"x":4}'))), ("f.zip", b"no archive")]
    got = {r["product"]: r["attrs"] for r in stores.product_attributes(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.zarr": '{"x":1}', "b.zarr": "{}", "c.zarr": "{}", "e.zip": '{"x":4}'}


def test_leaves_of_deep_and_broken_trees(spark):
    deep = '{"k":' * 30 + '"end"' + "}" * 30
    rows = [(1, deep), (2, "{"), (3, None), (4, '{"l":[[1,[2]],{"version":null}]}'), (5, "7"), (6, "[]")]
    got = stores.leaves(spark.createDataFrame(rows, "id int, attrs string"), ["id"], "attrs").collect()
    assert sorted((r["id"], r["path"], r["key"], r["value"]) for r in got if r["id"] != 1 and r["value"]) == [(4, "l[0][0]", "l", "1"), (4, "l[0][1][0]", "l", "2")]
    assert [(r["path"], r["value"]) for r in got if r["id"] == 1] == [(".".join(["k"] * 30), "end")]
    assert [(r["path"], r["key"]) for r in stores.date_like(spark.createDataFrame(got)).collect()] == [("l[1].version", "version")]


def test_fetched_objects(spark):
    listed = spark.createDataFrame([("p/a", 1, "0cc175b9c0f1b6a831c399e269772661"), ("p/b", 1, "x-2"), ("p/c", 1, "bad"), ("p/d", 2, ""), ("p/e", 1, ""), ("p/", 0, ""), ("p/../q", 1, "")], "key string, size long, etag string")
    there = spark.createDataFrame([("a", 1, b"a"), ("b", 1, b"b"), ("c", 1, b"c"), ("d", 1, b"d")], "path string, length long, content binary")
    got = {r["key"]: (r["verify"], (r["error"] or "").split(" ")[0]) for r in stores.complete(listed, there, "p/").collect()}
    assert got == {"p/a": ("md5", ""), "p/b": ("size", ""), "p/c": (None, "MD5"), "p/d": (None, "received"), "p/e": (None, "missing"), "p/": (None, "empty"), "p/../q": (None, "unsafe")}
    assert sorted(r["key"] for r in stores.to_fetch(listed, there, "p/").collect()) == ["p/c", "p/d", "p/e"]
