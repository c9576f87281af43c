"""Queries that SQL cannot restate, against plain Python; stencils and shifts against plain loops; validity by hand."""

from __future__ import annotations

import datetime
import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sensorlake.operators import lineblocks, profile, validity
from sensorlake.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"


def test_frame_checksums(spark):
    from sensorlake.fixtures import frame_lines

    want, lines = defaultdict(int), defaultdict(int)
    text = frame_lines(spark, SF).select("band", F.concat_ws(",", F.col("line").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("string")), ",")).alias("t"))
    for r in text.collect():
        want[r["band"]] ^= zlib.crc32(r["t"].encode())
        lines[r["band"]] += 1
    got = {r["band"]: (r["checksum"], r["n_lines"]) for r in registry.QUERIES["agg_15_frame_checksum"](spark, SF).collect()}
    assert got == {b: (want[b], lines[b]) for b in want}


def frames(seed, heights, width):
    rng = random.Random(seed)
    return [(b, y, x, rng.randrange(4096)) for b, h in enumerate(heights) for y in range(h) for x in range(width)]


def test_blur_equals_plain_loops(spark):
    rows, w = frames(1, (5, 130, 70), 9), 9
    kernel = [(-2, 0, 0.25), (0, 1, 0.5), (3, -1, 0.25), (70, 0, 0.125)]
    height = {0: 5, 1: 130, 2: 70}
    want = defaultdict(float)
    for b, y, x, v in rows:
        for dy, dx, k in kernel:
            want[b, (y + dy) % height[b], (x + dx) % w] += v * k
    df = spark.createDataFrame(rows, "band int, line int, col int, dn int")
    got = {(r["band"], r["line"], r["col"]): r["dn"] for r in lineblocks.convolve(df, spark.createDataFrame(kernel, "dy int, dx int, w double"), ["band"], "dn").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert lineblocks.convolve(df.limit(0), spark.createDataFrame(kernel, "dy int, dx int, w double"), ["band"], "dn").count() == 0


def test_shifted_sums_equal_plain_loops(spark):
    rows = [r for r in frames(2, (100, 140), 4) if random.Random(repr(r)).random() < 0.9]
    other = [(b, y + 2, x, v + 1) for b, y, x, v in rows]
    a, b = (spark.createDataFrame(x, "band int, line int, col int, dn int") for x in (rows, other))
    at = {(k, y, x): v for k, y, x, v in other}
    want = defaultdict(lambda: [0] * 6)
    for k, y, x, v in rows:
        for s in range(-40, 41):
            u = at.get((k, y + s, x))
            if u is not None:
                want[k, s] = [p + q for p, q in zip(want[k, s], (1, v, u, v * v, u * u, u * v), strict=True)]
    got = {(r["band"], r["shift"]): [r[c] for c in ("n", "sx", "sy", "sxx", "syy", "sxy")] for r in lineblocks.shifted_sums(a, b, ["band"], 40).collect()}
    assert got == dict(want)
    assert {(r["band"], r["shift"]) for r in profile.drift(a, b, ["band"], 40).collect()} == {(0, 2), (1, 2)}
    assert profile.drift(a.limit(0), b, ["band"], 3).count() == 0


def test_applicable_files(spark):
    """The last that starts at or before the day, its window and its gap; the first of its type before all starts; nothing without a day."""
    rng, day = random.Random(5), lambda n: datetime.date(2016, 1, 1) + datetime.timedelta(n)
    files = [(i, rng.choice("AB"), day(s := rng.randrange(2_000)), day(s + rng.randrange(900))) for i in range(40)] + [(99, "A", day(10), None), (100, "B", None, day(3))]
    rows = [(i, day(rng.randrange(-300, 2_800))) for i in range(200)] + [(900, None)]
    got = validity.applicable(spark.createDataFrame(rows, "k long, day date"), spark.createDataFrame(files, "f long, type string, start date, stop date"), "day", "f", "type").collect()
    assert [r["f"] for r in got if r["k"] == 900] == [None]
    seen = {(r["k"], r["type"]): r for r in got if r["k"] != 900}
    assert len(seen) == len(got) - 1 == 400
    for (k, kind), r in seen.items():
        own = [x for x in files if x[1] == kind and x[2] is not None]
        before = [x for x in own if x[2] <= r["day"]]
        start = max(x[2] for x in before) if before else min(x[2] for x in own)
        best = min(x for x in own if x[2] == start)
        days = abs((r["day"] - start).days)
        assert (r["f"], r["start"], r["gap_days"]) == (best[0], start, days)
        if best[3] is None:
            continue
        within = start <= r["day"] <= best[3]
        assert r["within_validity"] == within and r["warn"] == (round(days / 365.25, 2) > 1 or not within) and math.isclose(r["gap_years"], round(days / 365.25, 2))


def test_payload_decode_gives_back_the_numbers(spark):
    got = {r["vec_id"]: list(r)[1:] for r in registry.QUERIES["sca_12_payload_decode"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 11).cast("array<double>").alias("e")).collect()
    assert got == {r["vec_id"]: r["e"] for r in rows}
