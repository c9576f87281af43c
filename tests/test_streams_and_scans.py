"""Streams that resume, scans that are dealt out, and wavelets of whole frames."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.operators import sequence, wavelets
from sensorlake.plans import streams
from sensorlake.sources.shared import new_path
from sensorlake.streaming import packets as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "apid int, seq_count int, pos long, ts timestamp"


def gaps_by_hand(rows):
    """apid, previous, seq_count, missing in order of time."""
    out = []
    for apid in {r[0] for r in rows}:
        seqs = [r[1] for r in sorted((r for r in rows if r[0] == apid), key=lambda r: (r[3], r[2]))]
        out += [(apid, a, b, (b - a - 1) % 16384) for a, b in zip(seqs[:-1], seqs[1:]) if b != (a + 1) % 16384]
    return sorted(out)


def test_gap_monitor_resumes_and_waits_for_late_packets(spark):
    rng = random.Random(5)
    rows = [(apid, (16_380 + k) % 16_384, k, T0 + dt.timedelta(minutes=7 * k + apid)) for apid in (1, 2) for k in range(60) if rng.random() > 0.2]
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=rng.randrange(10)))
    end = [(-1, 0, 0, T0 + dt.timedelta(days=2))]
    source, at = new_path(spark, "gap-source"), new_path(spark, "gap-runs")
    for part in (arrival[:40], arrival[40:75], arrival[75:], end):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        found = S.drained(S.gap_monitor(spark.readStream.schema(SCHEMA).parquet(source), "10 minutes", "1 hour"), "gaps", at)
        seen = [tuple(r) for r in S.closed_gaps(found.where("apid > 0")).collect()]
        assert set(seen) <= set(gaps_by_hand(rows))  # nothing that a late packet closes
    assert sorted(seen) == gaps_by_hand(rows) and found.where("kind = 'edge' AND apid > 0").agg(F.sum("n")).first()[0] == len(rows)


def test_gap_monitor_of_streams_with_very_many_packets(spark, monkeypatch):
    """Positions up to the last that an int holds: every packet arrives in one delivery, and all gaps are found."""
    starts = {1: 0, 2: 271_150, 3: 2**31 - 60}
    rows = [(apid, (16_380 + pos) % 16_384, pos, T0 + dt.timedelta(hours=5 * k, seconds=apid)) for apid, first in starts.items() for k, pos in enumerate(range(first, first + 60)) if k % 7 != 3]
    table = spark.createDataFrame([(*r[:3], 9, r[3]) for r in rows], "apid int, seq_count int, pos int, data_len int, ts timestamp")
    monkeypatch.setattr(streams, "packets", lambda spark, sf_dir: table)
    *parts, _ = streams.deliveries(spark, "", 3)
    assert sorted((r["apid"], r["pos"]) for p in parts for r in p.collect()) == [(r[0], r[2]) for r in rows] and all(p.count() for p in parts)
    assert sorted(tuple(r) for r in streams.str_01(spark, "").collect()) == gaps_by_hand(rows)


def test_a_batch_that_runs_twice_or_broke_off_adds_its_rows_once(spark):
    path = new_path(spark, "merged")
    a, b = (spark.createDataFrame([(i, f"x{i}") for i in ids], "k long, v string") for ids in (range(20), range(10, 30)))
    for df, batch in ((a, 0), (a, 0), (b, 1), (b, 1), (a.limit(0), 2)):
        S.merged(df, batch, "k", path, 4)
    assert sorted(map(tuple, S.arrived(spark, path).collect())) == [(i, f"x{i}") for i in range(30)]


@pytest.mark.parametrize("width", [1, 3, 50, 10_000])
def test_scans_by_spans_equal_one_scan(spark, width):
    rng = random.Random(width)
    rows, seq = [], {}
    for pos in range(300):
        apid = 1 if rng.random() < 0.7 else rng.randrange(2, 5)
        seq[apid] = (seq.get(apid, 16_300) + (1 if rng.random() < 0.8 else 4)) % 16_384
        rows.append((apid, seq[apid], pos * 3, rng.randrange(1, 90), rng.randrange(4)))
    df = spark.createDataFrame(rows, "apid int, seq_count int, pos long, data_len int, seq_flags int").repartition(5)
    own = {a: [r for r in rows if r[0] == a] for a in seq}
    want = sorted((a, q[2], p[1], q[1], (q[1] - p[1] - 1) % 16_384) for a, x in own.items() for p, q in zip(x[:-1], x[1:], strict=True) if q[1] != (p[1] + 1) % 16_384)
    assert sorted((r["apid"], r["pos"], r["previous"], r["seq_count"], r["missing"]) for r in sequence.gaps(df, ["apid"], "pos", width).collect()) == want
    places = {(a, r[2]): sum(6 + q[3] for q in x[:i]) for a, x in own.items() for i, r in enumerate(x)}
    got = sequence.offsets(df, ["apid"], "pos", width).collect()
    assert {(r["apid"], r["pos"]): r["offset"] for r in got} == places and all(r["tiles"] for r in got)
    segments = {(a, s): [r[3] for i, r in enumerate(x) if sum(q[4] in (1, 3) for q in x[: i + 1]) == s] for a, x in own.items() for s in range(len(x) + 1)}
    got = sequence.reassemble(df, ["apid"], "pos", width).collect()
    assert {(r["apid"], r["segment"]): r["lengths"] for r in got} == {k: v for k, v in segments.items() if v}


def lines_of(spark, frames):
    return spark.createDataFrame([(k, i, row.tolist()) for k, f in frames.items() for i, row in enumerate(f)], "band int, line int, samples array<int>").repartition(7)


@pytest.mark.parametrize("levels", [1, 3])
def test_wavelets_of_any_size_are_undone_exactly(spark, levels, monkeypatch):
    monkeypatch.setattr(wavelets, "BLOCK", 3)
    rng = np.random.default_rng(levels)
    frames = {k: rng.integers(-5_000, 5_000, shape) for k, shape in enumerate([(1, 1), (2, 3), (9, 5), (40, 17), (64, 8), (23, 33)])}
    bands = wavelets.forward(lines_of(spark, frames), ["band"], levels)
    back = {k: np.zeros_like(f) for k, f in frames.items()}
    rows = wavelets.inverse(bands, ["band"], levels).collect()
    assert len(rows) == sum(len(f) for f in frames.values())
    for r in rows:
        back[r["band"]][r["line"]] = r["samples"]
    assert all((back[k] == f).all() for k, f in frames.items())


def test_blocks_of_lines_equal_whole_columns(spark, monkeypatch):
    """One level against the kernel along both axes of the whole frame."""
    monkeypatch.setattr(wavelets, "BLOCK", 4)
    frame = np.random.default_rng(0).integers(0, 4_096, (50, 16))
    lo, hi = wavelets.lift(frame)
    want = {n: x.T for n, x in zip(("LL1", "LH1", "HL1", "HH1"), (*wavelets.lift(lo.T), *wavelets.lift(hi.T)), strict=True)}
    got = wavelets.forward(lines_of(spark, {0: frame}), ["band"], 1).collect()
    assert all((want[r["subband"]][r["line"]] == r["samples"]).all() for r in got) and len(got) == 100


def test_lifting_by_hand():
    """Constant samples have no detail; a line of equal steps has none but where it is mirrored."""
    low, high = wavelets.lift(np.full((1, 8), 7))
    assert low.tolist() == [[7] * 4] and high.tolist() == [[0] * 4]
    low, high = wavelets.lift(np.arange(0, 32, 2)[None])
    assert high[0, 1:6].tolist() == [0] * 5 and (wavelets.unlift(low, high) == np.arange(0, 32, 2)).all()
