"""SimHash near duplicates against brute force, and on awkward tables."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sensorlake.llm import simhash

SF = "/root/testdata/sf0.001"


def fingerprint_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(fps, limit):
    """The least value that links reach, for each value."""
    label = {f: f for f in fps}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    values = sorted(label)
    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= limit:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {f: top(f) for f in values}


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], fingerprint_by_hand(r["text"])) for r in docs.collect()]
    label = classes_by_hand({f for _, f in rows}, 4)
    least = {}
    for i, f in rows:
        least[label[f]] = min(i, least.get(label[f], i))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", least[label[f]]) for i, f in rows)


def near(rng, f, most):
    for b in rng.sample(range(64), rng.randrange(most + 1)):
        f ^= 1 << b
    return f


def joined(links):
    return {(min(a, b), max(a, b)) for a, b in ((r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in links)}


@pytest.mark.parametrize(("seed", "limit"), [(0, 4), (1, 4), (2, 4), (3, 1), (4, 2), (5, 6)])
def test_links_join_what_brute_force_joins(spark, seed, limit, monkeypatch):
    """Balls around a few centres, correlated bits, a constant part that all share, and groups that are dealt out to blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(seed)
    common = rng.getrandbits(20) << 44 if seed % 2 else None
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {near(rng, c, limit + 3) for c in centres for _ in range(12)} | {near(rng, centres[0], 5) for _ in range(300)}
    if common is not None:
        fps = {f & (1 << 44) - 1 | common for f in fps}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    parts = simhash.plan(df, len(fps), limit)
    assert sorted(b for p, _ in parts for b in p) == sorted(set(b for p, _ in parts for b in p))
    got = joined(simhash.links(df, parts, limit).collect())
    assert all((a ^ b).bit_count() <= limit for a, b in got)
    label = {f: f for f in fps}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in got:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    assert {f: top(f) for f in fps} == classes_by_hand(fps, limit)


@pytest.mark.parametrize("t", range(5))
def test_values_within_a_threshold_share_a_probe(t):
    rng = random.Random(t)
    part = sorted(rng.sample(range(64), 11))
    masks = simhash.probes(part, t)
    for d in range(t + 1):
        for _ in range(30):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(part, d):
                y ^= 1 << b
            y ^= rng.getrandbits(64) & ~simhash._mask(part)
            reach = lambda z: {((z ^ f) & k, k) for f, k in masks}
            assert reach(x) & reach(y)
    assert simhash.probes(part, -1) == []


def test_thresholds_are_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(20):
        costs = [{t: 0.0 if t < 0 else rng.random() * 4**t for t in range(-1, 5)} for _ in range(3)]
        cost, ts = simhash.allotted(costs, 2)
        every = [(sum(c[t] for c, t in zip(costs, (a, b, c_), strict=True)), [a, b, c_]) for a in range(-1, 5) for b in range(-1, 5) for c_ in range(-1, 5) if a + b + c_ == 2]
        assert sum(ts) == 2 and cost == pytest.approx(min(every)[0])


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4_000, 64))
    bits[:, [3, 17, 40, 63]] = bits[:, [3]]
    parts = simhash.correlated_parts((bits.T @ bits).astype(float), 4_000, 4)
    assert [len(p) for p in parts] == [16] * 4 and any({3, 17, 40, 63} <= set(p) for p in parts)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(str(i % 700) for i in range(5_000))
    whole = fingerprint_by_hand(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    assert simhash.fingerprint(text.encode().split(), 4, 42) == whole


def test_awkward(spark):
    rows = [(5, None), (2, ""), (3, " \n\t"), (None, "one two three four five"), (9, "ONE two three four five"), (9, "one two three four five"), (7, "x" * 70_000), (8, "é ü ß 中文 🙂 " * 50), (None, "quite another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "id": F.lit(None).cast("string"), "component_id": F.lit(1)})
    got = simhash.near_duplicates(df).collect()
    assert sorted((repr(r[0]), r[1], r[2]) for r in got if r[1] == "0" * 16) == [("2", "0" * 16, 2), ("3", "0" * 16, 2), ("5", "0" * 16, 2)]
    assert {r[0]: r[1] for r in got if r[0] in (7, 8)} == {i: f"{fingerprint_by_hand(t):016x}" for i, t in rows if i in (7, 8)}
    assert sorted(repr(r[2]) for r in got if r[0] in (None, 9)) == ["9", "9", "9", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert {r[2] for r in simhash.near_duplicates(df, limit=0).collect() if r[0] in (2, 3, 5)} == {2}
