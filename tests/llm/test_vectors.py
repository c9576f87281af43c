"""Hard negatives and vector codes against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import ball_kmeans, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit(1), "code": F.lit(None).cast("string")})


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def random_rows(seed, n, width=8, coarse=4, labels=3):
    rng = random.Random(seed)
    vec = lambda: [rng.randrange(-2, coarse) / 256 * 3 for _ in range(width)]
    rows = [(i, vec(), rng.randrange(labels)) for i in range(n)]
    hot = vec()
    rows += [(n + i, hot, 1) for i in range(n // 2)]
    return rows + [(10 * n, None, 1), (10 * n + 1, [None] * width, 1), (10 * n + 2, [float("nan")] * width, 0), (10 * n + 3, [float("inf")] * width, 0), (10 * n + 4, vec(), None), (None, vec(), 2)]


def negatives_by_hand(rows, every, positives=5, negatives=3):
    kept = sorted({(i, label, tuple(whole(v))) for i, v, label in rows if i is not None and label is not None and usable(v)}, reverse=True)
    kept = {i: (label, v) for i, label, v in kept}
    out = set()
    for a, (la, va) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, (label, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [(t, i) for t, i, label in scored if label != la and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit[:negatives], 1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, seed, monkeypatch):
    """With ties, a vector of many copies, repeated rows, and several passes of anchors."""
    monkeypatch.setattr(hard_negatives, "MOST_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 100)
    rows = random_rows(seed, 60)
    rows += rows[:5] + [(3, rows[9][1], 0)]
    got = hard_negatives.mine(table_of(spark, rows).repartition(5), F.col("id") % 4 == 0).collect()
    want = negatives_by_hand(rows, 4)
    assert len(got) == len(want) > 50 and set(map(tuple, got)) == want


def test_negatives_awkward(spark):
    empty = table_of(spark, [])
    assert hard_negatives.mine(empty, F.col("id") % 2 == 0).count() == 0
    alone = table_of(spark, [(2, [1.0], 0), (4, [1.0], 1), (5, None, 1)])
    assert hard_negatives.mine(alone, F.col("id") % 2 == 0).count() == 0
    ragged = table_of(spark, [(0, [0.5, 0.5], 0), (1, [0.5], 0), (2, [0.25, 0.25, 9.0], 1), (3, [], 1)])
    got = hard_negatives.mine(ragged, F.col("id") == 0).collect()
    assert not got  # 128 * 64 * 2 is 100 % of the positive's score: outside
    words = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.75], "b")], "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in hard_negatives.mine(words, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 49152)]
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(table_of(spark, [(0, [1e9], 0), (1, [1e9], 0)]), F.col("id") == 0).collect()


def codes_by_hand(rows, parts, entries, rounds):
    kept = sorted([(i is None, i or 0, whole(v), label) for i, v, label in rows if usable(v)], key=lambda r: r[:3])
    x = np.array([v for _, _, v, _ in kept], object).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[at[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    at, d = nearest()
    error = d.sum(axis=1)
    total = {}
    for (_, _, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted((repr(None if none else i), "".join(f"{c:02x}" for c in row), int(e), int(total[label]), digest) for (none, i, _, label), row, e in zip(kept, at, error, strict=True))


@pytest.mark.parametrize(("seed", "parts", "entries", "rounds"), [(0, 2, 5, 2), (1, 4, 16, 3), (2, 8, 3, 2), (3, 1, 40, 0), (4, 2, 200, 2)])
def test_codes_equal_brute_force(spark, seed, parts, entries, rounds):
    """With ties between entries, a vector of many copies, null labels and fewer rows than entries."""
    rows = random_rows(seed, 80, coarse=9)
    rows += rows[10:15]
    got = ball_kmeans.compressed(table_of(spark, rows).repartition(4), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == codes_by_hand(rows, parts, entries, rounds)


def test_cores_and_rings_leave_out_what_cannot_be_nearer():
    rng = np.random.default_rng(1)
    parts = rng.integers(-500, 500, (300, 4, 3))
    books = rng.integers(-500, 500, (4, 32, 3))
    balls = ball_kmeans.Balls(books)
    old = rng.integers(0, 32, (300, 4))
    code, least = balls.assign(parts, old)
    d = ((parts[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    assert (code == d.argmin(axis=2)).all() and (least == d.min(axis=2)).all()
    again, _ = balls.assign(parts, code)
    assert (again == code).all()
    radii = np.zeros((4, 32), np.int64)
    np.maximum.at(radii, (np.arange(4), code), least)
    small = ball_kmeans.Balls(books, radii)
    assert (small.assign(parts, code)[0] == code).all() and (small.apart == np.iinfo(np.int64).max).any()


def test_codes_awkward(spark):
    assert ball_kmeans.compressed(table_of(spark, []), parts=2, entries=4).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        ball_kmeans.compressed(table_of(spark, [(0, [1.0, 2.0, 3.0], 0)]), parts=2)
    got = ball_kmeans.compressed(table_of(spark, [(0, [1.0, 2.0], None), (1, [1.0], 0), (1, [1.0, 2.0], None), (1, [1.0, 2.0], None)]), parts=2, entries=4).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(0, "0000", 0, 0), (1, "0000", 0, 0), (1, "0000", 0, 0)]
