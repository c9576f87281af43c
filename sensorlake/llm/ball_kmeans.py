"""Vector code compression: product codes with codebooks by ball k-means.

A vector is cut into equal consecutive parts; each part position has a codebook whose entries are the centres of balls. In a round every part
starts from the entry that it had before. Entries that are not closer to that entry than twice its ball's radius can take none of the ball's parts:
the others are its neighbours, sorted by distance. With d the part's distance to its own entry and D_1 <= D_2 <= ... those to the neighbours, only the
neighbours with D_i <= 2 d can be as near as the own entry. So a part inside half of D_1 (the stable core) skips all work, and one in the ring
between half of D_i and half of D_i+1 is compared with i neighbours only. Distances are squared whole numbers, so the result is exactly that of
comparing all entries, with ties to the lower index.

A round is one pass over the rows: the entries (parts x entries x components, a fixed size) are broadcast, tasks write the codes beside the vectors,
and sums, counts and radii are added up in Spark.

Defined results: rows with a null vector or a null or non-finite component are dropped, as are vectors of another length than that of the first kept
row (smallest id, then smallest vector; the length must be a multiple of the number of parts); null ids are kept but come last when the first
entries are taken; with fewer rows than entries there are as many entries as rows; repeated rows get a row each; an empty table gives no rows; other
columns are ignored. Components and sums must stay within 64-bit whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import written
from sensorlake.llm.vectors import kept_rows, matrix


class Balls:
    """Codebooks of all part positions: entries [position, entry, component] and each ball's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray | None = None):
        """radii: squared upper bounds [position, entry]; without them every entry is a neighbour of every ball."""
        self.entries = entries
        p, k, _ = entries.shape
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(axis=3)  # [position, ball, entry]
        apart[:, np.arange(k), np.arange(k)] = -1  # the ball itself comes first and is left out
        order = np.argsort(apart, axis=2, kind="stable")[:, :, 1:]
        far = np.take_along_axis(apart, order, axis=2)
        if radii is not None:
            far[far > 4 * radii[:, :, None]] = np.iinfo(np.int64).max  # no neighbours
        self.neighbours, self.apart = order.reshape(p * k, max(k - 1, 0)), far.reshape(p * k, max(k - 1, 0))

    def assign(self, parts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """parts [row, position, component], codes [row, position] of the round before. New codes and squared distances."""
        n, p, width = parts.shape
        k = self.entries.shape[1]
        flat, entries = parts.reshape(n * p, width), self.entries.reshape(p * k, width)
        base = np.tile(np.arange(p) * k, n)
        ball = base + codes.ravel()
        least = ((flat - entries[ball]) ** 2).sum(axis=1)
        best, limit = ball.copy(), 4 * least
        active = np.arange(n * p)
        for i in range(k - 1):  # rings: parts that reach the i-th neighbour of their ball
            active = active[self.apart[ball[active], i] <= limit[active]]
            if not len(active):
                break
            entry = base[active] + self.neighbours[ball[active], i]
            d = ((flat[active] - entries[entry]) ** 2).sum(axis=1)
            nearer = (d < least[active]) | ((d == least[active]) & (entry < best[active]))
            at = active[nearer]
            least[at], best[at] = d[nearer], entry[nearer]
        return (best - base).reshape(n, p), least.reshape(n, p)


def _assigned(rows: DataFrame, balls: Balls, p: int) -> DataFrame:
    """rows (id, label, v, code) with new codes, a byte a part, and the row's error."""
    given, kind = rows.sparkSession.sparkContext.broadcast(balls), rows.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = given.value
        width = balls.entries.shape[0] * balls.entries.shape[2]
        for batch in batches:
            parts = matrix(batch.column(2), width).reshape(batch.num_rows, p, -1)
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, p).astype(np.int64)
            codes, d = balls.assign(parts, old)
            text = codes.astype(np.uint8).tobytes()
            codes_out = pa.array([text[i : i + p] for i in range(0, len(text), p)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], codes_out, pa.array(d.sum(axis=1))], ["id", "label", "v", "code", "error"])

    return rows.select("id", "label", "v", "code").mapInArrow(assign, f"id long, label {kind}, v array<long>, code binary, error long")


def _moved(rows: DataFrame, balls: Balls) -> Balls:
    """The balls with each entry at the floor of its parts' mean, and upper bounds of their radii. Tasks add up; at most positions x entries rows arrive."""
    p, k, width = balls.entries.shape
    given = rows.sparkSession.sparkContext.broadcast(balls.entries)
    sums = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = given.value.reshape(p * k, width)
        total, radius = np.zeros((p * k, width + 1), np.int64), np.full(p * k, -1, np.int64)
        for batch in batches:
            parts = matrix(batch.column(0), p * width).reshape(-1, width)
            at = (np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, p) + np.arange(p) * k).ravel()
            np.add.at(total, at, np.column_stack([parts, np.ones(len(at), np.int64)]))
            np.maximum.at(radius, at, ((parts - entries[at]) ** 2).sum(axis=1))
        used = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, radius[used], total[used, width], *total[used, :width].T)], ["at", "radius", "n", *sums])

    schema = "at long, radius long, n long, " + ", ".join(f"{s} long" for s in sums)
    got = rows.select("v", "code").mapInArrow(add, schema).groupBy("at").agg(F.max("radius").alias("radius"), *[F.sum(c).alias(c) for c in ["n", *sums]]).collect()
    entries, radii = balls.entries.reshape(p * k, width).copy(), np.zeros(p * k, np.int64)
    for r in got:
        mean = [r[s] // r["n"] for s in sums]
        shift = sum((a - int(b)) ** 2 for a, b in zip(mean, entries[r["at"]], strict=True))
        radii[r["at"]] = int(np.ceil(np.sqrt(float(r["radius"])) + np.sqrt(float(shift)) + 1e-6)) ** 2  # by the triangle inequality
        entries[r["at"]] = mean
    return Balls(entries.reshape(p, k, width), radii.reshape(p, k))


def codes(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """id, label, v, code (a byte a part), error of each kept row; and the codebooks [position, entry, component]."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: at most 256 entries")
    rows = kept_rows(df, id_col, vec_col, label_col)
    order = [F.asc_nulls_last("id"), "v"]
    first = rows.orderBy(*order).select("v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    if width % parts or (first and not width):
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == width)
    start = np.array([r["v"] for r in rows.orderBy(*order).select("v").limit(entries).collect()], np.int64).reshape(-1, parts, width // parts or 1)
    balls = Balls(np.ascontiguousarray(start.transpose(1, 0, 2)))
    now = rows.withColumn("code", F.lit(bytes(parts)))
    for r in range(rounds + 1):
        now = written(_assigned(now, balls, parts), f"codes-{r}")
        if r < rounds:
            balls = _moved(now, balls)
    return now, balls.entries


def compressed(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """id_col, code (two hex digits a part), error, label_error (error of all rows of the label, nulls together), codebooks_sha256."""
    rows, books = codes(df, id_col=id_col, vec_col=vec_col, label_col=label_col, parts=parts, entries=entries, rounds=rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = rows.alias("r").join(of_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return both.select(F.col("r.id").alias(id_col), F.lower(F.hex("r.code")).alias("code"), "r.error", "l.label_error", F.lit(digest).alias("codebooks_sha256"))
