"""Stencils and shifts over blocks of lines: a pixel is sent to the blocks that need it (its own, and the next one near an edge), not to each of its neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
MOST_KERNEL = 10_000


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _keyed(t: pa.Table, keys: list[str], n: int) -> dict[str, pa.ChunkedArray]:
    return {k: t.column(k).take(pa.array(np.zeros(n, np.int64))) for k in keys}


def _column(t: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    return t.column(name).to_numpy().astype(kind)


def _dense(t: pa.Table, first: int, n_lines: int, width: int) -> np.ndarray:
    """Values by line and column; what is missing is not a number."""
    out = np.full((n_lines, width), np.nan)
    out[_column(t, "line") - first, _column(t, "col")] = _column(t, "v", np.float64)
    return out


def shifted_sums(a: DataFrame, b: DataFrame, keys: list[str], reach: int, block: int = BLOCK) -> DataFrame:
    """keys, shift, n, sx, sy, sxx, syy, sxy over pixels of a and those of b that stand `shift` lines below, for each shift within +-reach. A pixel stands once in a frame."""
    value = F.col("dn").cast("double").alias("v")
    at: Callable[[Column], Column] = lambda line: F.floor(line / block).cast("long")
    left = a.select(*keys, "line", "col", value, at(F.col("line")).alias("_block"))
    near = F.explode(F.sequence(at(F.col("line") - reach), at(F.col("line") + reach)))
    right = b.select(*keys, "line", "col", value, near.alias("_block"))
    shifts = np.arange(-reach, reach + 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = np.zeros((0, 6))
        if len(x) and len(y):
            first = int(x.column("_block")[0].as_py()) * block
            width = int(max(_column(x, "col").max(), _column(y, "col").max())) + 1
            p, q = _dense(x, first, block, width), _dense(y, first - reach, block + 2 * reach, width)
            rows = np.zeros((len(shifts), 6))
            for k in range(len(shifts)):
                other = q[k : k + block]
                both = ~(np.isnan(p) | np.isnan(other))
                u, v = p[both], other[both]
                rows[k] = len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v
        some = x if len(x) else y
        return pa.table({**_keyed(some, keys, len(rows)), "shift": pa.array(shifts[: len(rows)].astype(np.int32)), **{n: pa.array(rows[:, i]) for i, n in enumerate(names)}})

    by = [*keys, "_block"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _kinds(a, keys) + "shift int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy(*keys, "shift").agg(*[F.sum(n).alias(n) for n in names]).where("n > 0")


def convolve(pixels: DataFrame, kernel: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """keys, line, col, value: circular convolution with a kernel (dy, dx, w) of at most MOST_KERNEL entries; pixels that no other gives to are left out."""
    entries = [(r["dy"], r["dx"], r["w"]) for r in kernel.select("dy", "dx", "w").limit(MOST_KERNEL + 1).collect()]
    if len(entries) > MOST_KERNEL:
        raise ValueError("the kernel is too large")
    if not entries:
        return pixels.select(*keys, "line", "col", F.col(value).cast("double").alias(value)).where(F.lit(False))
    lowest, highest = min(e[0] for e in entries), max(e[0] for e in entries)
    size = pixels.groupBy(*keys).agg((F.max("line") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    to = F.transform(F.sequence(F.lit(lowest), F.lit(highest)), lambda dy: F.floor(F.pmod(F.col("line") + dy, F.col("_h")) / block).cast("long"))
    sent = pixels.join(size, keys).select(*keys, "line", "col", F.col(value).cast("double").alias("v"), "_h", "_w", F.explode(F.array_distinct(to)).alias("_block"))

    def run(t: pa.Table) -> pa.Table:
        first, height, width = (int(t.column(c)[0].as_py()) for c in ("_block", "_h", "_w"))
        first *= block
        line, col, v = _column(t, "line"), _column(t, "col"), _column(t, "v", np.float64)
        total, times = np.zeros(block * width), np.zeros(block * width, np.int64)
        for dy, dx, w in entries:
            to = (line + dy) % height - first
            here = (to >= 0) & (to < block)
            cell = to[here] * width + (col[here] + dx) % width
            total += np.bincount(cell, v[here] * w, block * width)
            times += np.bincount(cell, minlength=block * width)
        cell = np.flatnonzero(times)
        return pa.table({**_keyed(t, keys, len(cell)), "line": pa.array((first + cell // width).astype(np.int32)), "col": pa.array((cell % width).astype(np.int32)), value: pa.array(total[cell])})

    return sent.groupBy(*keys, "_block").applyInArrow(run, _kinds(pixels, keys) + f"line int, col int, `{value}` double")
