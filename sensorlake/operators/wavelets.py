"""Integer 9/7 wavelet of whole frames, both axes and any number of levels, on line rows.

A level lifts every line along its samples where it lies, and then all lines along the columns: blocks of lines meet with the few lines around
them that the filter reaches, so no task holds a frame. Frames are filled up to multiples of 2**levels by repeating the last sample and line, and
the inverse cuts them back. Samples are whole numbers and every step can be undone exactly. Ends are mirrored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # pairs of lines that a group lifts
REACH = 3  # pairs of lines on either side of a block that its values depend on, both ways


def _mirrored(i: np.ndarray, m: int) -> np.ndarray:
    """Places of a sequence of m that is mirrored around its first and last one."""
    if m == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * (m - 1))
    return np.where(i > m - 1, 2 * (m - 1) - i, i)


def _between(even: Callable[[int], np.ndarray]) -> np.ndarray:
    """What the even samples around foretell of the odd one. even(k): those k places further on."""
    return (9 * (even(0) + even(1)) - (even(-1) + even(2)) + 8) >> 4


def _update(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return (2 - (before + own)) >> 2


def lift(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half along the last axis, of even length."""
    e, o = x[..., 0::2], x[..., 1::2]
    m = e.shape[-1]
    d = o - _between(lambda k: e[..., _mirrored(np.arange(m) + k, m)])
    return e - _update(np.concatenate([d[..., :1], d[..., :-1]], axis=-1), d), d


def unlift(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    m = s.shape[-1]
    e = s + _update(np.concatenate([d[..., :1], d[..., :-1]], axis=-1), d)
    out = np.empty((*s.shape[:-1], 2 * m), np.int64)
    out[..., 0::2], out[..., 1::2] = e, d + _between(lambda k: e[..., _mirrored(np.arange(m) + k, m)])
    return out


def _rows(c: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of lists of one length."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def _along_lines(lines: DataFrame, columns: list[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f on the samples of each line. Lines of one width go together."""

    def run(batches):
        for batch in batches:
            width = np.asarray(batch.column(0).value_lengths())
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                yield pa.RecordBatch.from_arrays([_lists(f(_rows(part.column(0)))), *part.columns[1:]], ["samples", *columns])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in columns)
    return lines.select("samples", *columns).mapInArrow(run, f"samples array<long>, {kinds}")


def _around(pair: str, m: str) -> Column:
    """Blocks that need a pair of lines: its own, and those whose reach it lies in. Ends are mirrored into the first and last block."""
    block = lambda p: F.floor(F.greatest(F.least(p, F.col(m) - 1), F.lit(0)) / BLOCK).cast("long")
    return F.array_distinct(F.array(block(F.col(pair) - REACH), block(F.col(pair)), block(F.col(pair) + REACH)))


def _by_blocks(pairs: DataFrame, keys: list[str], inputs: list[str], outputs: list[str], f: Callable[..., list[np.ndarray]]) -> DataFrame:
    """f(pair numbers that are there, m, samples of the inputs) for each block; only rows of the block's own pairs are given out."""
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keys)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        j, m, block = t.column("pair").to_numpy(), t.column("m")[0].as_py(), t.column("_block")[0].as_py()
        order = np.argsort(j)
        j = j[order]
        own = (j // BLOCK) == block
        got = [x[own] for x in f(j, m, *[_rows(t.column(c))[order] for c in inputs])]
        kept = t.take(pa.array(order[own]))
        return pa.table({**{k: kept.column(k) for k in keys}, "pair": kept.column("pair"), "m": kept.column("m"), **{n: _lists(x) for n, x in zip(outputs, got, strict=True)}})

    met = pairs.withColumn("_block", F.explode(_around("pair", "m")))
    return met.groupBy(*keys, "_block").applyInArrow(run, f"{kinds}, pair long, m long, " + ", ".join(f"{n} array<long>" for n in outputs))


def _neighbours(j: np.ndarray, m: int, x: np.ndarray) -> Callable[[int], np.ndarray]:
    """x of the pairs k further on. Pairs beyond the block's reach stand in by its last ones: what depends on them is not given out."""
    return lambda k: x[np.clip(np.searchsorted(j, _mirrored(j + k, m)), 0, len(j) - 1)]


def _lift_pairs(j: np.ndarray, m: int, e: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    d = o - _between(_neighbours(j, m, e))
    before = d[np.clip(np.searchsorted(j, np.maximum(j - 1, 0)), 0, len(j) - 1)]
    return [e - _update(before, d), d]


def _unlift_pairs(j: np.ndarray, m: int, s: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    before = d[np.clip(np.searchsorted(j, np.maximum(j - 1, 0)), 0, len(j) - 1)]
    e = s + _update(before, d)
    return [e, d + _between(_neighbours(j, m, e))]


def filled(lines: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """keys, line, samples, h (lines), w (samples of a line), filled up to multiples of 2**levels."""
    step = 1 << levels
    up = lambda n: (F.ceil(n / step) * step).cast("long")
    size = lines.groupBy(*keys).agg((F.max("line") + 1).cast("long").alias("h"), F.max(F.size("samples")).cast("long").alias("w"))
    x = lines.join(size, keys)
    more = F.when(F.col("line") == F.col("h") - 1, F.sequence(F.col("line").cast("long"), up(F.col("h")) - 1)).otherwise(F.array(F.col("line").cast("long")))
    wide = F.concat(F.transform("samples", lambda v: v.cast("long")), F.array_repeat(F.element_at("samples", -1).cast("long"), (up(F.col("w")) - F.size("samples")).cast("int")))
    return x.select(*keys, F.explode(more).alias("line"), wide.alias("samples"), "h", "w")


def forward(lines: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """keys, h, w, subband (HL1, LH1, HH1, ... and LL of the last level), line, samples. lines: keys, line (from 0, none missing), samples."""
    x, out = filled(lines, keys, levels), None
    given = [*keys, "h", "w"]
    x = x.withColumn("rows", (F.ceil(F.col("h") / (1 << levels)) * (1 << levels)).cast("long"))
    for level in range(1, levels + 1):
        x = _along_lines(x, [*given, "line", "rows"], lambda a: np.concatenate(lift(a), axis=1))
        pairs = x.groupBy(*given, F.floor(F.col("line") / 2).alias("pair"), (F.col("rows") / 2).cast("long").alias("m")).agg(F.max_by("samples", F.col("line") % 2 == 0).alias("e"), F.max_by("samples", F.col("line") % 2 == 1).alias("o"))
        both = _by_blocks(pairs, given, ["e", "o"], ["s", "d"], _lift_pairs)
        half = lambda c, second: F.slice(c, F.size(c) / 2 + 1 if second else F.lit(1), F.size(c) / 2)
        bands = F.array(*[F.struct(F.lit(f"{n}{level}").alias("subband"), half(c, second).alias("samples")) for n, c, second in (("HL", "s", True), ("LH", "d", False), ("HH", "d", True))])
        if level == levels:
            bands = F.array_append(bands, F.struct(F.lit(f"LL{level}").alias("subband"), half("s", False).alias("samples")))
        else:
            x = both.select(*given, F.col("pair").alias("line"), half("s", False).alias("samples"), F.col("m").alias("rows"))
        found = both.select(*given, "pair", F.explode(bands).alias("b")).select(*given, "b.subband", F.col("pair").alias("line"), "b.samples")
        out = found if out is None else out.unionByName(found)
    return out


def inverse(bands: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """keys, line, samples: the lines that forward() was given."""
    given = [*keys, "h", "w"]
    low = bands.where(F.col("subband") == f"LL{levels}").select(*given, "line", F.col("samples").alias("LL"))
    for level in range(levels, 0, -1):
        x = low
        for name in ("HL", "LH", "HH"):
            x = x.join(bands.where(F.col("subband") == f"{name}{level}").select(*given, "line", F.col("samples").alias(name)), [*given, "line"])
        m = (F.ceil(F.col("h") / (1 << levels)) * (1 << (levels - level))).cast("long")
        pairs = x.select(*given, F.col("line").alias("pair"), m.alias("m"), F.concat("LL", "HL").alias("s"), F.concat("LH", "HH").alias("d"))
        both = _by_blocks(pairs, given, ["s", "d"], ["e", "o"], _unlift_pairs)
        lines = both.select(*given, F.explode(F.array(F.struct((2 * F.col("pair")).alias("line"), F.col("e").alias("samples")), F.struct((2 * F.col("pair") + 1).alias("line"), F.col("o").alias("samples")))).alias("x")).select(*given, "x.line", "x.samples")
        low = _along_lines(lines, [*given, "line"], lambda a: unlift(a[:, : a.shape[1] // 2], a[:, a.shape[1] // 2 :])).withColumnRenamed("samples", "LL")
    return low.where("line < h").select(*keys, F.col("line"), F.slice("LL", F.lit(1), F.col("w").cast("int")).alias("samples"))
