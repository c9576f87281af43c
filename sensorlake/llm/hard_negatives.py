"""Hard-negative mining by a secondary-sort shuffle.

1. Rows are scored against the anchors in blocks: a pass broadcasts a bounded group of anchors and reads all rows, so no vector is shuffled for a
   score. A task keeps, of each anchor, the first rows of its label that it has.
2. These scores are packed into (anchor, descending score, id) keys, dealt out by anchor and sorted within partitions; an iterator takes the first
   ones of each anchor: its positives.
3. The anchors go out again with their positives. A task keeps, of each positive, the first rows of another label inside the positive's window. What
   it drops has enough rows of its own task before it, so no result is lost.
4. Positives and negatives are packed into (anchor, descending score, positives first, id) keys, dealt out by anchor and sorted within partitions. An
   iterator reads them once: a positive opens a window, a negative is given out for each open window that takes it, and a window closes when it is
   full or the scores have passed it. It holds the open windows of one anchor, never the anchor's rows.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; rows that share an id are one row, that of
the smallest (label, vector); vectors of unequal length are filled up with zeros; an anchor without positives, and a positive without negatives,
give no rows; an empty table gives no rows; other columns are ignored. Scores are exact whole numbers; from 2**46 on the job raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sensorlake.llm.common import written
from sensorlake.llm.vectors import kept_rows, matrix

MOST_ANCHORS = 16_384  # of one pass, about
MOST_BYTES = 16 << 20  # of the anchors' vectors in one pass, about
AT_ONCE = 1 << 20  # scores that a task holds at a time
LARGEST = 1 << 46
NONE = np.iinfo(np.int64).min


class Anchors:
    """A group of anchors: ids, labels, vectors, and for each of them the window (low, high) of each positive."""

    def __init__(self, rows: pa.Table, width: int):
        self.ids = rows.column("id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.vectors = matrix(rows.column("v").combine_chunks(), width)
        self.windows = np.zeros((2, len(self.ids), 0), np.int64)

    def open(self, found: pa.Table, most: int, percents: tuple[int, int]) -> None:
        """found: anchor_id, rank (from 0), score. A window that no positive opens takes nothing."""
        low, high = np.full((len(self.ids), most), 1, np.int64), np.zeros((len(self.ids), most), np.int64)
        order = np.argsort(self.ids)
        at = order[np.searchsorted(self.ids[order], found.column("anchor_id").to_numpy())]
        rank, score = found.column("rank").to_numpy(), found.column("score").to_numpy()
        low[at, rank], high[at, rank] = -(-percents[0] * score // 100), percents[1] * score // 100
        self.windows = np.stack([low, high])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b; floats hold them exactly up to the limit."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= LARGEST:
        raise OverflowError("components are too large for exact scores")
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _first(ranked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `most` largest values of each row, but for NONE."""
    if ranked.shape[1] > most:
        at = np.argpartition(ranked, -most, axis=1)[:, -most:]
    else:
        at = np.broadcast_to(np.arange(ranked.shape[1]), ranked.shape)
    row = np.repeat(np.arange(len(ranked)), at.shape[1])
    at = at.ravel()
    there = ranked[row, at] != NONE
    return row[there], at[there]


def _same_label(anchors: Anchors, part: slice, s: np.ndarray, ranked: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int) -> list[tuple]:
    fits = (anchors.labels[part, None] == labels) & (anchors.ids[part, None] != ids)
    row, at = _first(np.where(fits, ranked, NONE), most)
    return [(row, np.zeros(len(row), np.int64), at)]


def _in_windows(anchors: Anchors, part: slice, s: np.ndarray, ranked: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int) -> list[tuple]:
    out, other = [], anchors.labels[part, None] != labels
    for k in range(anchors.windows.shape[2]):
        low, high = anchors.windows[:, part, k]
        row, at = _first(np.where(other & (s >= low[:, None]) & (s <= high[:, None]), ranked, NONE), most)
        out.append((row, np.full(len(row), k), at))
    return out


def _thinned(x: np.ndarray, most: int) -> np.ndarray:
    """Columns of x (anchor's place, window, score, id) that are among the first `most` of their anchor and window."""
    x = x[:, np.lexsort((x[3], -x[2], x[1], x[0]))]
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    rank = np.arange(x.shape[1]) - np.repeat(starts, np.diff(np.append(starts, x.shape[1])))
    return x[:, rank < most]


def _scored(rows: DataFrame, anchors: Anchors, pick: Callable, most: int) -> DataFrame:
    """anchor_id, score, id of the rows that a task picks: at most `most` of each anchor and window."""
    given, width = rows.sparkSession.sparkContext.broadcast(anchors), anchors.vectors.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = given.value
        kept = np.zeros((4, 0), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 8_192):
                block = batch.slice(begin, 8_192)
                order = np.argsort(block.column(0).to_numpy(), kind="stable")
                ids, labels = block.column(0).to_numpy()[order], block.column(1).to_numpy()[order]
                x, n = matrix(block.column(2), width)[order], len(order)
                step, got = max(1, AT_ONCE // n), [kept]
                for at in range(0, len(anchors.ids), step):
                    part = slice(at, at + step)
                    s = _products(anchors.vectors[part], x)
                    ranked = s * n + np.arange(n - 1, -1, -1)  # ties by smaller id
                    got += [np.stack([row + at, window, s[row, place], ids[place]]) for row, window, place in pick(anchors, part, s, ranked, ids, labels, most)]
                kept = _thinned(np.concatenate(got, axis=1), most)
        out = np.unique(np.stack([anchors.ids[kept[0]], kept[2], kept[3]]), axis=1) if kept.shape[1] else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["anchor_id", "score", "id"])

    return rows.select("id", "label", "v").mapInArrow(score, "anchor_id long, score long, id long")


def _sorted_by_key(pairs: DataFrame, *more: str) -> DataFrame:
    """The secondary sort: an anchor's pairs lie together in one partition, by descending score, then `more`."""
    return pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), *more)


def _first_of_each(pairs: DataFrame, most: int) -> DataFrame:
    """anchor_id, positive_id, score, rank (from 0) of the first `most` of each anchor."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            out = []
            for anchor, score, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last, rank = (anchor, 0) if anchor != last else (last, rank + 1)
                if rank < most:
                    out.append((anchor, row, score, rank))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, ["anchor_id", "positive_id", "score", "rank"])

    return _sorted_by_key(pairs, "id").select("anchor_id", "score", "id").mapInArrow(take, "anchor_id long, positive_id long, score long, rank long")


def _negatives(keys: DataFrame, most: int, percents: tuple[int, int]) -> DataFrame:
    """keys: anchor_id, score, kind (0 for a positive, 1), id. One row for each positive and negative that its window takes."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, windows = None, None, []
        for batch in batches:
            out = []
            for anchor, score, kind, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    last, seen, windows = anchor, None, []
                if kind == 0:
                    windows.append([row, score, 0])
                elif (score, row) != seen:  # several tasks and windows may have picked one row
                    seen = (score, row)
                    windows = [w for w in windows if w[2] < most and percents[0] * w[1] <= 100 * score]
                    for w in windows:
                        if 100 * score <= percents[1] * w[1]:
                            w[2] += 1
                            out.append((anchor, w[0], w[2], row, w[1], score))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6, names)

    return _sorted_by_key(keys, "kind", "id").select("anchor_id", "score", "kind", "id").mapInArrow(stream, ", ".join(f"{n} long" for n in names))


def mine(df: DataFrame, anchors: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, percents: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows are anchors, by the columns id and label.
    A negative's score lies between the two percentages of its positive's."""
    rows = kept_rows(df, id_col, vec_col, label_col).where("id IS NOT NULL AND label IS NOT NULL")
    label = F.col("label").cast("long") if isinstance(rows.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    rows = rows.select("id", label.alias("label"), "v").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    rows = written(rows, "negatives-rows")
    asked = rows.where(anchors)
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, 1)
    groups = max(1, -(-n // MOST_ANCHORS), -(-n * width * 8 // MOST_BYTES))
    mine_of = lambda c, g: F.pmod(F.xxhash64(c), F.lit(groups)) == g
    given = lambda g: Anchors(asked.where(mine_of("id", g)).toArrow(), width)  # noqa: E731  a bounded group at a time

    def passes(each: Callable[[int], DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [written(each(g), name) for g in range(groups)])

    near = passes(lambda g: _scored(rows, given(g), _same_label, positives), "negatives-near")
    found = written(_first_of_each(near, positives), "negatives-positives")

    def with_windows(g: int) -> Anchors:
        out = given(g)
        out.open(found.where(mine_of("anchor_id", g)).toArrow(), positives, percents)
        return out

    far = passes(lambda g: _scored(rows, with_windows(g), _in_windows, negatives), "negatives-far")
    keys = found.select("anchor_id", "score", F.lit(0).alias("kind"), F.col("positive_id").alias("id")).unionByName(far.withColumn("kind", F.lit(1)))
    return _negatives(keys, negatives, percents).withColumn("rank", F.col("rank").cast("int"))
