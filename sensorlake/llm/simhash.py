r"""SimHash near duplicates by the generalised pigeonhole principle.

1. Each text becomes a 64-bit fingerprint of its four-word shingles; equal fingerprints are one from here on.
2. Bits that agree or differ together over all fingerprints are grouped into parts. For thresholds t_i of the parts that sum to
   (limit - parts + 1), two fingerprints within the limit are within t_i in some part i; -1 leaves a part out. Candidates of a part and threshold
   are estimated from the counts of all its values and from how often its bits differ; a dynamic program allots the thresholds, and the number
   of parts is the one that costs least. Every choice gives the same links.
3. Probes: within an even threshold two values share a value that is half of it from both; within an odd one they do so with one place masked out.
   Rows that share a probe meet and are verified on all 64 bits. A probe that very many fingerprints share is dealt out to pairs of blocks.
4. A group that meets gives a spanning forest of its links, never all its pairs, and connected components give the classes.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; a text of fewer than four words is one
shingle; repeated rows get a row each; a row with a null id has the smallest id of its class, null where there is none; an empty table gives no
rows; other columns are ignored. Probes are compared by 64-bit hashes: an equal hash only adds a candidate, which is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import integer_ids, words, written
from sensorlake.llm.components import components

BITS = 64
AT_ONCE = 1 << 16  # shingles of a long text that are counted at a time
BLOCK = 4_096  # fingerprints of one probe that meet in one place; more are dealt out to pairs of blocks
SMALL = 8  # groups up to this size are compared by shifts of whole columns
ROW_COST, PAIR_COST = 1.0, 0.02  # microseconds that a probe's row and a candidate pair take, about


def fingerprint(tokens: list[bytes], n: int, seed: int) -> int:
    """Bits that are set in over half of the hashes of all n-word shingles, repeats included."""
    if not tokens:
        return 0
    m = min(n, len(tokens))
    text, total = b" ".join(tokens), len(tokens) - m + 1
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:total].tolist(), ends[m - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, total, AT_ONCE):
        parts = map(text.__getitem__, map(slice, starts[at : at + AT_ONCE], ends[at : at + AT_ONCE]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, min(AT_ONCE, total - at))
        counts += np.add.reduce(_bits(h), axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _bits(x: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each number, lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, seed: int = 42) -> DataFrame:
    """id, fp (the 64 bits as a long) of each row; no shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                fp = np.array([fingerprint(words(t), n, seed) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    docs = df.select(integer_ids(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(make, "id long, fp long")


# Parts and thresholds


def _together(fps: DataFrame) -> np.ndarray:
    """How many of all fingerprints have bits i and j set, as a 64 x 64 matrix: summed in the tasks, then in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            b = _bits(batch.column(0).to_numpy()).astype(np.float64)
            total += b.T @ b
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])

    out = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 4,096 rows
        out[r["at"]] = r["n"]
    return out.reshape(BITS, BITS)


def correlated_parts(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m parts of nearly equal size; each part takes the bits that correlate most with those it has."""
    p = together.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(strength, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, parts))) // (m - k)
        part = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (strength[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def probes(part: list[int], t: int) -> list[tuple[int, int]]:
    """(flip, keep) masks of a part: values within t of each other share (value ^ flip) & keep for some of them."""
    if t < 0:
        return []
    whole, flips = _mask(part), [c for r in range(t // 2 + 1) for c in combinations(part, r)]
    if t % 2 == 0:
        return [(_mask(f), whole) for f in flips]
    return [(_mask(f), whole & ~(1 << b)) for f in flips for b in part if b not in f]


def _same_pairs(fps: DataFrame, choices: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each choice and part how many pairs of fingerprints have equal values there."""
    tags = [(m, i) for m, parts in choices.items() for i in range(len(parts))]
    values = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(choices[m][i]))).cast("long")).alias("v")) for k, (m, i) in enumerate(tags)]
    counts = fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").cast("double").alias("c"))
    got = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("n")).collect()}
    return {tag: got.get(k, 0.0) for k, tag in enumerate(tags)}


def _within(differ: np.ndarray, most: int) -> np.ndarray:
    """Probabilities that at most 0, 1, ... `most` bits differ, each by its own probability."""
    p = np.zeros(most + 1)
    p[0] = 1.0
    for q in differ:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)


def allotted(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """One threshold for each part, of the given sum and the least cost in all, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for of_part in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in of_part.items():
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*ts, t])
        best = nxt
    return best[total]


def plan(fps: DataFrame, n: int, limit: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, from counts over all n fingerprints."""
    together = _together(fps)
    choices = {m: correlated_parts(together, n, m) for m in range(2, limit + 2)} or {1: [list(range(BITS))]}
    same = _same_pairs(fps, choices)
    p = together.diagonal() / max(n, 1)
    found = []
    for m, parts in choices.items():
        costs = []
        for i, part in enumerate(parts):
            within = _within(2 * p[part] * (1 - p[part]), limit)
            base = max(same[m, i], n * n / 2 * within[0])
            pairs = [min(base * w / max(within[0], 1e-300), n * n / 2) for w in within]
            costs.append({-1: 0.0} | {t: ROW_COST * n * len(probes(part, t)) + PAIR_COST * pairs[t] for t in range(min(limit, 4) + 1)})
        cost, ts = allotted(costs, limit - m + 1)
        found.append((cost, m, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(found)[2]


# Groups that meet


def _forest(fp: np.ndarray, limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what belongs together in one group; a fingerprint that is reached is not compared again as a target."""
    us, vs, left = [], [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(left ^ u) <= limit
            if near.any():
                reached, left = left[near], left[~near]
                us.append(np.full(len(reached), u, np.uint64))
                vs.append(reached)
                queue += list(reached)
    return us, vs


def _links(key: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys."""
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= SMALL, sizes)
    for k in range(1, SMALL):
        i = np.flatnonzero(small[:-k] & (key[:-k] == key[k:])) if len(key) > k else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= limit]
        us.append(fp[i])
        vs.append(fp[i + k])
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = _forest(np.unique(fp[s : s + size]), limit)
        us += a
        vs += b
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, parts: list[tuple[list[int], int]], limit: int) -> DataFrame:
    """u, v: links that join all fingerprints (distinct, column fp) within the limit."""
    each = [(_signed(flip), _signed(keep)) for part, t in parts for flip, keep in probes(part, t)]
    masks = F.array(*[F.struct(F.lit(flip).cast("long").alias("flip"), F.lit(keep).cast("long").alias("keep")) for flip, keep in each])
    rows = fps.select("fp", F.explode(masks).alias("m"))
    # Masks tell parts and masked places apart; flips lead to one place.
    rows = rows.select("fp", F.xxhash64(F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.col("m.keep")), F.col("m.keep")).alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = written(crowded.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-crowded")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    dealt = F.expr("CASE WHEN blocks IS NULL THEN array(key) ELSE transform(sequence(0, blocks - 1), q -> xxhash64(key, least(own, q), greatest(own, q))) END")
    met = rows.join(crowded, "key", "left").withColumn("own", own).select("fp", F.explode(dealt).alias("key")).repartition("key").sortWithinPartitions("key")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            done = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if done:
                u, v = _links(key[:done], fp[:done], limit)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
            key, fp = key[done:], fp[done:]
        if len(key):
            u, v = _links(key, fp, limit)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return met.select("key", "fp").mapInArrow(check, "u long, v long").where("u <> v")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, seed: int = 42, limit: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the smallest id that links reach): a row per input row."""
    if not 0 <= limit <= 8:
        raise ValueError("limit must be from 0 to 8 bits")
    docs = written(fingerprints(df, id_col=id_col, text_col=text_col, n=n, seed=seed), "simhash-fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    if limit:
        found = components(links(fps, plan(fps, fps.count(), limit), limit), "simhash-components")
        named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
        fps = written(named.join(ids, "component").select("fp", "component_id"), "simhash-classes")
    else:
        fps = fps.withColumnRenamed("least", "component_id")
    return docs.join(fps, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
