"""N-gram Jaccard self-join by grouped prefixes.

1. Shingles that are frequent in some batch of documents are counted; the most frequent ones (a bounded list) stand last in the
   global order of shingles, the others come before them by hash. Any order gives the same links.
2. Each document becomes its set size, a hash of its set and its prefix: linked sets share a shingle of their prefixes.
3. Documents with one prefix and size form a group. Groups that share a prefix shingle and pass the filters by size and by the
   number of shared prefix shingles are candidates; a group's members are expanded and verified with their full sets.
4. Links between equal sets need no check. First every set is verified against the pivots it shares most with, which joins most
   copies; then all pairs whose members are still in different components are verified, so none that matters is left.
   A pair inside one component cannot change the components. Connected components give the class of each document.

Defined results: a text without words (null, empty, blank) has an empty set and is linked with nothing; rows with a null id
are linked with nothing and have a null component; rows that share an id are one document, linked by each of their
texts; an empty table gives no rows; other columns are ignored. Shingles and sets are compared by 64- and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sensorlake.llm.common import fresh, integer_ids, most_frequent, shingles, word_codes, words, written
from sensorlake.llm.components import components

HOT_IN_BATCH = 8  # a shingle in so many documents of a batch is counted
MOST_HOT = 1 << 18  # at most so many frequent shingles are broadcast (16 bytes each)
MOST_BLOOM_BITS = 1 << 29  # 64 MB: beyond 33 million ids more texts pass the filter; the join that follows it decides


def _sets(texts: list, n: int) -> list[np.ndarray]:
    return [shingles(word_codes(words(t)), n) for t in texts]


def _hot_counts(docs: DataFrame, n: int) -> DataFrame:
    """h, c: shingles that HOT_IN_BATCH documents of a batch have, and in how many documents of such batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                got = _sets(batch.column(1).slice(at, 2_000).to_pylist(), n)
                h, c = np.unique(np.concatenate(got), return_counts=True)
                hot = c >= HOT_IN_BATCH
                yield pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(c[hot].astype(np.int64))], ["h", "c"])

    return docs.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _prefixes(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """id, n, set_hash, prefix. hot: frequent shingles from rare to frequent."""
    at_hot = np.argsort(hot)
    given = docs.sparkSession.sparkContext.broadcast((hot[at_hot], at_hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                sizes, hashes, prefixes = [], [], []
                for s in _sets(part.column(1).to_pylist(), n):
                    sizes.append(len(s))
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    if len(known) and len(s):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        frequent = known[i] == s
                        s = np.concatenate([s[~frequent], s[frequent][np.argsort(rank[i[frequent]])]])
                    prefixes.append(s[:keep])
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), lists], ["id", "n", "set_hash", "prefix"])

    return docs.mapInArrow(cut, "id long, n long, set_hash binary, prefix array<long>")


def _bloom(ids: DataFrame, size: int) -> np.ndarray:
    """A bit for each id's hash, `size` in all."""
    h = F.pmod(F.xxhash64("id"), F.lit(size))
    rows = ids.select(F.expr("id").alias("id")).select(F.shiftright(h, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {size}) & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return bits


def _full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, s (sorted shingles) of the documents in ids, which are distinct. The text of others is dropped at the scan by a Bloom filter."""
    size = min(MOST_BLOOM_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    given = docs.sparkSession.sparkContext.broadcast(_bloom(ids, size))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = given.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            there = np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
            for at in range(0, len(there), 1_000):
                part = batch.take(pa.array(there[at : at + 1_000]))
                got = _sets(part.column(1).to_pylist(), n)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).view(np.int64)))], ["id", "s"])

    placed = docs.where("id IS NOT NULL").withColumn("place", F.pmod(F.xxhash64("id"), F.lit(size)))
    return placed.mapInArrow(make, "id long, s array<long>").join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (u, v) of distinct documents that link. Sets go to the pair's u; those of v are met there."""
    pairs = written(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    full = written(_full_sets(docs, written(ids, f"{name}-ids"), n), f"{name}-sets")
    met = pairs.join(full.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(full.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            av, bv = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
            ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    return met.select("u", "v", "su", "sv").mapInArrow(check, "u long, v long")


def _sizes(percent: int) -> str:
    """Size filter of two postings a and b."""
    return f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"


def _reaches(percent: int, shared: str, a: str, b: str, part: int = 1) -> str:
    """Count filter: shared prefix shingles and all that lies behind the shorter reach of two prefixes suffice for a link. part: of the needed number."""
    behind = lambda n: f"(cast(ceil({percent} * {n} / 100.0D) AS long) - 1)"  # noqa: E731  sizes less prefix lengths
    return f"{100 + percent} * ({part} * {shared} + greatest({behind(a)}, {behind(b)})) >= {percent} * ({a} + {b})"


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id: a row per input row."""
    spark = df.sparkSession
    docs = df.select(integer_ids(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hot = most_frequent(written(_hot_counts(docs, n), "jaccard-hot"), "c", MOST_HOT).toPandas().sort_values(["c", "h"])
    sets = written(_prefixes(docs, n, percent, hot["h"].to_numpy(np.int64).view(np.uint64)), "jaccard-prefixes")

    some = sets.where("n > 0 AND id IS NOT NULL").withColumn("gid", F.xxhash64("prefix", "n"))
    classes = written(some.groupBy("set_hash", "gid", "n").agg(F.min("id").alias("rep")), "jaccard-classes")  # one row a distinct set
    groups = some.groupBy("gid", "n").agg(F.first("prefix").alias("prefix"), F.min("id").alias("rep"))
    lists = groups.select("gid", F.col("n").cast("int").alias("n"), "rep", F.explode("prefix").alias("t"))
    # A shingle of one group alone proposes nothing.
    lists = lists.withColumn("k", F.count("*").over(_by("t"))).where("k > 1").drop("k")
    lists = written(lists, "jaccard-postings")

    # Each set against the pivots (the first member of a shingle's list, by size band; a group's first set) it shares most with.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    pivots = lists.withColumn("band", band).groupBy("t", "band").agg(F.min(F.struct("rep", "n")).alias("p")).select("t", "band", F.col("p.rep").alias("v"), F.col("p.n").alias("m"))
    votes = lists.withColumn("band", band).join(pivots, ["t", "band"]).where("rep <> v").groupBy("rep", "n", "v", "m").count()
    votes = votes.where(_reaches(percent, "count", "n", "m", part=2))  # some shared lists have another pivot
    best = votes.groupBy("rep").agg(F.max(F.struct("count", F.negate("v").alias("v"))).alias("b")).select(F.col("rep").alias("u"), F.negate(F.col("b.v")).alias("v"))
    inside = classes.join(classes.groupBy("gid", "n").agg(F.min("rep").alias("v")), ["gid", "n"]).where("rep <> v").select(F.col("rep").alias("u"), "v")
    copies = sets.where("n > 0 AND id IS NOT NULL").join(classes, "set_hash").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    links = written(copies.unionByName(_verified(best.unionByName(inside).distinct(), docs, n, percent, "jaccard-first")), "jaccard-links")
    found = components(links, "jaccard-components")

    # All candidate pairs that are still in different components.
    label = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    member = classes.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    member = written(member.select("gid", "n", "rep", "comp"), "jaccard-members")
    spread = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = lists.select("gid", "n", "t").join(spread, "gid").withColumns({"l": F.min("lo").over(_by("t")), "h": F.max("hi").over(_by("t"))}).where("l < h").drop("l", "h")
    mixed = written(mixed, "jaccard-mixed")
    near = mixed.alias("a").join(mixed.alias("b"), F.expr(f"a.t = b.t AND a.gid < b.gid AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AND {_sizes(percent)}"))
    near = near.groupBy(F.col("a.gid").alias("g1"), F.col("b.gid").alias("g2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2")).count()
    near = near.where(_reaches(percent, "count", "n1", "n2")).select("g1", "g2")
    one = member.select(F.col("gid").alias("g1"), F.col("rep").alias("u"), F.col("comp").alias("cu"))
    two = member.select(F.col("gid").alias("g2"), F.col("rep").alias("v"), F.col("comp").alias("cv"))
    same = spread.where("lo < hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    rest = near.unionByName(same).join(one, "g1").join(two, "g2").where("cu <> cv AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    more = _verified(rest, docs, n, percent, "jaccard-rest")
    joined = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), "jaccard-components")

    out = sets.select("id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def first_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each class: the one with the smallest id (one of them, where rows share that id). Rows with a null id stay."""
    classes = jaccard_components(df.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, n=n, percent=percent)
    gone = classes.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct()
    null_row = fresh(df, "_null_row")
    kept = df.join(gone, id_col, "left_anti").withColumn(null_row, F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([id_col, null_row]).drop(null_row).select(*[f"`{c}`" for c in df.columns])
