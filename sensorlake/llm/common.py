"""Helpers shared by the training-data operators: shared folder, tables written once, tokens and hashes."""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from sensorlake.sources.shared import new_path

#: Words are runs of characters other than these six; the same class in Java, RE2 and bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COLLECT_S = 10  # at least so many seconds between two collections of the driver's garbage
_collected = [0.0]


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; they are put back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collected(spark: SparkSession) -> None:
    """The driver's JVM collects its garbage, as Spark lets it by spark.cleaner.periodicGC.interval, but not only each half hour: its heap shrinks again
    after a run of many small jobs, and broadcasts that are no longer referred to leave the executors."""
    if time.monotonic() - _collected[0] > COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def written(df: DataFrame, name: str, batch: int = 2_000) -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends here, and a lost executor costs no recomputation. Shuffle files go as soon as the table is there.
    batch: rows that an executor sends to a Python worker at a time, as long as the session sets no fewer; the setting is put back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = int(spark.conf.get(BATCH))
    with held(spark, {BATCH: str(min(batch, before) if before > 0 else batch), FREED: "true"}):
        df.write.parquet(path)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Dealt out by the key and written once to the shared folder as n buckets: groups and joins by the key read it without a shuffle."""
    path = new_path(df.sparkSession, name)
    catalog_name = path.rpartition("/")[2].replace("-", "_")
    with held(df.sparkSession, {FREED: "true"}):
        df.repartition(n, key).write.option("path", path).bucketBy(n, key).saveAsTable(catalog_name)
    collected(df.sparkSession)
    return df.sparkSession.table(catalog_name)


def mapped(df: DataFrame, f: Callable) -> DataFrame:
    """mapInArrow that keeps df's columns; their names are put aside meanwhile, as names with dots are not taken there."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(f, plain.schema).toDF(*df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_ids(df: DataFrame, id_col: str) -> Column:
    """The id as a long. Ids of another kind raise an error, since a cast would turn them into nulls."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as bytes; bytes.lower() and bytes.split() know just the ASCII classes wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordCodes:
    """64-bit hash of each word, remembered for the worker's lifetime in a dictionary of bounded size."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.known: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        missing = set(tokens).difference(known)
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(tokens)
            digest = xxhash.xxh3_64_intdigest
            for w in missing:
                known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


_remembered: dict[str, object] = {}


def remembered(key: str, make: Callable[[], object]) -> object:
    """What a worker remembers for its next tasks, made when it is first asked for. A worker remembers one thing at a time: that of
    another operator is let go, so that the stages of one application do not add up in memory."""
    if key not in _remembered:
        _remembered.clear()
        pa.default_memory_pool().release_unused()
        _remembered[key] = make()
    return _remembered[key]


def word_codes(tokens: list[bytes]) -> np.ndarray:
    return remembered("words", WordCodes)(tokens)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of a public 64-bit mixer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(codes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word windows; with fewer words, the whole sequence as one; none for none."""
    if not len(codes):
        return codes[:0]
    m = min(n, len(codes))
    size = len(codes) - m + 1
    h = np.full(size, m, np.uint64)
    for k in range(m):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + size])
    return np.unique(h)


def crc_mod7(key: object) -> int:
    """crc32 of the key as text, modulo 7; a null key counts as the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most `most` of them, by a limit from a histogram of 64 bins for each power of two: nothing is sorted or gathered."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 64).cast("int")
    kept, limit = 0, None
    for r in counted.groupBy(level.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        if kept + r["n"] > most:
            break
        kept, limit = kept + r["n"], r["b"]
    return counted.where(level >= limit) if limit is not None else counted.where(F.lit(False))


def quiet_threads() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
