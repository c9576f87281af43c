"""Packing by power-of-two decomposition.

A document's ids (and its end id) are cut into as many full pieces of `longest` as fit and then into the binary digits of
the rest, largest first. Every piece has a power-of-two length and is a sequence of its own in the bucket of its
length, so no sequence crosses documents and nothing is padded. Batches are made from one bucket at a time.

Defined results: null and empty texts have one id, the end id; repeated rows are packed each; null doc_ids are kept;
an empty table gives no rows; other columns are ignored. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.bpe import unit_encoder
from sensorlake.llm.common import quiet_threads


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths that sum to n: full pieces, then the rest's powers of two from large to small."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


@lru_cache(1 << 16)
def _cuts(n: int, longest: int) -> tuple[tuple[int, int], ...]:
    """Start and length of each piece of n ids."""
    lengths = piece_lengths(n, longest)
    return tuple(zip(accumulate([0, *lengths[:-1]]), lengths, strict=True))


def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and ids (as little-endian uint32 bytes) if asked for."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        enc = unit_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(enc.ids([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    cuts = _cuts(len(data) // 4, longest)
                    row += [i] * len(cuts)
                    total += [len(data) // 4] * len(cuts)
                    start += [s for s, _ in cuts]
                    length += [n for _, n in cuts]
                    pieces = [data[4 * s : 4 * (s + n)] for s, n in cuts]
                    crc += map(zlib.crc32, pieces)
                    if with_ids:
                        ids += pieces
                cols = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(cut, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    more = [F.col("ids")] if with_ids else []
    return out.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.length(F.bin("length")) - 1).alias("bucket"), *more)


def bucket_plan(pieces: DataFrame, batch_tokens: int = 1 << 20) -> DataFrame:
    """Sequences, tokens and batches of `batch_tokens` tokens that each bucket gives."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("sequences"), F.sum("length").alias("tokens")).withColumn("batches", F.ceil(F.col("tokens") / batch_tokens))
