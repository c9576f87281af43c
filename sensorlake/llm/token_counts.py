"""Token counts by overlap resynchronisation.

A huge text, one of more than `huge_chars` characters, is cut into overlapping chunks that are encoded with offsets. Two neighbours are
spliced at a place in their overlap that is proven stable: a cut of every byte-level tokenizer's pattern (a blank after a non-blank
character, a change between letters, digits and signs) where a token starts in both encodings and from where both give the same ids up to
the last such place they share. Where no place qualifies the overlap is doubled, and at last the left chunk is, so that a text without any
cut costs a constant number of encodings of its length. Counts are those of the library for the whole text.

A text of up to `huge_chars` characters is one chunk and needs no splice. Its ids are put together from the ids of its units (bpe.py), which
each Python worker remembers: the same ids in less time.

Defined results: null text counts as empty (0 bytes, 0 tokens); an empty text has 0 tokens; null or repeated doc_ids
give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.bpe import unit_encoder
from sensorlake.llm.common import quiet_threads

CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
SPECIAL = 16  # no special string is longer: nearer to an end of the overlap both chunks could hold a part of one


class Chunk:
    """A part of a text with its ids and where each of them starts in the text."""

    def __init__(self, tokenizer: object, text: str, start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids, self.at = start, end, e.ids, [s + start for s, _ in e.offsets]


def _splice(text: str, a: Chunk, b: Chunk, past: int) -> tuple[int, int] | None:
    """Token indexes (in a, in b) at a proven common boundary after `past`, or None."""
    i, j = bisect_left(a.at, b.start), bisect_left(b.at, a.end)
    a_at = {at: i + k for k, at in reversed(list(enumerate(a.at[i:])))}
    b_at = {at: k for k, at in reversed(list(enumerate(b.at[:j])))}
    shared = [x for m in CUT.finditer(text, b.start + SPECIAL, max(b.start + SPECIAL, a.end - SPECIAL)) if (x := m.start()) > past and x in a_at and x in b_at]
    if len(shared) < 2:
        return None
    first, last = shared[0], shared[-1]
    if a.ids[a_at[first] : a_at[last]] != b.ids[b_at[first] : b_at[last]]:
        return None
    return a_at[first], b_at[first]


def long_ids(tokenizer: object, text: str, chunk_chars: int, overlap: int) -> list[int]:
    """Ids of a text of any length, encoded in overlapping chunks."""
    out: list[int] = []
    first = past = 0  # a's first token that is not yet given out, and where it starts
    a = Chunk(tokenizer, text, 0, min(len(text), chunk_chars))
    while a.end < len(text):
        width, found = overlap, None
        while found is None and a.end - width > a.start:
            b = Chunk(tokenizer, text, a.end - width, min(len(text), a.end - width + max(chunk_chars, 2 * width)))
            found = _splice(text, a, b, past)
            width *= 2
        if found is None:  # nothing in common: a larger left chunk
            a = Chunk(tokenizer, text, a.start, min(len(text), 2 * a.end - a.start))
            first = bisect_left(a.at, past)
            continue
        out += a.ids[first : found[0]]
        a, first = b, found[1]
        past = a.at[first]
    return out + a.ids[first:]


def token_counts(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge_chars: int = 32_768, chunk_chars: int = 16_384, overlap: int = 512) -> DataFrame:
    """Columns id_col, n_bytes, n_tokens, over_limit: one row per input row, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_threads()
        enc = unit_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                n = [-1 if t and len(t) > huge_chars else 0 for t in texts]
                short = enc.ids(["" if k or t is None else t for t, k in zip(texts, n, strict=True)])
                got = [len(long_ids(enc.tokenizer, t, chunk_chars, overlap)) if k else len(s) // 4 for t, k, s in zip(texts, n, short, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.int64())], ["_id", "_bytes", "_n"])

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    kind = src.schema["_id"].dataType.simpleString()
    out = src.mapInArrow(count, f"_id {kind}, _bytes long, _n long")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))
