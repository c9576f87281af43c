"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The index holds the test items: for each term its postings in item order, in blocks with their largest impact. An impact is the
term's BM25 weight in the item divided by the item's score against itself, so a score is the share of an item
that a passage holds. Every training text is read whole as overlapping passages of two units; an item's unit is the power of two that holds
its words (LEAST_UNIT at least), so each item lies inside one passage and no item changes the passages of another. Items of
one unit form an index. Blocks are the same ranges of items in every list, so the largest impacts of a passage's terms add up
to a bound for each block, for all passages of a text at once; frequent terms are not added but bounded by
what they can give to an item of the block. Block-max WAND searches the blocks whose bound reaches the threshold and
gives all items at or above it. An item is a leak if, besides, its question (all but the last sentence) and its
answer (the last sentence) are found again by their word pairs in the passage.

Items are dealt out by hash into shards of about `shard_words` words. A shard's indexes are broadcast together and share one vocabulary; more items
make more passes over the texts, not a larger broadcast, and give the same rows. In how many items a term is, Spark counts over all of them.

Defined results: null and empty texts or items hold nothing and match nothing; repeated rows are judged each; repeated
items are found each by their id; equal scores keep the earlier passage; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import integer_ids, mapped, written

PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
BLOCK = 8  # items
LEAST_UNIT = 32  # words
FREQUENT = 0.05  # terms in a larger share of the items are bounded, not added
K1, B = 1.2, 0.75


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split() if text else []


@dataclass
class Postings:
    items: np.ndarray  # ordinals, ascending
    impacts: np.ndarray
    blocks: np.ndarray = field(init=False)
    block_at: np.ndarray = field(init=False)
    block_max: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        block = self.items // BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        self.blocks, self.block_at = block[first], first
        self.block_max = np.maximum.reduceat(self.impacts, first)


@dataclass
class Index:
    """Items of one unit. Terms are numbers of the shard's vocabulary."""

    unit: int
    ids: list[int]
    n_terms: int
    postings: dict[int, Postings]
    frequent: np.ndarray  # by term
    starts: np.ndarray  # where a term's blocks begin in the next two
    blocks: np.ndarray
    block_max: np.ndarray
    block_at: np.ndarray  # where a block begins in its term's postings
    slack: np.ndarray  # by block: the most that frequent terms give to one of its items
    question: list[set]
    answer: list[set]


@dataclass
class Shard:
    vocabulary: dict[bytes, int]
    indexes: list[Index]


def _pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}


def _parts(text: str) -> tuple[set, set]:
    """Word pairs of the question and of the answer; a text of one sentence is cut at two thirds."""
    body = text.rstrip().rstrip(".!?")
    at = max(body.rfind(m) for m in (". ", ".\n", "? ", "?\n", "! ", "!\n"))
    q, a = terms(body[: at + 1]) if at >= 0 else [], terms(body[at + 1 :])
    if not q or len(a) < 2:
        words = terms(text)
        cut = max(1, 2 * len(words) // 3)
        q, a = words[:cut], words[cut:] or words[-1:]
    return _pairs(q), _pairs(a)


def unit_of(n_words: int) -> int:
    return max(LEAST_UNIT, 1 << max(0, n_words - 1).bit_length())


def build_index(items: list[tuple[int, str, list[bytes]]], vocabulary: dict[bytes, int], df: dict[bytes, int], n_items: int, mean_words: float) -> Index:
    """The index of items of one unit; df, n_items and mean_words describe all items, so that any dealing gives the scores of one index."""
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    often = max(BLOCK, FREQUENT * n_items)
    for o, (_, _, w) in enumerate(items):
        norm = K1 * (1 - B + B * len(w) / mean_words)
        weight = {t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()}
        whole = sum(weight.values())
        for t, x in weight.items():
            lists[vocabulary[t]].append((o, x / whole))
    postings = {t: Postings(np.array([o for o, _ in x]), np.array([y for _, y in x])) for t, x in sorted(lists.items())}
    frequent = np.array([df[t] > often for t in vocabulary])
    given = np.zeros(-(-len(items) // BLOCK) * BLOCK)
    for t, p in postings.items():
        if frequent[t]:
            given[p.items] += p.impacts
    n_blocks = np.zeros(len(vocabulary), np.int64)
    n_blocks[list(postings)] = [len(p.blocks) for p in postings.values()]
    parts = [_parts(t) for _, t, _ in items]
    flat = lambda name: np.concatenate([getattr(p, name) for p in postings.values()])
    return Index(unit_of(len(items[0][2])), [i for i, _, _ in items], len(vocabulary), postings, frequent, np.cumsum([0, *n_blocks]), flat("blocks"), flat("block_max"), flat("block_at"), given.reshape(-1, BLOCK).max(axis=1), [p[0] for p in parts], [p[1] for p in parts])


def build_shard(items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_words: float) -> Shard:
    """Items without words are left out; equal ids stand in the order of their texts."""
    by_unit: dict[int, list] = defaultdict(list)
    for i, t in sorted(items):
        if w := terms(t):
            by_unit[unit_of(len(w))].append((i, t, w))
    vocabulary = {t: k for k, t in enumerate(sorted({t for x in by_unit.values() for _, _, w in x for t in w}))}
    return Shard(vocabulary, [build_index(x, vocabulary, df, n_items, mean_words) for _, x in sorted(by_unit.items())])


def candidates(index: Index, ids: np.ndarray, threshold: float) -> list[tuple[int, list[int]]]:
    """(passage number, blocks) where the bound of a block reaches the threshold; passage k is words k * unit up to (k + 2) * unit."""
    size, n_blocks, n_terms = index.unit, len(index.slack), index.n_terms
    passages = max(1, -(-(len(ids) - size) // size))
    at = np.flatnonzero(ids >= 0)
    at = at[~index.frequent[ids[at]]]
    out = []
    step = max(1, 4_000_000 // n_blocks)
    for lo in range(0, passages, step):
        hi = min(passages, lo + step)
        own = at[(at >= lo * size) & (at < (hi + 1) * size)]
        here, term = own // size, ids[own]
        key = np.concatenate([here[here < hi] * n_terms + term[here < hi], (here[here > lo] - 1) * n_terms + term[here > lo]])
        passage, term = np.divmod(np.unique(key), n_terms)
        n = index.starts[term + 1] - index.starts[term]
        place = np.repeat(index.starts[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        bound = np.bincount(np.repeat(passage - lo, n) * n_blocks + index.blocks[place], index.block_max[place], (hi - lo) * n_blocks).reshape(-1, n_blocks)
        rows, blocks = np.nonzero(bound + index.slack >= threshold - 1e-9)
        for r in np.unique(rows):
            out.append((lo + int(r), blocks[rows == r].tolist()))
    return out


def wand(index: Index, query: np.ndarray, threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
    """All (item ordinal, score) of the given blocks (else of all) with a score of at least threshold for the distinct terms of the query."""
    low, found = threshold - 1e-9, []
    n = index.starts[query + 1] - index.starts[query]
    place = np.repeat(index.starts[query] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    block_of, owner = index.blocks[place], np.repeat(query, n)
    for b in np.unique(block_of).tolist() if blocks is None else blocks:
        here = np.flatnonzero(block_of == b)
        most = index.block_max[place[here]].tolist()
        if sum(most) < low:
            continue
        lists = [index.postings[t] for t in owner[here].tolist()]
        left = [list(zip(x.items[i : i + BLOCK].tolist(), x.impacts[i : i + BLOCK].tolist(), strict=True)) for x, i in zip(lists, index.block_at[place[here]].tolist(), strict=True)]
        left = [[x for x in one if x[0] < (b + 1) * BLOCK][::-1] for one in left]  # the next item of a list stands last
        alive = list(range(len(left)))
        while True:
            alive = sorted((c for c in alive if left[c]), key=lambda c: left[c][-1][0])  # noqa: B023
            total, pivot = 0.0, None
            for k, c in enumerate(alive):
                total += most[c]
                if total >= low:
                    pivot = k
                    break
            if pivot is None:
                break
            item = left[alive[pivot]][-1][0]
            if left[alive[0]][-1][0] == item:
                on_it = [c for c in alive if left[c][-1][0] == item]
                score = sum(left[c].pop()[1] for c in on_it)
                if score >= low:
                    found.append((item, score))
            else:
                for c in alive[:pivot]:
                    while left[c] and left[c][-1][0] < item:
                        left[c].pop()
    return found


def search(shard: Shard, text: str | None, threshold: float, least_question: float, least_answer: float) -> list[tuple[int, float, float, float, int]]:
    """(item id, score, question overlap, answer overlap, first word of the passage) of each leak, by its best passage."""
    words = terms(text)
    if not words:
        return []
    ids = np.fromiter(map(shard.vocabulary.get, words, repeat(-1)), np.int64, len(words))
    out = []
    for index in shard.indexes:
        best: dict[int, tuple[float, float, float, int]] = {}
        for k, blocks in candidates(index, ids, threshold):
            s, e = k * index.unit, (k + 2) * index.unit
            part = ids[s:e]
            got = wand(index, np.unique(part[part >= 0]), threshold, blocks)
            if got:
                passage = words[s:e]
                pairs = set(zip(passage, passage[1:], strict=False)) | {(w,) for w in passage}
                for item, score in got:
                    q, a = index.question[item], index.answer[item]
                    qo, ao = len(q & pairs) / len(q), len(a & pairs) / len(a)
                    if qo >= least_question and ao >= least_answer and (item not in best or score > best[item][0]):
                        best[item] = (score, qo, ao, int(s))
        out += [(index.ids[i], *best[i]) for i in sorted(best)]
    return out


def _shards(benchmark: DataFrame, item_id: str, item_text: str, shard_words: int) -> Iterator[Shard]:
    """One shard for each pass over the texts; the driver holds one at a time."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in w], pa.int64()), pa.array([sorted(set(x)) for x in w], pa.list_(pa.binary()))], ["i", "t", "n", "terms"])

    items = benchmark.select(integer_ids(benchmark, item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND length(t) > 0")
    items = written(items.mapInArrow(split, "i long, t string, n long, terms array<binary>").where("n > 0"), "benchmark-items")
    n, total = items.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return
    shards = -(-total // shard_words)
    items = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    each = items.select("shard", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("n"))
    for s in range(shards):
        own = each.where(F.col("shard") == s).select("term").distinct()
        counts = {bytes(r["term"]): r["n"] for r in df.join(own, "term", "left_semi").collect()}
        yield build_shard([(r["i"], r["t"]) for r in items.where(F.col("shard") == s).select("i", "t").collect()], counts, n, total / n)


def _mapped(docs: DataFrame, index: Shard, limits: tuple[float, float, float]) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = given.value
        for batch in batches:
            rows = [(k, *hit) for k, t in enumerate(batch.column(1).to_pylist()) for hit in search(index, t, *limits)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())], ["_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return docs.mapInArrow(look, f"_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long")


def leaks(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, least_question: float = 0.5, least_answer: float = 0.5, shard_words: int = 500_000) -> DataFrame:
    """id_col, item_id, score, question_overlap, answer_overlap, first_word: a row for each document row and item that it leaks."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    limits = (threshold, least_question, least_answer)
    out = None
    for index in _shards(benchmark, item_id, item_text, shard_words):
        part = _mapped(docs, index, limits)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = docs.schema["_id"].dataType.simpleString()
        out = df.sparkSession.createDataFrame([], f"_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
    return out.withColumnRenamed("_id", id_col)


def without_leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, least_question: float = 0.5, least_answer: float = 0.5, shard_words: int = 500_000) -> DataFrame:
    """The rows of df whose text leaks no item; all columns, no shuffle."""
    limits = (threshold, least_question, least_answer)
    at = df.columns.index(text_col)
    for index in _shards(benchmark, item_id, item_text, shard_words):
        given = df.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], given: object = given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not search(given.value, t, *limits) for t in batch.column(at).to_pylist()], pa.bool_()))

        df = mapped(df, clean)
    return df
