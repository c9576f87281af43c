"""Language-model scores from a hierarchical Pitman-Yor process.

Restaurants: one for each context (the word before), all with one parent, the restaurant of single words, whose base is uniform.
Customers of a context restaurant are the pairs seen in training; each table sends one customer to the parent.

1. Words are counted over all training documents. The state of the most frequent ones (at most `most_words`) is broadcast, as a
   shortcut; every other word has a restaurant and a place in the parent too, which are joined by its hash.
2. Texts are read once more; their pairs are dealt out into buckets, whose number follows the token count, and written as a table
   bucketed by them: by a hash of the pair if the context is frequent, so that it is spread over all buckets, and by the hash of the
   context otherwise, so that its restaurant is in one bucket. A row holds the pairs of one block of documents in one bucket.
3. In a sweep every customer of every pair leaves and is seated anew (seating.draw), given the tables of the other dishes of
   its restaurant and the parent; pairs seen once sit at one table always. Seatings are written and the next sweep goes on from them. A bucket
   makes `sweeps` sweeps a round with its own changes in sight, the pairs of a context in four turns; buckets of one round run side
   by side with each other's tables of the round before. Then the tables of all pairs are summed into the parent, which is
   seated likewise: the frequent words in segments, the others in parts by hash. Discounts are fitted to the pairs (n1 / (n1 + 2 n2)).
   Seeds come from bucket and sweep, so a repeated task seats alike.
4. After `burn` rounds the tables of every sweep and the parent's probabilities of every round are averaged; the predictive probabilities from these
   averages score all documents. They sum to one over the words of a context and the one place for all words never seen.

The base score of frequent words is summed where texts are read; other words' counts are at hand where they stand as contexts, each once a document's pair, so theirs is summed there.

Defined results: null and empty texts have one token, the end; a null id trains like the text ''; repeated rows count and
are scored each; without training documents scores come from the uniform base; an empty table gives no rows; other
columns are ignored; ids must be whole numbers (text ids raise an error). Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import bucketed, crc_mod7, integer_ids, mix, parallelism, word_codes, words, written
from sensorlake.llm.seating import draw

HELD_OUT = 2
MOST_WORDS = 1 << 20  # of a broadcast
BLOCK_BITS, BITS = 26, 32  # of a word's number in a block and in a bucket
SLOT_BITS = 20
SEGMENTS = 16
PART_WORDS = 250_000
TURNS = 4
ROW = "kind string, bucket int, part int, data binary, customers long, tables long"


@dataclass
class Head:
    """The frequent words: sorted hashes, their ids (0 is the most frequent) and counts by id; then the end. Numbers from `first` on are other words'."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # by id, with the end
    tokens: int  # N
    distinct: int  # V
    other_words: int

    def __post_init__(self) -> None:
        self.slots = np.searchsorted(self.hashes, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.append(self.slots, len(self.hashes))

    @property
    def end(self) -> int:
        return len(self.hashes)

    @property
    def first(self) -> int:
        return len(self.hashes) + 1

    @property
    def places(self) -> int:
        """Of the parent's base: all words, the end, and one for words that were never seen."""
        return len(self.hashes) + self.other_words + 2

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Ids; -1 for other words. Looks only at the words that share the first bits, of which there are few."""
        out = np.full(len(codes), -1, np.int64)
        if not len(self.hashes):
            return out
        slot = (codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.hashes[at[open_]] == codes[open_]
            out[open_[same]] = self.ids[at[open_[same]]]
            at[open_] += 1
            open_ = open_[~same & (at[open_] < end[open_])]
        return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first, second, ... bytes of all values together, compressed."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.int64).tobytes()]
    for a in arrays:
        x = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        parts += [x[:, k].tobytes() for k in range(a.itemsize)]  # byte by byte: a whole turned array is copied many times slower
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, np.int64, 1 + 2 * int(np.frombuffer(raw, np.int64, 1)[0]))
    at, out = head.nbytes, []
    for n, size, kind in zip(head[1::2].tolist(), head[2::2].tolist(), kinds, strict=True):
        x = np.empty((n, size), np.uint8)
        for k in range(size):
            x[:, k] = np.frombuffer(raw, np.uint8, n, at + k * n)
        out.append(x.reshape(-1).view(kind))
        at += n * size
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """h, c of the words of training documents, counted in each task before they are shuffled; h is null in a row a batch that counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        held, size = [], 0
        for batch in batches:
            train = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if crc_mod7(key) != HELD_OUT:
                    held.append(word_codes(words(text)))
                    size, train = size + len(held[-1]), train + 1
                    if size > 1_500_000:
                        yield done(held)
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([train], pa.int64())], ["h", "c"])
        yield done(held)

    return docs.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _head(vocabulary: DataFrame, most_words: int) -> Head:
    """The frequent words by a count limit taken from a histogram of 64 bins for each power of two."""
    real = vocabulary.where("h IS NOT NULL")
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    bins = real.groupBy(level.alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("b")).collect()
    docs = vocabulary.where("h IS NULL").agg(F.sum("c")).first()[0] or 0
    kept, limit = 0, None
    for r in bins:
        if kept + r["n"] > most_words:
            break
        kept, limit = kept + r["n"], r["b"]
    rows = real.where(level >= limit).toPandas() if limit is not None else None
    h = rows["h"].to_numpy(np.int64).view(np.uint64) if rows is not None else np.zeros(0, np.uint64)
    c = rows["c"].to_numpy(np.int64) if rows is not None else np.zeros(0, np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    by_hash = np.argsort(h)
    tokens, distinct = sum(r["c"] for r in bins), sum(r["n"] for r in bins)
    counts = np.concatenate([c, [docs]])
    return Head(h[by_hash], by_hash.astype(np.int64), counts, tokens + docs, distinct + (docs > 0), distinct - len(h))


def _blocks(batches: Iterator[pa.RecordBatch], most_docs: int = 1_000, most_tokens: int = 500_000) -> Iterator[tuple[int, list, list[np.ndarray]]]:
    """(block number, ids, word codes by document): the same blocks whenever a task runs again."""
    from pyspark import TaskContext

    at, ids, codes, size = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            codes.append(word_codes(words(text)))
            size += len(codes[-1])
            if len(ids) >= most_docs or size >= most_tokens:
                yield at, ids, codes
                at, ids, codes, size = at + 1, [], [], 0
    if ids:
        yield at, ids, codes


def _renumbered(numbers: np.ndarray, first: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with those from `first` on replaced by the places among the ones that occur, and the hashes of these."""
    there = np.unique(numbers[numbers >= first])
    return np.where(numbers >= first, first + np.searchsorted(there, numbers), numbers), hashes[there - first]


def _pairs(docs: DataFrame, head: object, buckets: int) -> DataFrame:
    """bucket, block, others, data: distinct (document, context, word) of a block with how often, which documents are held out, and the hashes of contexts and words that are not in the head; others is null in one row a block that describes its documents, with what frequent words give to their base scores."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        frequent = np.zeros(h.first, np.uint64)
        frequent[h.ids] = h.hashes
        log_base, known = (np.append(x, 0.0) for x in (np.log10(h.counts + 1.0), h.counts > 0))  # others are looked up where their counts are
        for block, ids, codes in _blocks(batches):
            n = np.array([len(c) for c in codes], np.int64)
            last = np.cumsum(n + 1) - 1
            w = np.full(int(n.sum()) + len(n), h.end, np.int64)
            inner = np.ones(len(w), bool)
            inner[last] = False
            code = np.concatenate(codes)
            number = h.of(code)
            other = number < 0
            others, number[other] = np.unique(code[other], return_inverse=True)
            number[other] += h.first
            w[inner] = number
            u = np.concatenate([[h.end], w[:-1]])  # a document begins after an end
            doc = np.repeat(np.arange(len(n)), n + 1)
            base, n_known = (np.bincount(doc, x[np.minimum(w, h.first)], len(n)) for x in (log_base, known))
            key, times = np.unique((doc << 2 * BLOCK_BITS) | (u << BLOCK_BITS) | w, return_counts=True)
            doc, u, w = key >> 2 * BLOCK_BITS, (key >> BLOCK_BITS) & ((1 << BLOCK_BITS) - 1), key & ((1 << BLOCK_BITS) - 1)
            held = np.packbits([crc_mod7(k) == HELD_OUT for k in ids])
            code = np.concatenate([frequent, others])
            context = mix(code[u])
            bucket = (np.where(u < h.first, mix(context + code[w]), context) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            none = np.array([k is None for k in ids], np.uint8)
            rows = [(int(block % buckets), None, pack(np.array([k or 0 for k in ids], np.int64), none, held, n + 1, base, n_known.astype(np.uint32)))]
            for b, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if e > s:
                    i = order[s:e]
                    (x, hx), (y, hy) = _renumbered(u[i], h.first, others), _renumbered(w[i], h.first, others)
                    rows.append((b, pack(hx, hy), pack(np.diff(doc[i], prepend=0).astype(np.uint16), x.astype(np.uint32), y.astype(np.uint32), times[i].astype(np.uint32), held)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "others": pa.array([r[1] for r in rows], pa.binary()), "data": pa.array([r[2] for r in rows], pa.binary())})

    return docs.mapInArrow(make, "bucket int, block long, others binary, data binary")


def _entries(data: bytes, first: int, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, pair, times, and whether the document is held out, of one block in one bucket; places: of the block's other contexts and words among the bucket's."""
    step, *numbers, times, held = unpack(data, np.uint16, np.uint32, np.uint32, np.uint32, np.uint8)
    doc = np.cumsum(step.astype(np.int64))
    for k, place in enumerate(places):
        x = numbers[k].astype(np.int64)
        other = x >= first
        x[other] = first + place[x[other] - first]
        numbers[k] = x
    return doc, (numbers[0] << BITS) | numbers[1], times.astype(np.int64), np.unpackbits(held)[doc].astype(bool)


def _contexts(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)


class Bucket:
    """The pairs of a bucket: its other contexts and words (sorted hashes), training pairs and how often, and the entries by block."""

    def __init__(self, t: pa.Table, first: int):
        rows = sorted((b, o, x) for b, o, x in zip(*(t.column(c).to_pylist() for c in ("block", "others", "data")), strict=True) if o is not None)
        self.first, self.blocks = first, [b for b, _, _ in rows]
        own = [unpack(o, np.uint64, np.uint64) for _, o, _ in rows]
        self.contexts, self.words = ([np.unique(np.concatenate([x[k] for x in own])) for k in (0, 1)]) if own else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.packed = [x for _, _, x in rows]
        self.places = [[np.searchsorted(all_, x).astype(np.uint32) for all_, x in zip((self.contexts, self.words), both, strict=True)] for both in own]
        got = [self.entries(i) for i in range(len(rows))]
        self.pair, self.count = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.repeat(key, times * ~held) for _, key, times, held in got)]), return_counts=True)

    def entries(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _entries(self.packed[i], self.first, self.places[i])

    def size(self, other: np.ndarray) -> int:
        return self.first + len(other)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("kind", "bucket", "part", "data", "customers", "tables"), kinds, strict=True))})


def _rows(t: pa.Table, kind: str) -> list[tuple[int, int, bytes]]:
    """bucket, part, data of the rows of a kind."""
    got = zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "part", "data")), strict=True)
    return sorted((b, p, x) for k, b, p, x in got if k == kind)


def _edges(size: int) -> list[tuple[int, int]]:
    e = np.linspace(0, size, SEGMENTS + 1).astype(int).tolist()
    return list(zip(e[:-1], e[1:], strict=True))


def _seen(table: DataFrame, first: int, parts: int) -> DataFrame:
    """What the pairs of each bucket give once. static: what its sweeps need of the pairs seen twice or more; word: by part, its other words, in how many pairs they
    are and in how many of those seen twice or more; head: by segment, pairs by frequent word and by frequent context, of all and of those seen once; counts: how many pairs were seen once and twice."""

    def run(t: pa.Table) -> pa.Table:
        x, bucket = Bucket(t, first), t.column("bucket")[0].as_py()
        u, w = _contexts(x.pair)
        many = x.count > 1
        mu, mw = u[many], w[many]
        ou, ow = np.unique(mu[mu >= first]), np.unique(mw[mw >= first])
        short = lambda v, there: np.where(v >= first, first + np.searchsorted(there, v), v)
        single = np.bincount(u[~many], minlength=x.size(x.contexts))[ou]
        part = _part(x.words, parts)
        shorter = part[ow - first]
        key = (short(mu, ou) << BITS) | short(mw, ow)
        rows = [("static", bucket, -1, pack(np.diff(key, prepend=0).astype(np.uint64), x.count[many].astype(np.uint64), single.astype(np.int64), shorter.astype(np.uint32)), len(u), len(mu))]
        by_word, by_many = (np.bincount(v, minlength=x.size(x.words)).astype(np.uint32) for v in (w, mw))
        for k in np.unique(part).tolist():
            here = np.flatnonzero(part == k) + first
            rows.append(("word", bucket, k, pack(x.words[here - first], by_word[here], by_many[here]), 0, 0))
        heads = [*(np.bincount(v, minlength=first)[:first].astype(np.uint32) for v in (w, u, w[~many], u[~many]))]
        rows += [("head", bucket, k, pack(*(v[a:e] for v in heads)), 0, 0) for k, (a, e) in enumerate(_edges(first))]
        rows.append(("counts", bucket, -1, None, int((x.count == 1).sum()), int((x.count == 2).sum())))
        return _table(rows)

    return written(table.groupBy("bucket").applyInArrow(run, ROW), "lm-seen")


def _frequent(rows: DataFrame, size: int, arrays: int) -> list[np.ndarray]:
    """Sums over all buckets of what they give by segment: `arrays` arrays of the frequent words' length."""

    def adder(kind: type) -> Callable:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, segment = np.zeros(1, np.int64), None
            for batch in batches:
                for segment, x in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):  # noqa: B007
                    total = total + np.stack(unpack(x, *[kind] * arrays))
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(*total)], pa.binary())], ["part", "salt", "data"])

        return add

    schema = "part int, salt int, data binary"
    dealt = rows.where("kind = 'head'").select("part", (F.floor(F.col("bucket") / 64) % 64).cast("int").alias("salt"), "data")
    got = dealt.groupBy("part", "salt").applyInArrow(adder(np.uint32), schema).groupBy("part").applyInArrow(adder(np.int64), schema).orderBy("part").collect()
    if not got:
        return [np.zeros(size, np.int64) for _ in range(arrays)]
    return [np.concatenate(x) for x in zip(*(unpack(r["data"], *[np.int64] * arrays) for r in got), strict=True)]


def _placed(seen: DataFrame) -> DataFrame:
    """The parent's other words, by part. base: their customers from pairs of one table; place: which of them each bucket has, and which of these are in pairs seen more often; told and parent: the first state, one table each."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        got = [(b, *unpack(x, np.uint64, np.uint32, np.uint32)) for b, _, x in _rows(t, "word")]
        word, back = np.unique(np.concatenate([x[1] for x in got]), return_inverse=True)
        c = np.bincount(back, np.concatenate([x[2] for x in got]), len(word)).astype(np.int64)
        rows, at = [("parent", -1, part, pack(np.minimum(c, 1), np.zeros(len(c))), int(c.sum()), int((c > 0).sum()))], 0
        fixed = c.copy()
        for b, h, _, many in got:
            place = back[at : at + len(h)]
            at += len(h)
            fixed[place] -= many  # what changes from sweep to sweep is sent anew each time
            rows.append(("place", b, part, pack(place.astype(np.uint32), (many > 0).astype(np.uint8)), 0, 0))
            now = c[place[many > 0]]
            rows.append(("told", b, part, pack(now, np.minimum(now, 1)), 0, 0))
        return _table([*rows, ("base", -1, part, pack(fixed), int((c == 1).sum()), int((c == 2).sum()))])

    return written(seen.where("kind = 'word'").groupBy("part").applyInArrow(run, ROW), "lm-words-placed")


@dataclass
class Parent:
    """The parent after a round: of the frequent words customers, tables and (by context) their own restaurants' tables; and its totals."""

    customers: np.ndarray
    seated: np.ndarray
    contexts: np.ndarray
    all_customers: int
    all_tables: int


@dataclass
class Settings:
    d: tuple[float, float]  # of the parent and of the contexts
    strength: tuple[float, float]
    places: int  # of the parent's base

    def rest(self, p: Parent) -> float:
        """What the parent's base gives to each word, in customers."""
        return (self.strength[0] + self.d[0] * p.all_tables) / self.places


def _swept(static: DataFrame, state: DataFrame, parent: Parent, how: Settings, number: int, sweeps: int, keep: bool) -> DataFrame:
    """`sweeps` sweeps of each bucket. state: the tables of its pairs, and their sum over kept sweeps; word: by part; head: by segment, with the sums over the sweeps of tables by context."""
    given = static.sparkSession.sparkContext.broadcast(parent)

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        p, rows = given.value, []
        first = len(p.customers)
        for bucket, _, data in _rows(t, "static"):
            step, count, single, part = unpack(data, np.uint64, np.uint64, np.int64, np.uint32)
            u, w = _contexts(np.cumsum(step.astype(np.int64)))
            c = count.astype(np.int64)
            before = _rows(s, "state")
            tables, total = (x.copy() for x in unpack(before[0][2], np.int64, np.int64)) if before else (np.ones_like(c), np.zeros_like(c))
            customers, seated = np.zeros(first + len(part), np.int64), np.zeros(first + len(part), np.int64)
            customers[:first], seated[:first] = p.customers, p.seated
            for _, k, x in _rows(s, "told"):
                here = np.flatnonzero(part == k) + first
                if len(here):
                    customers[here], seated[here] = unpack(x, np.int64, np.int64)
            at_context = np.concatenate([p.contexts, single + np.bincount(u, tables, first + len(single)).astype(np.int64)[first:]])
            rng = np.random.default_rng([bucket, number])
            rest, everything = how.rest(p), how.strength[0] + p.all_customers
            sums = np.zeros(first, np.int64)
            for _ in range(sweeps):
                for turn in range(TURNS):
                    i = slice(turn, None, TURNS)
                    elsewhere = customers[w[i]] - tables[i]
                    place = np.where(elsewhere > 0, np.minimum(seated[w[i]], elsewhere), 0)
                    q = (elsewhere - how.d[0] * place + rest) / everything
                    later = (elsewhere - how.d[0] * np.maximum(place, 1) + rest) / everything
                    now = draw(c[i], at_context[u[i]] - tables[i], how.d[1], how.strength[1], q, (later, 1 / everything), rng)
                    change = now - tables[i]
                    moved = np.flatnonzero(change)
                    np.add.at(at_context, u[i][moved], change[moved])
                    np.add.at(customers, w[i][moved], change[moved])
                    tables[i] = now
                if keep:
                    total += tables
                sums += np.bincount(u, tables, first + len(single)).astype(np.int64)[:first]
            by_word = np.bincount(w, tables, first + len(part)).astype(np.int64)
            by_context = np.bincount(u, tables, first + len(single)).astype(np.int64)
            rows.append(("state", bucket, -1, pack(tables, total), 0, int(tables.sum())))
            rows += [("word", bucket, k, pack(by_word[first:][part == k].astype(np.int64)), 0, 0) for k in np.unique(part).tolist()]
            heads = [v[:first].astype(np.uint32) for v in (by_word, by_context, sums)]
            rows += [("head", bucket, k, pack(*(v[a:e] for v in heads)), 0, 0) for k, (a, e) in enumerate(_edges(first))]
        return _table(rows)

    return written(static.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, ROW), "lm-swept")


def _parent_parts(placed: DataFrame, words_: DataFrame, all_tables: int, all_customers: int, how: Settings, number: int, keep: bool) -> DataFrame:
    """The parent's other words, seated anew. told: customers and tables for each bucket; parent: tables, and the sum of kept rounds' probabilities without the base's share."""

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        rows = []
        for _, part, data in _rows(t, "base"):
            customers = unpack(data, np.int64)[0].copy()
            places = {b: [x[0], x[1].astype(bool)] for b, _, d in _rows(t, "place") for x in [unpack(d, np.uint32, np.uint8)]}
            for b, _, x in _rows(s, "word"):
                place, many = places[b]
                customers[place[many]] += unpack(x, np.int64)[0]
            seated, total = unpack(_rows(s, "parent")[0][2], np.int64, np.float64)
            base = np.full(len(customers), 1 / how.places)
            seated = draw(customers, all_tables - seated, how.d[0], how.strength[0], base, (base, 0.0), np.random.default_rng([7, number, part]))
            if keep:
                total = total + (customers - how.d[0] * seated) / (how.strength[0] + all_customers)
            rows.append(("parent", -1, part, pack(seated, total), int(customers.sum()), int(seated.sum())))
            rows += [("told", b, part, pack(customers[place[many]], seated[place[many]]), 0, 0) for b, (place, many) in places.items()]
        return _table(rows)

    return written(placed.groupBy("part").cogroup(words_.groupBy("part")).applyInArrow(run, ROW), "lm-parent")


def _head_seated(customers: np.ndarray, before: np.ndarray, all_tables: int, how: Settings, number: int, spark: SparkSession) -> np.ndarray:
    """The frequent words' tables in the parent, by segments side by side."""
    given = spark.sparkContext.broadcast((customers, before))
    edges = _edges(len(customers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, old = given.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, e = edges[k]
                base = np.full(e - a, 1 / how.places)
                t = draw(c[a:e], all_tables - old[a:e], how.d[0], how.strength[0], base, (base, 0.0), np.random.default_rng([11, number, k]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pack(t)], pa.binary())], ["id", "data"])

    got = spark.range(SEGMENTS, numPartitions=min(SEGMENTS, 16)).mapInArrow(run, "id long, data binary").orderBy("id").collect()
    return np.concatenate([unpack(r["data"], np.int64)[0] for r in got])


def _means(placed: DataFrame, state: DataFrame, kept: int, rest: float) -> DataFrame:
    """mean: the parent's average probability of each bucket's other words, by part."""

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        rows = []
        for _, part, data in _rows(s, "parent"):
            p = unpack(data, np.int64, np.float64)[1] / kept + rest
            rows += [("mean", b, part, pack(p[unpack(x, np.uint32, np.uint8)[0]]), 0, 0) for b, _, x in _rows(t, "place")]
        return _table(rows)

    return placed.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(run, ROW)


def _scored(table: DataFrame, state: DataFrame, parent: np.ndarray, contexts: np.ndarray, counts: np.ndarray, how: Settings, samples: int, parts: int, rest: float) -> DataFrame:
    """block, kind, data: by document of the block, log10 probabilities of its pairs in a bucket, and of their contexts outside the head in the base and as known; kind 0 describes the block's documents.
    parent and contexts: averages of the frequent words' probabilities and of their restaurants' tables."""
    given = table.sparkSession.sparkContext.broadcast((parent, contexts, counts))

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        parent, at_context, counts = given.value
        first = len(counts)
        out = [(b, 0, x) for b, o, x in zip(*(t.column(c).to_pylist() for c in ("block", "others", "data")), strict=True) if o is None]
        x = Bucket(t, first)
        u, w = _contexts(x.pair)
        tables, many = np.ones(len(x.pair)), x.count > 1
        for _, _, data in _rows(s, "state"):
            tables[many] = unpack(data, np.int64, np.int64)[1] / samples
        p_word = np.concatenate([parent, np.full(len(x.words), rest)])
        part = _part(x.words, parts)
        for _, k, data in _rows(s, "mean"):
            p_word[first:][part == k] = unpack(data, np.float64)[0]
        own = np.bincount(u, tables, x.size(x.contexts))[first:]
        context_tables = np.concatenate([at_context, own])
        customers = np.concatenate([counts, np.bincount(u, x.count, x.size(x.contexts))[first:]]).astype(np.float64)
        d, strength = how.d[1], how.strength[1]
        seen = (x.count - d * tables) / (strength + customers[u])
        back = (strength + d * context_tables) / (strength + customers)
        log_base, known = np.log10(customers + 1), (customers > 0).astype(np.float64)
        for i, block in enumerate(x.blocks):
            doc, key, times, _ = x.entries(i)
            u, w = _contexts(key)
            p = back[u] * p_word[w]
            if len(x.pair):
                order = np.argsort(key)  # places of rising keys are found faster
                j = np.empty(len(key), np.int64)
                j[order] = np.minimum(np.searchsorted(x.pair, key[order]), len(x.pair) - 1)
                p = p + np.where(x.pair[j] == key, seen[j], 0.0)
            there, of_others = np.unique(doc), u >= first
            score = np.bincount(doc, times * np.log10(p))[there]
            doc, u, times = doc[of_others], u[of_others], times[of_others]
            base, n_known = (np.bincount(doc, times * y[u]) for y in (log_base, known))
            others = np.unique(doc)
            out.append((block, 1, pack(np.diff(there, prepend=0).astype(np.uint16), score, np.diff(others, prepend=0).astype(np.uint16), base[others], n_known[others].astype(np.uint32))))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "data": pa.array([r[2] for r in out], pa.binary())})

    return table.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, "block long, kind int, data binary")


def _summed(parts: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """A row a document from all parts of its block."""

    def add(t: pa.Table) -> pa.Table:
        kinds, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
        ids, none, held, n, base, known = unpack(data[kinds.index(0)], np.int64, np.uint8, np.uint8, np.int64, np.float64, np.uint32)
        size = len(n)
        score, base, known = np.zeros(size), base.copy(), known.astype(np.int64)
        for k, x in sorted(zip(kinds, data, strict=True)):  # one order, so that sums are the same each time
            if k == 1:
                there, y, others, more, n_known = unpack(x, np.uint16, np.float64, np.uint16, np.float64, np.uint32)
                score[np.cumsum(there, dtype=np.int64)] += y
                others = np.cumsum(others, dtype=np.int64)
                base[others] += more
                known[others] += n_known
        base -= n * np.log10(tokens + distinct + 1.0)
        return pa.table({"id": pa.array(ids, mask=none.astype(bool)), "held_out": pa.array(np.unpackbits(held)[:size].astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(known), "train_tokens": pa.array(np.full(size, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return parts.groupBy("block").applyInArrow(add, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _discount(once: int, twice: int) -> float:
    """The usual estimate from how many counts are one and two."""
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.9))


def scores(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_words: int = 1 << 18, rounds: int = 6, sweeps: int = 3, burn: int = 2, discounts: tuple[float, float] | None = None, strengths: tuple[float, float] = (1.0, 1.0), bucket_tokens: int = 1_000_000) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the text, by token). Discounts of the parent and the contexts are fitted where not given."""
    if most_words > MOST_WORDS - 2:
        raise ValueError("the broadcast of frequent words is bounded")
    spark = df.sparkSession
    docs = df.select(integer_ids(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    h = _head(written(_word_counts(docs), "lm-words"), most_words)
    head = spark.sparkContext.broadcast(h)
    few = min(parallelism(spark), 24)
    buckets = max(few, -(-h.tokens // bucket_tokens))
    parts = max(min(few, 1 + h.other_words), -(-h.other_words // PART_WORDS))
    table = bucketed(_pairs(docs, head, buckets), "bucket", max(few, buckets // 2), "lm-pairs")
    seen = _seen(table, h.first, parts)
    static = bucketed(seen.where("kind = 'static'"), "bucket", max(few, buckets // 2), "lm-static")
    words_placed = _placed(seen)
    placed = bucketed(words_placed.where("kind IN ('base', 'place')"), "part", max(few, parts // 2), "lm-places")
    totals = {r["kind"]: r for r in seen.unionByName(words_placed).groupBy("kind").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).collect()}
    total = lambda kind, of: totals[kind][of] if kind in totals else 0
    by_word, by_context, *single = _frequent(seen, h.first, 4)
    if discounts is None:
        discounts = (_discount(total("base", "customers") + int((by_word == 1).sum()), total("base", "tables") + int((by_word == 2).sum())), _discount(total("counts", "customers"), total("counts", "tables")))
    how = Settings(discounts, strengths, h.places)
    parent = Parent(by_word, np.minimum(by_word, 1), by_context, total("static", "customers"), int((by_word > 0).sum()) + total("parent", "tables"))
    told = words_placed.where("kind IN ('told', 'parent')")
    state = told.where("kind = 'told'")
    p_head, p_rest, c_head, kept = np.zeros(h.first), 0.0, np.zeros(h.first), 0
    for k in range(rounds):
        keep = k >= burn
        swept = _swept(static, state, parent, how, k, sweeps, keep)
        by_word, by_context, sums = _frequent(swept, h.first, 3)
        customers, contexts = single[0] + by_word, single[1] + by_context
        all_customers = total("static", "customers") - total("static", "tables") + (swept.agg(F.sum("tables")).first()[0] or 0)
        words_now = swept.where("kind = 'word'").unionByName(told.where("kind = 'parent'"))
        told = _parent_parts(placed, words_now, parent.all_tables, all_customers, how, k, keep)
        seated = _head_seated(customers, parent.seated, parent.all_tables, how, k, spark)
        other_tables = told.where("kind = 'parent'").agg(F.sum("tables")).first()[0] or 0
        parent = Parent(customers, seated, contexts, all_customers, int(seated.sum()) + other_tables)
        state = told.where("kind = 'told'").unionByName(swept.where("kind = 'state'"))
        if keep:
            kept += 1
            everything = strengths[0] + parent.all_customers
            p_head += (customers - how.d[0] * seated) / everything
            p_rest += how.rest(parent) / everything
            c_head += single[1] + sums / sweeps
    p_rest /= kept
    means = _means(placed, told.where("kind = 'parent'"), kept, p_rest)
    last = swept.where("kind = 'state'").unionByName(means)
    scored = _scored(table, last, p_head / kept + p_rest, c_head / kept, h.counts, how, kept * sweeps, parts, p_rest)
    out = _summed(scored, h.tokens, h.distinct)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
