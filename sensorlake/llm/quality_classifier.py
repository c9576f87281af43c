"""Co-trained quality classifier: a text view and a metadata view teach each other.

1. Each document becomes two short feature vectors, written once: its content (shares of character classes and of their
   pairs, hashed words and pairs of words, word statistics) and its metadata (language, source, length band). Rounds read these, not the texts.
2. Both views are fitted on a sample of labelled documents of at most `most_labelled`, chosen by hash of the id. The pool has one
   unlabelled document of each text vector. In each round each view labels about twice a `share` of the pool (2 `per_round` documents
   at least) that no view has labelled before, its surest ones by rank, of both classes in their labelled shares (a class's side of the pool is its share of all ranks); the other view trains on
   these too, by sums over them that Spark adds up. The text view takes the documents it is surest of; the metadata view, whose vectors
   are shared by many documents, takes as evenly from all on a class's side as their numbers allow. Documents that both views are sure of and
   disagree on are dropped. A pseudo-label weighs as much as the view's calibrated probability of it exceeds the class's share, in parts of what it
   could exceed it by, times how surely the view's ranking of held-out labels beats chance: a view that may know nothing teaches nothing. `confident` is a further, absolute limit; by default there is none.
3. Two fifths of the labelled sample are never trained on: one calibrates each view, the other fits the weights that combine the views
   (the same one does both where a fifth holds one class only).
4. All documents are scored by the combined, calibrated views.

Defined results: labels that contradict each other count as low quality; without labels of both classes every document
gets the share of good labels (1 without labels); null texts have the features of the empty text and null metadata are
a value of their own; repeated rows get a score each; of several texts with one labelled id the one with the smallest features teaches; empty tables give no rows; other columns are ignored. Pseudo-label
ties go by hash of the text vector; rows with a null id are scored, not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import integer_ids, mapped, mix, words, written

SOURCES, LANGS, BANDS = 32, 16, 16
META = SOURCES + LANGS + BANDS


def _classes() -> np.ndarray:
    """Class of each byte: letters, capitals, digits, the ASCII signs one by one, line ends, blanks, bytes beyond ASCII."""
    c = np.zeros(256, np.int64)
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 1, 2, 3
    c[128:], c[10], c[[32, 9, 11, 12, 13]] = 4, 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[signs] = 7 + np.arange(len(signs))
    return c


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
COARSE = np.minimum(CLASS, 7)
WORDS = 32  # hashed slots, once for words and once for pairs of words
STATS = 6
TEXT = N_CLASSES + 64 + 2 * WORDS + STATS
MANY_TASKS = 64


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(TEXT, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    out[:N_CLASSES] = np.sqrt(np.bincount(CLASS[data], minlength=N_CLASSES) / len(data))
    if len(data) > 1:
        k = COARSE[data]
        out[N_CLASSES : N_CLASSES + 64] = np.sqrt(np.bincount(k[:-1] * 8 + k[1:], minlength=64) / (len(data) - 1))
    tokens = words(text)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    at = N_CLASSES + 64
    for k, h in enumerate((mix(codes), mix(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]))):
        if len(h):
            out[at + k * WORDS : at + (k + 1) * WORDS] = np.sqrt(np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / len(h))
    w = text.split()
    if w:
        lines = [x for x in text.split("\n") if x.strip()]
        out[-STATS:] = (
            len(set(w)) / len(w), sum(map(str.__eq__, w, w[1:])) / len(w), min(20, len(data) / len(w)) / 20,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(w)) / 12, min(1, len(w) / max(1, len(lines)) / 100),
        )
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[SOURCES + LANGS + (BANDS - 1 if n_chars is None else min(BANDS - 2, int(max(0, n_chars)).bit_length()))] = 1
    return out


@dataclass
class Linear:
    """A logistic regression on standardised features, with a scale and shift that calibrate it."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    skill: float = 1.0  # how surely its ranking of held-out labels beats chance

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * (((x - self.mean) / self.scale) @ self.weights + self.bias) + self.b


def _gradient(x1: np.ndarray, y: np.ndarray, w: np.ndarray, trust: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
    return (x1 * (trust * p * (1 - p))[:, None]).T @ x1, x1.T @ (trust * (p - y))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, more: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """more: curvature and gradient of further rows, given the weights. start: weights to begin with."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1]) if start is None else start
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        h, g = _gradient(x1, y, w)
        if more is not None:
            h, g = (a + b for a, b in zip((h, g), more(w), strict=True))
        step = np.linalg.solve(h + np.diag(penalty), g + penalty * w)
        w = w - step
        if more is not None and np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def _smooth(y: np.ndarray) -> np.ndarray:
    """Targets for calibration, pulled in by the class sizes so that separable classes keep finite slopes."""
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    return np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))


def _summed(taught: DataFrame, many: bool, name: str, width: int, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | float:
    """The sums of an array over all taught rows: one array comes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _slices(batches):
            y, trust = (part.column(part.schema.get_field_index(c)).to_numpy().astype(np.float64) for c in ("y", "trust"))
            got = sums(_arrays(part, name, width), y, trust)
            total = got if total is None else total + got
        if total is not None:
            slot = TaskContext.get().partitionId() % MANY_TASKS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["slot", "data", "shape"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in t.column("data").to_pylist())
        return pa.table({"slot": t.column("slot").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary()), "shape": t.column("shape").slice(0, 1)})

    schema = "slot int, data binary, shape array<int>"
    parts = taught.select(name, "y", "trust").mapInArrow(run, schema)
    if many:  # the driver gets MANY_TASKS arrays at most
        parts = parts.groupBy("slot").applyInArrow(add, schema)
    rows = parts.collect()
    return sum((np.frombuffer(r["data"], np.float64).reshape(r["shape"]) for r in rows), 0.0)


def skill(z: np.ndarray, y: np.ndarray) -> float:
    """0 for a ranking that may be chance, 1 for a perfect one: twice the area under the ROC curve less one, at the area's lower 95 % bound (its
    standard error after Hanley and McNeil)."""
    good, bad = z[y > 0], np.sort(z[y <= 0])
    n1, n0 = len(good), len(bad)
    if not n1 or not n0:
        return 0.0
    area = (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / (2 * n1 * n0)
    q1, q2 = area / (2 - area), 2 * area * area / (1 + area)
    error = np.sqrt(max(0.0, area * (1 - area) + (n1 - 1) * (q1 - area * area) + (n0 - 1) * (q2 - area * area)) / (n1 * n0))
    return float(max(0.0, 2 * (area - 1.645 * error) - 1))


def fit_linear(x: np.ndarray, y: np.ndarray, x_cal: np.ndarray, y_cal: np.ndarray, taught: DataFrame | None = None, name: str = "t", last: Linear | None = None) -> Linear:
    """taught: pseudo-labelled rows with the view's vector as `name`, y, and trust, the weight of the row. last: the view
    of the round before, from whose weights the fit sets out, so that few passes are needed."""
    width = x.shape[1]
    moments = np.array([np.full(width, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
    many = taught is not None and taught.rdd.getNumPartitions() > MANY_TASKS
    if taught is not None:
        moments = moments + _summed(taught, many, name, width, lambda x, y, trust: np.array([np.full(x.shape[1], trust.sum()), trust @ x, trust @ (x * x)]))
    mean = moments[1] / moments[0]
    scale = np.maximum(np.sqrt(np.maximum(moments[2] / moments[0] - mean * mean, 0)), 1e-3)

    def more(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sums(x: np.ndarray, y: np.ndarray, trust: np.ndarray) -> np.ndarray:
            return np.column_stack(_gradient(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, w, trust))

        got = _summed(taught, many, name, width, sums)
        return (got[:, :-1], got[:, -1]) if isinstance(got, np.ndarray) else (0.0, 0.0)

    start = None if last is None else np.append(last.weights / last.scale * scale, last.bias + (last.weights / last.scale) @ (mean - last.mean))
    w, b = _newton((x - mean) / scale, y, ridge=1.0, more=None if taught is None else more, start=start)
    view = Linear(mean, scale, w, b)
    view.skill = skill(view.logit(x_cal), y_cal)
    a, shift = _newton(view.logit(x_cal)[:, None], _smooth(y_cal), ridge=1e-3)
    view.a, view.b = (float(a[0]), shift) if a[0] > 0 else (0.0, float(np.log((y_cal.mean() + 1e-3) / (1 - y_cal.mean() + 1e-3))))
    return view


@dataclass
class Model:
    text: Linear | None
    meta: Linear | None
    weights: tuple[float, float, float]
    prior: float

    def probabilities(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            same = np.full(len(xt), self.prior)
            return same, same, same
        lt, lm = self.text.logit(xt), self.meta.logit(xm)
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(lt), p(lm), p(self.weights[0] * lt + self.weights[1] * lm + self.weights[2])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows, so that a worker holds few vectors and texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrays(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    data = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(data.to_pylist()), np.float16).reshape(-1, width).astype(np.float64)


def features(docs: DataFrame) -> DataFrame:
    """_id, t, m: half-precision features of both views. docs: _id, _text, _lang, _source, _n."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            t = [text_features(x).astype(np.float16).tobytes() for x in batch.column(1).to_pylist()]
            m = [meta_features(*x).astype(np.float16).tobytes() for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["_id", "t", "m"])

    return docs.mapInArrow(make, "_id long, t binary, m binary")


def _shares(groups: list[tuple[object, int]], wanted: int, evenly: bool) -> list[tuple[object, float]]:
    """What share of each group is taken for about `wanted` rows: whole groups in their order and a part of the last, or as evenly from all as their sizes allow."""
    out, left = [], wanted
    if evenly:
        groups = sorted(groups, key=lambda g: g[1])
    for i, (key, n) in enumerate(groups):
        take = min(n, left / (len(groups) - i) if evenly else left)
        out.append((key, take / n))
        left -= take
    return [x for x in out if x[1] > 0]


def _scored_pool(pool: DataFrame, before: DataFrame | None, text: Linear, meta: Linear) -> DataFrame:
    """_id, t, m, zt, zm, written once: both views' logits of all rows that no view has taught yet."""
    given = pool.sparkSession.sparkContext.broadcast((text, meta))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = given.value
        for batch in _slices(batches):
            z = [pa.array(view.logit(_arrays(batch, name, width))) for view, name, width in ((text, "t", TEXT), (meta, "m", META))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *z], ["_id", "t", "m", "zt", "zm"])

    left = pool if before is None else pool.join(before.select("_id"), "_id", "left_anti")
    return written(left.mapInArrow(score, "_id long, t binary, m binary, zt double, zm double"), "quality-scored")


def _marked(scored: DataFrame, name: str, view: Linear, middle: float, good: float, confident: float, wanted: int) -> DataFrame:
    """scored with the columns y and trust of a view's own surest rows: about 2 `wanted` in all, of both classes in the shares of the labelled ones. A row is on the
    side of a class by its rank: above or below `middle`, the logit that parts the pool in those shares (ties with it go to the larger class). Of these the highest ranks are taken, or for
    the metadata view, whose vectors are shared by many rows, as evenly from all vectors as their numbers allow."""
    z, y, place = F.col(f"z{name}"), f"y{name}", F.pmod(F.xxhash64("t", F.lit(f"place {name}")), F.lit(1 << 30)) / float(1 << 30)
    sure = F.abs(z) >= float(np.log(confident / (1 - confident)))
    side = F.when(sure, F.when(z > middle, 1).when(z < middle, 0).otherwise(int(good >= 0.5)))
    far = F.abs(z - middle)
    # A metadata vector is a group of its own; there are SOURCES x LANGS x BANDS of them at most.
    group = F.xxhash64("m") if name == "m" else F.floor(F.least(far, F.lit(1000.0)) * 256)
    x = scored.withColumns({"_side": side, "_g": group})
    counts = x.where("_side IS NOT NULL").groupBy("_side", "_g").count().orderBy("_side", F.desc("_g")).collect()
    share = {1: max(1, round(2 * wanted * good)), 0: max(1, round(2 * wanted * (1 - good)))}
    taken = [(c, g, s) for c in (0, 1) for g, s in _shares([(r["_g"], r["count"]) for r in counts if r["_side"] == c], share[c], name == "m")]
    taken = scored.sparkSession.createDataFrame(taken, "_side int, _g long, _share double")
    x = x.join(F.broadcast(taken), ["_side", "_g"], "left")
    p = 1 / (1 + F.exp(-z))
    gain = F.when(F.col("_side") == 1, (p - good) / (1 - good)).otherwise((good - p) / good)
    x = x.withColumn(f"trust{name}", view.skill * F.greatest(F.least(gain, F.lit(1.0)), F.lit(0.0)))
    return x.withColumn(y, F.when(place < F.col("_share"), F.col("_side"))).drop("_side", "_g", "_share")


def _surest(marked: DataFrame, name: str, other: str) -> DataFrame:
    """_id, t, m, y, trust, written once: what a view teaches the other in a round. A row that both are sure of is dropped where they disagree, and taught
    by the text view where they agree."""
    alone, both = F.col(f"y{name}").isNotNull() & F.col(f"y{other}").isNull(), F.col(f"y{name}") == F.col(f"y{other}")
    rows = marked.where(alone | both if name == "t" else alone)
    return written(rows.select("_id", "t", "m", F.col(f"y{name}").cast("int").alias("y"), F.col(f"trust{name}").alias("trust")), "quality-taught")


def _sourced(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    return df.select(integer_ids(df, id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), has("lang", "string").alias("_lang"), has("source", "string").alias("_source"), has("n_chars", "long").alias("_n"))


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = 3, per_round: int = 500, share: float = 0.02, confident: float = 0.5, most_labelled: int = 20_000) -> tuple[Model, DataFrame]:
    """The model, and the features of all documents, written once."""
    table = written(features(_sourced(df, id_col, text_col)), "quality-features")
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    labelled = y.select("_id")
    y = y.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    y = written(y.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(5)).cast("int")), "quality-labels")  # at most most_labelled rows
    rows = table.join(F.broadcast(y), "_id").groupBy("_id", "y", "fold").agg(F.min(F.struct("t", "m")).alias("f")).select("_id", "y", "fold", "f.t", "f.m").orderBy("_id").collect()
    t = np.frombuffer(b"".join(r["t"] for r in rows), np.float16).reshape(-1, TEXT).astype(np.float64)
    m = np.frombuffer(b"".join(r["m"] for r in rows), np.float16).reshape(-1, META).astype(np.float64)
    target, fold = np.array([r["y"] for r in rows], np.float64), np.array([r["fold"] for r in rows], np.int64)
    train, cal, combine = fold > 1, fold == 0, fold == 1
    good = float((target > 0).mean()) if len(target) else 1.0
    if len(set(target[combine])) < 2:
        train, combine = train | combine, cal
    if len(set(target[cal])) < 2 or len(set(target[train])) < 2:
        return Model(None, None, (0.0, 0.0, 0.0), good), table
    target = (target > 0).astype(np.float64)
    first = F.min(F.struct(F.xxhash64("_id"), "_id", "m")).alias("s")
    pool = written(table.where("_id IS NOT NULL").join(labelled, "_id", "left_anti").groupBy("t").agg(first).select("s._id", "t", "s.m"), "quality-pool")
    wanted = max(per_round, int(share * pool.count()))
    taught: dict[str, list[DataFrame]] = {"t": [], "m": []}  # what the metadata view teaches the text view, and the other way round

    def together(tables: list[DataFrame]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, tables) if tables else None

    def fitted(x: np.ndarray, name: str, last: Linear | None = None) -> Linear:
        return fit_linear(x[train], target[train], x[cal], target[cal], together(taught[name]), name, last)

    text, meta = fitted(t, "t"), fitted(m, "m")
    for _ in range(rounds):
        marked = _scored_pool(pool, together(taught["t"] + taught["m"]), text, meta)
        middle = marked.agg(*[F.percentile_approx(f"z{name}", 1 - good, 10_000).alias(name) for name in ("t", "m")]).first()
        if middle["t"] is None:  # the pool has been taught
            break
        for name in ("t", "m"):
            marked = _marked(marked, name, {"t": text, "m": meta}[name], middle[name], good, confident, wanted)
        for name, other in (("t", "m"), ("m", "t")):
            taught[other].append(_surest(marked, name, other))
        text, meta = fitted(t, "t", text), fitted(m, "m", meta)
    both = np.column_stack([text.logit(t[combine]), meta.logit(m[combine])])
    w, b = _newton(both, _smooth(target[combine]), ridge=0.1)
    return Model(text, meta, (float(w[0]), float(w[1]), b), good), table


def score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how: object) -> DataFrame:
    """id_col, text_probability, meta_probability, quality, kept (quality of at least threshold) for each row."""
    model, table = fit(df, labels, id_col=id_col, text_col=text_col, **how)
    given = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            p = given.value.probabilities(_arrays(batch, "t", TEXT), _arrays(batch, "m", META))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p)], ["_id", "text_probability", "meta_probability", "quality"])

    out = table.mapInArrow(run, "_id long, text_probability double, meta_probability double, quality double")
    return out.withColumn("kept", F.col("quality") >= threshold).withColumnRenamed("_id", id_col)


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how: object) -> DataFrame:
    """The rows of df that the model keeps; all columns, judged where they are read, without a shuffle."""
    model, _ = fit(df, labels, id_col=id_col, text_col=text_col, **how)
    given = df.sparkSession.sparkContext.broadcast(model)
    place = {c: df.columns.index(c) for c in (text_col, "lang", "source", "n_chars") if c in df.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1_000):
            get = lambda c: part.column(place[c]).to_pylist() if c in place else [None] * part.num_rows  # noqa: B023, E731
            t = np.array([text_features(x) for x in get(text_col)]).astype(np.float16).astype(np.float64)
            m = np.array([meta_features(*x) for x in zip(get("lang"), get("source"), get("n_chars"), strict=True)]).astype(np.float16).astype(np.float64)
            yield part.filter(pa.array(given.value.probabilities(t, m)[2] >= threshold))

    return mapped(df, run)
