"""What a run leaves behind: shuffle files, settings of the session, and jobs of components that have settled."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sensorlake.llm import common, components, pitman_yor


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(common, "_collected", [time.monotonic()])  # not by the garbage collector
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    settings = {k: spark.conf.get(k, None) for k in (common.BATCH, common.FREED)}
    before = _shuffle_files(spark)
    tables = [common.written(df.groupBy("g").agg(F.sum("id").alias("s")), "test"), common.bucketed(df, "g", 4, "test-bucketed")]
    until = time.monotonic() + 10
    while (left := _shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left
    assert {k: spark.conf.get(k, None) for k in settings} == settings
    assert sorted(r["s"] for r in tables[0].collect()) == sorted(sum(range(g, 1000, 7)) for g in range(7))
    assert tables[1].count() == 1000


def test_stars_take_no_further_step(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(components, "written", lambda df, name: (steps.append(name), common.written(df, name))[1])
    stars = [(k * 100 + i, k * 100) for k in range(5) for i in range(1, 9)]
    df = spark.createDataFrame(stars, "u long, v long")
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == dict(stars)
    assert len(steps) == 1
    turned = components.components(df.selectExpr("v AS u", "u AS v")).collect()
    assert {r["node"]: r["component"] for r in turned} == dict(stars)
    # a node with two centres, and a centre with an edge of its own, are no stars
    two = spark.createDataFrame([(5, 1), (5, 2), (9, 7), (7, 6)], "u long, v long")
    assert {r["node"]: r["component"] for r in components.components(two).collect()} == {2: 1, 5: 1, 7: 6, 9: 6}


def test_packed_arrays():
    rng = np.random.default_rng(5)
    kinds = (np.uint8, np.uint16, np.uint32, np.int64, np.float64)
    for n in (0, 1, 1000):
        arrays = [rng.integers(0, 200, n).astype(k) for k in kinds]
        assert all(np.array_equal(a, b) for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays), *kinds), strict=True))
    strided = np.arange(20, dtype=np.int64)[::2]
    assert np.array_equal(pitman_yor.unpack(pitman_yor.pack(strided), np.int64)[0], strided)



def test_scores_send_no_base_of_frequent_words(spark, monkeypatch):
    """What a bucket sends for a document in which all contexts are frequent is one number, its score; the base score is whole all the same."""
    sent = []

    def kept(parts, *more):
        sent.extend(r["data"] for r in parts.where("kind = 1").collect())
        return summed(parts, *more)

    summed = pitman_yor._summed
    monkeypatch.setattr(pitman_yor, "_summed", kept)
    texts = {i: f"a b c a {'x' * (i % 3 + 1)}" for i in range(40)} | {40: "never seen words", 41: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (1 << 18, 2):
        sent.clear()
        got = {r["doc_id"]: r for r in pitman_yor.scores(df, most_words=most).collect()}
        tokens = {i: [*common.words(t), None] for i, t in texts.items()}
        counts = Counter(w for i, ws in tokens.items() if common.crc_mod7(i) != 2 for w in ws)
        for i, ws in tokens.items():
            base = sum(math.log10((counts[w] + 1) / (counts.total() + len(counts) + 1)) for w in ws)
            assert abs(got[i]["base_score"] - base) < 1e-9 and got[i]["n_known"] == sum(counts[w] > 0 for w in ws)
        others = sum(len(pitman_yor.unpack(x, np.uint16, np.float64, np.uint16, np.float64, np.uint32)[2]) for x in sent)
        assert others <= 3 if most > 2 else others > 3  # the words of a document that is held out may be new
