"""Training-corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rejected
documents go, one document of each near-duplicate class (80 % of five-word shingles) stays, documents that leak a
benchmark item go, secrets are replaced by a mark, and what is left is packed into power-of-two sequences.

Defined results of all stages: a null or empty text, a null in any other column and repeated rows pass through like any row, as told at each
stage; an empty table gives an empty table of the same columns; further columns, of whatever names, are kept up to the last stage; ids are whole
numbers (text ids raise an error).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import decontaminate, jaccard_join, packing, quality_classifier, secret_scans
from sensorlake.llm.common import fresh, table, written

#: SQL cannot express the classifier, the index search and the token ids; the tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier gives at least an even chance of high quality. A null text counts as empty, null metadata as a value of
    its own; equal rows are judged alike; without labels of both classes all rows stay or all go with the share of good ones."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class of texts that links of at least 80 % of five-word shingles join; one of the rows that share an id.
    Texts without words are linked with nothing and stay, as do rows with a null id."""
    return jaccard_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, by BM25 score and by word pairs of question and answer. Null and empty texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by [SECRET], and n_chars follows where a text has changed. Null texts stay null."""
    spans, clean = fresh(docs, "_spans"), fresh(docs, "_clean")
    found = secret_scans.scan_all(docs, rules=secret_scans.REDACTED, spans_col=spans)
    found = found.withColumn(clean, secret_scans.redacted("text", spans))
    n_chars = F.when(F.size(spans) > 0, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", F.col(clean)).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own in the bucket of its length. Null and empty texts give one piece, the end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what goes from one to the next is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
