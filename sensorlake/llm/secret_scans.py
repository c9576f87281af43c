r"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. Only pairs of blob and rule version that the ledger does not hold are
scanned; findings are appended to the ledger with the version of their rule and joined back to all rows that hold the blob, so
copies are scanned once. A caller gets the findings of the rule versions that it asks for, whatever else the ledger holds.
Spans are code points, end exclusive.

Defined results: a null text is the empty blob; repeated rows get the findings of their blob each; an empty table adds
nothing to the ledger; a text without findings has an empty array of spans; other columns are kept or ignored by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import fresh, written


@dataclass(frozen=True)
class SecretRule:
    """kind and version name the rule; a match counts if `group` has at least `least` characters. order sorts spans that start together."""

    kind: str
    version: int
    pattern: str
    order: int
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three kinds that the result contract names, then those that this scanner adds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    SecretRule("assign", 1, ASSIGN, 0, group=2, least=6),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{16,}", 1),
    SecretRule("hex", 1, r"[0-9a-f]{24,}", 2),
    SecretRule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 3),
    SecretRule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 4),
    SecretRule("hub_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 5),
]
# A whole key: from its first line to its last, or to the end of its base64 lines where the last is missing.
KEY = r"-----BEGIN [A-Za-z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*(?:-(?!----)[^-]*){0,20}-----END [A-Za-z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s*Proc-Type:[^\n]*\n\s*DEK-Info:[^\n]*\n)?[A-Za-z0-9+/=\\\r\n]*)"
#: What the pipeline takes out of texts: the rules above, but whole keys.
REDACTED = [SecretRule("private_key", 2, KEY, r.order) if r.kind == "private_key" else r for r in RULES]
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,ord:int,end:int,kind:string>"
#: In the ledger a span carries the version of its rule.
FOUND = "struct<start:int,ord:int,end:int,kind:string,version:int>"
LEDGER = f"blob string, rules array<string>, spans array<{FOUND}>"


def _matched(df: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """For each rule arrays of its matches (_m), of the texts before them (_b) and of the groups that are measured (_g)."""
    for r in rules:
        p = r.pattern.replace("'", "\\x27")
        m, wanted = f"_m_{r.kind}", f"array_contains(rules, '{r.key}')"
        df = df.withColumn(m, F.expr(f"CASE WHEN {wanted} THEN regexp_extract_all(_text, r'{p}', 0) END"))
        df = df.withColumn(f"_b_{r.kind}", F.expr(f"CASE WHEN size({m}) > 0 THEN slice(split(_text, r'{p}'), 1, size({m})) END"))
        df = df.withColumn(f"_g_{r.kind}", F.expr(f"CASE WHEN size({m}) > 0 THEN regexp_extract_all(_text, r'{p}', {r.group}) END"))
    return df


def _spans_sql(r: SecretRule) -> str:
    """Spans of one rule: the lengths of the matches and of the text between them give every position."""
    m, b, g, none = f"_m_{r.kind}", f"_b_{r.kind}", f"_g_{r.kind}", f"cast(array() AS array<{FOUND}>)"
    start = f"a.at + char_length({b}[i])"
    return f"""CASE WHEN size({m}) > 0 THEN aggregate(sequence(0, size({m}) - 1), named_struct('at', 0, 'out', {none}),
        (a, i) -> named_struct('at', {start} + char_length({m}[i]),
          'out', CASE WHEN char_length({g}[i]) >= {r.least} THEN array_append(a.out, named_struct('start', {start}, 'ord', {r.order}, 'end', {start} + char_length({m}[i]), 'kind', '{r.kind}', 'version', {r.version})) ELSE a.out END),
        a -> a.out) ELSE {none} END"""


def blob_of(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None, rules: list[SecretRule] | None = None, text_col: str = "text") -> DataFrame:
    """Rows to append to the ledger: blob, rules (the keys that were scanned now), spans. versions may hold any number of versions and copies."""
    rules = RULES if rules is None else rules
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).dropDuplicates(["blob"])
    if ledger is None:
        todo = blobs.withColumn("rules", keys)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("_seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.when(F.col("_seen").isNull(), keys).otherwise(F.array_except(keys, "_seen"))).where(F.size("rules") > 0)
    parts = ", ".join(_spans_sql(r) for r in rules)
    return _matched(todo, rules).select("blob", "rules", F.expr(f"array_sort(concat({parts}))").alias("spans"))


def findings(ledger: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """blob, spans of the given rule versions; only blobs that have some. A blob has one row a scan in the ledger, not one a copy."""
    wanted = [r.key for r in (RULES if rules is None else rules)]
    some = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).where(F.concat("s.kind", F.lit("@"), "s.version").isin(wanted))
    some = some.select("blob", F.struct("s.start", "s.ord", "s.end", "s.kind").alias("s"))
    return some.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def scan_all(df: DataFrame, ledger_path: str | None = None, *, text_col: str = "text", columns: list[str] | None = None, rules: list[SecretRule] | None = None, spans_col: str = "_spans") -> DataFrame:
    """The given columns of df and the spans as spans_col, which takes the place of a column of that name. With ledger_path the ledger there is read, extended and kept for later runs."""
    spark = df.sparkSession
    if ledger_path is None:
        ledger = written(scan(df, None, rules, text_col), "secret-ledger")
    else:
        old = read_ledger(spark, ledger_path)
        scan(df, old, rules, text_col).write.mode("append").parquet(ledger_path)
        ledger = read_ledger(spark, ledger_path)
    kept = [c for c in (columns if columns is not None else df.columns) if c != spans_col]
    blob, found = fresh(df, "_blob"), fresh(df, "_found")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], blob_of(text_col).alias(blob))
    spans = findings(ledger, rules).withColumnsRenamed({"blob": blob, "spans": found})
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    return rows.join(spans, blob, "left").select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(found), none).alias(spans_col))


def new_pairs(rows: DataFrame, step: str) -> DataFrame:
    """step, rule, blobs, spans: how many blobs rows of a ledger tell that a rule version has been scanned over, and what it found there."""
    scanned = rows.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("blobs"))
    found = rows.select(F.explode("spans").alias("s")).groupBy(F.concat("s.kind", F.lit("@"), "s.version").alias("rule")).agg(F.count("*").alias("spans"))
    return scanned.join(found, "rule", "left").select(F.lit(step).alias("step"), "rule", "blobs", F.coalesce("spans", F.lit(0)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; an empty one where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], LEDGER)


def redacted(text_col: str, spans_col: str, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced."""
    return F.expr(f"""
      CASE WHEN size({spans_col}) = 0 THEN `{text_col}` ELSE
        aggregate({spans_col}, named_struct('at', 0, 'out', cast('' AS string)),
          (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, substring(`{text_col}`, a.at + 1, s.start - a.at), '{mark}'))
                         ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END,
          a -> concat(a.out, substring(`{text_col}`, a.at + 1))) END""")
