r"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps its measurements and one failure bit a rule, and is stored: texts
are not read again for a policy. Policies are versioned sets of rules: applying one is a bitwise AND over the stored bits, and
ablations come from counts by distinct bit patterns.

Defined results: a null text has no words, measures 0 and fails `few_words`; repeated rows are judged each; an empty table
gives an empty ledger; extra columns are ignored. Equal eight-word windows are found by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import SPACE, WORD, written

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]

#: Rule name -> failure, as SQL over the measurements. A rule's bit is its place in this table; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines",
    "upper_case": "10 * n_upper > 6 * n_letters",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
}

#: Policy version -> its rules. Versions are never changed, only added.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "2024-1": list(RULES),
    "2024-1-lenient": ["few_words", "repeated_windows", "symbols"],
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeat_words(n: int = WINDOW) -> Column:
    """Words inside windows of n words that stand twice or more in a text; _order has windows and places by hash where some are equal."""
    return F.expr(f"""
      CASE WHEN _order IS NULL THEN 0L
           ELSE aggregate(
             array_sort(transform(filter(_order, (s, i) -> (i > 0 AND _order[i - 1].h = s.h) OR (i + 1 < size(_order) AND _order[i + 1].h = s.h)), s -> s.p)),
             named_struct('n', 0L, 'end', 0),
             (a, p) -> named_struct('n', a.n + least({n}, p + {n} - a.end), 'end', p + {n}),
             a -> a.n) END""")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measurements; no shuffle."""
    t = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    t = t.withColumn("_words", F.expr(rf"filter(split(_text, r'{SPACE}+'), w -> w <> '')"))
    t = t.withColumn("_lines", F.expr(rf"filter(split(_text, '\n'), l -> l RLIKE r'{WORD}')"))
    t = t.withColumn("_wins", F.expr(f"CASE WHEN size(_words) > {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) ELSE array() END"))
    t = t.withColumn("_order", F.expr("CASE WHEN size(array_distinct(_wins)) < size(_wins) THEN array_sort(transform(_wins, (h, i) -> named_struct('h', h, 'p', i))) END"))
    length = lambda pattern: F.expr(f"cast(char_length(regexp_replace(_text, r'{pattern}', '')) AS long)")
    return t.select(
        F.col("_id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        length(SPACE).alias("word_chars"),
        length("[^#*$%&|<>]").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        length(r"[^\p{Lu}]").alias("n_upper"),
        length(r"[^\p{L}]").alias("n_letters"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure_bits (long) of each document."""
    bits = " | ".join(f"(CASE WHEN {fails} THEN {bit(name)}L ELSE 0L END)" for name, fails in RULES.items())
    return measured(df, id_col, text_col).withColumn("failure_bits", F.expr(bits))


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written once to the shared folder and read back."""
    return written(ledger(df, id_col, text_col), "quality-ledger")


def apply_policy(led: DataFrame, policy: str, name: str = "kept") -> DataFrame:
    return led.withColumn(name, F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(led: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """policy, rule, failed, only_this (documents that the policy would keep without this rule), kept. Grouped by distinct bits first: at most 2^rules rows go on."""
    nothing = led.sparkSession.createDataFrame([(0, 0)], "failure_bits long, n long")  # so that policies show on an empty ledger
    counts = led.groupBy("failure_bits").agg(F.count("*").alias("n")).unionByName(nothing)
    asked = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(bit(r)).cast("long").alias("bit")) for p in policies or POLICIES for r in POLICIES[p]]
    each = counts.select("failure_bits", "n", F.explode(F.array(*asked)).alias("a")).select("failure_bits", "n", "a.*")
    hit = F.col("failure_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(total(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"), total(hit == F.col("bit")).alias("only_this"), total(hit == 0).alias("kept"))
