"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import ball_kmeans, decontaminate, hard_negatives, jaccard_join, packing, pitman_yor, quality_classifier, quality_rules, secret_scans, simhash, token_counts, url_filter, warc
from sensorlake.llm.common import WORD, new_path, table, written

BPE = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", *[F.round(c, 6).alias(c) for c in ("text_probability", "meta_probability", "quality")], "kept")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


#: The host rules of the result contract, then patterns that block what these leave open.
HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
BLOCKED = [r"\bspam-farm\.", r"\bcheap-pills\.", r"\bcasino\b", r"\bporn\b", r"\bviagra\b", r"\bwarez\b", r"\bfree-money\b"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(i, text, action) for i, (text, action) in enumerate(HOST_RULES)]
    rules += [url_filter.Rule(100 + i, p, p, "block", 0) for i, p in enumerate(BLOCKED)]
    best = url_filter.best_rules(table(spark, sf_dir, "pages"), rules, id_col="page_id", url_col="url")
    return best.select("page_id", "host", "path", F.when(F.col("priority") > 0, F.col("rule")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.stored(table(spark, sf_dir, "documents")), "base", "base_ok")
    led = quality_rules.apply_policy(led, "2024-1", "policy_ok")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), (F.col("base_ok") & F.col("policy_ok")).alias("kept"), "failure_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, alone and with the others, from one stored ledger."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"), "first_word")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan_all(table(spark, sf_dir, "documents"), columns=["doc_id"])
    n = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"].isin(*secret_scans.BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("_spans")).alias("spans"))


#: The access rule as a later version widens it.
ACCESS_2 = secret_scans.SecretRule("access", 2, r"A(?:KI|SI)A[A-Z0-9]{16,}", 1)


def secret_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on one ledger: documents of even ids, then all of them, then all with a new version of one rule. Each scans what is new only."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "secret-increments")
    upgraded = [ACCESS_2 if r.kind == "access" else r for r in secret_scans.RULES]
    out = None
    for step, rows, rules in (("even", docs.where("doc_id % 2 = 0"), secret_scans.RULES), ("all", docs, secret_scans.RULES), ("upgrade", docs, upgraded)):
        ledger = secret_scans.read_ledger(spark, path)
        new = written(secret_scans.scan(rows, ledger, rules), "secret-new")
        new.write.mode("append").parquet(path)
        counts = secret_scans.new_pairs(new, step)
        out = counts if out is None else out.unionByName(counts)
    return out


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = written(warc.write_warc(table(spark, sf_dir, "pages"), folder), "warc-files")
    return warc.read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(noisy, F.col("id") % 50 == 0)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scans": op6_secret_scans,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_simhash": op11_simhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ball_kmeans": op13_ball_kmeans,
    "quality_ablations": quality_ablations,
    "secret_increments": secret_increments,
}


_HOST_PATH = r"""
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages"""

_OP3 = rf"""
WITH r AS ({_HOST_PATH}),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, rhost, rpath, action) AS (VALUES {', '.join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{a}')" for t, a in HOST_RULES)}),
m AS (SELECT h.*, (SELECT max_by(struct_pack(rule := rule, action := action), length(rule)) FROM rules
        WHERE (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)) AS best FROM h)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.action, CASE WHEN regexp_matches(host || path, '{'|'.join(BLOCKED)}') THEN 'block' ELSE 'allow' END) AS verdict FROM m"""

_LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT rid, i, {' || chr(32) || '.join('word' if j == 0 else f'lead(word, {j}) OVER p' for j in range(8))} AS key FROM x WINDOW p AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, key) AS n FROM k WHERE key IS NOT NULL) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, range(8) AS s(j) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, {' | '.join(f'(CASE WHEN {fails} THEN {quality_rules.bit(name)} ELSE 0 END)' for name, fails in quality_rules.RULES.items())} AS failure_bits FROM m)
"""

_OP4 = _LEDGER + rf"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       failure_bits & {quality_rules.mask('base') | quality_rules.mask('2024-1')} = 0 AS kept, CAST(failure_bits AS BIGINT) AS failure_bits FROM b"""


_ABLATIONS = _LEDGER + f"""
, pr(policy, rule, mask, bit) AS (VALUES {', '.join(f"('{p}', '{r}', {quality_rules.mask(p)}, {quality_rules.bit(r)})" for p, rules in quality_rules.POLICIES.items() for r in rules)})
SELECT policy, rule, count(*) FILTER (failure_bits & bit <> 0) AS failed, count(*) FILTER (failure_bits & mask = bit) AS only_this, count(*) FILTER (failure_bits & mask = 0) AS kept FROM pr, b GROUP BY policy, rule"""


def _op6_kind(rule: secret_scans.SecretRule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT rid, '{rule.kind}' AS kind, {rule.order} AS o, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS g, string_split_regex(t, '{p}') AS b FROM d))
  WHERE length(g[i]) >= {rule.least}"""


_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_op6_kind(r) for r in secret_scans.RULES)}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) AS spans,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, o) FILTER (kind IN ('assign', 'access', 'hex')) AS base FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


def _increment(step: str, texts: str, rules: list[secret_scans.SecretRule]) -> str:
    """Counts of one run, for the given distinct new texts and rule versions."""
    return " UNION ALL ".join(f"""
SELECT '{step}' AS step, '{r.key}' AS rule, count(*) AS blobs, CAST(coalesce(sum(len(list_filter(regexp_extract_all(t, '{r.pattern.replace("'", "''")}', {r.group}), lambda g: length(g) >= {r.least}))), 0) AS BIGINT) AS spans FROM {texts}""" for r in rules)


_INCREMENTS = f"""
WITH d AS (SELECT coalesce(text, '') AS t, min(doc_id % 2) AS odd FROM documents GROUP BY ALL), e AS (SELECT t FROM d WHERE odd = 0), o AS (SELECT t FROM d WHERE odd = 1)
{_increment('even', 'e', secret_scans.RULES)} UNION ALL {_increment('all', 'o', secret_scans.RULES)} UNION ALL {_increment('upgrade', 'd', [ACCESS_2])}"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT doc_id, key FROM (
        SELECT doc_id, {' || chr(32) || '.join('word' if j == 0 else f'lead(word, {j}) OVER p' for j in range(5))} AS key FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4) WHERE key IS NOT NULL),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM pairs JOIN c cu ON cu.doc_id = u JOIN c cv ON cv.doc_id = v WHERE 100 * k >= 80 * (cu.n + cv.n - k)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(node, comp) AS (SELECT v, u FROM e UNION SELECT b.v, r.comp FROM r JOIN sym b ON b.u = r.node WHERE r.comp < b.v),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.node = d.doc_id"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, {at}, 5) AS INT) >> {shift}) & 31) + 1, 1)"

_OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, {' || '.join(_DIGIT.format(at=5 * k + 1, shift=s) for k in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN g USING (h)"""

_KEPT = """embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"""
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"

_OP12 = f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST({_WHOLE} AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND {_KEPT}),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""


def _op13_round(r: int) -> str:
    """Assignment to the entries b{r}, and the entries b{r + 1} after it."""
    d = " + ".join(f"(x.x{i} - b.x{i}) * (x.x{i} - b.x{i})" for i in range(4))
    mean = ", ".join(f"coalesce(m.x{i}, b.x{i}) AS x{i}" for i in range(4))
    sums = ", ".join(f"CAST(floor(CAST(sum(x.x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in range(4))
    return f"""
a{r} AS (SELECT rid, p, min(struct_pack(d := {d}, e := e)) AS m FROM x JOIN b{r} b USING (p) GROUP BY rid, p),
m{r} AS (SELECT a.p, a.m.e AS e, {sums} FROM a{r} a JOIN x ON x.rid = a.rid AND x.p = a.p GROUP BY ALL),
b{r + 1} AS (SELECT b.p, b.e, {mean} FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""


_OP13 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_KEPT}),
x AS (SELECT rid, p, {', '.join(f'v[4 * p + {i + 1}] AS x{i}' for i in range(4))} FROM k, range(16) t(p)),
b0 AS (SELECT p, rid - 1 AS e, x0, x1, x2, x3 FROM x WHERE rid <= 64), {_op13_round(0)}, {_op13_round(1)}, {_op13_round(2)},
c AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM c JOIN k USING (rid)"""

ORACLE: dict[str, str] = {"op3_url_filter": _OP3, "op4_quality_rules": _OP4, "op6_secret_scans": _OP6, "op7_jaccard_join": _OP7, "op10_warc": _OP10, "op12_hard_negatives": _OP12, "op13_ball_kmeans": _OP13, "quality_ablations": _ABLATIONS, "secret_increments": _INCREMENTS}
