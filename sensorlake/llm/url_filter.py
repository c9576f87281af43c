r"""URL pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path. Its literal tokens are the whole words (`\w+`) that every match must contain:
runs of literals, cut at other characters, whose ends are proven by a literal neighbour, a word boundary or an anchor.
Each rule is filed under the one of them that is rarest among the URLs. A URL's words fetch the candidate
rules, and only those run their expression; rules without such a token run on every URL. Rules are broadcast in passes of
`per_pass` at most, so any number of rules works with a bounded broadcast.

Defined results: null URLs and URLs without `://` have empty host and path and match nothing but rules for the empty
text; repeated rows are judged each; no rules or an empty table are fine; equal priorities go to the smaller rule id;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9_]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGE = "\x00"  # stands for a proven word edge


@dataclass(frozen=True)
class Rule:
    rule_id: int
    name: str
    pattern: str
    action: str
    priority: int


def host_rule(rule_id: int, text: str, action: str) -> Rule:
    """A rule such as `example.com/en/`: the host and all its subdomains, paths that start so; longer rules come first."""
    host, _, path = text.partition("/")
    return Rule(rule_id, text, rf"^(?:[^/]*\.)?\b{re.escape(host)}{re.escape('/' + path)}", action, len(text))


def literal_tokens(pattern: str) -> set[str]:
    """Words that every match contains as whole words, lower-cased."""
    runs, run = [], ""
    for op, arg in sre_parser.parse(pattern, re.ASCII):
        if op is sre.LITERAL:
            run += chr(arg)
        elif op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_BOUNDARY, sre.AT_END_STRING):
            run += _EDGE
        else:
            runs.append(run)
            run = ""
    found = set()
    for r in [*runs, run]:
        found |= {m[0].lower() for m in TOKEN.finditer(r) if m.start() > 0 and m.end() < len(r)}
    return found


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def token_frequencies(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many times each wanted token stands in all host + path texts; at most one row a wanted token reaches the driver."""
    if not wanted:
        return {}
    tokens = urls.select(F.explode(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9_]+")).alias("t"))
    names = urls.sparkSession.createDataFrame([(w,) for w in sorted(wanted)], "t string")
    return {r["t"]: r["count"] for r in tokens.join(F.broadcast(names), "t").groupBy("t").count().collect()}


def build_index(rules: list[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> positions of rules, and the positions of rules without a token."""
    index: dict[str, list[int]] = defaultdict(list)
    always = []
    for i, r in enumerate(rules):
        tokens = literal_tokens(r.pattern)
        if tokens:
            index[min(tokens, key=lambda t: (frequency.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(index), always


def best_rules(df: DataFrame, rules: list[Rule], *, id_col: str, url_col: str, per_pass: int = 20_000) -> DataFrame:
    """id_col, host, path, and of the best matching rule: rule, action, priority, rule_id (null without a match); candidates: how many rules ran."""
    urls = with_host_path(df.select(F.col(id_col), F.col(url_col).alias("_url")), "_url").select(F.col(id_col).alias("_id"), "host", "path")
    frequency = token_frequencies(urls, set().union(*[literal_tokens(r.pattern) for r in rules]))
    kind = urls.schema["_id"].dataType.simpleString()
    out = urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string"), "priority": F.lit(None).cast("long"), "rule_id": F.lit(None).cast("long"), "candidates": F.lit(0).cast("long")})
    for at in range(0, len(rules), per_pass):
        part = sorted(rules[at : at + per_pass], key=lambda r: r.rule_id)
        given = urls.sparkSession.sparkContext.broadcast((part, *build_index(part, frequency)))

        def judge(batches: Iterator[pa.RecordBatch], given: object = given) -> Iterator[pa.RecordBatch]:
            these, index, always = given.value
            compiled: dict[int, re.Pattern] = {}
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                for i, (host, path) in enumerate(zip(cols[1], cols[2], strict=True)):
                    key = host + path
                    wanted = [*always, *(k for t in {t.lower() for t in TOKEN.findall(key)} for k in index.get(t, ()))]
                    cols[7][i] += len(wanted)
                    for k in wanted:
                        if k not in compiled:
                            compiled[k] = re.compile(these[k].pattern, re.ASCII)
                        r = these[k]
                        if compiled[k].search(key) and (cols[6][i] is None or (r.priority, -r.rule_id) > (cols[5][i], -cols[6][i])):
                            cols[3][i], cols[4][i], cols[5][i], cols[6][i] = r.name, r.action, r.priority, r.rule_id
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(batch.schema)[1:], strict=True))], schema=batch.schema)

        out = out.mapInArrow(judge, f"_id {kind}, host string, path string, rule string, action string, priority long, rule_id long, candidates long")
    return out.withColumnRenamed("_id", id_col)
