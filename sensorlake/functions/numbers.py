"""Numbers that must come out alike in two engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady(x: Column | str) -> Column:
    """Six decimals. The edge between two results lies off the decimal halves, so that exact halves do not depend on the last bit."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 1e6 + 0.4997) / 1e6


def steady_sql(text: str) -> str:
    """The same for `round(x, 6)` in oracle SQL."""
    head, at = "round(", text.find("round(")
    while at >= 0:
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at = text.find(head, at + 1)
            continue
        end, depth = at + len(head), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        body = text[at + len(head) : end - 1]
        if body.endswith(", 6"):
            text = f"{text[:at]}(floor(({body[:-3]}) * 1e6 + 0.4997) / 1e6){text[end:]}"
        at = text.find(head, at + 1)
    return text
