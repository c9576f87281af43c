"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from sensorlake.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.column_names) == columns
    duck.register("got", got)
    names = ", ".join(f'"{c}"' for c in columns)
    a, b = (sorted(map(repr, duck.sql(f"SELECT {names} FROM {x}").fetchall())) for x in (f"({queries.ORACLE[name]})", "got"))
    duck.unregister("got")
    assert a and a == b
