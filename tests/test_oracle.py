"""Every query of the engine with an oracle, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sensorlake.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.ORACLE:
        assert got.num_columns > 0
        return
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.column_names) == columns
    duck.register("got", got)
    names = ", ".join(f'"{c}"' for c in columns)
    a = sorted(map(repr, want.select(names).fetchall()))
    b = sorted(map(repr, duck.sql(f"SELECT {names} FROM got").fetchall()))
    duck.unregister("got")
    assert a == b


@pytest.mark.parametrize("name", ["sca_13_metadata", "sca_14_whole_number", "sca_15_orbit_of_data_take", "sca_16_identity", "sca_17_context", "sca_18_unit", "sca_24_key_search"])
def test_documents_of_ids_with_more_than_six_digits(spark, tmp_path, name):
    con, at = duckdb.connect(), f"{tmp_path}/events.parquet"
    con.execute(f"COPY (SELECT * REPLACE (event_id + k AS event_id) FROM '{SF}/events.parquet', (VALUES (0), (999_500), (1_234_000), (123_456_000)) s(k)) TO '{at}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toArrow(), con.sql(registry.ORACLE[name])  # noqa: F841
    names = ", ".join(want.columns)
    assert sorted(map(repr, con.sql(f"SELECT {names} FROM got").fetchall())) == sorted(map(repr, want.select(names).fetchall()))
