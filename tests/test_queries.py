"""Registered queries on small tables against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skerry.plans import registry


def against_sql(spark, folder, name, **tables):
    """The sorted rows of a query on tables (columns by name), which must be those of its SQL."""
    db = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    got = sorted((tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()), key=key)
    assert got == sorted(db.execute(registry.ORACLES[name]).fetchall(), key=key)
    return got


@pytest.mark.parametrize("n", [30, 100])
def test_all_dependents_of_modules_beside_external_ones(spark, tmp_path, n):
    assert against_sql(spark, tmp_path, "all_dependents", supplier={"s_suppkey": pa.array(range(n), pa.int64())})


@pytest.mark.parametrize("keys", [range(70), [*range(3, 40), *range(1000, 1033)]])
def test_dependency_depth_of_all_parts_by_all_calls(spark, tmp_path, monkeypatch, keys):
    """Calls ten further count, and parts below ten; keys may have gaps."""
    from skerry.operators import iterate

    monkeypatch.setattr(iterate, "LOCAL_EDGES", 0 if len(keys) == 70 and keys[0] else iterate.LOCAL_EDGES)
    got = against_sql(spark, tmp_path, "dependency_depth", part={"p_partkey": pa.array(keys, pa.int64())})
    assert len(got) == 70 and max(depth or 0 for _, depth, _ in got) > 4
