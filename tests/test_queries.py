"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

from check_oracle import TABLES, rows
from __spark_entry__ import entry, oracle_sql, queries

#: Compared with brute force or held-out rows in tests/llm and tests/test_models.py instead.
WITHOUT_SQL = {n for n in set(queries()) - set(oracle_sql())}


@pytest.fixture(scope="module")
def base(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return connection


def test_every_ticket_query_has_sql():
    assert not {n for n in WITHOUT_SQL if not n.startswith("op") and n != "pipeline"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_query_equals_sql(spark, folder, base, name):
    found = queries()[name](spark, folder)
    cursor = base.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, cursor.fetchall())


def test_smaller_anchors_are_in_the_vocabulary(spark, folder):
    found = queries()["nv_anchor_weights"](spark, folder)
    sides = [c for c in found.columns if c.startswith("anchor_")]
    assert found.count() > 0 and found.where(" + ".join(sides) + " = 0").count() == 0 and found.where("df < 1").count() == 0


def test_entry(spark):
    assert {r.priority for r in entry(spark).collect()} == {"Low", "Medium", "High", "Critical"}
