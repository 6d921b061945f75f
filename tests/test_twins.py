"""Every registered query of the engine's own operators against its SQL twin, over whole tables."""

import os

import duckdb
import pytest

from ketframe.plans import registry

FOLDER = "/root/testdata/sf0.01"
QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER), db.execute(TWINS[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    twin = sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=repr)
    assert rows == twin


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
