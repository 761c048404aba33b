"""Every registered query with SQL against DuckDB, at the smallest scale; the rest must run."""

import glob
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

CORE = importlib.import_module("rainloom.plans")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v).removesuffix(" 00:00:00")

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(CORE.all_oracles()))
def test_against_sql(spark, data, db, name):
    ours = CORE.all_queries()[name](spark, data)
    theirs = db.execute(CORE.all_oracles()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert _rows(ours.columns, ours.collect()) == _rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "regularize_timesteps", "split_sampling_intervals", "split_into_events", "stratified_sample", "powerlaw_fit", "grid_snap_lookup"])
def test_runs(spark, data, name):
    assert CORE.all_queries()[name](spark, data).count() >= 0


def test_contract(spark, data):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns == ["station_id", "time", "R", "Z", "Dm", "rank"]
