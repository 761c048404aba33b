"""The llm queries against their SQL at the smallest scale; the rest must run."""

import glob
import os

import duckdb
import pytest

from rainloom.llm import queries as Q


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, data, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    theirs = db.execute(Q.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    ours = Q.QUERIES[name](spark, data)
    assert _rows(ours.columns, ours.collect()) == _rows(columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() >= 0


def test_sources_with_documents_reach_their_shares(spark, data):
    rows = Q.QUERIES["p9_shares"](spark, data).collect()
    held = [r for r in rows if r.available > 0 and r.max_repeats > 0 and r.target_share > 0]
    share, size = sum(r.target_share for r in held), sum(r.quota for r in held)
    assert size > 0 and all(abs(r.quota - size * r.target_share / share) <= len(held) for r in held)
