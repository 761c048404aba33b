"""Percentiles within the promised error, merged from any parts."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from rainloom.llm import quantile_sketch as Q


def _ranked(values, q):
    values = sorted(values)
    return values[math.floor(q * (len(values) - 1))]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for k in range(4000):
        x = r.choice([r.lognormvariate(0, 3), -r.lognormvariate(0, 2), 0.0, 5.0, 1e-300, -1e300])
        out.append((k, "hot" if k % 3 else r.choice(["a", None]), date(2020, 1, k % 5 + 1), x, "clash"))
    return out + [(5000, "a", None, float("nan"), ""), (5001, "a", None, float("inf"), ""), (5002, "a", None, None, ""), (5003, "only", None, None, "")]


SCHEMA = "row_id long, station string, day date, x double, bucket string"


def test_error_bound_and_merging(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    parts = Q.sketch(df, ["station", "day"], ["x"])
    merged = {r.station: r for r in Q.percentiles(Q.merge(parts, ["station"]), ["station"]).collect()}
    direct = {r.station: r for r in Q.percentiles(Q.sketch(df, ["station"], ["x"]), ["station"]).collect()}
    assert merged == direct and set(merged) == {"hot", "a", None}
    for station, found in merged.items():
        values = [x for _, s, _, x, _ in rows if s == station and x is not None and math.isfinite(x)]
        assert found.n == len(values)
        for q in Q.PERCENTILES:
            true = _ranked(values, q)
            assert abs(found[f"p{round(q * 100):02d}"] - true) <= Q.ACCURACY * abs(true) * (1 + 1e-9)


def test_empty_and_single(spark):
    assert Q.percentiles(Q.sketch(spark.createDataFrame([], SCHEMA), ["station"], ["x"]), ["station"]).count() == 0
    one = spark.createDataFrame([(1, "s", None, -2.0, "")], SCHEMA)
    assert abs(Q.percentiles(Q.sketch(one, ["station"], ["x"]), ["station"]).first().p50 + 2.0) <= 0.02


def test_plan_combines_before_the_exchange(spark, rows):
    plan = Q.sketch(spark.createDataFrame(rows, SCHEMA), ["station"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.index("partial_count") > 0
    assert F is not None
