"""Pairs against brute force: ties, copies, midnight, nulls, a hot station."""

import random
from datetime import datetime, timedelta

from rainloom.llm import nearest_time as N

READINGS = "obs_id long, station_id string, time timestamp, id long"
REPORTS = "report_id long, station_id string, report_time timestamp, day int"


def _pairs(spark, reports, readings, tolerance=45):
    found = N.nearest(spark.createDataFrame(reports, REPORTS), spark.createDataFrame(readings, READINGS), "report_time", "time", "report_id", "obs_id", tolerance)
    return {(r.obs_id, r.report_id, r.offset_us) for r in found.collect()}


def brute(reports, readings, tolerance=45):
    out = set()
    for report, station, at, _ in reports:
        if station is None or at is None:
            continue
        near = [(abs(t - at), t, o) for o, s, t, _ in readings if s == station and t is not None and abs(t - at) <= timedelta(seconds=tolerance)]
        if near:
            off, t, o = min(near)
            out.add((o, report, round((t - at) / timedelta(microseconds=1))))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    base = datetime(2020, 1, 1, 23, 50)
    time = lambda: base + timedelta(seconds=r.choice([r.randint(0, 1200), 600, 600 + r.choice([-45, 45, 46]), r.random() * 1200]))
    readings = [(k, r.choice(["hot", "hot", "b", None]), None if k % 30 == 0 else time(), 1) for k in range(300)]
    reports = [(1000 + k, r.choice(["hot", "hot", "b", "none", None]), None if k % 30 == 0 else time(), 1) for k in range(300)]
    assert _pairs(spark, reports, readings) == brute(reports, readings)


def test_tie_and_empty(spark):
    t = datetime(2020, 1, 1)
    assert _pairs(spark, [(9, "a", t, 1)], [(2, "a", t + timedelta(seconds=5), 1), (3, "a", t - timedelta(seconds=5), 1), (1, "a", t - timedelta(seconds=5), 1)]) == {(1, 9, -5_000_000)}
    assert _pairs(spark, [], [(2, "a", t, 1)]) == set() and _pairs(spark, [(9, "a", t, 1)], []) == set()
