"""Slots against brute force; interpolation by hand."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from rainloom.operators import regular_grid as G

SCHEMA = "obs_id long, station_id string, time timestamp, sample_interval int, value double, step int"


def brute(rows):
    by_day = {}
    for _, s, t, si, *_ in rows:
        if s is not None and t is not None:
            by_day.setdefault((s, (t - datetime(1970, 1, 1)).days), []).append((t, si))
    filled, steps = set(), {}
    for (s, day), readings in by_day.items():
        votes = Counter(si for _, si in readings if si is not None and 1 <= si <= 3600)
        if not votes:
            continue
        step = steps[(s, day)] = min(votes, key=lambda k: (-votes[k], k))
        slots = [*range(0, 86400, step), 86400]
        for t, _ in readings:
            second = (t - datetime(1970, 1, 1) - timedelta(days=day)).total_seconds()
            filled.add((s, day * 86400 + min(slots, key=lambda x: (abs(x - second), x))))
    out = set()
    for (s, day), step in steps.items():
        mine = [x for a, x in filled if a == s and x // 86400 == day]
        if mine:
            out |= {(s, x) for x in range(min(mine), max(mine) + 1, step)} - filled
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_missing_slots(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(400):
        t = datetime(2020, 1, r.randint(1, 3)) + timedelta(seconds=r.choice([0, 30, 15.5, 43200]) + 60 * r.randint(0, 300))
        t = datetime(2020, 1, r.randint(1, 3), 23, 59, 59, 900000) if k % 40 == 0 else t
        rows.append((k, r.choice(["A", "B", "C", None]), None if k % 27 == 0 else t, r.choice([60, 60, 120, 70, 0, None, 65535]), r.random(), 1))
    found = {(x.station_id, x.slot_epoch_s) for x in G.missing_slots(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def test_interpolation(spark):
    t = datetime(2020, 1, 1, 23, 58)
    rows = [(1, "A", t, 60, 1.0, 1), (2, "A", t + timedelta(seconds=30), 60, float("nan"), 1), (3, "A", t + timedelta(minutes=4), 60, 5.0, 1), (4, "A", t + timedelta(minutes=4), 60, 7.0, 1), (5, "A", t + timedelta(minutes=30), 60, 0.0, 1)]
    out = {x.slot_epoch_s: x for x in G.regular_series(spark.createDataFrame(rows, SCHEMA), ("value",), 10).collect()}
    base = round((t - datetime(1970, 1, 1)).total_seconds())
    assert out[base].value == 1.0 and out[base].value_fill == "exact" and not out[base].is_missing
    assert out[base + 240].value == 6.0  # the mean of two at one time, after midnight
    assert out[base + 600].value_fill == "gap" and out[base + 600].value is None and out[base + 600].is_missing


def test_series_over_midnight_and_empty_days(spark):
    day = datetime(2020, 1, 1)
    rows = [(k, "A", day + timedelta(hours=h), si, float(h), 1) for k, (h, si) in enumerate([(22, 3600), (26, 3600), (27, 3600), (74.5, 1800), (75, 1800)])]
    rows += [(9, "B", day + timedelta(hours=23, minutes=50), 3600, 1.0, 1), (10, "B", day + timedelta(hours=26), None, 2.0, 1), (11, "B", day + timedelta(hours=49), 3600, 3.0, 1)]
    out = G.regular_series(spark.createDataFrame(rows, SCHEMA), ("value",), 4).collect()
    base = round((day - datetime(1970, 1, 1)).total_seconds())
    found = {s: sorted(((x.slot_epoch_s - base) / 3600, x.is_missing) for x in out if x.station_id == s) for s in "AB"}
    filled = {22, 26, 27, 74.5, 75}
    assert found["A"] == [(h, h not in filled) for h in [*range(22, 72), *[72 + k / 2 for k in range(7)]]]
    assert found["B"] == [(h, h not in (24, 49)) for h in range(24, 50)]
    at = {(x.slot_epoch_s - base) / 3600: x for x in out if x.station_id == "A"}
    assert at[23].value == 23 and at[24].value == 24 and at[24].value_fill == "interpolated"
    assert at[50].value is None and at[50].value_fill == "gap" and at[50].step == 3600


def test_empty(spark):
    assert G.missing_slots(spark.createDataFrame([], SCHEMA)).count() == 0
