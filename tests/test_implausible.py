"""Spikes, stuck values and bounds on series with known faults, also over midnight and with copies."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rainloom.operators import implausible as I

SCHEMA = "obs_id long, station_id string, time timestamp, rainfall_rate_32bit double, sensor_temperature double, laser_amplitude double"


def _series(n=2880, seed=0):
    random = np.random.default_rng(seed)
    start = datetime(2020, 1, 1)
    temperature = np.round(10 + 3 * np.sin(np.arange(n) / 400) + random.normal(0, 0.2, n), 1)
    laser = np.round(20000 + random.normal(0, 100, n))
    rain = np.where(np.arange(n) % 600 < 60, np.round(np.sin(np.arange(n) % 600 / 60 * np.pi) * 5 * random.uniform(0.9, 1.1, n), 2), 0.0)
    return [start + timedelta(seconds=60 * k) for k in range(n)], rain, temperature, laser


@pytest.fixture(scope="module")
def found(spark):
    times, rain, temperature, laser = _series()
    expected = set()

    def fault(field, array, at, values, name):
        for k, v in zip(at, values):
            array[k] = v
            expected.add((k, field, name))

    fault("sensor_temperature", temperature, [500], [25.0], "spike")
    fault("sensor_temperature", temperature, [1438, 1439, 1440], [-9.0, -9.1, -9.2], "spike")  # over midnight
    fault("laser_amplitude", laser, range(1425, 1455), [20111.0] * 30, "stuck")  # over midnight
    fault("laser_amplitude", laser, [700], [-5.0], "impossible")
    fault("rainfall_rate_32bit", rain, [300, 301], [40.0, 42.0], "spike")
    fault("rainfall_rate_32bit", rain, [900], [5000.0], "impossible")
    temperature[2000:] += 15  # a lasting shift is no case
    laser[100] = 99999  # a flag is none
    rain[1000] = np.nan
    rows = [(k, "A", times[k], float(rain[k]), float(temperature[k]), float(laser[k])) for k in range(len(times))]
    rows += [(10_500, "A", times[500], 0.0, 25.0, float(laser[500])), (20_000, "A", None, 9e9, 0.0, 0.0), (20_001, None, times[0], -5.0, 0.0, 0.0), (20_002, "B", times[0], None, None, None)]
    expected.add((10_500, "sensor_temperature", "spike"))  # the copy counts like its original
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.lit(1))
    return {(r.obs_id, r.field_name, r.reason) for r in I.implausible(df).collect()}, expected


def test_faults_are_found(found):
    got, expected = found
    assert expected <= got, expected - got


def test_nothing_else_is(found):
    got, expected = found
    assert got == expected, got - expected


def test_empty(spark):
    assert I.implausible(spark.createDataFrame([], SCHEMA)).count() == 0


def _stuck(spark, laser, per_day=100):
    """Positions of the stuck readings of a series with ``per_day`` readings a day."""
    start = datetime(2020, 1, 1)
    rows = [(k, "A", start + timedelta(days=k // per_day, seconds=60 * (k % per_day)), None, None, float(x)) for k, x in enumerate(laser)]
    return {r.obs_id for r in I.implausible(spark.createDataFrame(rows, SCHEMA)).collect() if r.reason == "stuck"}


@pytest.mark.parametrize("copies", [1, 8])
def test_threshold_does_not_depend_on_the_number_of_runs(spark, copies):
    """A run of 9 among values of which a thirtieth repeats, twice or thrice, in 400 and in 3,200 readings."""
    unit = np.arange(400) * 37 % 400 + 20000.0
    for at in range(30, 390, 30):
        unit[at : at + 3] = unit[at]
    laser = np.concatenate([unit + 500 * (c % 2) for c in range(copies)])
    laser[101:110] = 20900.0
    assert _stuck(spark, laser) == set(range(101, 110))


def test_coarse_source(spark):
    """Values that repeat geometrically, 3.3 times on average: 100 readings of one value are stuck, its longest usual runs are not."""
    random = np.random.default_rng(5)
    length = random.geometric(0.3, 3_000)
    length[::400] = 100
    laser = np.repeat(20000.0 + 500 * (np.arange(3_000) % 3), length)
    at = np.cumsum(length) - length
    stuck = {k for a, n in zip(at, length) if n == 100 for k in range(a, a + n)}
    assert _stuck(spark, laser) == stuck


def test_heavy_tail_of_a_coarse_source_is_usual(spark):
    random = np.random.default_rng(5)
    length = np.maximum(1, np.round(3 * random.weibull(0.4, 3_000))).astype(int)
    assert length.max() > 10 * np.percentile(length, 95)
    assert _stuck(spark, np.repeat(20000.0 + 500 * (np.arange(3_000) % 3), length), 1440) == set()


def _spikes(spark, times, temperature):
    rows = [(k, "A", t, None, float(x), None) for k, (t, x) in enumerate(zip(times, temperature))]
    return {r.obs_id for r in I.implausible(spark.createDataFrame(rows, SCHEMA)).collect() if r.reason == "spike"}


@pytest.mark.parametrize("first_hour", [11, 22, 23])
def test_hourly_spike_over_midnight(spark, first_hour):
    """Three hourly readings are found alike at noon and over midnight, also with an outage right before or after."""
    times = [datetime(2020, 1, 1) + timedelta(hours=k) for k in range(24 * 8)]
    temperature = 10 + np.round(np.random.default_rng(1).normal(0, 0.2, len(times)), 1)
    at = range(72 + first_hour, 75 + first_hour)
    temperature[at] += 30
    assert _spikes(spark, times, temperature) == set(at)
    late = [t + timedelta(hours=30 * (k > at[-1]) + 30 * (k >= at[0])) for k, t in enumerate(times)]
    assert _spikes(spark, late, temperature) == set(at)


def test_days_are_judged_like_the_whole_series(spark):
    """Random series with gaps and few readings a day: the same spikes as from the filter over the whole series."""
    random = np.random.default_rng(3)
    times = [datetime(2020, 1, 1) + timedelta(minutes=int(m)) for m in np.unique(random.integers(0, 60 * 24 * 60, 900))]
    temperature = np.round(random.normal(0, 0.3, len(times)), 1)
    for a in random.integers(0, len(times) - 4, 14):
        temperature[a : a + random.integers(1, 5)] += random.choice([-20, 20])
    found = _spikes(spark, times, temperature)
    table = pa.table({"us": np.arange(len(times)), "sensor_temperature": temperature})
    s = I._series(table, np.array([0]), I.FIELDS[1])
    whole = {int(k) for k in I._spikes(s, np.array([5.0]))}
    assert len(whole) > 10 and found == whole


def test_stuck_length_has_one_rule():
    """It grows steadily as values get coarser, and stays above what geometric and heavier tails show."""
    random = np.random.default_rng(2)
    before = 0.0
    for share in (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8):
        runs = random.geometric(1 - share, 200_000)
        length = I.stuck_length(*np.unique(runs, return_counts=True))
        assert runs.max() < length <= 3 * (1 + np.log(I.RUN_CHANCE) / np.log(share)) + 6 and length >= before - 2
        before = length
    heavy = np.ceil(2 * random.weibull(0.6, 200_000)).astype(int)
    assert heavy.max() < I.stuck_length(*np.unique(heavy, return_counts=True))
    assert I.stuck_length(np.zeros(0, int), np.zeros(0, int)) == np.inf and I.stuck_length(np.array([500]), np.array([1])) == np.inf

