"""Operators on small tables with known results, nulls, ties and empty input."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom import api, sensors
from rainloom.functions import psd
from rainloom.operators import classification, events, fitting, joins, packed_lists, remap, resample, sanitize, statistics, time_axis

T0 = datetime(2000, 1, 1)


def _times(spark, minutes, station="A"):
    return spark.createDataFrame([(station, T0 + timedelta(minutes=m)) for m in minutes], "station_id string, time timestamp")


# --- cleaning --------------------------------------------------------------------------------------------------


def test_sanitize(spark):
    rows = [
        ("A", T0, 1, " 12.5 ", "9999.999", ",1,2,3,", "x "), ("A", T0, 2, "1", "1", "1,2,3", "y"), ("A", None, 3, "1", "1", "1,2,3", "y"), ("A", T0 + timedelta(seconds=30.7), 4, "abc", "-5", "1,,3", None),
        ("A", T0 + timedelta(minutes=2), 5, "1", "1", "1,x,3", "y"), ("A", T0 + timedelta(minutes=3), 6, "1", "1", "1,2,3", "y"), ("B", T0, 7, "1", None, "1;2;;4", "y"),
    ]
    raw = spark.createDataFrame(rows, "station_id string, time timestamp, line int, sensor_temperature string, rainfall_rate_32bit string, raw_drop_number string, weather_code_nws string")
    issues = spark.createDataFrame([(T0 + timedelta(minutes=2.5), T0 + timedelta(minutes=3))], "start timestamp, end timestamp")
    out = {(r.station_id, r.line): r for r in sanitize.sanitize(raw, "PARSIVEL", order=("line",), issue_periods=issues.withColumn("station_id", F.lit("A"))).collect()}
    assert set(out) == {("A", 1), ("A", 4), ("B", 7)}
    assert out[("A", 1)].sensor_temperature == 12.5 and math.isnan(out[("A", 1)].rainfall_rate_32bit) and out[("A", 1)].raw_drop_number == "1,2,3" and out[("A", 1)].weather_code_nws == "x"
    assert math.isnan(out[("A", 4)].sensor_temperature) and math.isnan(out[("A", 4)].rainfall_rate_32bit) and out[("A", 4)].time == T0 + timedelta(seconds=30)
    assert sanitize.sanitize(raw.limit(0), "PARSIVEL").count() == 0


def test_parse_list(spark):
    texts = [",1,2,", "1;2;;4", "", "0", "NaN", "1,2", "1,x,3", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.x for r in df.orderBy("i").select(sanitize.parse_list(F.col("t"), 4).alias("x")).collect()]
    assert found[1] == [1, 2, 0, 4] and found[2] == found[3] == [0] * 4 and all(math.isnan(v) for k in (0, 4, 5, 6, 7) for v in found[k])
    assert df.where("i = 0").select(sanitize.parse_list(F.col("t"), 2).alias("x")).first().x == [1, 2]


def test_spectrum_order(spark):
    values = np.arange(1024)
    df = spark.createDataFrame([(",".join(map(str, values)),)], "t string")
    expected = values.reshape(32, 32).T.ravel().tolist()
    assert df.select(sanitize.diameter_major(sanitize.parse_list(F.col("t"), 1024), "PARSIVEL2").alias("x")).first().x == expected
    order = [v * 32 + d for d in range(32) for v in range(32)]
    assert df.select(packed_lists.list_column(F.col("t"), 1024, order).alias("x")).first().x == expected


def test_check_columns():
    sanitize.check_columns(["time", "raw_drop_number", "mor_visibility"], "PARSIVEL")
    for columns in (["time"], ["raw_drop_number"], ["time", "raw_drop_number", "other"]):
        with pytest.raises(ValueError):
            sanitize.check_columns(columns, "PARSIVEL")


# --- time axis -------------------------------------------------------------------------------------------------


def test_resolutions():
    assert time_axis.resolution_seconds("1H30MIN") == (5400, False) and time_axis.resolution_seconds("ROLL5MIN") == (300, True)
    assert time_axis.seconds_resolution(93784) == "1D2H3MIN4S"
    with pytest.raises(ValueError):
        time_axis.resolution_seconds("5 minutes")


def test_regularize(spark):
    second = [0, 59, 121, 149, 180, 301, 360, 361, 362, 363, 600]
    df = spark.createDataFrame([("A", T0 + timedelta(seconds=s), s) for s in second], "station_id string, time timestamp, s int")
    out = {r.s: ((r.time - T0).seconds, r.qc_time) for r in time_axis.regularize_times(df, 60).collect()}
    assert out[0] == (0, 0) and out[59] == (60, 0) and out[121] == (120, 5) if 121 in out else True
    assert 149 in out and out[180][0] in (180, 240)
    assert out[600] == (600, 1) and out[363][0] == 360  # four at one slot: the last stays
    assert len({t for t, _ in out.values()}) == len(out)


def test_regularize_over_midnight(spark):
    """At midnight rows are spread, repeated slots resolved and gaps flagged as at any other hour, each row once."""

    def run(shift):
        second = [shift + s for s in (-300, -240, -180, -120, -62, -58, -1, 29, 60, 121, 240, 300)]
        df = spark.createDataFrame([("A", datetime(2020, 1, 1) + timedelta(seconds=86_400 + s), s - shift) for s in second], "station_id string, time timestamp, s int")
        return sorted(((r.time - datetime(2020, 1, 2)).total_seconds() - shift, r.s, r.qc_time) for r in time_axis.regularize_times(df, 60).collect())

    at_midnight, later = run(0), run(36_000)
    assert at_midnight == later
    times = [t for t, _, _ in at_midnight]
    assert len(set(times)) == len(times) and {s for _, s, _ in at_midnight} >= {-300, -180, 60, 240}
    assert {t: q for t, _, q in at_midnight}[120.0] == time_axis.NEXT_MISSING


def test_duplicates(spark):
    rows = [("A", T0, [1.0, float("nan")], 1.0), ("A", T0, [1.0, float("nan")], 1.0), ("A", T0 + timedelta(minutes=1), [1.0], 1.0), ("A", T0 + timedelta(minutes=1), [2.0], 1.0), ("A", T0 + timedelta(minutes=2), [1.0], 1.0), ("A", T0 + timedelta(minutes=2), [1.0], 2.0)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, raw_drop_number array<double>, x double")
    assert [(r.time - T0).seconds for r in time_axis.resolve_duplicates(df).collect()] == [0]
    assert sorted((r.time - T0).seconds for r in time_axis.resolve_duplicates(df, all_equal=False).collect()) == [0, 120]


def test_split_by_interval(spark):
    second = [30 * k for k in range(12)] + [330 + 60 * k for k in range(1, 12)]
    df = spark.createDataFrame([("A", T0 + timedelta(seconds=s)) for s in second], "station_id string, time timestamp")
    counts = {r.interval_s: r.n for r in time_axis.split_by_interval(df, (30, 60)).groupBy("interval_s").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {30, 60} and sum(counts.values()) == len(second)


def test_fill_grid(spark):
    df = spark.createDataFrame([("A", T0, 1.0), ("A", T0 + timedelta(days=1, minutes=2), 2.0)], "station_id string, time timestamp, x double")
    assert time_axis.fill_grid(df, 60).count() == 1443
    assert time_axis.fill_grid(df, 60, fill="forward").where("x is null").count() == 0
    with pytest.raises(Exception, match="off the grid"):
        time_axis.fill_grid(df.union(spark.createDataFrame([("A", T0 + timedelta(seconds=7), 1.0)], df.schema)), 60).collect()


def test_blocks(spark):
    df = spark.createDataFrame([("A", datetime(2020, 12, 31)), ("A", datetime(2021, 3, 1, 0, 0, 1))], "station_id string, time timestamp")
    found = sorted((r.block_start, r.block_end) for r in time_axis.time_blocks(df, "season").collect())
    assert found == [(datetime(2020, 12, 1), datetime(2021, 2, 28, 23, 59, 59)), (datetime(2021, 3, 1), datetime(2021, 5, 31, 23, 59, 59))]


# --- resampling ------------------------------------------------------------------------------------------------


def _resampled(spark, resolution, **options):
    rows = [("A", T0 + timedelta(minutes=k), 10.0 * (k + 1), 1.0 + k, [2.0 + k, 1.0], 5.0 + k, 8.0 + k) for k in range(4)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, fall_velocity double, drop_number double, raw_drop_number array<double>, Dmin double, Dmax double")
    return resample.resample(df, 60, resolution, time_is_end=False, **options).orderBy("time").collect()


def test_tumbling(spark):
    a, b = _resampled(spark, "2MIN")
    assert [(r.time - T0).seconds for r in (a, b)] == [0, 120]
    assert (a.fall_velocity, a.drop_number, a.raw_drop_number, a.Dmin, a.Dmax, a.qc_resampling) == (15, 3, [5, 2], 5, 9, 0)
    assert (b.fall_velocity, b.drop_number, b.raw_drop_number, b.Dmin, b.Dmax) == (35, 7, [9, 2], 7, 11)


def test_rolling_and_errors(spark):
    rows = _resampled(spark, "ROLL2MIN")
    assert [r.drop_number for r in rows] == [3, 5, 7] and [r.raw_drop_number for r in rows] == [[5, 2], [7, 2], [9, 2]]
    for bad in ("ROLL200S", "30S"):
        with pytest.raises(ValueError):
            _resampled(spark, bad)
    with pytest.raises(ValueError):
        _resampled(spark, "2MIN", average=["none"])


def test_resample_missing(spark):
    df = spark.createDataFrame([("A", T0, 1.0, [1.0]), ("A", T0 + timedelta(minutes=1), 2.0, [float("nan")]), ("A", T0 + timedelta(minutes=2), 3.0, [1.0])], "station_id string, time timestamp, Dmax double, raw_drop_number array<double>")
    a, b = resample.resample(df, 60, "2MIN", time_is_end=False).orderBy("time").collect()
    assert a.qc_resampling == 0.5 and a.raw_drop_number == [1.0] and a.Dmax == 2.0 and b.qc_resampling == 0.5 and b.Dmax == 3.0


def test_resample_gap(spark):
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=k), 1.0) for k in (0, 1, 2, 5)], "station_id string, time timestamp, Dmax double")
    rows = resample.resample(df, 60, "3MIN", time_is_end=False).orderBy("time").collect()
    assert [r.qc_resampling for r in rows] == [0.0, 0.7] and rows[0].Dmax == 1.0 and math.isnan(rows[1].Dmax)


# --- events ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("minutes", "k", "within", "kept"),
    [([0, 1, 10], 1, "1MIN", [0, 1]), ([0, 1, 2, 4], 2, "2MIN", [0, 1, 2]), ([0, 1, 2, 4], 2, "3MIN", [0, 1, 2, 4]), ([120, 0, 60], 1, "1H", [0, 60, 120])],
)
def test_isolated(spark, minutes, k, within, kept):
    found = events.remove_isolated(_times(spark, minutes), k, within).collect()
    assert sorted((r.time - T0).seconds // 60 for r in found) == kept


def test_event_table(spark):
    one = events.event_table(_times(spark, [0, 30, 60]), "1H").collect()
    assert len(one) == 1 and one[0].n_timesteps == 3 and one[0].duration_min == 60
    assert events.event_table(_times(spark, [0, 60, 121]), "1H").count() == 2
    assert events.event_table(_times(spark, [0]).limit(0), "1H").count() == 0


def test_split_and_rank(spark):
    rows = [("A", T0 + timedelta(minutes=m), v, 7) for m, v in [(0, 1.0), (1, 0.0), (2, 2.0), (300, 9.0), (301, 9.0), (330, float("nan"))]]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, x double, event_id int")
    out = events.split_into_events(df, "x", 0.5, neighbours=0, max_gap="1H", min_duration=0, min_size=2, sort_by="x").collect()
    assert sorted((r.event_rank, (r.time - T0).seconds // 60) for r in out) == [(1, 300), (1, 301), (2, 0), (2, 1), (2, 2)]


def test_spikes_and_runs(spark):
    rows = [("A", T0 + timedelta(minutes=m), h, t) for m, h, t in [(0, 1, 5.2), (1, 0, None), (2, 1, 4.9), (3, 1, 5.4), (4, 0, 9.0)]]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, h int, t double")
    assert [r.flag_spikes for r in events.precipitation_spikes(df, "h", 60).orderBy("time").collect()] == [1, 0, 0, 0, 0]
    assert [r.qc_temperature for r in events.qc_temperature(df, "t", 60, threshold_minutes=4).orderBy("time").collect()] == [1, 1, 1, 1, 0]


# --- joins -----------------------------------------------------------------------------------------------------


def test_asof(spark):
    left = spark.createDataFrame([("A", T0 + timedelta(seconds=s), s) for s in (3, 20, 41)] + [("A", None, -1)], "k string, time timestamp, s int")
    right = spark.createDataFrame([("A", T0 + timedelta(seconds=s), s, "c") for s in (5, 25, 0)] + [("B", T0, 9, "c")], "k string, time timestamp, v int, s string")
    out = {r.s: (r.v, r.matched_s) for r in joins.asof_nearest(left, right, ["k"], 10, ["v", "s"]).collect()}
    assert out == {3: (5, "c"), 20: (25, "c"), 41: (None, None), -1: (None, None)}
    assert joins.asof_nearest(left, right, ["k"], None, ["v"], inner=True).count() == 3


def test_update(spark):
    left, right = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int"), spark.createDataFrame([(1, "z", None)], "k int, x string, y int")
    assert sorted(tuple(r) for r in joins.update(left, right, ["k"]).collect()) == [(1, "z", 1), (2, "b", 2)]


def test_nearest_value(spark):
    df = spark.createDataFrame([(0.4,), (1.5,), (9.0,), (None,), (float("nan"),)], "q double")
    lut = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (float("nan"), "n")], "x double, v string")
    out = [(r.q, r.v) for r in joins.nearest_value(df, lut, "q", "x", 1.0).collect()]
    assert [v for _, v in out] == ["a", "a", None, None, None]
    assert joins.nearest_value(df, lut.limit(0), "q", "x").where("v is not null").count() == 0
    ranged = joins.nearest_value_by_range(df, lut, "q", "x", 1.0, 1.0).collect()
    assert sorted((r.v or "") for r in ranged) == ["", "", "", "a", "a"]


def test_point_lookups(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.9, 0.6), (5.0, 5.0), (None, 1.0)], "a double, b double")
    lut = spark.createDataFrame([(0.0, 0.0, 1), (1.0, 0.0, 2), (0.0, 1.0, 3), (1.0, 1.0, 4)], "x double, y double, v int")
    assert [r.v for r in joins.grid_lookup(df, lut, "a", "b", max_distance=(1, 1)).orderBy("a").collect()] == [None, 1, 4, None]
    assert [r.v for r in joins.nearest_point(df, lut, "a", "b", metric="manhattan", max_distance=2.0).orderBy("a").collect()] == [None, 1, 4, None]
    hull = joins.convex_hull([(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)])
    assert len(hull) == 4 and [r.h for r in df.orderBy("a").select(joins.in_hull(F.coalesce("a", F.lit(float("nan"))), F.col("b"), hull).alias("h")).collect()] == [False, True, True, False]


def test_interpolation(spark):
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=m), v) for m, v in [(0, 350.0), (1, None), (2, float("nan")), (3, 20.0), (4, None)]], "station_id string, time timestamp, x double")
    assert [r.x for r in joins.interpolate(df, ["x"], limit=1).orderBy("time").collect()] == [350.0, 240.0, None, 20.0, None]
    assert [r.x for r in joins.interpolate_direction(df, "x").orderBy("time").collect()] == [350.0, 0.0, 10.0, 20.0, None]


def test_id_value_records(spark):
    rows = [(1, k, t) for k, t in enumerate(["01:a", "02: b", "junk", "01:c", "03:d"])]
    out = joins.id_value_records(spark.createDataFrame(rows, "file_id int, line_no int, payload string"), ["01", "02", "03"]).orderBy("record").collect()
    assert [(r.field_1, r.field_2, r.field_3) for r in out] == [("a", "b", "NaN"), ("c", "NaN", "d")]


# --- statistics ------------------------------------------------------------------------------------------------


def test_histogram(spark):
    df = spark.createDataFrame([(x, y) for x, y in [(0.0, 1.0), (1.0, 2.0), (1.5, 4.0), (3.0, 9.0), (None, 1.0), (0.5, float("nan")), (4.0, 1.0)]], "x double, y double")
    rows = statistics.histogram(df, "x", ["y"], [0, 1, 2, 3, 4]).orderBy("x").collect()
    assert [r["count"] for r in rows] == [2, 1, 1, None] and rows[0].y_mean == 1.5 and rows[0].y_mad == 0.5
    assert statistics.histogram(df, "x", bins=4).count() == 4


def test_unbiased_moments(spark):
    row = statistics.distribution_table(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"), ("x",), digits=None).first()
    assert row.SKEWNESS == pytest.approx(1.7636, abs=1e-3) and row.KURTOSIS == pytest.approx(3.228, abs=1e-3) and row.Q10 == pytest.approx(1.3)


def test_power_law():
    x = np.linspace(1, 10, 12)
    y = 3 * x**1.7
    for law in (statistics.weighted_power_law(x, y, y * 0.1), statistics.robust_power_law(x, np.where(x > 9.5, y * 50, y))):
        assert (law.a, law.b) == (pytest.approx(3, rel=1e-6), pytest.approx(1.7, rel=1e-6))
    inverse = law.inverse()
    assert inverse.a * (y[3] ** inverse.b) == pytest.approx(x[3])
    assert statistics.weighted_power_law(x, 2 * 10 ** (0.5 * np.log10(x) + 0.3 * np.log10(x) ** 2), y, quadratic=True).c == pytest.approx(0.3)


def test_sample(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 990, "big").otherwise("small"))
    counts = {r.g: r.n for r in statistics.sample_rows(df, 20, id_columns=["id"], category="g").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 20, "small": 10}
    assert statistics.sample_rows(df, 15, id_columns=["id"], category="g", replace=True).count() == 30


# --- classification --------------------------------------------------------------------------------------------


def _spectra(spark, cells):
    d, v = sensors.diameter_bins("PARSIVEL2"), sensors.velocity_bins("PARSIVEL2")
    rows = []
    for k, drops in enumerate(cells):
        m = np.zeros((32, 32))
        for diameter, speed, n in drops:
            m[np.searchsorted(d.upper, diameter), np.searchsorted(v.upper, speed)] += n
        rows.append(("A", T0 + timedelta(minutes=k), 60, m.ravel().tolist()))
    return spark.createDataFrame(rows, "station_id string, time timestamp, sample_interval int, raw_drop_number array<double>")


def test_classification(spark):
    cells = [[], [(0.4, 1.7, 30)], [(0.4, 1.7, 30), (1.3, 4.8, 20)], [(1.3, 4.8, 20), (5.5, 9.2, 2)], [(3.5, 1.2, 30), (7.0, 1.5, 10)], [(2.2, 2.6, 30)]]
    rows = classification.generate_l1(_spectra(spark, cells), "PARSIVEL2").orderBy("time").collect()
    assert [r.hydrometeor_type for r in rows[:5]] == [0, 1, 2, 3, 5] and [r.precipitation_type for r in rows[:5]] == [-1, 0, 0, 0, 1]
    assert rows[5].hydrometeor_type in (5, 8) and rows[1].n_particles == 30 and rows[1].Dmin == pytest.approx(0.437) and math.isnan(rows[0].Dmin)


def test_temperature_overrides(spark):
    df = _spectra(spark, [[(0.4, 1.7, 30)], [(3.5, 1.2, 30), (7.0, 1.5, 10)]])
    cold = classification.classify(df, "PARSIVEL2", temperature=(F.lit(-10.0), F.lit(6.0))).orderBy("time").collect()
    assert [r.hydrometeor_type for r in cold] == [61, 5] and cold[0].precipitation_type == -2
    warm = classification.classify(df, "PARSIVEL2", temperature=(F.lit(20.0), F.lit(6.0))).orderBy("time").collect()
    assert [r.hydrometeor_type for r in warm] == [1, -2] and warm[1].flag_noise == 1


def test_temperature_sources(spark):
    df = spark.createDataFrame([(50.0, 10.0), (None, 12.0), (1.0, 20.0), (5.0, 6.0), (None, None)], "air_temperature double, sensor_temperature double")
    value, limit = classification.best_temperature(df)
    rows = df.select(value.alias("t"), limit.alias("l")).collect()
    assert [None if math.isnan(r.t) else (r.t, r.l) for r in rows] == [(10.0, 15.0), (12.0, 15.0), None, (5.0, 6.0), None]


# --- fits and remapping ----------------------------------------------------------------------------------------


def _fit_rows(spark, d, spectra):
    return spark.createDataFrame([(k, [float(x) for x in s]) for k, s in enumerate(spectra)], "k int, drop_number_concentration array<double>")


def test_fits_recover(spark):
    bins = remap.regular_bins(0, 8, 0.125)
    d, w = bins.center, bins.width
    true = psd.gamma_psd(d, 8000.0, 2.5, 2.0)
    df = _fit_rows(spark, d, [true, np.zeros(64), np.full(64, np.nan)])
    ml = fitting.fit_likelihood(df, "GammaPSD", bins.lower, bins.upper, keys=("k",), init_method="M346").orderBy("k").collect()
    assert ml[0].mu == pytest.approx(2.0, abs=0.1) and ml[0].Lambda == pytest.approx(2.5, abs=0.1) and math.isnan(ml[1].mu) and math.isnan(ml[2].mu)
    gs = fitting.fit_grid(df, "GammaPSD", d, w, np.ones(64), keys=("k",), space={"mu": (0, 4, 0.5), "Lambda": (1.0, 4.0, 0.25)}).orderBy("k").collect()
    assert (gs[0].mu, gs[0].Lambda) == (2.0, 2.5) and gs[0].N0 == pytest.approx(8000, rel=0.02) and math.isnan(gs[1].mu)
    mom = fitting.fit_moments(df, "GammaPSD", ["M346"], diameter=sensors.literal(d), width=sensors.literal(w), keep=["k"]).orderBy("k").collect()
    assert mom[0].mu == pytest.approx(2.0, abs=0.05)
    normal = fitting.fit_grid(_fit_rows(spark, d, [psd.normalized_gamma_dm(d, 5000.0, 1.5, 3.0)]), "NormalizedGammaDmNwPSD", d, w, np.ones(64), keys=("k",), space={"mu": (0, 6, 0.5)}).first()
    assert normal.mu == 3.0 and normal.Dm == pytest.approx(1.5, rel=0.01)
    lognormal = fitting.fit_likelihood(_fit_rows(spark, d, [psd.lognormal(d, 900.0, 0.2, 0.35)]), "LognormalPSD", bins.lower, bins.upper, keys=("k",)).first()
    assert (lognormal.mu, lognormal.sigma) == (pytest.approx(0.2, abs=0.02), pytest.approx(0.35, abs=0.02))


def test_objectives():
    with pytest.raises(ValueError):
        fitting.Objective("Z", "SSE")
    obs, pred = np.array([0.0, 1.0, 0.0]), np.array([[5.0, 1.0, 0.0], [0.0, 2.0, 0.0]])
    for censoring, expected in (("none", [25, 1]), ("left", [0, 1]), ("both", [0, 1])):
        got = fitting.objective_error(fitting.Objective(censoring=censoring), obs, pred, np.ones(3), np.ones(3), np.ones(3))
        assert got.tolist() == expected
    assert fitting.gamma_cdf(np.array([1.0, 5.0, 0.0]), 2.5) == pytest.approx([0.150855, 0.924765, 0], abs=1e-5)


def test_remap_conserves(spark):
    source = remap.regular_bins(0, 4, 0.5)
    df = _fit_rows(spark, source.center, [np.exp(-source.center), np.zeros(8)])
    for method in ("constant", "log_pchip"):
        out = remap.resample_concentration(df, "drop_number_concentration", "fine", source, np.arange(17) * 0.25, method).orderBy("k").collect()
        assert sum(out[0].fine) * 0.25 == pytest.approx(np.exp(-source.center).sum() * 0.5) and sum(out[1].fine) == 0
    coarse = remap.resample_concentration(df, "drop_number_concentration", "coarse", source, [0, 2, 4]).first().coarse
    assert coarse == pytest.approx([np.exp(-source.center[:4]).mean(), np.exp(-source.center[4:]).mean()])
    assert remap.pchip(np.array([0.0, 1, 2]), np.array([0.0, 1, 8]), np.array([0.5, 3.0]))[0] == pytest.approx(0.325, abs=0.1)
    linear = remap.interpolate_bins(df, "drop_number_concentration", "at", source.center, np.array([0.1, 1.0, 9.0])).first()["at"]
    assert math.isnan(linear[0]) and math.isnan(linear[2]) and linear[1] == pytest.approx((math.exp(-0.75) + math.exp(-1.25)) / 2)


# --- api -------------------------------------------------------------------------------------------------------


def test_series(spark):
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=m), float(m)) for m in range(6)], "station_id string, time timestamp, N double")
    s = api.series(df)
    assert s.resample(60, "3MIN").df.count() == 3 and s.isel(0, 5).df.count() == 2
    assert s.sel(start=T0 + timedelta(minutes=4)).df.count() == 2 and s.sel(nearest=T0 + timedelta(minutes=2.6)).df.first().N == 3.0
    assert [x.df.count() for x in s.align(api.series(df.where("N > 2")))] == [3, 3]


def test_partitions_and_lookup(spark, tmp_path):
    files = spark.createDataFrame([("A", datetime(2020, 1, 1, 10), datetime(2020, 1, 1, 12)), ("A", datetime(2020, 1, 4), datetime(2020, 1, 5, 1))], "station_id string, start timestamp, end timestamp")
    assert sorted(r.block_start.day for r in time_axis.temporal_partitions(files, "time_block", "day", time_is_end=False).collect()) == [1, 4, 5]
    assert time_axis.blocks_offsets(60, "ROLL5MIN") == (-240, 0) and time_axis.blocks_offsets(60, "5MIN") == (0, 0)
    table = joins.LookupTable(spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, v string"))
    table.save(str(tmp_path / "lut"))
    assert joins.LookupTable.read(spark, str(tmp_path / "lut")).predict_dict(1.6) == {"x": 2.0, "v": "b"}


def test_texts(spark):
    from rainloom.functions import text

    df = spark.createDataFrame([("1.25", "WW61"), ("-3", "x"), (None, "y")], "a string, b string")
    rows = {r.column: r for r in text.describe_columns(df).collect()}
    assert (rows["a"].numbers, rows["a"].integers, rows["a"].with_decimals, rows["a"].natural_digits, rows["a"].decimal_digits) == (2, 1, 1, 1, 2) and rows["b"].numbers == 0
    names = {r.column: r.candidates for r in text.candidate_names(df.select("a"), "PARSIVEL").collect()}
    assert "sensor_temperature" in names["a"] and "mor_visibility" not in names["a"]


def test_radar(spark):
    from rainloom.functions import backend, radar

    bins = remap.regular_bins(0, 5, 0.5)
    df = _fit_rows(spark, bins.center, [np.exp(-bins.center), np.zeros(10)])
    wave = radar.wavelength_of_frequency(9.4)
    table = [{c: 0.0 for c in radar.TABLE} | {"diameter": d, "sigma_h": float(radar.rayleigh_backscatter(d, wave, 0.93)), "sigma_v": float(radar.rayleigh_backscatter(d, wave, 0.93))} for d in bins.center]
    rows = radar.radar_parameters(df, {(9.4,): table}, [{"frequency": 9.4}, {"frequency": "S"}], bins.center, bins.width).where("k = 0").collect()
    z = backend.decibel(float((np.exp(-bins.center) * bins.center**6 * bins.width).sum()))
    assert all(r.DBZH == pytest.approx(z, rel=1e-6) for r in rows) and len(rows) == 2
    assert next(r for r in rows if r.frequency == 9.4).ZDR == pytest.approx(0, abs=1e-9)
    assert radar.unstack_bands(radar.radar_parameters(df, {}, [{"frequency": "S"}, {"frequency": "X"}], bins.center, bins.width), ["k"], ["DBZH"], [2.7, 9.4]).columns == ["k", "DBZH_S", "DBZH_X"]
    assert backend.idecibel(np.array(20.0)) == pytest.approx(100)


def test_lookups_of_any_size(spark, monkeypatch):
    """The ways for large tables give what the way for small ones gives; cells the table lacks, hull, ties and a hot value."""
    random = np.random.default_rng(4)
    lut = spark.createDataFrame([(float(round(a, 3)), int(i)) for i, a in enumerate(random.normal(0, 50, 900))], "x double, v long").dropDuplicates(["x"])
    values = [*random.normal(0, 70, 300).tolist(), *[7.5] * 200, None, float("nan"), -1e9, 1e9]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(values)], "id long, q double")
    small = {r.id: (r.x, r.v, r.distance) for r in joins.nearest_value(df, lut, "q").collect()}
    plane = spark.createDataFrame([(float(a), float(b), int(i)) for i, (a, b) in enumerate(random.normal(0, 10, (700, 2)))], "x double, y double, v long")
    at = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(random.normal(0, 14, (250, 2)))] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, a double, b double")
    near = {m: {r.id: (r.distance, r.v) for r in joins.nearest_point(at, plane, "a", "b", metric=m).collect()} for m in ("euclidean", "manhattan")}
    monkeypatch.setattr(joins.nearest_value.__globals__["bounded"], "__defaults__", (10,))
    monkeypatch.setattr(joins, "PLANE_POINTS", 20)
    assert {r.id: (r.x, r.v, r.distance) for r in joins.nearest_value(df, lut, "q").collect()} == small
    for m, expected in near.items():
        assert {r.id: (r.distance, r.v) for r in joins.nearest_point(at, plane, "a", "b", metric=m).collect()} == expected


def test_grid_lookup_of_missing_cells(spark):
    lut = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 0.0, 2), (0.0, 10.0, 3), (30.0, 30.0, 4)], "x double, y double, v int")
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, 29.0, 1.0), (4, 5.0, 0.0), (5, None, 1.0), (6, float("nan"), 1.0)], "id int, a double, b double")
    rows = {r.id: (r.v, r.nearest_x, r.nearest_y, r.out_of_bound) for r in joins.grid_lookup(df, lut, "a", "b").collect()}
    assert rows[1] == (1, 0.0, 0.0, False) and rows[4] == (1, 0.0, 0.0, False)
    assert rows[2] == (3, 10.0, 10.0, False) and rows[3][0] == 2 and rows[3][3]
    assert rows[5] == (None, None, None, False) and rows[6] == (None, None, None, False)


def test_quantiles_against_numpy(spark):
    """Negative, zero, tied, tiny, huge and infinite values, one group with most rows, and groups of one value."""
    random = np.random.default_rng(6)
    groups = {"big": np.concatenate([random.lognormal(0, 3, 4_000), -random.lognormal(0, 3, 1_000), np.zeros(50), np.full(700, 2.5)]), "one": np.array([3.25]), "two": np.array([-1e-300, 1e300]), "ends": np.array([-np.inf, 0.0, 1.0, np.inf])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("big", None), ("big", float("nan")), ("none", None)]
    shares = (0, 0.01, 0.25, 0.5, 0.9, 1)
    found = {r.g: (r.n, r.q) for r in statistics.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], shares).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g][0] == len(values)
        for q, x in zip(shares, found[g][1]):
            expected = np.quantile(values, q) if g != "ends" else {0: -np.inf, 1: np.inf}.get(q)
            assert expected is None or x == pytest.approx(expected, rel=1e-12)
    assert statistics.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], shares).count() == 0
