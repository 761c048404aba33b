"""Formulae against known values, and column forms against numpy forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.functions import axis_ratio, fall_velocity, goodness, moments_fit, permittivity, physics, psd, radar
from rainloom.functions import spectrum as S
from rainloom.functions.backend import gamma, lgamma

D, W, V, ND = [0.2, 0.4, 0.6, 0.8], [0.2] * 4, [0.5, 1.0, 1.5, 2.0], [0.0, 10000.0, 5000.0, 500.0]


def _lit(x):
    return sensors.literal(np.array(x))


@pytest.fixture(scope="module")
def realistic(spark):
    df = spark.createDataFrame([(ND, 60.0), ([0.0] * 4, 60.0), ([float("nan")] * 4, 60.0), ([0.0, 7.0, 0.0, 0.0], 60.0)], "nd array<double>, interval double")
    return S.integral_parameters(df, "nd", np.array(V), np.array(D), np.array(W), F.col("interval")).collect()


def test_integral_parameters(realistic):
    r = realistic[0]
    expected = {"Nt": 3100, "M0": 3100, "M1": 1480, "M2": 744, "M3": 395.2, "M4": 221.76, "M5": 131.008, "M6": 81.0624, "R": 1.04501938, "Z": 19.08819458, "LWC": 0.20692624, "Dm": 0.5611336, "sigma_m": 0.12894594,
                "Nw": 170075.02472902, "D50": 0.46444444, "D10": 0.26175, "D90": 0.645625, "TKE": 0.0198957, "KEF": 1.1937424, "KED": 1.1423160, "P": 0.0174170, "Dmode": 0.4}
    for name, value in expected.items():
        assert r[name] == pytest.approx(value, rel=1e-5), name


def test_zero_and_nan(realistic):
    zero, missing, single = realistic[1:]
    assert zero.R == 0 and zero.Nt == 0 and zero.KED == 0 and all(math.isnan(zero[c]) for c in ("Z", "Dm", "D50", "Dmode", "Nw", "sigma_m"))
    assert all(math.isnan(missing[c]) for c in ("R", "Nt", "M6", "Z", "Dm", "D50", "TKE"))
    assert single.D50 == pytest.approx(0.4) and single.D10 == pytest.approx(0.32) and single.sigma_m == 0


def test_concentration_round_trip(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.0, 4.0],)], "n array<double>")
    args = (_lit(V), _lit(W), _lit([0.005] * 4), F.lit(60.0))
    nd = S.number_concentration(F.col("n"), *args)
    row = df.select(nd.alias("nd"), S.counts_from_concentration(nd, *args).alias("back"), S.number_concentration(F.col("n"), _lit([0.0, float("nan"), 1, 1]), *args[1:]).alias("still")).first()
    assert row.back == pytest.approx([1, 2, 0, 4]) and row.nd[0] == pytest.approx(1 / (0.5 * 0.2 * 0.005 * 60)) and row.still[:2] == [0, 0]


def test_bin_metrics(spark):
    df = spark.createDataFrame([([0.0] * 5,), ([1.0, 0.0, 0.0, 2.0, 0.0],), ([float("nan"), 1.0, 1.0, 0.0, 1.0],)], "n array<double>")
    rows = df.select(*[c.alias(n) for n, c in S.bin_metrics(F.col("n")).items()]).collect()
    assert [tuple(r) for r in rows] == [(0, 5, 1.0, 5), (2, 2, 0.5, 2), (3, 1, 0.25, 1)]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [True, False, True, True])], "x array<double>, m array<boolean>")
    row = df.select(A.over_velocity(F.col("x"), 3).alias("s"), A.cumulative(F.col("x")).alias("c"), A.first_true(F.col("m")).alias("f"), A.last_true(F.col("m")).alias("l"), A.longest_run(F.col("m")).alias("r"), A.linear(F.col("x"), np.eye(6)[:2]).alias("k")).first()
    assert row.s == [6, 15] and row.c == [1, 3, 6, 10, 15, 21] and (row.f, row.l, row.r) == (1, 4, 2) and row.k == [1, 2]
    bad = spark.createDataFrame([(None,), ([1.0],), ([1.0, float("nan")],), ([1.0, 2.0],)], "x array<double>").select(A.linear(F.col("x"), np.ones((1, 2))).alias("a"), A.linear(F.col("x"), np.ones((1, 2)), True).alias("b")).collect()
    assert [r.b[0] for r in bad[2:]] == [1, 3] and math.isnan(bad[0].a[0]) and math.isnan(bad[1].a[0]) and math.isnan(bad[2].a[0])


@pytest.mark.parametrize("form", [*[f"rain {m}" for m in fall_velocity.RAIN_MODELS], *[f"axis {m}" for m in axis_ratio.MODELS], *[f"hail {m}" for m in fall_velocity.HAIL_MODELS], *[f"graupel {m}" for m in fall_velocity.GRAUPEL_MODELS], "lgamma", "gamma", "density"])
def test_column_form_is_numpy_form(spark, form):
    kind, _, model = form.partition(" ")
    f = {
        "rain": lambda x: fall_velocity.rain_speed(x, model), "axis": lambda x: axis_ratio.axis_ratio(x, model), "hail": lambda x: fall_velocity.hail_speed(x, model),
        "graupel": lambda x: fall_velocity.graupel_speed(x, model), "lgamma": lgamma, "gamma": gamma, "density": lambda x: fall_velocity.graupel_density_speed(x, 400.0),
    }[kind]
    x = np.array([0.05, 0.3, 0.9, 1.2, 2.5, 4.5, 6.0, 9.9, 12.0])
    got = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(f(F.col("x")).alias("y")).collect()]
    np.testing.assert_allclose(got, f(x), rtol=1e-9)


def test_physics():
    assert physics.vapor_saturation_pressure(np.array(293.15)) == pytest.approx(2338.5, rel=1e-3)
    assert physics.gravitational_acceleration(np.array(45.0)) == pytest.approx(9.806229)
    assert physics.water_density(np.array(277.15), np.array(101325.0)) == pytest.approx(999.97, rel=1e-4)
    assert fall_velocity.rain_speed(np.array([1.0, 2.0, 5.0])) == pytest.approx([4.0, 6.5, 9.1], rel=0.02)


def test_refractive_index(spark):
    for model in permittivity.MODELS:
        re, im = permittivity.refractive_index(np.array(10.0), np.array(9.4), model)
        assert (re, im) == (pytest.approx(7.84, rel=0.01), pytest.approx(2.39, rel=0.01))
        row = spark.range(1).select(permittivity.refractive_index_struct(F.lit(10.0), F.lit(9.4), model).alias("m")).first().m
        assert row.re == pytest.approx(float(re)) and row.im == pytest.approx(float(im))
    assert math.isnan(permittivity.refractive_index(np.array(60.0), np.array(9.4), "Turner2016")[0])
    assert permittivity.rayleigh_dielectric_factor(np.array(7.84), np.array(2.39)) == pytest.approx(0.927, abs=0.01)
    assert radar.numerical_frequency("X") == 9.4 and radar.wavelength_of_frequency(radar.frequency_of_wavelength(32.0)) == pytest.approx(32)


def test_distributions_keep_their_moments():
    d = np.arange(0.0005, 60, 0.001)
    integral = lambda n, k: float((n * d**k * 0.001).sum())
    assert integral(psd.gamma_psd(d, 8000.0, 2.5, 2.0), 3) == pytest.approx(float(psd.gamma_moment(8000.0, 2.5, 2.0, 3)), rel=1e-3)
    assert integral(psd.exponential(d, 8000.0, 2.5), 4) == pytest.approx(psd.exponential_moment(8000.0, np.array(2.5), 4), rel=1e-3)
    assert integral(psd.normalized_gamma_dm(d, 8000.0, 1.5, 3.0), 4) == pytest.approx(float(psd.normalized_gamma_moment(8000.0, np.array(1.5), 3.0, 4)), rel=1e-3)
    assert integral(psd.generalized_gamma(d, 1000.0, 2.0, 1.5, 1.2), 0) == pytest.approx(1000, rel=1e-3)
    assert integral(psd.generalized_gamma(d, 1000.0, 2.0, 1.5, 1.2), 3) == pytest.approx(float(psd.generalized_gamma_moment(1000.0, np.array(2.0), 1.5, 1.2, 3)), rel=1e-3)
    shape = psd.normalized_generalized_gamma(d, 8000.0, 1.5, 3.0, 4.0, 1.0, 1.5)
    for k in (2, 3, 4):
        assert integral(shape, k) == pytest.approx(float(psd.normalized_generalized_moment(k, 8000.0, np.array(1.5), 3.0, 4.0, 1.0, 1.5)), rel=1e-3)
    assert integral(psd.lognormal(d, 500.0, 0.2, 0.4), 2) == pytest.approx(float(psd.lognormal_moment(500.0, np.array(0.4), 0.2, 2, corrected=True)), rel=1e-3)


def test_moment_fits_recover():
    m = {k: float(psd.gamma_moment(8000.0, 2.5, 2.0, k)) for k in range(7)}
    for orders, method in ((o, f) for n, (o, f) in moments_fit.METHODS["GammaPSD"].items() if n != "M246"):
        assert [float(x) for x in method(*[np.array(m[k]) for k in orders])] == pytest.approx([8000, 2.0, 2.5], rel=1e-6)
    assert [float(x) for x in moments_fit.gamma_m246(*[np.array(m[k]) for k in (2, 4, 6)], corrected=True)] == pytest.approx([8000, 2.0, 2.5], rel=1e-6)
    e = {k: psd.exponential_moment(8000.0, np.array(2.5), k) for k in (3, 4)}
    assert [float(x) for x in moments_fit.exponential_m34(e[3], e[4])] == pytest.approx([8000, 2.5])
    assert [float(x) for x in moments_fit.exponential_of_moments(e[3], e[4], 3, 4)] == pytest.approx([8000, 2.5])


def test_goodness(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 1.0], [0.0, 1.0, 2.0, 1.0]), ([0.0, 1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 0.0]), ([float("nan")] * 4, [1.0] * 4)], "o array<double>, p array<double>")
    same, shifted, bad = goodness.goodness(df, "o", "p", _lit(D), _lit(W), None).collect()
    assert same.R2 == pytest.approx(1) and same.KLDiv == 0 and same.WD == 0 and same.KS == 0 and same.RelMaxAE == 0
    assert shifted.KS == pytest.approx(0.5) and shifted.WD == pytest.approx(0.2) and shifted.DmodeDiff == pytest.approx(0.2) and shifted.JSD > 0
    assert math.isnan(bad.R2) and math.isnan(bad.KS)


def test_sensor_registry(spark):
    for sensor in sensors.SENSORS:
        sensors.check_sensor_configuration(sensor)
    assert {s: sensors.list_size(s) for s in sensors.SENSORS} == {"PARSIVEL": 1024, "PARSIVEL2": 1024, "LPM": 440, "LPM_V0": 400, "PWS100": 1156, "SWS250": 336, "ODM470": 128, "RD80": 20}
    assert sensors.bins_table(spark, ("RD80",)).count() == 20
    with pytest.raises(ValueError):
        sensors.diameter_bins("X")
