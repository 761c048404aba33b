"""Named queries of the scalar formulae and spectrum reductions, each against SQL written out by hand.

Diameters and parameters come from whole tables: ``lineitem`` for scalar formulae, ``stations`` for the air at a
place, ``embeddings`` for spectra.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions import axis_ratio, fall_velocity, goodness, moments_fit, permittivity, physics, psd, radar
from rainloom.functions import spectrum as S
from rainloom.functions.physics import Environment
from rainloom.plans.reference_queries import _BINS, _CENTERS, _D, _LONG, _W, _WIDTHS, BIN_WIDTH, N_BINS, _spectra, query
from rainloom.session import staged, table


def _out(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    """Rounded, with null for a missing number."""
    return [F.round(F.nanvl(c, F.lit(None).cast("double")), digits).alias(n) for n, c in columns.items()]


def _rounded(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f'round({c}, {digits}) AS "{n}"' for n, c in columns.items())


# --- fall speeds and shapes -----------------------------------------------------------------------------------

#: Default air at sea level, in SQL: temperature t, gravity g, pressure p, saturation es, density rho, viscosity eta.
_AIR = """SELECT t, g, p, es, (p - 0.378 * 0.95 * es) / (t * 287.04) AS rho, 1.721e-5 + 4.87e-8 * (t - 273.15) AS eta, 0.0761 - 0.000155 * (t - 273.15) AS tension,
    (999.83952 + 16.945176 * c - 7.9870401e-3 * c * c - 4.6170461e-5 * pow(c, 3) + 1.0556302e-7 * pow(c, 4) - 2.8054253e-10 * pow(c, 5)) / (1 + 1.687985e-2 * c) AS rho_w
    FROM (SELECT t, t - 273.15 AS c, 9.806229 - 0.025889372 * cos(2 * radians(46.159346)) AS g, 101325.0 AS p,
        exp(-2991.2729 * pow(t, -2) - 6017.0128 / t + 18.87643854 - 0.028354721 * t + 1.7838301e-5 * t * t - 8.4150417e-10 * pow(t, 3) + 4.4412543e-13 * pow(t, 4) + 2.858487 * ln(t)) AS es FROM (SELECT CAST(288.15 AS DOUBLE) AS t))"""
_DIAMETERS = "d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000.0 AS d FROM lineitem)"


def _diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10_000.0).alias("d"))


_RAIN = {
    "atlas": "9.65 - 10.3 * exp(-0.6 * d)",
    "lhermitte": "9.25 * (1 - exp(-(0.068 * d * d + 0.488 * d)))",
    "brandes": "-0.1021 + 4.932 * d - 0.9551 * d * d + 0.07934 * pow(d, 3) - 0.002362 * pow(d, 4)",
    "uplinger": "4.874 * d * exp(-0.195 * d)",
    "van_dijk": "-0.254 + 5.03 * d - 0.912 * d * d + 0.0561 * pow(d, 3)",
}
_RAIN_NAMES = {"atlas": "Atlas1973", "lhermitte": "Lhermitte1988", "brandes": "Brandes2002", "uplinger": "Uplinger1981", "van_dijk": "VanDijk2002"}


@query(
    f"""WITH {_DIAMETERS}, v AS (SELECT d.*, {", ".join(f"{c} AS {n}" for n, c in _RAIN.items())}, pow(1.225 / rho, 0.025 * d + 0.375) AS thin, d > 0 AND d < 10 AS valid FROM d, ({_AIR}) a)
    SELECT l_orderkey, l_linenumber, {_rounded({n: f"CASE WHEN valid AND {n} > 0 THEN {n} * thin END" for n in _RAIN})} FROM v"""
)
def rain_speed_models(spark, sf_dir):
    speeds = {n: fall_velocity.rain_speed(F.col("d"), m) for n, m in _RAIN_NAMES.items()}
    return _diameters(spark, sf_dir).select("l_orderkey", "l_linenumber", *_out(speeds))


@query(
    f"""WITH {_DIAMETERS}, x AS (SELECT d.*, a.*, d / 1000.0 AS m, (rho_w - rho) * g AS lift FROM d, ({_AIR}) a WHERE d > 0 AND d < 10),
    y AS (SELECT *, ln(4.0 / 3 * rho * lift * pow(m, 3) / (eta * eta)) AS x1, ln(4.0 / 3 * lift * m * m / tension) AS x2, ln(pow(tension, 3) * rho * rho / (pow(eta, 4) * lift)) / 6 AS np FROM x),
    z AS (SELECT *, CASE WHEN m < 1.07e-3
        THEN exp(-3.18657 + 0.992696 * x1 - 0.00153193 * x1 * x1 - 0.000987059 * pow(x1, 3) - 0.000578878 * pow(x1, 4) + 0.0000855176 * pow(x1, 5) - 0.00000327815 * pow(x1, 6))
        ELSE exp(np - 5.00015 + 5.23778 * (x2 + np) - 2.04914 * pow(x2 + np, 2) + 0.475294 * pow(x2 + np, 3) - 0.0542819 * pow(x2 + np, 4) + 0.00238449 * pow(x2 + np, 5)) END AS re FROM y)
    SELECT l_orderkey, l_linenumber, round(re, 4) AS reynolds, round(re * eta / (m * rho), 6) AS speed, round(4.0 / 3 * lift * m / (rho * pow(re * eta / (m * rho), 2)), 6) AS drag FROM z"""
)
def beard_speeds(spark, sf_dir):
    d, air = F.col("d"), Environment(temperature=F.lit(288.15))
    speed = fall_velocity.rain_speed(d, "Beard1976", air)
    reynolds = fall_velocity.reynolds_number(d / 1000, air.temperature, air.air_density, air.liquid_density, air.gravity)
    out = staged(_diameters(spark, sf_dir).where("d > 0 and d < 10"), {"speed": speed, "reynolds": reynolds})
    drag = fall_velocity.drag_coefficient(d / 1000, air.air_density, air.liquid_density, F.col("speed"), air.gravity)
    return out.select("l_orderkey", "l_linenumber", F.round("reynolds", 4).alias("reynolds"), *_out({"speed": F.col("speed"), "drag": drag}))


_BEARD_RATIO = "1.0048 + 5.7e-4 * d - 2.628e-2 * d * d + 3.682e-3 * pow(d, 3) - 1.677e-4 * pow(d, 4)"
_RATIOS = {
    "Thurai2005": "0.9707 + 4.26e-2 * d - 4.29e-2 * d * d + 6.5e-3 * pow(d, 3) - 3e-4 * pow(d, 4)",
    "Thurai2007": "CASE WHEN d > 1.5 THEN 1.065 - 6.25e-2 * d - 3.99e-3 * d * d + 7.66e-4 * pow(d, 3) - 4.095e-5 * pow(d, 4) WHEN d > 0.7 THEN 1.173 - 0.5165 * d + 0.4698 * d * d - 0.1317 * pow(d, 3) - 8.5e-3 * pow(d, 4) ELSE 1 END",
    "Parsivel": "CASE WHEN d <= 1 THEN 1 WHEN d >= 5 THEN 0.7 ELSE 1.075 - 0.075 * d END",
    "Brandes2002": "0.9951 + 0.0251 * d - 0.03644 * d * d + 0.005303 * pow(d, 3) - 0.0002492 * pow(d, 4)",
    "Pruppacher1970": "1.03 - 0.062 * d",
    "Beard1987": _BEARD_RATIO,
    "Andsager1999": f"CASE WHEN 0.1 * d >= 1.1 AND 0.1 * d < 4.4 THEN 1.012 - 0.144 * (0.1 * d) - 1.03 * pow(0.1 * d, 2) ELSE {_BEARD_RATIO} END",
    "Chang2009": "0.98287 + 4.2514e-2 * d - 3.3439e-2 * d * d + 4.3402e-3 * pow(d, 3) - 1.9223e-4 * pow(d, 4)",
}


@query(f"WITH {_DIAMETERS} SELECT l_orderkey, l_linenumber, {_rounded({n: f'greatest(0, least(1, {c}))' for n, c in _RATIOS.items()}, 9)} FROM d")
def axis_ratio_models(spark, sf_dir):
    return _diameters(spark, sf_dir).select("l_orderkey", "l_linenumber", *_out({m: axis_ratio.axis_ratio(F.col("d"), m) for m in axis_ratio.MODELS}, 9))


_GRAUPEL = {
    "Lee2015": "1.10 * pow(d, 0.28)",
    "Locatelli1974Lump": "1.3 * pow(d, 0.66)",
    "Locatelli1974Conical": "1.20 * pow(d, 0.65)",
    "Locatelli1974Hexagonal": "1.10 * pow(d, 0.57)",
    "Heymsfield2014": "4.88 * pow(0.1 * d, 0.84)",
    "Heymsfield2018": "7.59 * pow(0.1 * d, 0.89)",
}
_HAIL = {
    "Laurie1960": "13.95 * pow(0.1 * d, 0.51)",
    "Knight1983LD": "8.445 * pow(0.1 * d, 0.553)",
    "Knight1983HD": "10.58 * pow(0.1 * d, 0.267)",
    "Heymsfield2014": "12.28 * pow(0.1 * d, 0.57)",
    "Heymsfield2018": "8.39 * pow(0.1 * d, 0.67)",
    "Fehlmann2020": "3.74 * pow(d, 0.5)",
}
_BEST = "4.0 / 3 * 500 * 9.81 * 1.225 * pow(d / 1000, 3) / (1.81e-5 * 1.81e-5)"


@query(
    f"""WITH {_DIAMETERS}, x AS (SELECT *, {_BEST} AS best FROM d WHERE d > 0)
    SELECT l_orderkey, l_linenumber, {_rounded({f"graupel_{n}": f"CASE WHEN d >= 0.5 AND d <= 5 THEN {c} END" for n, c in _GRAUPEL.items()})}, {_rounded({f"hail_{n}": f"CASE WHEN d > 4 THEN {c} END" for n, c in _HAIL.items()})},
        round(180 * pow(0.1 * d, 0.33), 6) AS density, round(CASE WHEN best < 67700 THEN 0.106 * pow(best, 0.693) ELSE 0.55 * pow(best, 0.545) END * 1.81e-5 / (1.225 * d / 1000), 6) AS speed_of_density FROM x"""
)
def graupel_hail_speeds(spark, sf_dir):
    d = F.col("d")
    columns = {f"graupel_{m}": fall_velocity.graupel_speed(d, m) for m in _GRAUPEL} | {f"hail_{m}": fall_velocity.hail_speed(d, m) for m in _HAIL}
    columns |= {"density": fall_velocity.graupel_density(d), "speed_of_density": fall_velocity.graupel_density_speed(d)}
    return _diameters(spark, sf_dir).where("d > 0").select("l_orderkey", "l_linenumber", *_out(columns))


# --- air, water, permittivity ------------------------------------------------------------------------------------

_ES = "exp(-2991.2729 * pow({t}, -2) - 6017.0128 / {t} + 18.87643854 - 0.028354721 * {t} + 1.7838301e-5 * {t} * {t} - 8.4150417e-10 * pow({t}, 3) + 4.4412543e-13 * pow({t}, 4) + 2.858487 * ln({t}))"


@query(
    f"""WITH s AS (SELECT row_id, 268.15 + 30 * (row_id % 1000) / 1000.0 AS t, CAST(row_id % 3500 AS DOUBLE) AS h, 40 + (row_id % 20) AS lat, 0.3 + (row_id % 7) / 10.0 AS rh FROM l2e_params),
    x AS (SELECT *, t - 273.15 AS c, 9.806229 - 0.025889372 * cos(2 * radians(lat)) - 2.879513e-6 * h AS g, {_ES.format(t="t")} AS es, t - 0.0065 * h AS aloft FROM s),
    y AS (SELECT *, 101325 * exp(-g / (0.0065 * 287.04) * ln(1 + 0.0065 * h / t)) AS p,
        CASE WHEN c > 0 THEN (999.83952 + 16.945176 * c - 7.9870401e-3 * c * c - 4.6170461e-5 * pow(c, 3) + 1.0556302e-7 * pow(c, 4) - 2.8054253e-10 * pow(c, 5)) / (1 + 1.687985e-2 * c) ELSE 999.84 + 0.086 * c - 0.0108 * c * c END AS pure,
        1e-11 * (50.88496 + 0.6163813 * c + 1.459187e-3 * c * c + 2.008438e-5 * pow(c, 3) - 5.857727e-8 * pow(c, 4) + 4.10411e-10 * pow(c, 5)) / (1 + 1.967348e-2 * c) AS comp FROM x)
    SELECT row_id, round(g, 8) AS gravity, round(p, 4) AS pressure, round(aloft, 6) AS temperature, round(es, 5) AS saturation, round(rh * es, 5) AS vapor, round((p - 0.378 * rh * es) / (t * 287.04), 8) AS density,
        round((CASE WHEN c > 0 THEN 1.721e-5 + 4.87e-8 * c ELSE 1.718e-5 + 4.9e-8 * c - 1.2e-10 * c * c END) * 1e6, 6) AS viscosity, round(rh / (1 / es - (1 - rh) / 101325) * exp(-h * (5.8e3 * 0.0065 / (aloft * aloft) + 5.5e-5)), 5) AS vapor_aloft,
        round(pure, 6) AS pure_water, round(comp * 1e12, 6) AS compressibility, round(0.0761 - 0.000155 * c, 8) AS tension, round(pure * exp(comp * (p - 101325)), 6) AS water FROM y"""
)
def air_and_water(spark, sf_dir):
    n = F.col("row_id")
    rows = table(spark, sf_dir, "l2e_params").select("row_id", (268.15 + 30 * (n % 1000) / 1000.0).alias("t"), (n % 3500).cast("double").alias("h"), (40 + n % 20).cast("double").alias("lat"), (0.3 + (n % 7) / 10.0).alias("rh"))
    air = Environment(latitude=F.col("lat"), altitude=F.col("h"), temperature=F.col("t"), relative_humidity=F.col("rh"))
    exact = {"gravity": (air.gravity, 8), "pressure": (air.pressure, 4), "temperature": (physics.air_temperature_at_height(F.col("h"), F.col("t")), 6), "saturation": (physics.vapor_saturation_pressure(F.col("t")), 5)}
    exact |= {"vapor": (physics.vapor_pressure(F.col("rh"), F.col("t")), 5), "density": (air.air_density, 8), "viscosity": (air.air_viscosity * 1e6, 6), "vapor_aloft": (physics.vapor_pressure_at_height(F.col("h"), F.col("t"), F.col("rh")), 5)}
    exact |= {"pure_water": (physics.pure_water_density(F.col("t")), 6), "compressibility": (physics.pure_water_compressibility(F.col("t")) * 1e12, 6), "tension": (physics.pure_water_surface_tension(F.col("t")), 8), "water": (air.liquid_density, 6)}
    return rows.select("row_id", *[F.round(c, d).alias(name) for name, (c, d) in exact.items()])


# --- distributions ------------------------------------------------------------------------------------------------

_PARAMETERS = """p AS (SELECT row_id, 0.1 + (row_id % 79) / 10.0 AS d, 100.0 + row_id % 900 AS nt, 0.5 + (row_id % 37) / 10.0 AS lam, (row_id % 91) / 10.0 AS mu, 0.6 + (row_id % 29) / 10.0 AS dm, 0.2 + (row_id % 13) / 10.0 AS sg, 0.6 + (row_id % 17) / 10.0 AS c FROM l2e_params)"""


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("row_id")
    part = lambda low, k: (low + (n % k) / 10.0)
    values = {"d": part(0.1, 79), "nt": (100.0 + n % 900).cast("double"), "lam": part(0.5, 37), "mu": part(0.0, 91), "dm": part(0.6, 29), "sg": part(0.2, 13), "c": part(0.6, 17)}
    return table(spark, sf_dir, "l2e_params").select("row_id", *[c.cast("double").alias(k) for k, c in values.items()])


def _parts(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


_NGG = """c * exp(lgamma(mu + 1 + 3 / c) * ((4 + c * (mu + 1)) / (3 - 4.0)) + lgamma(mu + 1 + 4 / c) * ((-3 - c * (mu + 1)) / (3 - 4.0))) * pow(x, c * (mu + 1) - 1)
    * exp(-pow(x * exp((lgamma(mu + 1 + 3 / c) - lgamma(mu + 1 + 4 / c)) / (3 - 4.0)), c))"""
_DENSITIES = {
    "lognormal": "nt / (sqrt(2 * pi()) * sg * d) * exp(-pow(ln(d) - mu / 10, 2) / (2 * sg * sg))",
    "exponential": "nt * exp(-lam * d)",
    "gamma": "nt * pow(d, mu) * exp(-lam * d)",
    "gamma_dm": "nt * 6 / pow(4, 4) * pow(mu + 4, mu + 4) / gamma(mu + 4) * pow(x, mu) * exp(-(mu + 4) * x)",
    "gamma_d50": "nt * 6 / pow(3.67, 4) * pow(mu + 3.67, mu + 4) / gamma(mu + 4) * pow(x, mu) * exp(-(mu + 3.67) * x)",
    "gamma_nt": "nt / dm * pow(mu + 4, mu + 1) / gamma(mu + 1) * pow(x, mu) * exp(-(mu + 4) * x)",
    "generalized": "nt * c * lam / gamma(mu + 1) * pow(lam * d, c * (mu + 1) - 1) * exp(-pow(lam * d, c))",
    "shape": _NGG,
    "normalized": f"nt * {_NGG}",
}


@query(f"WITH {_PARAMETERS} SELECT row_id, {_rounded({n: f'({c}) / (1e3 * (1 + abs({c})))' for n, c in _DENSITIES.items()}, 9)} FROM (SELECT *, d / dm AS x FROM p)")
def distribution_values(spark, sf_dir):
    """N(D) of every distribution, as n / (1000 (1 + n)), which keeps their many orders of magnitude apart."""
    d, nt, lam, mu, dm, sg, c = _parts("d", "nt", "lam", "mu", "dm", "sg", "c")
    values = {
        "lognormal": psd.lognormal(d, nt, mu / 10, sg),
        "exponential": psd.exponential(d, nt, lam),
        "gamma": psd.gamma_psd(d, nt, lam, mu),
        "gamma_dm": psd.normalized_gamma_dm(d, nt, dm, mu),
        "gamma_d50": psd.normalized_gamma_d50(d, nt, dm, mu),
        "gamma_nt": psd.normalized_gamma_nt(d, nt, dm, mu),
        "generalized": psd.generalized_gamma(d, nt, lam, mu, c),
        "shape": psd.normalized_generalized_shape(d / dm, 3, 4, c, mu),
        "normalized": psd.normalized_generalized_gamma(d, nt, dm, 3, 4, mu, c),
    }
    out = staged(_parameters(spark, sf_dir), values)
    return out.select("row_id", *[F.round(F.col(n) / (1e3 * (1 + F.abs(n))), 9).alias(n) for n in values])


_MOMENTS_OF = {
    "gamma_m3": "nt * gamma(mu + 4) / pow(lam, mu + 4)",
    "gamma_r": "6 * pi() * 1e-4 * 3.778 * nt * gamma(mu + 3 + 3.67 + 1) / pow(lam, mu + 3 + 3.67 + 1)",
    "gamma_lwc": "pi() / 6 * 1e-3 * nt * gamma(mu + 4) / pow(lam, mu + 4)",
    "gamma_z": "10 * log10(nt * gamma(mu + 7) / pow(lam, mu + 7))",
    "gamma_dm": "(mu + 4) / lam",
    "gamma_sigma": "sqrt(mu + 4) / lam",
    "exponential_m4": "nt * 24 / pow(lam, 5)",
    "total_m2": "nt * gamma(mu + 3) / (gamma(mu + 1) * lam * lam)",
    "lognormal_m3": "nt * exp(3 * mu / 10 + 1.5 * sg * sg)",
    "normalized_m6": "6.0 / 256 * nt * pow(dm, 7) * pow(mu + 4, -3) * gamma(mu + 7) / gamma(mu + 4)",
    "generalized_m3": "nt * pow(lam, -3) * gamma(mu + 1 + 3 / c) / gamma(mu + 1)",
    "scaled_m6": "nt * pow(dm, 7) * exp(lgamma(mu + 1 + 6 / c) + lgamma(mu + 1 + 3 / c) * 2 - lgamma(mu + 1 + 4 / c) * 3)",
    "scaling_nc": "pow(nt, 5.0) * pow(nt * dm, -4.0)",
    "scaling_dc": "dm",
}


@query(f"WITH {_PARAMETERS} SELECT row_id, {_rounded({n: c if n == 'gamma_z' else f'ln({c})' for n, c in _MOMENTS_OF.items()}, 5)} FROM p")
def distribution_moments(spark, sf_dir):
    """Moments and what follows from them, as natural logarithms (gamma_z is in dBZ)."""
    nt, lam, mu, dm, sg, c = _parts("nt", "lam", "mu", "dm", "sg", "c")
    values = {
        "gamma_m3": psd.gamma_moment(nt, lam, mu, 3),
        "gamma_r": psd.gamma_rain_rate(nt, lam, mu),
        "gamma_lwc": psd.gamma_water_content(nt, lam, mu),
        "gamma_z": psd.gamma_reflectivity(nt, lam, mu),
        "gamma_dm": psd.gamma_mean_diameter(mu, lam),
        "gamma_sigma": psd.gamma_width(mu, lam),
        "exponential_m4": psd.exponential_moment(nt, lam, 4),
        "total_m2": psd.gamma_moment_of_total(nt, mu, lam, 2),
        "lognormal_m3": psd.lognormal_moment(nt, sg, mu / 10, 3),
        "normalized_m6": psd.normalized_gamma_moment(nt, dm, mu, 6),
        "generalized_m3": psd.generalized_gamma_moment(nt, lam, mu, c, 3),
        "scaled_m6": psd.normalized_generalized_moment(6, nt, dm, 3, 4, mu, c),
        "scaling_nc": psd.scaling_concentration(3, 4, nt, nt * dm),
        "scaling_dc": psd.scaling_diameter(3, 4, nt, nt * dm),
    }
    out = staged(_parameters(spark, sf_dir), values)
    return out.select("row_id", *[F.round(F.col(n) if n == "gamma_z" else F.log(n), 5).alias(n) for n in values])


_MOMENT_LIST = ", ".join(f"sum(pow(d, {k}) * nd * {_W}) AS m{k}" for k in range(7))


@query(
    f"""WITH {_LONG}, m AS (SELECT vec_id, {_MOMENT_LIST} FROM s GROUP BY vec_id),
    g AS (SELECT *, 1 / (1 - m3 * m3 / (m2 * m4)) - 4 AS mu234, 1 / (1 - m5 * m5 / (m4 * m6)) - 6 AS mu456, pow(m4, 3) / (m3 * m3 * m6) AS g346, m4 * m4 / (m2 * m6) AS g246 FROM m),
    h AS (SELECT *, m2 / m3 * (mu234 + 3) AS l234, m4 / m5 * (mu456 + 5) AS l456, (5.5 * g346 - 4 + sqrt(g346 * (0.25 * g346 + 2))) / (1 - g346) AS mu346, 7 - 11 * g246 - sqrt(g246 * g246 + 14 * g246 + 1) / (2 * (g246 - 1)) AS mu246 FROM g),
    i AS (SELECT *, (mu346 + 4) * m3 / m4 AS l346, sqrt((4 + mu246) * (3 + mu246) * m2 / m4) AS l246, pow(m2 * gamma(5) / (m4 * gamma(3)), 0.5) AS lexp FROM h)
    SELECT vec_id, {_rounded({"mu234": "mu234", "l234": "l234", "mu456": "mu456", "l456": "l456", "mu346": "mu346", "l346": "l346", "mu246": "mu246", "l246": "l246",
        "n234": "ln(m2 * pow(l234, mu234 + 3) / gamma(mu234 + 3))", "n346": "ln(m3 * pow(l346, mu346 + 4) / gamma(mu346 + 4))", "exp_n": "256.0 / 6 * pow(m3, 5) / pow(m4, 4)", "exp_l": "4 * m3 / m4",
        "two_l": "lexp", "two_n": "m2 * pow(lexp, 3) / gamma(3)", "log_nt": "8 * ln(m3) - 9 * ln(m4) - 2 * ln(m6)", "log_mu": "(-10 * ln(m3) + 13.5 * ln(m4) - 3.5 * ln(m6)) / 3", "log_sigma": "(2 * ln(m3) - 3 * ln(m4) + ln(m6)) / 3"})} FROM i"""
)
def moment_methods(spark, sf_dir):
    rows = _spectra(spark, sf_dir).select("vec_id", *[S.moment(F.col("nd"), _CENTERS(), _WIDTHS(), k).alias(f"m{k}") for k in range(7)])
    m = {k: F.col(f"m{k}") for k in range(7)}
    fits = {n: f(*(m[k] for k in orders)) for n, (orders, f) in moments_fit.METHODS["GammaPSD"].items()}
    out = {}
    for n in ("M234", "M456", "M346", "M246"):
        out |= {f"mu{n[1:]}": fits[n][1], f"l{n[1:]}": fits[n][2]}
    out |= {f"n{n[1:]}": F.log(fits[n][0]) for n in ("M234", "M346")}
    out |= dict(zip(("exp_n", "exp_l"), moments_fit.exponential_m34(m[3], m[4])))
    out |= dict(zip(("two_n", "two_l"), moments_fit.exponential_of_moments(m[2], m[4], 2, 4)))
    nt, mu, sigma = moments_fit.lognormal_m346(m[3], m[4], m[6])
    out |= {"log_nt": F.log(nt), "log_mu": mu, "log_sigma": sigma}
    done = staged(rows, out)
    return done.select("vec_id", *_out({n: F.col(n) for n in out}))


# --- spectra ---------------------------------------------------------------------------------------------------------

_SPEED = "(9.65 - 10.3 * exp(-0.6 * d))"
#: Still-air speeds of the bins, at least 0.05 m/s.
_V = np.maximum(9.65 - 10.3 * np.exp(-0.6 * _BINS.center), 0.05)
_AREA = 0.0054


def _values(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


@query(
    f"""WITH {_LONG}, x AS (SELECT *, greatest({_SPEED}, 0.05) AS v FROM s), t AS (SELECT vec_id, sum(nd * pow(d, 3)) AS w3, sum(6 * pi() * 1e-4 * nd * v * pow(d, 3) * {_W}) AS r FROM x GROUP BY vec_id)
    SELECT x.vec_id, CAST(x.i - 1 AS INTEGER) AS bin, {_rounded({"n": f"nd / (v * {_W} * {_AREA} * 60)", "counts": f"nd * v * {_W} * {_AREA} * 60", "rain": "6 * pi() * 1e-4 * nd * v * pow(d, 3)", "part": f"100 * 6 * pi() * 1e-4 * nd * v * pow(d, 3) * {_W} / r",
        "dbz": "CASE WHEN nd > 0 THEN greatest(10 * log10(nd * pow(d, 6)), -60) END", "water": "pi() / 6 * 1e-3 * nd * pow(d, 3)", "energy": "pi() / 12 * 1e-6 * nd * pow(d, 3) * pow(v, 3) * 60", "volume": "pi() / 6 * pow(d, 3)"})}
    FROM x JOIN t ON x.vec_id = t.vec_id"""
)
def spectrum_by_bin(spark, sf_dir):
    nd, d, w, v, area = F.col("nd"), _CENTERS(), _WIDTHS(), _values(_V), _values(np.full(N_BINS, _AREA))
    interval = F.lit(60.0)
    spectra = S.spectrum_parameters(nd, v, d, interval)
    arrays = {
        "n": S.number_concentration(nd, v, w, area, interval),
        "counts": S.counts_from_concentration(nd, v, w, area, interval),
        "rain": spectra["R_spectrum"],
        "part": S.rain_rate_contribution(nd, v, d, w),
        "dbz": spectra["Z_spectrum"],
        "water": spectra["LWC_spectrum"],
        "energy": spectra["KE_spectrum"],
        "volume": F.transform(d, S.drop_volume),
    }
    rows = staged(_spectra(spark, sf_dir), arrays).select("vec_id", F.posexplode(F.arrays_zip(*arrays)).alias("bin", "x"))
    return rows.select("vec_id", "bin", *_out({n: F.col(f"x.{n}") for n in arrays}))


@query(
    f"""WITH {_LONG}, x AS (SELECT *, greatest({_SPEED}, 0.05) AS v FROM s),
    m AS (SELECT vec_id, sum(nd * {_W}) AS nt, sum(pow(d, 3) * nd * {_W}) AS m3, sum(pow(d, 4) * nd * {_W}) AS m4, sum(6 * pi() * 1e-4 * nd * v * pow(d, 3) * {_W}) AS r, sum(nd * pow(d, 3)) AS c3, sum(nd * pow(d, 3) * v * v) AS c32,
        pi() / 12 * 1e-6 * 60 * sum(nd * pow(d, 3) * pow(v, 3) * {_W}) AS e, sum(nd * {_W}) FILTER (i <= 16) AS low FROM x GROUP BY vec_id)
    SELECT vec_id, {_rounded({"nt": "nt", "accumulation": "r * 60 / 3600", "rate_of_counts": f"pi() / 6 * 1e-9 * 3.6e6 * c3 / {_AREA} / 60", "lwc": "pi() / 6 * 1e-3 * m3", "nw": "256 / (pi() * 1000) * 1e6 * (pi() / 6 * 1e-3 * m3) / pow(m4 / m3, 4)",
        "energy": "e", "flux": "e * 60", "per_mm": "e * 60 / r", "energy_of_counts": f"pi() / 12 * 1e-6 * c32 / {_AREA}", "per_mm_of_counts": f"(pi() / 12 * 1e-6 * c32 / {_AREA} * 60) / (pi() / 6 * 1e-9 * 3.6e6 * c3 / {_AREA} / 60)", "below_2mm": "low"}, 5)} FROM m"""
)
def spectrum_totals(spark, sf_dir):
    nd, d, w, v, area, t = F.col("nd"), _CENTERS(), _WIDTHS(), _values(_V), _values(np.full(N_BINS, _AREA)), F.lit(60.0)
    m3, m4 = (S.moment(nd, d, w, k) for k in (3, 4))
    energy, counted = S.kinetic_energy(nd, v, d, w, t), S.kinetic_energy_from_counts(nd, v, area, d, t)
    out = {
        "nt": S.total_number_concentration(nd, w),
        "accumulation": S.rain_accumulation(S.rain_rate(nd, v, d, w), t),
        "rate_of_counts": S.rain_rate_from_counts(nd, area, d, t),
        "lwc": S.liquid_water_content_from_moment(m3),
        "nw": S.normalized_intercept(S.liquid_water_content(nd, d, w), S.mean_volume_diameter(m3, m4)),
        "energy": energy[0],
        "flux": energy[1],
        "per_mm": energy[2],
        "energy_of_counts": counted[0],
        "per_mm_of_counts": counted[2],
        "below_2mm": S.partial_number_concentration(nd, _BINS.lower, _BINS.upper, 0.0, 2.0),
    }
    done = staged(_spectra(spark, sf_dir), out)
    return done.select("vec_id", *_out({n: F.col(n) for n in out}, 5))


@query(
    f"""WITH {_LONG}, q AS (SELECT vec_id, 0.1 * unnest(range(1, 10)) AS f FROM (SELECT DISTINCT vec_id FROM s)),
    c AS (SELECT vec_id, d, i, sum(pow(d, 3) * nd * {_W}) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, sum(pow(d, 3) * nd * {_W}) OVER (PARTITION BY vec_id) AS whole FROM s),
    u AS (SELECT c.vec_id, f, min(i) AS i FROM c JOIN q ON c.vec_id = q.vec_id WHERE cum >= whole * f GROUP BY 1, 2),
    e AS (SELECT u.vec_id, u.f, hi.d AS d1, hi.cum AS c1, lo.d AS d0, lo.cum AS c0, hi.whole FROM u JOIN c hi ON hi.vec_id = u.vec_id AND hi.i = u.i JOIN c lo ON lo.vec_id = u.vec_id AND lo.i = u.i - 1)
    SELECT vec_id, {", ".join(f"round(max(d0 + (d1 - d0) * (whole * f - c0) / (c1 - c0)) FILTER (abs(f - {k / 10}) < 1e-6), 6) AS D{k}0" for k in (1, 2, 5, 8, 9))} FROM e GROUP BY vec_id"""
)
def volume_quantiles(spark, sf_dir):
    fractions = (0.1, 0.2, 0.5, 0.8, 0.9)
    found = S.volume_quantiles(F.col("nd"), _CENTERS(), _WIDTHS(), fractions)
    return _spectra(spark, sf_dir).select("vec_id", *_out({f"D{round(f * 100)}": c for f, c in zip(fractions, found)}))


@query(
    f"""WITH {_LONG}, p AS (SELECT vec_id, i, nd FROM s), g AS (SELECT vec_id, (i - 1) // 8 AS bin, sum(nd) AS counted, sum(nd * (1 + (i - 1) % 8)) AS moving FROM p GROUP BY 1, 2)
    SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(moving / counted, 6) AS speed, round(counted, 5) AS counted FROM g"""
)
def velocity_by_diameter(spark, sf_dir):
    """The bins as a spectrum of 8 diameters by 8 speeds: mean speed and number per diameter."""
    from rainloom.functions import arrays as A

    nd = F.col("nd")
    speed = S.average_velocity(nd, _values(np.tile(np.arange(1.0, 9.0), 8)), 8)
    rows = _spectra(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(speed.alias("speed"), A.over_velocity(nd, 8).alias("counted"))).alias("bin", "x"))
    return rows.select("vec_id", "bin", F.round("x.speed", 6).alias("speed"), F.round("x.counted", 5).alias("counted"))


_FIT = f"""WITH {_LONG}, t AS (SELECT vec_id, sum(nd * {_W}) AS n0 FROM s GROUP BY vec_id),
    f AS (SELECT s.vec_id, s.i, s.d, s.nd AS o, CASE WHEN n0 * exp(-d) < 1e-3 THEN 0 ELSE n0 * exp(-d) END AS q FROM s JOIN t ON s.vec_id = t.vec_id),
    w AS (SELECT *, o / sum(o) OVER v AS po, q / sum(q) OVER v AS pq, max(o) OVER v AS top_o, max(q) OVER v AS top_q FROM f WINDOW v AS (PARTITION BY vec_id)),
    k AS (SELECT *, (po + pq) / 2 AS pm, sum(po) OVER c AS co, sum(pq) OVER c AS cq FROM w WINDOW c AS (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT vec_id, pow(corr(o, q), 2) AS r2, avg(abs(o - q)) AS mae, max(abs(o - q)) AS worst, max(top_o) AS top_o, max(top_q) AS top_q, min(d) FILTER (o = top_o) - min(d) FILTER (q = top_q) AS mode, sum((q - o) * {_W}) AS nt,
        sum(CASE WHEN po > 0 THEN po * ln(po / pq) ELSE 0 END) AS kl, sum(CASE WHEN po > 0 THEN po * ln(po / pm) ELSE 0 END) AS ko, sum(CASE WHEN pq > 0 THEN pq * ln(pq / pm) ELSE 0 END) AS kq, sum(abs(co - cq)) * {_W} AS wd, max(abs(co - cq)) AS ks FROM k GROUP BY vec_id)"""


@query(
    f"""{_FIT} SELECT vec_id, {_rounded({"R2": "r2", "MAE": "mae", "MaxAE": "worst", "RelMaxAE": "worst / top_o", "PeakDiff": "top_o - top_q", "RelPeakDiff": "(top_o - top_q) / top_o", "DmodeDiff": "mode", "NtDiff": "nt", "KLDiv": "greatest(kl, 0)",
        "JSD": "sqrt((greatest(ko, 0) + greatest(kq, 0)) / 2)", "WD": "wd", "KS": "ks"}, 5)} FROM e"""
)
def fit_errors(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    fitted = spectra.withColumn("fitted", psd.model("ExponentialPSD").values(_CENTERS(), {"N0": S.total_number_concentration(F.col("nd"), _WIDTHS()), "Lambda": F.lit(1.0)}))
    out = goodness.goodness(fitted, "nd", "fitted", _CENTERS(), _WIDTHS(), None)
    return out.select("vec_id", *_out({n: F.col(n) for n in ("R2", "MAE", "MaxAE", "RelMaxAE", "PeakDiff", "RelPeakDiff", "DmodeDiff", "NtDiff", "KLDiv", "JSD", "WD", "KS")}, 5))


# --- radar and permittivity ----------------------------------------------------------------------------------------------


@query(
    f"""WITH {_DIAMETERS}, f AS (SELECT *, 299.792458 / (d + 1) AS ghz FROM d) SELECT l_orderkey, l_linenumber, round(299.792458 / (d + 1), 6) AS ghz, round(299.792458 / ghz, 6) AS mm,
        round(ln(pow(pi(), 5) * 0.93 * pow(d, 6) / pow(d + 1, 4)), 6) AS backscatter, round(pi() * d / (d + 1), 6) AS size FROM f WHERE d > 0"""
)
def radar_units(spark, sf_dir):
    d = F.col("d")
    ghz = radar.frequency_of_wavelength(d + 1)
    return _diameters(spark, sf_dir).where("d > 0").select("l_orderkey", "l_linenumber", *_out({"ghz": ghz, "mm": radar.wavelength_of_frequency(ghz), "backscatter": F.log(radar.rayleigh_backscatter(d, d + 1, 0.93)), "size": radar.size_parameter(d, d + 1)}))
