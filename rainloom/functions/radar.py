"""Radar: bands, wavelengths, Rayleigh scattering, and radar variables by integrating a scattering table.

Full scattering amplitudes are not computed here; a table of them (one row per diameter and setting) is an
input. Without one, the Rayleigh forms below hold for drops small against the wavelength.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions.backend import ops

# Frequency in GHz by band.
BANDS = {"S": 2.70, "C": 5.4, "X": 9.4, "Ku": 13.6, "K": 24.2, "Ka": 35.5, "W": 94.05}
SPEED_OF_LIGHT = 299_792_458.0
OPTIONS = ("frequency", "num_points", "diameter_min", "diameter_max", "canting_angle_std", "axis_ratio_model", "permittivity_model", "water_temperature", "elevation_angle")
VARIABLES = ("DBZH", "DBZV", "ZDR", "LDRH", "LDRV", "RHOHV", "DELTAHV", "KDP", "AH", "AV", "ADP")
#: Columns of a scattering table: per diameter the backscattering cross sections and amplitudes in mm and mm2.
TABLE = ("frequency", "diameter", "sigma_h", "sigma_v", "sigma_hv", "cov_re", "cov_im", "forward_h_re", "forward_v_re", "ext_h", "ext_v")


def numerical_frequency(frequency: str | float) -> float:
    """GHz of a band name or number."""
    if isinstance(frequency, str):
        if frequency not in BANDS:
            raise ValueError(f"{frequency} is no radar band; known are {', '.join(BANDS)}")
        return BANDS[frequency]
    if not frequency > 0:
        raise ValueError("frequencies are above 0")
    return float(frequency)


def band_of(frequency: float) -> str:
    """The band's name, or the frequency as text."""
    return next((b for b, f in BANDS.items() if abs(f - frequency) < 1e-9), f"{frequency:g}")


def frequency_of_wavelength(wavelength: Any) -> Any:
    """GHz of mm."""
    return SPEED_OF_LIGHT / 1e6 / wavelength


def wavelength_of_frequency(frequency: Any) -> Any:
    """mm of GHz."""
    return SPEED_OF_LIGHT / 1e6 / frequency


def rayleigh_backscatter(diameter: Any, wavelength: Any, dielectric_factor: Any) -> Any:
    """Cross section in mm2."""
    o = ops(diameter, wavelength, dielectric_factor)
    return math.pi**5 * dielectric_factor * o.power(diameter, 6) / o.power(wavelength, 4)


def size_parameter(diameter: Any, wavelength: Any) -> Any:
    return math.pi * diameter / wavelength


def settings_table(spark: SparkSession, **options: Sequence[Any]) -> DataFrame:
    """The product of simulation settings; one row per combination, numbered."""
    names = [n for n in OPTIONS if n in options]
    values = [[numerical_frequency(f) for f in options[n]] if n == "frequency" else list(options[n]) for n in names]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(product(*values))], ["setting", *names])


def integrate(df: DataFrame, table: Sequence[dict[str, float]], diameters: np.ndarray, width: np.ndarray, wavelength: float, dielectric_factor: float, nd: str = "drop_number_concentration") -> DataFrame:
    """Adds the radar variables of one setting from a scattering table, interpolated to the bins.

    ``table`` holds the columns of TABLE for a setting, in order of diameter. Rows without drops get NaN.
    """
    at = np.array([r["diameter"] for r in table], float)

    def column(name: str) -> Column:
        return F.array(*[F.lit(float(v)) for v in np.interp(diameters, at, [r[name] for r in table], left=0, right=0) * width])

    def total(name: str) -> Column:
        return A.dot(F.col(nd), column(name))

    factor = wavelength**4 / (math.pi**5 * dielectric_factor)
    sums = {f"_{n}": total(n) for n in TABLE[2:]}
    df = df.withColumns(sums | {"_dry": A.total(F.col(nd)) <= 0})
    db = lambda x: F.when(x > 0, 10 * F.log10(x)).otherwise(A.nan())
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), A.nan())
    h, v, hv = F.col("_sigma_h"), F.col("_sigma_v"), F.col("_sigma_hv")
    cov = F.sqrt(F.col("_cov_re") * F.col("_cov_re") + F.col("_cov_im") * F.col("_cov_im"))
    values = {
        "DBZH": db(h * factor),
        "DBZV": db(v * factor),
        "ZDR": db(ratio(h, v)),
        "LDRH": db(ratio(hv, h)),
        "LDRV": db(ratio(hv, v)),
        "RHOHV": ratio(cov, F.sqrt(h * v)),
        "DELTAHV": F.degrees(F.atan2("_cov_im", "_cov_re")),
        "KDP": 1e-3 * (180 / math.pi) * wavelength * (F.col("_forward_h_re") - F.col("_forward_v_re")),
        "AH": 4.343e-3 * F.col("_ext_h"),
        "AV": 4.343e-3 * F.col("_ext_v"),
    }
    df = df.withColumns({n: F.when(F.col("_dry"), A.nan()).otherwise(c) for n, c in values.items()})
    return df.withColumn("ADP", F.col("AH") - F.col("AV")).drop(*sums, "_dry")


def rayleigh_reflectivity(nd: Column, diameter: Column, width: Column) -> Column:
    """dBZ by the sixth moment: the radar variable that needs no table."""
    z = A.dot(nd, A.powers(diameter, 6), width)
    return F.when(z > 0, 10 * F.log10(z)).otherwise(A.nan())


def unstack_bands(df: DataFrame, keys: Sequence[str], variables: Sequence[str], frequencies: Sequence[float]) -> DataFrame:
    """One row per keys with columns like DBZH_X instead of one row per frequency."""
    out = []
    for f in frequencies:
        for v in variables:
            out.append(F.max(F.when(F.abs(F.col("frequency") - f) < 1e-9, F.col(v))).alias(f"{v}_{band_of(f)}"))
    return df.groupBy(*keys).agg(*out)


def radar_parameters(df: DataFrame, tables: dict[tuple[Any, ...], Sequence[dict[str, float]]], settings: Sequence[dict[str, Any]], diameters: np.ndarray, width: np.ndarray, dielectric_factor: float = 0.93, nd: str = "drop_number_concentration") -> DataFrame:
    """The radar variables of every setting, one row per input row and setting, with the setting's columns.

    ``tables`` gives the scattering table of a setting by the values of its OPTIONS in order; a setting
    without a table gets Rayleigh reflectivity in DBZH and NaN else.
    """
    parts = []
    for setting in settings:
        frequency = numerical_frequency(setting["frequency"])
        key = tuple(setting[o] for o in OPTIONS if o in setting)
        if key in tables:
            part = integrate(df, tables[key], diameters, width, wavelength_of_frequency(frequency), dielectric_factor, nd)
        else:
            d, w = (F.array(*[F.lit(float(v)) for v in x]) for x in (diameters, width))
            part = df.withColumns({v: A.nan() for v in VARIABLES} | {"DBZH": rayleigh_reflectivity(F.col(nd), d, w)})
        parts.append(part.withColumns({o: F.lit(frequency if o == "frequency" else setting[o]) for o in OPTIONS if o in setting}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
