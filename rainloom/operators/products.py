"""Product chains: L1 spectra to empirical (L2E) and modelled (L2M) parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.functions import fall_velocity as V
from rainloom.functions import goodness, psd
from rainloom.functions import spectrum as S
from rainloom.functions.physics import Environment
from rainloom.operators import classification, fitting
from rainloom.operators.remap import kept_bins, regular_bins, select_bins
from rainloom.sensors import Bins
from rainloom.session import staged

THEORETICAL, MEASURED = "theoretical_velocity", "measured_velocity"


def _cut(bins: Bins, keep: Sequence[int]) -> Bins:
    keep = list(keep)
    return Bins(bins.lower[keep], bins.upper[keep], bins.center[keep], bins.width[keep])


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_drops(df: DataFrame, least: int = 0, column: str = "N") -> DataFrame:
    return df.where(F.col(column) >= least)


def with_bins(df: DataFrame, least: int, column: str = "Nbins") -> DataFrame:
    return df.where(F.col(column) >= least)


def with_rain(df: DataFrame, least: float, columns: Sequence[str] = ("R",)) -> DataFrame:
    """Rows where the largest of the rain rates reaches a minimum."""
    known = [F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns]
    return df.where((F.greatest(*known) if len(known) > 1 else known[0]) >= least)


def generate_l2e(
    df: DataFrame, sensor: str, minimum_ndrops: int = 1, minimum_nbins: int = 1, minimum_rain_rate: float = 0.01, minimum_diameter: float = 0.0, maximum_diameter: float = 10.0,
    minimum_velocity: float = 0.0, maximum_velocity: float = 12.0, keep_mixed: bool = False, model: str = "Beard1976", above_fraction: float | None = 0.5, above_tolerance: float | None = None,
    below_fraction: float | None = 0.5, below_tolerance: float | None = None, keep_smallest: bool = True, remove_splashes: bool = True, air: Environment | None = None, spectra: bool = False,
    partial_edges: Sequence[float] | None = None, methods: Sequence[str] = (THEORETICAL, MEASURED),
) -> DataFrame:
    """One row per time and velocity_method of ``methods`` with N(D) and its integral parameters.

    Rows whose precipitation is neither none nor rain go (``keep_mixed`` keeps type 4, which no row has,
    as in use). Sensors without velocity give theoretical rows only. ``source`` of the energies is told by
    their suffix: _drops of counted drops, none of N(D).
    """
    require(df, ("raw_drop_number", "sample_interval"))
    if "precipitation_type" in df.columns:
        df = df.where(F.col("precipitation_type").isin(*([-1, 0, 4] if keep_mixed else [-1, 0])))
    all_d, all_v = sensors.diameter_bins(sensor), sensors.velocity_bins(sensor)
    ds = kept_bins(all_d, minimum_diameter, maximum_diameter)
    d = _cut(all_d, ds)
    air = air or Environment()
    speed = np.nan_to_num(V.rain_speed(d.center, model, air))
    diameter, width = sensors.literal(d.center), sensors.literal(d.width)
    area = sensors.effective_sampling_area(sensor, d.center / 1000)
    interval = F.col("sample_interval") * F.lit(sensors.effective_interval_factor(sensor))
    if all_v is not None:
        vs = kept_bins(all_v, minimum_velocity, maximum_velocity)
        v = _cut(all_v, vs)
        n_v = len(all_v)
        cells = [i * n_v + j for i in ds for j in vs]
        raw = F.col("raw_drop_number") if len(cells) == len(all_d) * n_v else select_bins(F.col("raw_drop_number"), cells)
        mask = classification.rain_mask(d, v, air, above_fraction, above_tolerance, below_fraction, below_tolerance, keep_smallest, model=model)
        kind = F.col("precipitation_type") if "precipitation_type" in df.columns else None
        splash = F.col("flag_splashing") if remove_splashes and "flag_splashing" in df.columns else None
        df = staged(df, {"_raw": raw})
        df = df.withColumn("drop_number", classification.drop_spectrum(F.col("_raw"), mask, kind, splash, classification.splash_mask(d, v)))
        over = np.kron(np.eye(len(d)), np.ones(len(v)))
        # Counts, flux by measured speeds, and kinetic energies by either speed: one product over the drops.
        weight = (math.pi / 12 * S.WATER_DENSITY * 1e-9) * d.center**3 / area
        energies = np.stack([np.repeat(weight * speed**2, len(v)), np.outer(weight, v.center**2).ravel()])
        sums = A.linear(F.col("drop_number"), np.concatenate([over, np.kron(np.diag(1 / (area * d.width)), 1 / v.center), energies]))
        df = staged(df, {"_sums": sums, "raw_drop_counts": A.linear(F.col("_raw"), over)}).drop("_raw")
        n = len(d)
        df = staged(df, {"drop_counts": F.slice("_sums", 1, n), "_flux": F.slice("_sums", n + 1, n), "_energy": F.slice("_sums", 2 * n + 1, 2)}).drop("_sums")
    else:
        picked = select_bins(F.col("raw_drop_number"), ds)
        df = df.withColumn("drop_number", picked).withColumns({"drop_counts": F.col("drop_number"), "raw_drop_counts": F.col("drop_number")})
    counts = F.col("drop_counts")
    df = staged(df, {"Dmin": S.min_diameter(counts, diameter), "Dmax": S.max_diameter(counts, diameter), "N": A.total(counts), "Nraw": A.total(F.col("raw_drop_counts"))} | S.bin_metrics(counts))
    df = with_bins(with_drops(df.withColumn("Nremoved", F.col("Nraw") - F.col("N")), minimum_ndrops), minimum_nbins)
    area_column = sensors.literal(area)
    theoretical = S.number_concentration(counts, sensors.literal(speed), width, area_column, interval)
    forms = {THEORETICAL: theoretical}
    if all_v is not None:
        forms[MEASURED] = F.transform("_flux", lambda x: x / interval)
    wanted = [F.struct(F.lit(m).alias("velocity_method"), c.alias("drop_number_concentration")) for m, c in forms.items() if m in methods]
    df = df.select("*", F.inline(F.array(*wanted))).withColumns({"fall_velocity": sensors.literal(speed), "Rm": S.rain_rate_from_counts(counts, area_column, diameter, interval)})
    df = df.withColumn("Pm", S.rain_accumulation(F.col("Rm"), interval))
    df = S.integral_parameters(df, "drop_number_concentration", speed, d.center, d.width, interval)
    if all_v is not None:
        energy = F.when(F.col("velocity_method") == MEASURED, F.col("_energy")[1]).otherwise(F.col("_energy")[0])
        energies = S.energy_variables(energy, F.col("Rm"), interval)
        df = df.withColumns({f"{n}_drops": e for n, e in zip(("TKE", "KEF", "KED"), energies)}).drop("_energy", "_flux")
    if partial_edges is not None:
        df = df.withColumns(S.partial_number_concentrations(F.col("drop_number_concentration"), d.lower, d.upper, partial_edges))
    if spectra:
        df = df.withColumns(S.spectrum_parameters(F.col("drop_number_concentration"), sensors.literal(speed), diameter, interval))
    return with_rain(df, minimum_rain_rate)


def generate_l2m(
    df: DataFrame, model: str = "NormalizedGammaD50NwPSD", optimization: str | None = None, bins: Bins | None = None, sensor: str | None = None, keys: Sequence[str] = ("station_id", "time"),
    diameter_min: float = 0.0, diameter_max: float = 10.0, diameter_spacing: float = 0.05, fall_model: str = "Beard1976", minimum_ndrops: int = 1, minimum_nbins: int = 3, minimum_rain_rate: float = 0.01,
    with_goodness: bool = True, air: Environment | None = None, **settings: Any,
) -> DataFrame:
    """Fitted parameters, the fitted N(D) on a regular grid with its integral parameters, and its goodness.

    ``bins`` are those of the spectra, by default the sensor's up to 10 mm. Rows that no fit meets go with
    the minimum rain rate.
    """
    if bins is None:
        if sensor is None:
            raise ValueError("give the bins or the sensor")
        every = sensors.diameter_bins(sensor)
        bins = _cut(every, kept_bins(every, 0.0, 10.0))
    optimization = optimization or ("GS" if model.startswith("Normalized") else "ML" if model != "GeneralizedGammaPSD" else "GS")
    air = air or Environment()
    if "N" in df.columns:
        df = with_drops(df, minimum_ndrops)
    if "Nbins" not in df.columns:
        df = df.withColumns(S.bin_metrics(F.col("drop_number_concentration")))
    df = with_bins(df, minimum_nbins)
    speed = np.nan_to_num(V.rain_speed(bins.center, fall_model, air))
    parameters = fitting.estimate(df, model, optimization, bins.center, bins.width, speed, keys=keys, **settings)
    chosen = psd.model(model)
    df = df.select(*keys, "drop_number_concentration", "sample_interval", *[c for c in ("N", "Nbins", "Dmin", "Dmax", "qc_time", "qc_resampling") if c in df.columns])
    df = df.withColumnRenamed("drop_number_concentration", "_observed").join(parameters, list(keys))
    grid = regular_bins(diameter_min, diameter_max, diameter_spacing)
    centers = sensors.literal(grid.center)
    values = {p: F.col(p) for p in chosen.parameters}
    df = staged(df, {"drop_number_concentration": chosen.values(centers, values)})
    grid_speed = np.nan_to_num(V.rain_speed(grid.center, fall_model, air))
    df = df.withColumnsRenamed({p: f"psd_{p}" for p in chosen.parameters})
    df = S.integral_parameters(df, "drop_number_concentration", grid_speed, grid.center, grid.width, F.col("sample_interval"))
    if with_goodness:
        fitted = {p: F.col(f"psd_{p}") for p in chosen.parameters}
        df = staged(df, {"_fitted": chosen.values(sensors.literal(bins.center), fitted)})
        df = goodness.goodness(df, "_observed", "_fitted", sensors.literal(bins.center), sensors.literal(bins.width)).drop("_fitted")
    return with_rain(df.drop("_observed"), minimum_rain_rate)


def summary_rows(df: DataFrame, velocity_method: str = THEORETICAL, minimum_rain_rate: float = 0.0) -> DataFrame:
    """L2E rows for station summaries: one velocity method, rain above the minimum, enough and close bins."""
    chosen = df.where(F.col("velocity_method") == velocity_method) if "velocity_method" in df.columns else df
    known = chosen.where(~F.isnan("R") & (F.col("R") > minimum_rain_rate))
    quality = (F.col("Nbins") >= 3) & (F.col("sigma_m") >= 0.2) & (F.col("Nbins_missing_fraction") <= 0.3) & (F.col("Dmin") <= 1) & (F.col("R") > 0.01)
    return known.where(quality)
