"""From counts per bin to integral parameters: expressions over arrays of bins.

Diameters are arrays in mm, bin widths in mm, speeds in m/s, areas in m2, intervals in s. Concentrations
are in 1/m3/mm. A row whose spectrum holds NaN has NaN results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions.backend import ops
from rainloom.session import staged

WATER_DENSITY = 1000.0
#: Least reflectivity in dBZ.
LEAST_DBZ = -60.0
#: Edges in mm of the partial number concentrations.
PARTIAL_EDGES = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)


def _safe(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), A.nan())


def _decibel(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), 10 * F.log10(x)).otherwise(A.nan())


def number_concentration(counts: Column, velocity: Column, width: Column, area: Column, interval: Column) -> Column:
    """N(D) of counts and speeds per diameter bin; a speed of 0 or NaN adds nothing."""
    flux = F.zip_with(counts, velocity, lambda n, v: F.when((v > 0) & ~F.isnan(v), n / v).otherwise(F.when(F.isnan(n), n).otherwise(0.0)))
    return F.zip_with(flux, A.times(width, area), lambda x, wa: x / (wa * interval))


def number_concentration_2d(spectrum: Column, velocity: Column, width: Column, area: Column, interval: Column, n_velocity: int) -> Column:
    """N(D) of a flat diameter-major spectrum; ``velocity`` has one entry per bin of the spectrum."""
    flux = F.zip_with(spectrum, velocity, lambda n, v: F.when((v > 0) & ~F.isnan(v), n / v).otherwise(F.when(F.isnan(n), n).otherwise(0.0)))
    return F.zip_with(A.over_velocity(flux, n_velocity), A.times(width, area), lambda x, wa: x / (wa * interval))


def counts_from_concentration(nd: Column, velocity: Column, width: Column, area: Column, interval: Column) -> Column:
    return F.transform(A.times(nd, velocity, width, area), lambda x: x * interval)


def total_number_concentration(nd: Column, width: Column) -> Column:
    return A.dot(nd, width)


def moment(nd: Column, diameter: Column, width: Column, order: float) -> Column:
    """mm^order / m3."""
    return A.dot(nd, A.powers(diameter, order), width) if order else A.dot(nd, width)


def rain_rate(nd: Column, velocity: Column, diameter: Column, width: Column) -> Column:
    """mm/h of a concentration."""
    return A.dot(nd, velocity, A.powers(diameter, 3), width) * (6 * math.pi * 1e-4)


def rain_rate_from_counts(counts: Column, area: Column, diameter: Column, interval: Column) -> Column:
    """mm/h of counted drops per diameter bin."""
    volume = F.zip_with(A.times(counts, A.powers(diameter, 3)), area, lambda x, a: x / a)
    return A.total(volume) * (math.pi / 6 * 1e-9 * 3.6e6) / interval


def rain_rate_spectrum(nd: Column, velocity: Column, diameter: Column) -> Column:
    return F.transform(A.times(nd, velocity, A.powers(diameter, 3)), lambda x: x * (6 * math.pi * 1e-4))


def rain_rate_contribution(nd: Column, velocity: Column, diameter: Column, width: Column) -> Column:
    """Per cent of the rain rate per bin."""
    parts = A.times(rain_rate_spectrum(nd, velocity, diameter), width)
    whole = A.total(parts)
    return F.transform(parts, lambda x: _safe(x * 100, whole))


def rain_accumulation(rate: Column, interval: Column) -> Column:
    """mm."""
    return rate * interval / 3600.0


def reflectivity(nd: Column, diameter: Column, width: Column) -> Column:
    """dBZ; NaN without drops, at least LEAST_DBZ."""
    z = _decibel(moment(nd, diameter, width, 6))
    return F.when(F.isnan(z), z).otherwise(F.greatest(z, F.lit(LEAST_DBZ)))


def reflectivity_spectrum(nd: Column, diameter: Column) -> Column:
    def one(x: Column) -> Column:
        z = _decibel(x)
        return F.when(F.isnan(z), z).otherwise(F.greatest(z, F.lit(LEAST_DBZ)))

    return F.transform(A.times(nd, A.powers(diameter, 6)), one)


def liquid_water_spectrum(nd: Column, diameter: Column, density: float = WATER_DENSITY) -> Column:
    return F.transform(A.times(nd, A.powers(diameter, 3)), lambda x: x * (math.pi / 6 * density * 1e-6))


def liquid_water_content(nd: Column, diameter: Column, width: Column, density: float = WATER_DENSITY) -> Column:
    """g/m3."""
    return liquid_water_content_from_moment(moment(nd, diameter, width, 3), density)


def liquid_water_content_from_moment(m3: Column, density: float = WATER_DENSITY) -> Column:
    return m3 * (math.pi / 6 * density * 1e-6)


def min_diameter(counts: Column, diameter: Column) -> Column:
    first = A.first_true(F.transform(counts, lambda x: (x > 0) & ~F.isnan(x)))
    return F.coalesce(F.try_element_at(diameter, F.when(first > 0, first)), A.nan())


def max_diameter(counts: Column, diameter: Column) -> Column:
    last = A.last_true(F.transform(counts, lambda x: (x > 0) & ~F.isnan(x)))
    return F.coalesce(F.try_element_at(diameter, F.when(last > 0, last)), A.nan())


def mode_diameter(nd: Column, diameter: Column) -> Column:
    """Diameter of the first highest bin; NaN of a spectrum that is all zero or NaN."""
    known = F.transform(nd, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    top = F.array_max(known)
    position = F.array_position(known, top).cast("int")
    return F.when((top > 0) & (position > 0), F.try_element_at(diameter, F.when(position > 0, position))).otherwise(A.nan())


def mean_volume_diameter(m3: Column, m4: Column) -> Column:
    return _safe(m4, m3)


def std_volume_diameter(m3: Column, m4: Column, m5: Column) -> Column:
    """Width of the mass spectrum; a variance below 1e-5 is 0."""
    variance = _safe(m3 * m5 - m4 * m4, m3 * m3)
    return F.when(F.isnan(variance), variance).when(variance < 1e-5, 0.0).otherwise(F.sqrt(variance))


def volume_quantiles(nd: Column, diameter: Column, width: Column, fractions: Sequence[float]) -> list[Column]:
    """Diameters at which the cumulated water reaches each fraction, interpolated between bin centres.

    With all water in one bin the diameter lies at the fraction of that bin's width; without water NaN.
    """
    water = A.times(nd, A.powers(diameter, 3), width)
    return [_volume_quantile(water, diameter, width, f) for f in fractions]


def _volume_quantile(water: Column, diameter: Column, width: Column, fraction: float) -> Column:
    # One pass gathers the cumulated water; the rest reads positions of it.
    def finish(cum: Column) -> Column:
        whole = F.element_at(cum, -1)
        target = whole * fraction
        upper = A.first_true(F.transform(cum, lambda x: x >= target))
        lower = F.greatest(A.last_true(F.transform(cum, lambda x: x <= target)), F.lit(1))
        single = F.size(F.filter(water, lambda x: x > 0)) == 1
        bin_ = A.first_true(F.transform(water, lambda x: x > 0))
        at = lambda a, i: F.try_element_at(a, F.when(i > 0, i))
        d0, d1, c0, c1 = at(diameter, lower), at(diameter, upper), at(cum, lower), at(cum, upper)
        between = F.when(lower == upper, d0).otherwise(d0 + (d1 - d0) * _safe(target - c0, c1 - c0))
        inside = at(diameter, bin_) - at(width, bin_) / 2 + at(width, bin_) * fraction
        return F.when(F.isnan(whole) | ~(whole > 0), A.nan()).when(single, inside).otherwise(between)

    start = F.array().cast("array<double>")
    return F.aggregate(water, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)), finish)


def median_volume_diameter(nd: Column, diameter: Column, width: Column) -> Column:
    return volume_quantiles(nd, diameter, width, (0.5,))[0]


def normalized_intercept(lwc: Column, dm: Column, density: float = WATER_DENSITY) -> Column:
    """Nw in 1/m3/mm of water content in g/m3 and mean diameter in mm."""
    return _safe(lwc * (256.0 / (math.pi * density) * 1e6), F.pow(dm, F.lit(4.0)))


def normalized_intercept_from_moments(m3: Column, m4: Column) -> Column:
    return _safe(F.pow(m3, F.lit(5.0)) * (256.0 / 6.0), F.pow(m4, F.lit(4.0)))


def kinetic_energy_spectrum(nd: Column, velocity: Column, diameter: Column, interval: Column, density: float = WATER_DENSITY) -> Column:
    return F.transform(A.times(nd, A.powers(diameter, 3), A.powers(velocity, 3)), lambda x: x * interval * (math.pi / 12 * density * 1e-9))


def kinetic_energy(nd: Column, velocity: Column, diameter: Column, width: Column, interval: Column, density: float = WATER_DENSITY) -> tuple[Column, Column, Column]:
    """Total energy in J/m2, energy flux in J/m2/h and energy density in J/m2/mm."""
    energy = A.dot(nd, A.powers(diameter, 3), A.powers(velocity, 3), width) * interval * (math.pi / 12 * density * 1e-9)
    return energy_variables(energy, rain_rate(nd, velocity, diameter, width), interval)


def kinetic_energy_from_counts(counts: Column, velocity: Column, area: Column, diameter: Column, interval: Column, density: float = WATER_DENSITY) -> tuple[Column, Column, Column]:
    """As kinetic_energy, of counted drops; all arrays have one entry per counted bin."""
    parts = F.zip_with(A.times(counts, A.powers(diameter, 3), A.powers(velocity, 2)), area, lambda x, a: x / a)
    energy = A.total(parts) * (math.pi / 12 * density * 1e-9)
    return energy_variables(energy, rain_rate_from_counts(counts, area, diameter, interval), interval)


def energy_variables(energy: Column, rate: Column, interval: Column) -> tuple[Column, Column, Column]:
    flux = energy / interval * 3600.0
    return energy, flux, F.when(rate == 0, 0.0).otherwise(_safe(flux, rate))


def average_velocity(spectrum: Column, velocity: Column, n_velocity: int) -> Column:
    """Mean measured speed per diameter bin of a flat spectrum; NaN where nothing was counted."""
    moving, counted = A.over_velocity(A.times(spectrum, velocity), n_velocity), A.over_velocity(spectrum, n_velocity)
    return F.zip_with(moving, counted, _safe)


def bins_with_drops(counts: Column) -> Column:
    return F.size(F.filter(counts, lambda x: (x > 0) & ~F.isnan(x)))


def bin_metrics(counts: Column) -> dict[str, Column]:
    """Nbins, and missing bins between the first and last filled one: number, share, longest run.

    A spectrum without drops has no bins, all missing, a share of 1.
    """
    filled = F.transform(counts, lambda x: (x != 0) & ~F.isnan(x))
    first, last = A.first_true(filled), A.last_true(filled)
    inner = F.when(first > 0, F.slice(filled, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(1))))
    n, span = F.size(F.filter(filled, lambda x: x)), last - first + 1
    size = F.size(counts)
    missing = F.when(first > 0, span - n).otherwise(size)
    return {
        "Nbins": n,
        "Nbins_missing": missing,
        "Nbins_missing_fraction": F.when(first > 0, _safe((span - n).cast("double"), span.cast("double"))).otherwise(1.0),
        "Nbins_missing_consecutive": F.when(first > 0, A.longest_run(F.transform(inner, lambda x: ~x))).otherwise(size),
    }


def stratiform_or_convective(dm: Column, nw: Column) -> Column:
    """2 convective, 1 stratiform, 0 where Dm or Nw is no positive number."""
    valid = (dm > 0) & (nw > 0) & ~F.isnan(dm) & ~F.isnan(nw)
    return F.when(~valid, 0).when(F.log10(nw) > 6.3 - 1.6 * dm, 2).otherwise(1)


def drop_volume(diameter):
    return math.pi / 6 * ops(diameter).power(diameter, 3)


def integral_parameters(df: DataFrame, nd: str, velocity: np.ndarray, diameter: np.ndarray, width: np.ndarray, interval: Column, density: float = WATER_DENSITY) -> DataFrame:
    """Adds Nt, R, P, M0..M6, LWC, Z, Dmode, Dm, sigma_m, Nw, D10, D50, D90, TKE, KEF, KED.

    All sums over the bins are one matrix product; what follows from them is a second step.
    """
    n = F.col(nd)
    d, w, still = np.asarray(diameter, float), np.asarray(width, float), np.nan_to_num(np.asarray(velocity, float))
    rows = [d**k * w for k in range(7)] + [still * d**3 * w * (6 * math.pi * 1e-4), d**3 * still**3 * w * (math.pi / 12 * density * 1e-9)]
    df = df.withColumn("_sums", A.linear(n, np.stack(rows)))
    centers = F.expr("array(" + ", ".join(f"{x!r}D" for x in d.tolist()) + ")")
    widths = F.expr("array(" + ", ".join(f"{x!r}D" for x in w.tolist()) + ")")
    parts = {f"M{k}": F.col("_sums")[k] for k in range(7)} | {"R": F.col("_sums")[7], "TKE": F.col("_sums")[8] * interval, "Dmode": mode_diameter(n, centers)}
    parts |= dict(zip(("D10", "D50", "D90"), volume_quantiles(n, centers, widths, (0.1, 0.5, 0.9))))
    df = staged(df, parts).drop("_sums")
    m = {k: F.col(f"M{k}") for k in range(7)}
    z = _decibel(m[6])
    _, flux, per_mm = energy_variables(F.col("TKE"), F.col("R"), interval)
    return df.withColumns(
        {
            "Nt": m[0],
            "P": rain_accumulation(F.col("R"), interval),
            "LWC": liquid_water_content_from_moment(m[3], density),
            "Z": F.when(F.isnan(z), z).otherwise(F.greatest(z, F.lit(LEAST_DBZ))),
            "Dm": mean_volume_diameter(m[3], m[4]),
            "sigma_m": std_volume_diameter(m[3], m[4], m[5]),
            "Nw": normalized_intercept_from_moments(m[3], m[4]),
            "KEF": flux,
            "KED": per_mm,
        }
    )


def spectrum_parameters(nd: Column, velocity: Column, diameter: Column, interval: Column, density: float = WATER_DENSITY) -> dict[str, Column]:
    """The spectra of kinetic energy, rain rate, water content and reflectivity."""
    return {
        "KE_spectrum": kinetic_energy_spectrum(nd, velocity, diameter, interval, density),
        "R_spectrum": rain_rate_spectrum(nd, velocity, diameter),
        "LWC_spectrum": liquid_water_spectrum(nd, diameter, density),
        "Z_spectrum": reflectivity_spectrum(nd, diameter),
    }


def overlap_weights(lower: np.ndarray, upper: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    """Length of each source bin (columns) within each target bin (rows)."""
    edges = np.asarray(edges, float)
    return np.clip(np.minimum(upper[None, :], edges[1:, None]) - np.maximum(lower[None, :], edges[:-1, None]), 0, None)


def partial_name(low: float, high: float) -> str:
    return "N_" + "_".join(f"{x:.1f}".replace(".", "p") for x in (low, high))


def partial_number_concentrations(nd: Column, lower: np.ndarray, upper: np.ndarray, edges: Sequence[float] = PARTIAL_EDGES) -> dict[str, Column]:
    """Drops per m3 in diameter intervals, by conservative remapping; one column per interval."""
    weights = overlap_weights(lower, upper, edges)
    return {partial_name(a, b): A.dot(nd, F.array(*[F.lit(float(w)) for w in row])) for a, b, row in zip(edges[:-1], edges[1:], weights)}


def partial_number_concentration(nd: Column, lower: np.ndarray, upper: np.ndarray, minimum: float = 0.0, maximum: float | None = None) -> Column:
    return next(iter(partial_number_concentrations(nd, lower, upper, (minimum, float(upper[-1]) if maximum is None else maximum)).values()))


_PARTIAL = re.compile(r"^N_(\d+p\d+)_(\d+p\d+)$")


def partial_columns(columns: Sequence[str]) -> list[tuple[str, float, float]]:
    """Columns that hold partial concentrations, with their interval, by its centre."""
    found = [(c, *(float(x.replace("p", ".")) for x in m.groups())) for c in columns if (m := _PARTIAL.match(c))]
    return sorted(found, key=lambda f: f[1] + f[2])


def concentration_from_partials(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse: keys, diameter (centre), width and concentration, one row per interval."""
    parts = partial_columns(df.columns)
    structs = [F.struct(F.lit((a + b) / 2).alias("diameter"), F.lit(b - a).alias("width"), (F.col(c) / (b - a)).alias("drop_number_concentration")) for c, a, b in parts]
    return df.select(*keys, F.inline(F.array(*structs)))
