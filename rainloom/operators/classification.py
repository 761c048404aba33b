"""Classification of particle spectra by masks over diameter and velocity, weather codes and temperature."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.functions import fall_velocity as V
from rainloom.functions import spectrum as S
from rainloom.functions.physics import Environment
from rainloom.operators import events
from rainloom.sensors import Bins
from rainloom.session import staged

# Hydrometeor class by present weather code.
SYNOP_4677 = {
    -2: -2, -1: -1, 0: 0, 51: 1, 53: 1, 55: 1, 58: 2, 59: 2, 61: 3, 63: 3, 65: 3, 68: 4, 69: 4, 71: 5, 73: 5, 75: 5, 77: 6, 87: 7, 88: 7, 89: 9, 90: 9,
}
SYNOP_4680 = {
    -2: -2, -1: -1, 0: 0, 51: 1, 52: 1, 53: 1, 57: 2, 58: 2, 61: 3, 62: 3, 63: 3, 67: 4, 68: 4, 71: 5, 72: 5, 73: 5, 77: 6, 74: 7, 75: 7, 76: 7, 89: 9, 90: 9,
}
METAR_4678 = {
    "NP": 0, "-DZ": 1, "DZ": 1, "+DZ": 1, "-RADZ": 2, "RADZ": 2, "+RADZ": 2, "-RA": 3, "RA": 3, "+RA": 3, "-RASN": 4, "RASN": 4, "+RASN": 4, "-SN": 5,
    "SN": 5, "+SN": 5, "SG": 6, "-PL": 7, "PL": 7, "+PL": 7, "-GS": 8, "GS": 8, "+GS": 8, "-GR": 9, "GR": 9,
}
NWS = {
    "C": 0, "L-": 1, "L": 1, "L+": 1, "RL-": 2, "RL": 2, "RL+": 2, "R-": 3, "R": 3, "R+": 3, "RLS-": 4, "RLS": 4, "RLS+": 4, "S-": 5, "S": 5, "S+": 5,
    "SG": 6, "IP": 7, "SP": 8, "A": 9,
}
WEATHER_CODES = {"weather_code_synop_4677": SYNOP_4677, "weather_code_synop_4680": SYNOP_4680, "weather_code_metar_4678": METAR_4678, "weather_code_nws": NWS}
# Precipitation type by hydrometeor class and by the flag of one sensor; snow limit by temperature source.
PRECIPITATION_TYPE = {0: -1, 1: 0, 2: 0, 3: 0, 9: 0, 5: 1, 6: 1, 7: 1, 8: 1, 4: 2}
PRECIP_FLAG_TYPE = {0: 0, 1: 1, 2: 2, -1: -1, 4: -2, 5: -2}
SNOW_LIMITS = {"air_temperature": 6, "air_temperature_min": 6, "temperature_ambient": 6, "temperature_interior": 10, "sensor_temperature": 15}


def mapped(value: Column, table: dict, default: Column | None = None) -> Column:
    """A value looked up in a literal map; ``default`` (NaN) where the map has none."""
    text = isinstance(next(iter(table)), str)
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k) if text else F.lit(float(k)), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(entries, value if text else value.cast("double")), A.nan() if default is None else default)


def hydrometeor_of_code(code: Column, kind: str) -> Column:
    """Hydrometeor class of a weather code; ``kind`` is its column's name, with or without _5min."""
    name = kind.removesuffix("_5min")
    if name not in WEATHER_CODES:
        raise ValueError(f"{kind} is no weather code; known are {', '.join(WEATHER_CODES)}")
    return mapped(code, WEATHER_CODES[name])


def precipitation_type(hydrometeor: Column) -> Column:
    """-1 none, 0 rain, 1 snow, 2 mixed, -2 undefined."""
    return mapped(hydrometeor, PRECIPITATION_TYPE, F.lit(-2.0))


def precipitation_type_of_flag(flag: Column) -> Column:
    return mapped(flag, PRECIP_FLAG_TYPE)


def best_temperature(df: DataFrame) -> tuple[Column, Column] | None:
    """The first known temperature of the sources by priority, and its snow limit.

    Values outside -40..35 are unknown; where the sources differ by over 10 degrees none counts (NaN).
    """
    found = [c for c in SNOW_LIMITS if c in df.columns]
    if not found:
        return None
    known = {c: F.when(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).between(-40, 35), F.col(c).cast("double")) for c in found}
    spread = (F.greatest(*known.values()) - F.least(*known.values())) if len(found) > 1 else F.lit(0.0)
    apart = F.coalesce(spread > 10, F.lit(False))
    value = F.coalesce(*known.values(), A.nan())
    limit = F.coalesce(*[F.when(v.isNotNull(), F.lit(float(SNOW_LIMITS[c]))) for c, v in known.items()], A.nan())
    return F.when(apart, A.nan()).otherwise(value), F.when(apart, A.nan()).otherwise(limit)


# --- masks over (diameter, velocity), flat and diameter-major ---------------------------------------------


def _cells(d: Bins, v: Bins) -> dict[str, np.ndarray]:
    one_d, one_v = np.ones(len(d)), np.ones(len(v))
    return {"d_lower": np.outer(d.lower, one_v), "d_upper": np.outer(d.upper, one_v), "v_lower": np.outer(one_d, v.lower), "v_upper": np.outer(one_d, v.upper)}


def _beside(values: np.ndarray, v: Bins) -> np.ndarray:
    return np.outer(np.asarray(values, float), np.ones(len(v)))


def rain_mask(
    d: Bins, v: Bins, air: Environment | None = None, above_fraction: float | None = None, above_tolerance: float | None = None, below_fraction: float | None = None,
    below_tolerance: float | None = None, keep_smallest: bool = False, smaller_than: float = 1.0, slower_than: float = 2.5, model: str = "Beard1976",
) -> np.ndarray:
    """Cells that raindrops of a bin can reach; give either a fraction or a tolerance for each side."""
    if (above_fraction is not None and above_tolerance is not None) or (below_fraction is not None and below_tolerance is not None):
        raise ValueError("give either a fraction or a tolerance")
    air = air or Environment()
    c = _cells(d, v)
    upper, lower = (_beside(V.rain_speed(edge, model, air), v) for edge in (d.upper, d.lower))
    above = upper * (1 + above_fraction) if above_fraction is not None else upper + above_tolerance if above_tolerance is not None else np.full_like(upper, np.inf)
    below = lower * (1 - below_fraction) if below_fraction is not None else lower - below_tolerance if below_tolerance is not None else np.zeros_like(lower)
    with np.errstate(invalid="ignore"):
        mask = (c["v_upper"] > below) & (c["v_lower"] < above)
    return mask | ((c["d_upper"] <= smaller_than) & (c["v_upper"] <= slower_than)) if keep_smallest else mask


def margin_faller_mask(d: Bins, v: Bins, air: Environment | None = None, fraction: float | None = None, tolerance: float = 2.0) -> np.ndarray:
    """Small drops faster than rain: they crossed the beam at its margin."""
    c, speed = _cells(d, v), _beside(V.rain_speed(d.upper, "Beard1976", air or Environment()), v)
    limit = speed * (1 + fraction) if fraction is not None else speed + tolerance
    with np.errstate(invalid="ignore"):
        return (c["d_upper"] <= 5) & (c["v_lower"] >= limit)


def strong_wind_mask(d: Bins, v: Bins) -> np.ndarray:
    c = _cells(d, v)
    return (c["d_lower"] >= 5) & (c["v_upper"] < 1)


def splash_mask(d: Bins, v: Bins) -> np.ndarray:
    c = _cells(d, v)
    return (c["d_lower"] >= 0) & (c["d_upper"] <= 6) & (c["v_upper"] <= 0.6)


def hail_mask(d: Bins, v: Bins, air: Environment | None = None, minimum_diameter: float = 5.0) -> np.ndarray:
    c, air = _cells(d, v), air or Environment()
    slow = _beside(V.hail_speed(d.lower, "Heymsfield2018", air, minimum_diameter - 1), v)
    fast = _beside(V.hail_speed(d.upper, "Laurie1960", air, minimum_diameter - 1), v)
    with np.errstate(invalid="ignore"):
        return (c["d_lower"] >= minimum_diameter) & (c["v_lower"] >= slow) & (c["v_upper"] <= fast)


def graupel_mask(d: Bins, v: Bins, air: Environment | None = None, minimum_diameter: float = 0.5, maximum_diameter: float = 5.0, minimum_density: float = 50.0, maximum_density: float = 600.0) -> np.ndarray:
    c, air = _cells(d, v), air or Environment()
    of = lambda edge, density: _beside(V.graupel_density_speed(edge, density, air.air_density, air.air_viscosity), v)
    with np.errstate(invalid="ignore"):
        return (c["d_lower"] >= minimum_diameter) & (c["d_upper"] <= maximum_diameter) & (c["v_lower"] >= of(d.lower, minimum_density)) & (c["v_upper"] <= of(d.upper, maximum_density))


def mask_boundary(mask: np.ndarray) -> np.ndarray:
    """Cells of a mask with a neighbour outside it, diameter by velocity."""
    padded = np.pad(np.asarray(mask, bool), 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    return np.asarray(mask, bool) & ~inner


def mask_table(df: DataFrame, masks: dict[str, np.ndarray]) -> DataFrame:
    """Masks as a dimension table: d, v and one boolean column per mask; for joins on exploded bins."""
    n_d, n_v = next(iter(masks.values())).shape
    rows = [(i, j, *[bool(m[i, j]) for m in masks.values()]) for i in range(n_d) for j in range(n_v)]
    return df.sparkSession.createDataFrame(rows, "d int, v int, " + ", ".join(f"`{n}` boolean" for n in masks))


@lru_cache(maxsize=None)
def _kept(sensor: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Diameter and velocity bins that the classification uses: noisy smallest bins are left out."""
    d, v = sensors.diameter_bins(sensor), sensors.velocity_bins(sensor)
    least = {"LPM": (0.375, 0.2), "PWS100": (0.2, 0.2), "PARSIVEL": (0.2495, None), "PARSIVEL2": (0.2495, None)}.get(sensor, (None, None))
    ds = [i for i in range(len(d)) if least[0] is None or d.upper[i] > least[0]]
    vs = [i for i in range(len(v)) if least[1] is None or v.upper[i] > least[1]]
    return tuple(ds), tuple(vs)


def _sub(bins: Bins, keep) -> Bins:
    keep = list(keep)
    return Bins(bins.lower[keep], bins.upper[keep], bins.center[keep], bins.width[keep])


@lru_cache(maxsize=None)
def class_masks(sensor: str) -> tuple[dict[str, np.ndarray], Bins, Bins]:
    """The masks of the classification over the bins used, by name."""
    ds, vs = _kept(sensor)
    d, v = _sub(sensors.diameter_bins(sensor), ds), _sub(sensors.velocity_bins(sensor), vs)
    c = _cells(d, v)
    liquid = rain_mask(d, v, above_tolerance=2.0, below_tolerance=3.0)
    tiny = (c["d_lower"] >= 0) & (c["d_upper"] <= 0.5)
    small = (c["d_upper"] > 0.5) & (c["d_upper"] <= 5.0)
    large, huge = (c["d_upper"] > 5.0) & (c["d_upper"] <= 8.0), c["d_upper"] > 8.0
    graupel = graupel_mask(d, v, None, 0.9, 5.5, 50, 900) & ~liquid
    dense = graupel_mask(d, v, None, 0.9, 5.5, 400, 900) & graupel
    hail = hail_mask(d, v) & ~graupel
    splash = splash_mask(d, v)
    snow = (c["v_upper"] <= 6.5) & ~liquid & ~hail & (c["d_lower"] >= 1)
    masks = {
        "drizzle": liquid & tiny,
        "drizzle_rain": liquid & small,
        "rain": liquid & large,
        "liquid_robust": liquid & ~splash,
        "small_hail": hail & large,
        "large_hail": hail & huge,
        "graupel": graupel,
        "graupel_ld": graupel & ~dense & ~splash,
        "graupel_hd": dense,
        "snow": snow,
        "snow_robust": snow & ~splash,
        "snow_large": snow & (c["d_upper"] > 5.0),
        "snow_grains": (c["v_upper"] <= 2.5) & (c["d_upper"] <= 2.2),
        "wind": strong_wind_mask(d, v),
        "margin": margin_faller_mask(d, v),
        "splash": splash,
    }
    return masks, d, v


def classify(df: DataFrame, sensor: str, spectrum: str = "raw_drop_number", interval: Column | None = None, temperature: tuple[Column, Column] | None = None, rain_limit: float = -5.0, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """Adds hydrometeor_type, precipitation_type, particle counts and flags of hail, graupel, noise, spikes, splashing, wind.

    Counts under each mask are one dot product of the flat spectrum with a literal mask; the ladder of
    classes is first-match. ``temperature`` (value, snow limit) overrides classes it excludes, unless
    it stood still for a day. Class 61 is left as it is, with an undefined precipitation type.
    """
    masks, d, v = class_masks(sensor)
    ds, vs = _kept(sensor)
    n_v = len(sensors.velocity_bins(sensor))
    interval = F.col("sample_interval") if interval is None else interval
    # The masks cover the bins used; in the whole spectrum the others weigh nothing.
    cells = np.array([i * n_v + j for i in ds for j in vs])
    full = np.zeros((len(masks) + 2, len(sensors.diameter_bins(sensor)) * n_v))
    area = sensors.effective_sampling_area(sensor, d.center / 1000)
    volume = np.outer(np.pi / 6 * 1e-9 * 3.6e6 * d.center**3 / area, np.ones(len(v))) * (masks["drizzle"] | masks["drizzle_rain"])
    for row, weights in enumerate([*masks.values(), np.ones((len(d), len(v))), volume]):
        full[row, cells] = np.asarray(weights, float).ravel()
    # Missing cells count as none in the masked sums.
    robust = full[[list(masks).index(m) for m in ("liquid_robust", "snow_robust")]]
    df = df.withColumn("_sums", A.linear(F.col(spectrum), full, skip_missing=True, filled=robust))
    names = [*[f"_n_{m}" for m in masks], "n_particles", "_rate", "_liquid_bins", "_snow_bins"]
    sums = {c: F.col("_sums")[k] for k, c in enumerate(names)}
    # Steps of their own, so that the sums are not computed again for every condition that reads them.
    df = staged(staged(df, sums).drop("_sums"), {"_rate": F.col("_rate") / interval})
    n = {name: F.col(f"_n_{name}") for name in masks}
    all_ = F.col("n_particles")
    share = lambda c: F.when(all_ == 0, 0.0).otherwise(c / all_)
    liquid = n["drizzle"] + n["drizzle_rain"] + n["rain"]
    # Without robust liquid drops the ratio is infinite, with neither it is NaN and meets no condition.
    ratio = F.when(all_ == 0, 0.0).when(n["liquid_robust"] > 0, n["snow_robust"] / F.nullif(n["liquid_robust"], F.lit(0.0))).when(n["snow_robust"] > 0, float("inf"))
    df = staged(
        df,
        {
            "_f_drizzle": share(n["drizzle"]), "_f_drizzle_rain": share(n["drizzle"] + n["drizzle_rain"]), "_f_rain": share(liquid), "_f_graupel": share(n["graupel"]), "_f_snow": share(n["snow"]),
            "_f_grains": share(n["snow_grains"]), "_f_splash": share(n["splash"]), "_ratio": ratio,
            "_bins": F.when(all_ == 0, 0.0).otherwise(F.try_divide(F.col("_liquid_bins"), F.col("_liquid_bins") + F.col("_snow_bins"))),
        }
    )
    rate, splash, solid = F.col("_rate"), F.col("_f_splash"), F.col("_ratio")
    no_ice = (n["graupel"] < 1) & (n["snow_large"] < 1)
    ladder = (
        (all_ == 0, 0),
        ((F.col("_f_graupel") > 0.7) & (n["snow_large"] < 1), 8),
        ((F.col("_f_drizzle") > 0.1) & no_ice & (n["drizzle_rain"] < 1), 1),
        ((F.col("_f_drizzle_rain") > 0.1) & no_ice & (n["rain"] < 1), 2),
        ((F.col("_f_rain") > 0.1) & no_ice, 3),
        (F.col("_f_snow") > 0.6, 5),
        ((F.col("_bins") >= 0.75) & (rate > 3), 31),
        ((solid >= 0.05) & (rate > 1) & (F.col("_snow_bins") > 6) & (splash < 0.1), 4),
        ((solid >= 0.05) & (rate > 1) & (F.col("_snow_bins") <= 6) & (splash < 0.1), 21),
        ((solid < 0.05) & (rate > 1) & (splash < 0.1), 21),
        ((splash >= 0.5) & (rate < 1.5), -2),
        ((splash >= 0.4) & (splash <= 0.5) & (rate <= 0.2), -2),
        ((rate > 1) & (splash >= 0.1) & (solid >= 0.2), 41),
        ((rate > 1) & (splash >= 0.1) & (solid < 0.2), 23),
        ((solid <= 0.05) & (n["snow_robust"] <= 2), 22),
        (F.col("_f_grains") >= 0.95, 6),
    )
    label = F.when(ladder[0][0], ladder[0][1])
    for condition, value in ladder[1:]:
        label = label.when(condition, value)
    df = staged(df, {"_label": label.otherwise(51)})
    if temperature is not None:
        df = df.withColumns({"_air": temperature[0], "_limit": temperature[1]})
        df = events.qc_temperature(df, "_air", interval, keys, 1440)
        sure = (F.col("qc_temperature") == 0) & ~F.isnan("_air")
        warm, cold = sure & (F.col("_air") >= F.col("_limit")), sure & (F.col("_air") <= rain_limit)
        c = F.col("_label")
        override = (
            F.when(warm & c.isin(4, 41), 24).when(cold & c.isin(4, 41), 52).when(cold & (c == 1), 61).when(warm & c.isin(5, 51, 6), -21)
            .when(cold & c.isin(2, 21, 22, 23, 3), -21).when(cold & (c == 8), 7).otherwise(c)
        )
        df = df.withColumn("_label", override).drop("_air", "_limit", "qc_temperature")
    c = F.col("_label")
    kind = F.when(c.isin(-2, -21), -2).when(c.isin(2, 21, 22, 23, 24), 2).when(c.isin(3, 31), 3).when(c.isin(5, 51, 52), 5).otherwise(c)
    df = staged(df, {"hydrometeor_type": kind.cast("int")})
    df = staged(df, {"precipitation_type": precipitation_type(F.col("hydrometeor_type")).cast("int")})
    rain, hydrometeor = F.col("precipitation_type") == 0, F.col("hydrometeor_type")
    graupel = hydrometeor == 8
    df = staged(
        df,
        {
            "flag_graupel": F.when((rain & (n["graupel_hd"] > 2)) | (graupel & (n["graupel_hd"] > 0)), 2).when((rain & (n["graupel_ld"] > 2)) | (graupel & (n["graupel_ld"] > 0)), 1).otherwise(0),
            "flag_hail": F.when(rain & (n["large_hail"] >= 1) & (rate > 1), 2).when(rain & (n["small_hail"] >= 1) & (rate > 1), 1).otherwise(0),
            "flag_splashing": (rain & (splash >= 0.1)).cast("int"),
            "flag_wind_artefacts": (rain & (n["wind"] >= 1)).cast("int"),
            "flag_noise": (hydrometeor == -2).cast("int"),
        }
    )
    only = lambda flag, count: F.when(flag, count).otherwise(0.0)
    df = df.withColumns(
        {
            "n_low_density_graupel": only(F.col("flag_graupel") > 0, n["graupel_ld"]), "n_high_density_graupel": only(F.col("flag_graupel") > 0, n["graupel_hd"]),
            "n_small_hail": only(F.col("flag_hail") > 0, n["small_hail"]), "n_large_hail": only(F.col("flag_hail") > 0, n["large_hail"]),
            "n_margin_fallers": only(rain, n["margin"]), "n_splashing": only(F.col("flag_splashing") == 1, n["splash"]), "n_wind_artefacts": only(F.col("flag_wind_artefacts") == 1, n["wind"]),
        }
    )
    df = df.withColumns({"fraction_splashing": share(F.col("n_splashing")), "fraction_margin_fallers": share(F.col("n_margin_fallers"))})
    df = events.precipitation_spikes(df, "hydrometeor_type", interval, keys)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def drop_spectrum(spectrum: Column, mask: np.ndarray, precipitation: Column | None = None, splashing: Column | None = None, splash: np.ndarray | None = None) -> Column:
    """The spectrum under a rain mask: zero where it does not rain, and without splashes where they are flagged."""
    clean = mask & ~splash if splash is not None else mask
    which = F.lit(1) if splashing is None or splash is None else F.when(splashing == 1, 2).otherwise(1)
    if precipitation is not None:
        which = F.when(precipitation.isin(0, 2), which).otherwise(0)
    return A.masked(spectrum, np.stack([np.zeros(mask.size), mask.ravel(), clean.ravel()]), which)


def generate_l1(df: DataFrame, sensor: str, keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """L0C to L1: counts per diameter, smallest and largest diameter, raw concentration, classification.

    A sensor without velocities has no classes; what its own flag of precipitation tells is kept.
    """
    d, v = sensors.diameter_bins(sensor), sensors.velocity_bins(sensor)
    n_v = len(v) if v else 1
    area = sensors.effective_sampling_area(sensor, d.center / 1000)
    # Counts per diameter and, for sensors with velocities, their flux: one product.
    over = np.kron(np.eye(len(d)), np.ones(n_v))
    both = A.linear(F.col("raw_drop_number"), over if v is None else np.concatenate([over, np.kron(np.diag(1 / (area * d.width)), 1 / v.center)]))
    df = staged(staged(df, {"_both": both}), {"raw_particle_counts": F.slice("_both", 1, len(d)), "_flux": F.slice("_both", len(d) + 1, len(d))}).drop("_both")
    centers = sensors.literal(d.center)
    df = df.withColumns({"Dmin": S.min_diameter(F.col("raw_particle_counts"), centers), "Dmax": S.max_diameter(F.col("raw_particle_counts"), centers)})
    if v is None:
        df = df.withColumn("n_particles", A.total(F.col("raw_drop_number"))).drop("_flux")
        return df.withColumn("precipitation_type", precipitation_type_of_flag(F.col("precip_flag"))) if "precip_flag" in df.columns else df
    df = df.withColumn("raw_particle_number_concentration", F.transform("_flux", lambda x: x / F.col("sample_interval")))
    return classify(df, sensor, temperature=best_temperature(df), keys=keys)
