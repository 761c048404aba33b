"""Product options in layers (global, sensor, resolution), and their validation."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from rainloom import sensors
from rainloom.functions import psd
from rainloom.functions.fall_velocity import RAIN_MODELS
from rainloom.operators.time_axis import resolution_seconds
from rainloom.sources.files import PRODUCTS

# Options of products that no layer overrides.
DEFAULTS: dict[str, dict[str, Any]] = {
    "L0C": {"archive_options": {"strategy": "time_block", "strategy_options": {"freq": "day"}, "folder_partitioning": "year/month"}},
    "L1": {"temporal_resolutions": ["1MIN"], "archive_options": {"strategy": "time_block", "strategy_options": {"freq": "day"}, "folder_partitioning": "year/month"}},
    "L2E": {
        "temporal_resolutions": ["1MIN"],
        "archive_options": {"strategy": "time_block", "strategy_options": {"freq": "month"}, "folder_partitioning": "year"},
        "product_options": {"minimum_ndrops": 1, "minimum_nbins": 1, "minimum_rain_rate": 0.01, "minimum_diameter": 0, "maximum_diameter": 10, "minimum_velocity": 0, "maximum_velocity": 12, "fall_velocity_model": "Beard1976"},
    },
    "L2M": {
        "temporal_resolutions": ["1MIN"],
        "archive_options": {"strategy": "time_block", "strategy_options": {"freq": "month"}, "folder_partitioning": "year"},
        "product_options": {"minimum_ndrops": 1, "minimum_nbins": 3, "minimum_rain_rate": 0.01, "diameter_min": 0, "diameter_max": 10, "diameter_spacing": 0.05, "fall_velocity_model": "Beard1976", "gof_metrics": True},
    },
}
FREQUENCIES = ("none", "hour", "day", "month", "quarter", "season", "year")


def merged(base: dict[str, Any], *layers: dict[str, Any] | None) -> dict[str, Any]:
    """Options with later layers over earlier ones; dictionaries merge one level down."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = out[key] | value if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def product_options(product: str, sensor: str | None = None, resolution: str | None = None, layers: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """The options of a product: its defaults, then ``layers`` by "global", sensor name and resolution."""
    if product not in PRODUCTS:
        raise ValueError(f"{product} is no product")
    layers = layers or {}
    found = merged(DEFAULTS.get(product, {}), layers.get("global"), layers.get(sensor or ""), layers.get(resolution or ""))
    errors = list(violations(product, found))
    if errors:
        raise ValueError("; ".join(errors))
    return found


def violations(product: str, options: dict[str, Any]) -> Iterable[str]:
    """What is wrong with a product's options."""
    for resolution in options.get("temporal_resolutions", []):
        try:
            resolution_seconds(resolution)
        except ValueError as e:
            yield str(e)
    archive = options.get("archive_options", {})
    if archive.get("strategy") not in (None, "time_block", "event"):
        yield f"{archive['strategy']} is no strategy"
    freq = archive.get("strategy_options", {}).get("freq")
    if archive.get("strategy") == "time_block" and freq not in FREQUENCIES:
        yield f"{freq} is no block"
    own = options.get("product_options", {})
    if own.get("fall_velocity_model", "Beard1976") not in RAIN_MODELS:
        yield f"{own['fall_velocity_model']} is no fall speed model"
    for low, high in (("minimum_diameter", "maximum_diameter"), ("minimum_velocity", "maximum_velocity"), ("diameter_min", "diameter_max")):
        if low in own and high in own and not own[low] < own[high]:
            yield f"{low} is not below {high}"
    for name, model in options.get("models", {}).items():
        if model.get("psd_model") not in psd.MODELS:
            yield f"{name}: {model.get('psd_model')} is no distribution"
        if model.get("optimization") not in (None, "MOM", "ML", "GS"):
            yield f"{name}: {model['optimization']} is no way to fit"


def is_possible(resolution: str, sample_interval: int) -> bool:
    """Whether a resolution can be made of a sample interval: a multiple of it, and not rolling over one step."""
    seconds, rolling = resolution_seconds(resolution)
    return seconds >= sample_interval and seconds % sample_interval == 0 and not (rolling and seconds == sample_interval)


def sensor_defaults(sensor: str) -> dict[str, Any]:
    """What is fixed for a sensor, as a dictionary."""
    return {"sampling_area": sensors.sampling_area(sensor), "list_order": sensors.LIST_ORDER[sensor], "list_size": sensors.list_size(sensor), "columns": sensors.columns(sensor)}
