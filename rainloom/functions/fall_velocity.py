"""Fall speeds of rain, graupel and hail in m/s; diameters in mm."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from rainloom.functions import physics
from rainloom.functions.backend import NAN, ops, polynomial
from rainloom.functions.physics import Environment


def _exponential(a: float, b: float, c: float) -> Callable[[Any], Any]:
    return lambda d: a - b * ops(d).exp(-c * d)


def _power_of_cm(a: float, b: float) -> Callable[[Any], Any]:
    return lambda d: a * ops(d).power(0.1 * d, b)


def _power(a: float, b: float) -> Callable[[Any], Any]:
    return lambda d: a * ops(d).power(d, b)


# Still-air fall speed models by name.
RAIN_MODELS: dict[str, Callable[[Any], Any] | None] = {
    "Atlas1973": _exponential(9.65, 10.3, 0.6),
    "Beard1976": None,  # needs the air, see beard_speed
    "Uplinger1981": lambda d: 4.874 * d * ops(d).exp(-0.195 * d),
    "Lhermitte1988": lambda d: 9.25 - 9.25 * ops(d).exp(-(0.068 * d * d + 0.488 * d)),
    "Brandes2002": lambda d: polynomial(d, (-0.1021, 4.932, -0.9551, 0.07934, -0.002362)),
    "VanDijk2002": lambda d: polynomial(d, (-0.254, 5.03, -0.912, 0.0561)),
}
GRAUPEL_MODELS: dict[str, Callable[[Any], Any]] = {
    "Lee2015": _power(1.10, 0.28),
    "Locatelli1974Lump": _power(1.3, 0.66),
    "Locatelli1974Conical": _power(1.20, 0.65),
    "Locatelli1974Hexagonal": _power(1.10, 0.57),
    "Heymsfield2014": _power_of_cm(4.88, 0.84),
    "Heymsfield2018": _power_of_cm(7.59, 0.89),
}
HAIL_MODELS: dict[str, Callable[[Any], Any]] = {
    "Laurie1960": _power_of_cm(13.95, 0.51),
    "Knight1983LD": _power_of_cm(8.445, 0.553),
    "Knight1983HD": _power_of_cm(10.58, 0.267),
    "Heymsfield2014": _power_of_cm(12.28, 0.57),
    "Heymsfield2018": _power_of_cm(8.39, 0.67),
    "Fehlmann2020": _power(3.74, 0.5),
}
# Logarithm of the Reynolds number by that of the Davies number, and of the Bond number.
_DAVIES = (-3.18657, 0.992696, -0.00153193, -0.000987059, -0.000578878, 0.0000855176, -0.00000327815)
_BOND = (-5.00015, 5.23778, -2.04914, 0.475294, -0.0542819, 0.00238449)
#: Drops above this diameter in m are deformed.
_DEFORMED_FROM = 1.07e-3


def _model(models: dict[str, Any], name: str) -> Any:
    if name not in models:
        raise ValueError(f"{name} is no fall speed model; known are {', '.join(models)}")
    return models[name]


def reynolds_number(diameter_m: Any, temperature: Any, air_density: Any, water_density: Any, gravity: Any) -> Any:
    """Of a raindrop of a diameter in m at terminal speed."""
    o = ops(diameter_m, temperature, air_density, water_density, gravity)
    buoyancy = (water_density - air_density) * gravity
    viscosity = physics.air_dynamic_viscosity(temperature)
    tension = physics.pure_water_surface_tension(temperature)
    davies = 4 / 3 * air_density * buoyancy * o.power(diameter_m, 3) / o.power(viscosity, 2)
    bond = 4 / 3 * buoyancy * o.power(diameter_m, 2) / tension
    sixth = o.log(o.power(tension, 3) * o.power(air_density, 2) / (o.power(viscosity, 4) * buoyancy)) / 6
    small = o.exp(polynomial(o.log(davies), _DAVIES))
    large = o.exp(sixth + polynomial(o.log(bond) + sixth, _BOND))
    return o.where(diameter_m < _DEFORMED_FROM, small, large)


def beard_speed(diameter: Any, air: Environment) -> Any:
    """Terminal speed of a raindrop of a diameter in mm in the given air."""
    density = air.air_density
    metres = diameter / 1000
    number = reynolds_number(metres, air.temperature, density, air.liquid_density, air.gravity)
    return number * air.air_viscosity / (metres * density)


def drag_coefficient(diameter_m: Any, air_density: Any, water_density: Any, fall_velocity: Any, gravity: Any = 9.81) -> Any:
    return 4 / 3 * (water_density - air_density) * gravity * diameter_m / (air_density * fall_velocity * fall_velocity)


def rain_speed(diameter: Any, model: str = "Beard1976", air: Environment | None = None) -> Any:
    """Fall speed of raindrops; NaN for diameters not above 0 or from 10 mm, and where a model gives no speed.

    Still-air models are corrected for the density of the air.
    """
    air = air or Environment()
    formula = _model(RAIN_MODELS, model)
    o = ops(diameter, air.altitude, air.latitude, air.temperature)
    valid = (diameter > 0) & (diameter < 10)
    safe = o.where(valid, diameter, 1.0)
    if formula is None:
        speed = beard_speed(safe, air)
    else:
        speed = formula(safe) * o.power(physics.SEA_LEVEL_AIR_DENSITY / air.air_density, 0.025 * safe + 0.375)
    return o.where(valid & (speed > 0), speed, NAN)


def _pressure_correction(air: Environment) -> Any:
    return ops(air.altitude, air.latitude, air.temperature).power(physics.SEA_LEVEL_PRESSURE / air.pressure, 0.545)


def graupel_density(diameter: Any) -> Any:
    """kg/m3."""
    return 180 * ops(diameter).power(0.1 * diameter, 0.33)


def graupel_density_speed(diameter: Any, density: Any = 500.0, air_density: Any = 1.225, air_viscosity: Any = 1.81e-5, gravity: Any = 9.81) -> Any:
    """Fall speed of graupel of a density, through the Best number."""
    o = ops(diameter, density, air_density, air_viscosity, gravity)
    metres = diameter / 1000
    best = 4 / 3 * density * gravity * air_density * o.power(metres, 3) / (air_viscosity * air_viscosity)
    number = o.where(best < 6.77e4, 0.106 * o.power(best, 0.693), 0.55 * o.power(best, 0.545))
    return o.divide(number * air_viscosity, air_density * metres)


def graupel_speed(diameter: Any, model: str, air: Environment | None = None, lower: Any = None, upper: Any = None, minimum_diameter: float = 0.5, maximum_diameter: float = 5.0) -> Any:
    """Fall speed of graupel; NaN for bins (``lower`` to ``upper``) that reach out of the given diameters."""
    air = air or Environment()
    o = ops(diameter, air.altitude, air.latitude, air.temperature)
    speed = _model(GRAUPEL_MODELS, model)(diameter) * _pressure_correction(air)
    lower, upper = diameter if lower is None else lower, diameter if upper is None else upper
    return o.where((lower >= minimum_diameter) & (upper <= maximum_diameter) & (speed > 0), speed, NAN)


def hail_speed(diameter: Any, model: str, air: Environment | None = None, minimum_diameter: float = 4.0) -> Any:
    """Fall speed of hailstones; NaN up to ``minimum_diameter``."""
    air = air or Environment()
    o = ops(diameter, air.altitude, air.latitude, air.temperature)
    speed = _model(HAIL_MODELS, model)(diameter) * _pressure_correction(air)
    return o.where((diameter > minimum_diameter) & (speed > 0), speed, NAN)
