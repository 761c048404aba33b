"""Atmosphere and water: scalar formulae, each for columns and numpy. Temperatures in kelvin, pressures in Pa."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainloom.functions.backend import ops, polynomial

SEA_LEVEL_PRESSURE = 101_325.0
DRY_AIR_GAS_CONSTANT = 287.04
LAPSE_RATE = 0.0065
SEA_LEVEL_AIR_DENSITY = 1.225

# Coefficients of the saturation pressure of vapour over water, by power of temperature
# from -2 to 4; the last is that of the logarithm.
_SATURATION = (-2991.2729, -6017.0128, 18.87643854, -0.028354721, 1.7838301e-05, -8.4150417e-10, 4.4412543e-13)
_SATURATION_LOG = 2.858487
# Density of water above freezing (numerator by power of degrees Celsius, denominator), below
# freezing, and isothermal compressibility.
_DENSITY_WARM = (999.83952, 16.945176, -0.0079870401, -4.6170461e-05, 1.0556302e-07, -2.8054253e-10)
_DENSITY_WARM_BELOW = 0.01687985
_DENSITY_COLD = (999.84, 0.086, -0.0108)
_COMPRESSIBILITY = (50.88496, 0.6163813, 0.001459187, 2.008438e-05, -5.857727e-08, 4.10411e-10)
_COMPRESSIBILITY_BELOW = 0.01967348


@dataclass(frozen=True)
class Environment:
    """The air around a sensor; each entry a number or a column."""

    latitude: Any = 46.159346
    longitude: Any = 8.774586
    altitude: Any = 0.0
    temperature: Any = 288.15
    relative_humidity: Any = 0.95
    air_pressure: Any = None
    sea_level_air_pressure: Any = SEA_LEVEL_PRESSURE
    gas_constant_dry_air: Any = DRY_AIR_GAS_CONSTANT
    lapse_rate: Any = LAPSE_RATE
    water_density: Any = 1000.0

    @staticmethod
    def of_station(latitude: Column, longitude: Column, altitude: Column) -> Environment:
        """Default air at a station's place; a missing or impossible place is the default one."""

        def valid(c: Column, low: float, high: float, default: float) -> Column:
            return F.coalesce(F.when(F.nanvl(c.cast("double"), F.lit(None)).between(low, high), c.cast("double")), F.lit(default))

        base = Environment()
        return Environment(valid(latitude, -90, 90, base.latitude), valid(longitude, -180, 180, base.longitude), valid(altitude, -450, 9000, base.altitude))

    @property
    def pressure(self) -> Any:
        if self.air_pressure is not None:
            return self.air_pressure
        return air_pressure_at_height(self.altitude, self.latitude, self.temperature, self.sea_level_air_pressure, self.lapse_rate, self.gas_constant_dry_air)

    @property
    def air_density(self) -> Any:
        return air_density(self.temperature, self.pressure, vapor_pressure(self.relative_humidity, self.temperature), self.gas_constant_dry_air)

    @property
    def air_viscosity(self) -> Any:
        return air_dynamic_viscosity(self.temperature)

    @property
    def gravity(self) -> Any:
        return gravitational_acceleration(self.latitude, self.altitude)

    @property
    def liquid_density(self) -> Any:
        return water_density(self.temperature, self.pressure, self.sea_level_air_pressure)


def gravitational_acceleration(latitude: Any, altitude: Any = 0.0) -> Any:
    """m/s2 at a latitude in degrees and an altitude in m."""
    o = ops(latitude, altitude)
    return 9.806229 - 0.025889372 * o.cos(2 * (math.pi / 180) * latitude) - 2.879513e-6 * altitude


def air_temperature_at_height(altitude: Any, sea_level_temperature: Any, lapse_rate: Any = LAPSE_RATE) -> Any:
    return sea_level_temperature - altitude * lapse_rate


def air_pressure_at_height(altitude: Any, latitude: Any, temperature: Any, sea_level_air_pressure: Any = SEA_LEVEL_PRESSURE, lapse_rate: Any = LAPSE_RATE, gas_constant: Any = DRY_AIR_GAS_CONSTANT) -> Any:
    """Barometric formula with gravity of the place."""
    o = ops(altitude, latitude, temperature, sea_level_air_pressure)
    exponent = gravitational_acceleration(latitude, altitude) / (gas_constant * lapse_rate)
    return sea_level_air_pressure * o.exp(-(exponent * o.log(altitude * lapse_rate / temperature + 1)))


def air_dynamic_viscosity(temperature: Any) -> Any:
    """Pa s."""
    o = ops(temperature)
    celsius = temperature - 273.15
    return o.where(celsius > 0, polynomial(celsius, (1.721e-5, 4.87e-8)), polynomial(celsius, (1.718e-5, 4.9e-8, -1.2e-10)))


def air_density(temperature: Any, air_pressure: Any, vapor: Any, gas_constant: Any = DRY_AIR_GAS_CONSTANT) -> Any:
    """kg/m3 of moist air."""
    return (air_pressure - 0.378 * vapor) / (temperature * gas_constant)


def vapor_saturation_pressure(temperature: Any) -> Any:
    o = ops(temperature)
    powers = sum(c * o.power(temperature, i - 2) for i, c in enumerate(_SATURATION))
    return o.exp(powers + _SATURATION_LOG * o.log(temperature))


def vapor_pressure(relative_humidity: Any, temperature: Any) -> Any:
    """Actual vapour pressure; humidity from 0 to 1."""
    return relative_humidity * vapor_saturation_pressure(temperature)


def vapor_pressure_at_height(altitude: Any, sea_level_temperature: Any, sea_level_humidity: Any, sea_level_air_pressure: Any = SEA_LEVEL_PRESSURE, lapse_rate: Any = LAPSE_RATE) -> Any:
    o = ops(altitude, sea_level_temperature, sea_level_humidity)
    aloft = air_temperature_at_height(altitude, sea_level_temperature, lapse_rate)
    saturated = vapor_saturation_pressure(sea_level_temperature)
    at_sea_level = sea_level_humidity / (1 / saturated - (1 - sea_level_humidity) / sea_level_air_pressure)
    return at_sea_level * o.exp(-altitude * (5.5e-5 + 5.8e3 * lapse_rate / o.power(aloft, 2)))


def pure_water_density(temperature: Any) -> Any:
    o = ops(temperature)
    celsius = temperature - 273.15
    warm = polynomial(celsius, _DENSITY_WARM) / (celsius * _DENSITY_WARM_BELOW + 1)
    return o.where(celsius > 0, warm, polynomial(celsius, _DENSITY_COLD))


def pure_water_compressibility(temperature: Any) -> Any:
    """1/Pa."""
    celsius = temperature - 273.15
    return polynomial(celsius, _COMPRESSIBILITY) * 1e-11 / (celsius * _COMPRESSIBILITY_BELOW + 1)


def pure_water_surface_tension(temperature: Any) -> Any:
    """N/m."""
    return 0.0761 - 0.000155 * (temperature - 273.15)


def water_density(temperature: Any, air_pressure: Any, sea_level_air_pressure: Any = SEA_LEVEL_PRESSURE) -> Any:
    o = ops(temperature, air_pressure)
    return pure_water_density(temperature) * o.exp(pure_water_compressibility(temperature) * (air_pressure - sea_level_air_pressure))
