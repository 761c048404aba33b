"""Refractive index of liquid water as a pair (real, imaginary); Spark has no complex type.

Temperatures in degrees Celsius, frequencies in GHz. Outside a model's range the result is NaN.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainloom.functions.backend import NAN, ops, polynomial

# Range of temperature and of frequency in which each model holds.
MODELS = {"Liebe1991": ((0, 40), (0, 1000)), "Liebe1991single": ((0, 100), (0, 100)), "Ellison2007": ((0, 100), (0, 1000)), "Turner2016": ((-40, 50), (0.5, 500))}
# The double-Debye fit of 2016 (two relaxations) and its static permittivity.
_TURNER = ((8.111e01, 4.434e-3, 1.302e-13, 6.627e02), (2.025, 1.073e-2, 1.012e-14, 6.089e02))
_TURNER_CRITICAL = 1.342e2
_TURNER_STATIC = (8.79144e1, -4.04399e-1, 9.58726e-4, -1.32802e-6)
# The 2007 fit.
_ELLISON_E1 = (5.7230, 2.2379e-2, -7.1237e-4)
_ELLISON_N1 = (5.0478, -7.0315e-2, 6.0059e-4)
_ELLISON_INFINITY = (3.6143, 2.8841e-2)
_ELLISON_N2 = (1.3652e-1, 1.4825e-3, 2.4166e-4)


def _debye(low: Any, high: Any, ratio: Any) -> tuple[Any, Any]:
    """A relaxation from ``low`` to ``high`` permittivity at a frequency ``ratio`` times its own."""
    strength = (low - high) / (1 + ratio * ratio)
    return strength, strength * ratio


def permittivity(temperature: Any, frequency: Any, model: str = "Turner2016") -> tuple[Any, Any]:
    """Real and imaginary part of the complex permittivity."""
    o = ops(temperature, frequency)
    if model not in MODELS:
        raise ValueError(f"{model} is no permittivity model; known are {', '.join(MODELS)}")
    theta = 1 - 300 / (temperature + 273.15)
    if model == "Liebe1991single":
        static = 77.66 - 103.3 * theta
        optical = 0.066 * static
        a, b = _debye(static, optical, frequency / polynomial(theta, (20.27, 146.5, 314.0)))
        real, imaginary = a + optical, b
    elif model == "Liebe1991":
        static = 77.66 - 103.3 * theta
        middle, optical = 0.0671 * static, 3.52 + 7.52 * theta
        own = polynomial(theta, (20.20, 146.5, 316.0))
        a, b = _debye(static, middle, frequency / own)
        c, d = _debye(middle, optical, frequency / (39.8 * own))
        real, imaginary = a + c + optical, b + d
    elif model == "Ellison2007":
        static = (37088.6 - 82.168 * temperature) / (421.854 + temperature)
        middle, optical = polynomial(temperature, _ELLISON_E1), polynomial(temperature, _ELLISON_INFINITY)
        a, b = _debye(static, middle, frequency * polynomial(temperature, _ELLISON_N1) / (45.0 + temperature))
        c, d = _debye(middle, optical, frequency * polynomial(temperature, _ELLISON_N2) / (45.0 + temperature))
        real, imaginary = a + c + optical, b + d
    else:
        angular = 2 * math.pi * 1e9 * frequency
        real, imaginary = polynomial(temperature, _TURNER_STATIC), 0.0
        for strength, cooling, time, rate in _TURNER:
            delta = strength * o.exp(-cooling * temperature)
            turn = angular * time * o.exp(rate / (temperature + _TURNER_CRITICAL))
            real = real - delta * turn * turn / (1 + turn * turn)
            imaginary = imaginary + delta * turn / (1 + turn * turn)
    (t0, t1), (f0, f1) = MODELS[model]
    valid = (temperature >= t0) & (temperature <= t1) & (frequency >= f0) & (frequency <= f1)
    return o.where(valid, real, NAN), o.where(valid, imaginary, NAN)


def refractive_index(temperature: Any, frequency: Any, model: str = "Turner2016") -> tuple[Any, Any]:
    """Real and imaginary part of the square root of the permittivity."""
    real, imaginary = permittivity(temperature, frequency, model)
    o = ops(temperature, frequency)
    size = o.sqrt(real * real + imaginary * imaginary)
    return o.sqrt((size + real) / 2), o.sqrt((size - real) / 2)


def refractive_index_struct(temperature: Column, frequency: Column, model: str = "Turner2016") -> Column:
    """The refractive index as a struct of re and im."""
    re, im = refractive_index(temperature, frequency, model)
    return F.struct(re.alias("re"), im.alias("im"))


def rayleigh_dielectric_factor(real: Any, imaginary: Any) -> Any:
    """|(e - 1) / (e + 2)|^2 of a refractive index given by its parts."""
    e_real, e_imaginary = real * real - imaginary * imaginary, 2 * real * imaginary
    over = (e_real - 1) * (e_real - 1) + e_imaginary * e_imaginary
    under = (e_real + 2) * (e_real + 2) + e_imaginary * e_imaginary
    return over / under
