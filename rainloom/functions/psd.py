"""Parametric drop size distributions N(D) in 1/m3/mm: values, moments and what follows from them.

Formulae take columns or numpy values. Diameters in mm, N0 in mm^-(1+mu)/m3, Lambda in 1/mm.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rainloom.functions.backend import gamma, lgamma, ops

#: Values of N(D) below this are 0.
ZERO_BELOW = 1e-3


def lognormal(D: Any, Nt: Any, mu: Any, sigma: Any) -> Any:
    o = ops(D, Nt, mu, sigma)
    off = o.log(D) - mu
    return o.divide(Nt, math.sqrt(2 * math.pi) * sigma * D) * o.exp(-o.divide(off * off, 2 * sigma * sigma))


def exponential(D: Any, N0: Any, Lambda: Any) -> Any:
    return N0 * ops(D, N0, Lambda).exp(-(Lambda * D))


def gamma_psd(D: Any, N0: Any, Lambda: Any, mu: Any) -> Any:
    o = ops(D, N0, Lambda, mu)
    return N0 * o.exp(mu * o.log(D) - Lambda * D)


def normalized_gamma_dm(D: Any, Nw: Any, Dm: Any, mu: Any) -> Any:
    o = ops(D, Nw, Dm, mu)
    x = o.divide(D, Dm)
    scale = 6 / 4**4 * o.exp((mu + 4) * o.log(mu + 4) - lgamma(mu + 4))
    return Nw * scale * o.exp(mu * o.log(x) - (mu + 4) * x)


def normalized_gamma_d50(D: Any, Nw: Any, D50: Any, mu: Any) -> Any:
    o = ops(D, Nw, D50, mu)
    x = o.divide(D, D50)
    scale = 6 / 3.67**4 * o.exp((mu + 4) * o.log(mu + 3.67) - lgamma(mu + 4))
    return Nw * scale * o.exp(mu * o.log(x) - (mu + 3.67) * x)


def normalized_gamma_nt(D: Any, Nt: Any, Dm: Any, mu: Any) -> Any:
    o = ops(D, Nt, Dm, mu)
    x = o.divide(D, Dm)
    return o.divide(Nt, Dm) * o.exp((mu + 1) * o.log(mu + 4) - lgamma(mu + 1) + mu * o.log(x) - (mu + 4) * x)


def generalized_gamma(D: Any, Nt: Any, Lambda: Any, mu: Any, c: Any) -> Any:
    o = ops(D, Nt, Lambda, mu, c)
    x = o.log(Lambda * D)
    return Nt * c * Lambda * o.exp((c * (mu + 1) - 1) * x - lgamma(mu + 1) - o.exp(c * x))


def normalized_generalized_shape(x: Any, i: Any, j: Any, c: Any, mu: Any) -> Any:
    """h(x) with the moments of order i and j of the shape equal to one."""
    o = ops(x, i, j, c, mu)
    gi, gj = lgamma(mu + 1 + i / c), lgamma(mu + 1 + j / c)
    power = mu + 1
    lead = gi * ((j + c * power) / (i - j)) + gj * ((-i - c * power) / (i - j))
    inner = o.exp(c * (o.log(x) + (gi - gj) / (i - j)))
    return c * o.exp(lead + (c * power - 1) * o.log(x) - inner)


def normalized_generalized_gamma(D: Any, Nc: Any, Dc: Any, i: Any, j: Any, mu: Any, c: Any) -> Any:
    return Nc * normalized_generalized_shape(ops(D, Dc).divide(D, Dc), i, j, c, mu)


def scaling_concentration(i: float, j: float, Mi: Any, Mj: Any) -> Any:
    o = ops(Mi, Mj)
    return o.power(Mi, (j + 1) / (j - i)) * o.power(Mj, (i + 1) / (i - j))


def scaling_diameter(i: float, j: float, Mi: Any, Mj: Any) -> Any:
    o = ops(Mi, Mj)
    return o.power(o.divide(Mj, Mi), 1 / (j - i))


# --- moments ---------------------------------------------------------------------------------------------


def gamma_moment(N0: Any, Lambda: Any, mu: Any, n: float) -> Any:
    o = ops(N0, Lambda, mu)
    return N0 * gamma(mu + n + 1) / o.power(Lambda, mu + n + 1)


def exponential_moment(N0: Any, Lambda: Any, n: float) -> Any:
    return N0 * math.gamma(n + 1) / ops(N0, Lambda).power(Lambda, n + 1)


def gamma_moment_of_total(Nt: Any, mu: Any, Lambda: Any, n: float) -> Any:
    """Of the total number instead of N0."""
    o = ops(Nt, mu, Lambda)
    return Nt * gamma(mu + n + 1) / (gamma(mu + 1) * o.power(Lambda, n))


def lognormal_moment(Nt: Any, sigma: Any, mu: Any, n: float, corrected: bool = False) -> Any:
    """The form in use has half of n sigma^2 in the exponent; ``corrected`` has n^2."""
    o = ops(Nt, sigma, mu)
    return Nt * o.exp(n * mu + 0.5 * (n * n if corrected else n) * sigma * sigma)


def normalized_gamma_moment(Nw: Any, Dm: Any, mu: Any, n: float) -> Any:
    o = ops(Nw, Dm, mu)
    return 6 / 4**4 * Nw * o.power(Dm, n + 1) * o.power(mu + 4, 3 - n) * o.exp(lgamma(mu + n + 1) - lgamma(mu + 4))


def generalized_gamma_moment(Nt: Any, Lambda: Any, mu: Any, c: Any, n: float) -> Any:
    o = ops(Nt, Lambda, mu, c)
    return Nt * o.power(Lambda, -n) * o.exp(lgamma(mu + 1 + n / c) - lgamma(mu + 1))


def normalized_generalized_moment(n: float, Nc: Any, Dc: Any, i: float, j: float, mu: Any, c: Any) -> Any:
    """In the logarithm: Nc Dc^(n+1) times the moment of the shape."""
    o = ops(Nc, Dc, mu, c)
    gi, gj, gn = (lgamma(mu + 1 + k / c) for k in (i, j, n))
    return Nc * o.power(Dc, n + 1) * o.exp(gn + gi * ((j - n) / (i - j)) + gj * ((n - i) / (i - j)))


def gamma_rain_rate(N0: Any, Lambda: Any, mu: Any, v0: float = 3.778, p: float = 3.67) -> Any:
    """mm/h by the moment of order 3 + p in use; the physical exponent of speeds v0 D^p is p = 0.67."""
    return 6 * math.pi * 1e-4 * v0 * gamma_moment(N0, Lambda, mu, 3 + p)


def gamma_water_content(N0: Any, Lambda: Any, mu: Any, density: float = 1000.0) -> Any:
    """g/m3."""
    return math.pi / 6 * density * 1e-6 * gamma_moment(N0, Lambda, mu, 3)


def gamma_reflectivity(N0: Any, Lambda: Any, mu: Any) -> Any:
    return 10 * ops(N0, Lambda, mu).log10(gamma_moment(N0, Lambda, mu, 6))


def gamma_mean_diameter(mu: Any, Lambda: Any) -> Any:
    return ops(mu, Lambda).divide(mu + 4, Lambda)


def gamma_width(mu: Any, Lambda: Any) -> Any:
    o = ops(mu, Lambda)
    return o.divide(o.sqrt(mu + 4), Lambda)


# --- models by name --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A distribution by name: its parameters in order and its formula."""

    name: str
    parameters: tuple[str, ...]
    formula: Callable[..., Any]

    def values(self, diameters: Column, parameters: dict[str, Column], zero_below: float = ZERO_BELOW) -> Column:
        """N(D) as an array, entry by entry of an array of diameters."""

        def one(d: Column) -> Column:
            n = self.formula(d, **{p: parameters[p] for p in self.parameters})
            return F.when(n < zero_below, 0.0).otherwise(n)

        return F.transform(diameters, one)

    def numpy_values(self, diameters: np.ndarray, zero_below: float = ZERO_BELOW, **parameters: Any) -> np.ndarray:
        with np.errstate(all="ignore"):
            n = self.formula(np.asarray(diameters, float), **parameters)
        return np.where(n < zero_below, 0.0, n)


MODELS = {
    m.name: m
    for m in (
        Model("LognormalPSD", ("Nt", "mu", "sigma"), lognormal),
        Model("ExponentialPSD", ("N0", "Lambda"), exponential),
        Model("GammaPSD", ("N0", "Lambda", "mu"), gamma_psd),
        Model("NormalizedGammaDmNwPSD", ("Nw", "Dm", "mu"), normalized_gamma_dm),
        Model("NormalizedGammaD50NwPSD", ("Nw", "D50", "mu"), normalized_gamma_d50),
        Model("NormalizedGammaDmNtPSD", ("Nt", "Dm", "mu"), normalized_gamma_nt),
        Model("GeneralizedGammaPSD", ("Nt", "Lambda", "mu", "c"), generalized_gamma),
        Model("NormalizedGeneralizedGammaPSD", ("Nc", "Dc", "i", "j", "mu", "c"), normalized_generalized_gamma),
    )
}


def model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"{name} is no distribution; known are {', '.join(MODELS)}")
    return MODELS[name]


def model_of_columns(columns: list[str]) -> Model:
    """The distribution whose parameters a table holds; of several the one with the most."""
    fitting = [m for m in MODELS.values() if set(m.parameters) <= set(columns)]
    if not fitting:
        raise ValueError("the columns are the parameters of no distribution")
    return max(fitting, key=lambda m: len(m.parameters))


def binned_step(diameters: Column, lower: np.ndarray, upper: np.ndarray, concentration: Column, left: bool = True) -> Column:
    """A binned N(D) evaluated as steps; 0 outside. Right-closed bins, or left-closed with ``left=False``."""
    bounds = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(i + 1).alias("i")) for i, (a, b) in enumerate(zip(lower, upper))])

    def one(d: Column) -> Column:
        inside = (lambda p: (p["a"] < d) & (d <= p["b"])) if left else (lambda p: (p["a"] <= d) & (d < p["b"]))
        found = F.try_element_at(F.filter(bounds, inside), F.lit(1))
        return F.greatest(F.coalesce(F.try_element_at(concentration, found["i"]), F.lit(0.0)), F.lit(0.0))

    return F.transform(diameters, one)


