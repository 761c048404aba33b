"""Parameters of distributions from moments, in closed form."""

from __future__ import annotations

from typing import Any

from rainloom.functions.backend import gamma, ops


def exponential_of_moments(Ml: Any, Mm: Any, l: float, m: float) -> tuple[Any, Any]:  # noqa: E741
    """N0, Lambda of any two moments."""
    import math

    if l == m:
        raise ValueError("the orders of the moments must differ")
    o = ops(Ml, Mm)
    slope = o.power(o.divide(Ml * math.gamma(m + 1), Mm * math.gamma(l + 1)), 1 / (m - l))
    return Ml * o.power(slope, l + 1) / math.gamma(l + 1), slope


def exponential_m34(M3: Any, M4: Any) -> tuple[Any, Any]:
    o = ops(M3, M4)
    return 256 / 6 * o.divide(o.power(M3, 5), o.power(M4, 4)), 4 * o.divide(M3, M4)


def _gamma_parameters(order: int, moment: Any, slope: Any, mu: Any) -> tuple[Any, Any, Any]:
    o = ops(moment, slope, mu)
    power = mu + order + 1
    return o.divide(o.power(slope, power) * moment, gamma(power)), mu, slope


def gamma_m234(M2: Any, M3: Any, M4: Any) -> tuple[Any, Any, Any]:
    """N0, mu, Lambda."""
    o = ops(M2, M3, M4)
    g = o.divide(M3 * M3, M2 * M4)
    mu = o.divide(1, 1 - g) - 4
    return _gamma_parameters(2, M2, o.divide(M2, M3) * (mu + 3), mu)


def gamma_m456(M4: Any, M5: Any, M6: Any) -> tuple[Any, Any, Any]:
    o = ops(M4, M5, M6)
    g = o.divide(M5 * M5, M4 * M6)
    mu = o.divide(1, 1 - g) - 6
    return _gamma_parameters(4, M4, o.divide(M4, M5) * (mu + 5), mu)


def gamma_m346(M3: Any, M4: Any, M6: Any) -> tuple[Any, Any, Any]:
    o = ops(M3, M4, M6)
    g = o.divide(o.power(M4, 3), M3 * M3 * M6)
    mu = o.divide(5.5 * g - 4 + o.sqrt(g * (0.25 * g + 2)), 1 - g)
    return _gamma_parameters(3, M3, (mu + 4) * o.divide(M3, M4), mu)


def gamma_m246(M2: Any, M4: Any, M6: Any, corrected: bool = False) -> tuple[Any, Any, Any]:
    """The form in use divides only the root by 2 (G - 1); ``corrected`` divides the whole numerator."""
    o = ops(M2, M4, M6)
    g = o.divide(M4 * M4, M2 * M6)
    root, under = o.sqrt(g * g + 14 * g + 1), 2 * (g - 1)
    mu = o.divide(7 - 11 * g - root, under) if corrected else 7 - 11 * g - o.divide(root, under)
    slope = o.sqrt((4 + mu) * (3 + mu) * o.divide(M2, M4))
    return _gamma_parameters(2, M2, slope, mu)


def lognormal_m346(M3: Any, M4: Any, M6: Any) -> tuple[Any, Any, Any]:
    """Nt, mu, sigma; the third is the variance-like expression in use."""
    o = ops(M3, M4, M6)
    l3, l4, l6 = o.log(M3), o.log(M4), o.log(M6)
    return o.exp(8 * l3 - 9 * l4 - 2 * l6), (13.5 * l4 - 10 * l3 - 3.5 * l6) / 3, (2 * l3 - 3 * l4 + l6) / 3


#: Methods by distribution: the moments used, and the function.
METHODS = {
    "GammaPSD": {"M234": ((2, 3, 4), gamma_m234), "M246": ((2, 4, 6), gamma_m246), "M456": ((4, 5, 6), gamma_m456), "M346": ((3, 4, 6), gamma_m346)},
    "LognormalPSD": {"M346": ((3, 4, 6), lognormal_m346)},
    "ExponentialPSD": {"M234": ((3, 4), exponential_m34)},
}
PARAMETERS = {"GammaPSD": ("N0", "mu", "Lambda"), "LognormalPSD": ("Nt", "mu", "sigma"), "ExponentialPSD": ("N0", "Lambda")}
