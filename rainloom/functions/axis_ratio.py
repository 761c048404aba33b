"""Axis ratios of raindrops by diameter in mm."""

from __future__ import annotations

from typing import Any

from rainloom.functions.backend import NAN, ops, polynomial

# Coefficients by power of the diameter.
_POLYNOMIALS = {
    "Thurai2005": (0.9707, 4.26e-2, -4.29e-2, 6.5e-3, -3e-4),
    "Brandes2002": (0.9951, 0.0251, -0.03644, 0.005303, -0.0002492),
    "Pruppacher1970": (1.03, -0.062),
    "Beard1987": (1.0048, 5.7e-04, -2.628e-02, 3.682e-03, -1.677e-04),
    "Chang2009": (0.98287, 4.2514e-2, -3.3439e-2, 4.3402e-3, -1.9223e-4),
}
_THURAI_2007_MIDDLE = (1.173, -0.5165, 0.4698, -0.1317, -8.5e-3)
_THURAI_2007_LARGE = (1.065, -6.25e-2, -3.99e-3, 7.66e-4, -4.095e-5)
MODELS = ("Thurai2005", "Thurai2007", "Parsivel", "Brandes2002", "Pruppacher1970", "Beard1987", "Andsager1999", "Chang2009")


def axis_ratio(diameter: Any, model: str = "Thurai2007") -> Any:
    """Vertical by horizontal axis, within 0 and 1; NaN stays NaN."""
    o = ops(diameter)
    if model in _POLYNOMIALS:
        ratio = polynomial(diameter, _POLYNOMIALS[model])
    elif model == "Thurai2007":
        larger = o.where(diameter > 1.5, polynomial(diameter, _THURAI_2007_LARGE), polynomial(diameter, _THURAI_2007_MIDDLE))
        ratio = o.where(diameter > 0.7, larger, 1.0)
    elif model == "Parsivel":
        ratio = o.where(diameter <= 1, 1.0, o.where(diameter >= 5, 0.7, 1.075 - 0.075 * diameter))
    elif model == "Andsager1999":
        cm = 0.1 * diameter
        oscillating = polynomial(cm, (1.012, -0.144, -1.03))
        ratio = o.where((cm >= 1.1) & (cm < 4.4), oscillating, polynomial(diameter, _POLYNOMIALS["Beard1987"]))
    else:
        raise ValueError(f"{model} is no axis ratio model; known are {', '.join(MODELS)}")
    return o.where(o.isnan(diameter), NAN, o.minimum(o.maximum(ratio, 0.0), 1.0))
