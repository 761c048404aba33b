"""Formulae written once, for Spark columns and for numpy arrays.

A formula takes its operations from ``ops(*arguments)``: column expressions if any argument is a Column,
else numpy. The numpy form fills literal arrays of bin constants and serves as the check of the column
form. Missing numbers are NaN on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


class _ColumnOps:
    """Operations on columns with numpy's meaning of NaN."""

    @staticmethod
    def lit(x: Any) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    @classmethod
    def exp(cls, x):
        return F.exp(cls.lit(x))

    @classmethod
    def log(cls, x):
        # Spark's logarithm of 0 and below is null.
        x = cls.lit(x)
        return F.when(x > 0, F.log(x)).otherwise(F.lit(NAN))

    @classmethod
    def log10(cls, x):
        x = cls.lit(x)
        return F.when(x > 0, F.log10(x)).otherwise(F.lit(NAN))

    @classmethod
    def sqrt(cls, x):
        return F.sqrt(cls.lit(x))

    @classmethod
    def cos(cls, x):
        return F.cos(cls.lit(x))

    @classmethod
    def power(cls, x, p):
        return F.pow(cls.lit(x), cls.lit(p))

    @classmethod
    def absolute(cls, x):
        return F.abs(cls.lit(x))

    @classmethod
    def where(cls, condition, yes, no):
        return F.when(condition, cls.lit(yes)).otherwise(cls.lit(no))

    @classmethod
    def maximum(cls, x, y):
        x, y = cls.lit(x), cls.lit(y)
        return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.greatest(x, y))

    @classmethod
    def minimum(cls, x, y):
        x, y = cls.lit(x), cls.lit(y)
        return F.when(F.isnan(x) | F.isnan(y), F.lit(NAN)).otherwise(F.least(x, y))

    @classmethod
    def isnan(cls, x):
        return F.isnan(cls.lit(x))

    @classmethod
    def divide(cls, x, y):
        """x / y; by zero NaN where numpy has NaN or an infinity."""
        return F.coalesce(F.try_divide(cls.lit(x), cls.lit(y)), F.lit(NAN))


def _plain(function):
    """A numpy operation whose single results are Python floats, as numpy's own would not mix with columns."""

    def wrapped(*arguments):
        out = function(*arguments)
        return float(out) if np.ndim(out) == 0 and np.asarray(out).dtype.kind == "f" else out

    return staticmethod(wrapped)


class _NumpyOps:
    lit = staticmethod(lambda x: np.asarray(x, float))
    cos = _plain(np.cos)
    exp = _plain(np.exp)
    sqrt = _plain(np.sqrt)
    absolute = _plain(np.abs)
    where = _plain(np.where)
    maximum = _plain(np.maximum)
    minimum = _plain(np.minimum)
    isnan = staticmethod(np.isnan)

    @_plain
    def log(x):
        x = np.asarray(x, float)
        return np.log(x, where=x > 0, out=np.full(x.shape, NAN))

    @_plain
    def log10(x):
        x = np.asarray(x, float)
        return np.log10(x, where=x > 0, out=np.full(x.shape, NAN))

    @_plain
    def power(x, p):
        with np.errstate(all="ignore"):
            return np.power(np.asarray(x, float), p)

    @_plain
    def divide(x, y):
        x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
        return np.divide(x, y, where=y != 0, out=np.full(x.shape, NAN))


def ops(*arguments: Any) -> Any:
    return _ColumnOps if any(isinstance(a, Column) for a in arguments) else _NumpyOps


def polynomial(x: Any, coefficients: Sequence[float]) -> Any:
    """Sum of coefficients[i] * x ** i."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


# Lanczos approximation of the gamma function, g = 7.
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def lgamma(x: Any) -> Any:
    """Logarithm of the gamma function for x > 0; NaN for x <= 0."""
    o = ops(x)
    z = x - 1
    series = _LANCZOS[0]
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + c / (z + i) if o is _NumpyOps else series + o.divide(c, z + i)
    t = z + 7.5
    value = 0.5 * math.log(2 * math.pi) + (z + 0.5) * o.log(t) - t + o.log(series)
    return o.where(x > 0, value, NAN)


def gamma(x: Any) -> Any:
    """The gamma function for x > -4 that is no integer of 0 and below; by recurrence below 1."""
    o = ops(x)
    # Gamma(x) = Gamma(x + 5) / (x (x + 1) ... (x + 4)) keeps the argument of lgamma positive.
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4)
    shifted = o.divide(o.exp(lgamma(x + 5)), rising)
    return o.where(x > 1, o.exp(lgamma(x)), shifted)


def decibel(x: Any) -> Any:
    """10 log10; NaN of 0 and below."""
    return 10 * ops(x).log10(x)


def idecibel(x: Any) -> Any:
    return ops(x).power(x * 0 + 10.0, x / 10)
