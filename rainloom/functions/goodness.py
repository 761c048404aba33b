"""How well a fitted N(D) meets an observed one: expressions over two arrays of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions.spectrum import mode_diameter
from rainloom.session import staged

EPSILON = 1e-12


def _div(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), A.nan())


def probabilities(nd: Column, width: Column) -> Column:
    """Share of drops per bin; zeros without drops."""
    parts = A.times(nd, width)
    whole = A.total(parts)
    return F.transform(parts, lambda x: F.when(whole == 0, 0.0).otherwise(_div(x, whole)))


def kl_divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence, at least 0; NaN if either has no mass. Zeros count as EPSILON inside the logarithm."""
    safe = lambda x: F.when(x == 0, F.lit(EPSILON)).otherwise(x)
    terms = F.zip_with(p, q, lambda a, b: a * F.log(safe(a) / safe(b)))
    return F.when((A.total(p) == 0) | (A.total(q) == 0), A.nan()).otherwise(F.greatest(A.total(terms), F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    middle = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return F.sqrt((kl_divergence(p, middle) + kl_divergence(q, middle)) / 2)


def wasserstein(p: Column, q: Column, diameter: Column, width: Column, integration: str = "bin") -> Column:
    """Area between the cumulated shares, by bin widths or as a left Riemann sum over the diameters."""
    gaps = F.zip_with(A.cumulative(p), A.cumulative(q), lambda a, b: F.abs(a - b))
    if integration == "bin":
        area = A.dot(gaps, width)
    elif integration == "left_riemann":
        n = F.size(diameter) - 1
        steps = F.zip_with(F.slice(diameter, 2, n), F.slice(diameter, 1, n), lambda b, a: b - a)
        area = A.dot(F.slice(gaps, 1, n), steps)
    else:
        raise ValueError("integration is bin or left_riemann")
    return F.when((A.total(p) == 0) | (A.total(q) == 0), A.nan()).otherwise(area)


def kolmogorov_smirnov(p: Column, q: Column) -> tuple[Column, Column]:
    """Largest gap between the cumulated shares, and its p-value by effective sample sizes."""
    gap = F.array_max(F.zip_with(A.cumulative(p), A.cumulative(q), lambda a, b: F.abs(a - b)))
    size = lambda x: _div(F.lit(1.0), A.dot(x, x))
    n = size(p) * size(q) / (size(p) + size(q))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.exp(-2 * gap * gap * n)))
    empty = (A.total(p) == 0) | (A.total(q) == 0)
    return F.when(empty, A.nan()).otherwise(gap), F.when(empty, A.nan()).otherwise(value)


def correlation(x: Column, y: Column) -> Column:
    n = F.size(x)
    mx, my = A.total(x) / n, A.total(y) / n
    cov = A.total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    vx, vy = A.total(F.transform(x, lambda a: (a - mx) * (a - mx))), A.total(F.transform(y, lambda b: (b - my) * (b - my)))
    return _div(cov, F.sqrt(vx * vy))


def goodness(df: DataFrame, observed: str, predicted: str, diameter: Column, width: Column, digits: int | None = 2) -> DataFrame:
    """Adds R2, MAE, MaxAE, RelMaxAE, PeakDiff, RelPeakDiff, DmodeDiff, NtDiff, KLDiv, JSD, WD, KS; all NaN for a row with NaN."""
    o, q = F.col(observed), F.col(predicted)
    df = staged(df, {"_p": probabilities(o, width), "_q": probabilities(q, width), "_gap": F.zip_with(o, q, lambda a, b: F.abs(a - b)), "_bad": A.any_missing(o) | A.any_missing(q)})
    worst, top = F.array_max("_gap"), F.array_max(o)
    peak = top - F.array_max(q)
    relative = lambda x: F.when(x == 0, 0.0).when(top == 0, A.nan()).otherwise(_div(x, top))
    values = {
        "R2": F.pow(correlation(o, q), F.lit(2.0)),
        "MAE": A.total(F.col("_gap")) / F.size("_gap"),
        "MaxAE": worst,
        "RelMaxAE": relative(worst),
        "PeakDiff": peak,
        "RelPeakDiff": relative(peak),
        "DmodeDiff": mode_diameter(o, diameter) - mode_diameter(q, diameter),
        "NtDiff": A.dot(q, width) - A.dot(o, width),
        "KLDiv": kl_divergence(F.col("_p"), F.col("_q")),
        "JSD": jensen_shannon(F.col("_p"), F.col("_q")),
        "WD": wasserstein(F.col("_p"), F.col("_q"), diameter, width),
        "KS": kolmogorov_smirnov(F.col("_p"), F.col("_q"))[0],
    }
    final = {n: F.when(F.col("_bad"), A.nan()).otherwise(c if digits is None else F.bround(c, digits)) for n, c in values.items()}
    return df.withColumns(final).drop("_p", "_q", "_gap", "_bad")
