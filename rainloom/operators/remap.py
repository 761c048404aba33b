"""Spectra onto other bins: conservative remapping (native), shape-preserving cubic interpolation (numpy over Arrow)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions.spectrum import overlap_weights
from rainloom.sensors import Bins


def regular_bins(low: float = 0.0, high: float = 10.0, spacing: float = 0.05) -> Bins:
    """Evenly spaced bins; for diameters in mm or speeds in m/s."""
    n = int(round((high - low) / spacing))
    return Bins.of_edges(np.round(low + spacing * np.arange(n + 1), 10))


def kept_bins(bins: Bins, minimum: float | None = None, maximum: float | None = None) -> list[int]:
    """Positions of bins that overlap (minimum, maximum); an error if none does."""
    keep = [i for i in range(len(bins)) if (minimum is None or bins.upper[i] > minimum) and (maximum is None or bins.lower[i] < maximum)]
    if not keep:
        raise ValueError("no bin overlaps the given limits")
    return keep


def select_bins(array: Column, keep: Sequence[int]) -> Column:
    """Entries of an array at 0-based positions; contiguous ones as a slice."""
    if list(keep) == list(range(keep[0], keep[0] + len(keep))):
        return F.slice(array, keep[0] + 1, len(keep))
    return F.transform(F.expr("array(" + ", ".join(str(k + 1) for k in keep) + ")"), lambda i: F.element_at(array, i))


def _weighted(array: Column, weights: np.ndarray) -> Column:
    """One dot product per target bin; only source bins that overlap it take part."""
    positive = F.transform(array, lambda x: F.when((x > 0) & ~F.isnan(x), x).otherwise(0.0))
    rows = []
    for row in weights:
        used = np.flatnonzero(row)
        if not len(used):
            rows.append(F.lit(0.0))
            continue
        part = F.slice(positive, int(used[0]) + 1, int(used[-1] - used[0]) + 1)
        rows.append(A.dot(part, F.array(*[F.lit(float(w)) for w in row[used[0] : used[-1] + 1]])))
    return F.array(*rows)


def remap_counts(counts: Column, source: Bins, edges: Sequence[float]) -> Column:
    """Counts on new edges; a source bin's count is spread evenly over its width."""
    return _weighted(counts, overlap_weights(source.lower, source.upper, edges) / source.width[None, :])


def remap_density(density: Column, source: Bins, edges: Sequence[float]) -> Column:
    """A density on new edges, conserving its integral."""
    return _weighted(density, overlap_weights(source.lower, source.upper, edges) / np.diff(np.asarray(edges, float))[:, None])


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic Hermite interpolation through increasing x; NaN outside."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    if len(x) < 2:
        return np.full(at.shape, np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = slope[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        with np.errstate(all="ignore"):
            harmonic = (w1 + w2) / (w1 / slope[:-1] + w2 / slope[1:])
        m[1:-1] = np.where(slope[:-1] * slope[1:] > 0, harmonic, 0.0)
        for end, (h0, h1, s0, s1) in ((0, (h[0], h[1], slope[0], slope[1])), (-1, (h[-1], h[-2], slope[-1], slope[-2]))):
            edge = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            m[end] = 0.0 if edge * s0 <= 0 else 3 * s0 if s0 * s1 < 0 and abs(edge) > 3 * abs(s0) else edge
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    value = (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]
    return np.where((at >= x[0]) & (at <= x[-1]), value, np.nan)


def log_pchip_density(density: np.ndarray, source: Bins, target: Bins) -> np.ndarray:
    """A density interpolated in its logarithm, held beyond the outer centres, rescaled to its integral."""
    density = np.where(np.isfinite(density) & (density > 0), density, 0.0)
    filled = np.flatnonzero(density > 0)
    total = float((density * source.width).sum())
    if total <= 0:
        return np.zeros(len(target))
    if len(filled) < 2:
        return overlap_weights(source.lower, source.upper, np.append(target.lower, target.upper[-1])) @ density / target.width
    first, last = filled[0], filled[-1]
    out = np.exp(pchip(source.center[filled], np.log(density[filled]), target.center))
    out = np.where(np.isfinite(out), out, 0.0)
    reached = (target.upper > source.lower[first]) & (target.lower < source.upper[last])
    out = np.where(reached & (target.center < source.center[first]), density[first], out)
    out = np.where(reached & (target.center > source.center[last]), density[last], out)
    out = np.where(reached, out, 0.0)
    after = float((out * target.width).sum())
    return out * (total / after) if after > 0 else out


def by_row(df: DataFrame, column: str, out: str, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds the result of a numpy function of an array column, batch by batch."""

    @F.arrow_udf("array<double>")
    def apply(lists: pa.Array) -> pa.Array:
        return _lists([None if a is None else function(np.asarray(a, float)) for a in lists.to_pylist()])

    return df.withColumn(out, apply(F.col(column)))


def _lists(rows: Sequence[np.ndarray | None]) -> pa.Array:
    """Arrays as lists that keep NaN apart from null."""
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    values = np.concatenate([r for r in rows if r is not None]) if sizes.sum() else np.zeros(0)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([*(r is None for r in rows), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def resample_concentration(df: DataFrame, column: str, out: str, source: Bins, edges: Sequence[float], method: str | Callable = "log_pchip") -> DataFrame:
    """N(D) on new edges: "constant", "log_pchip" or a function; fewer bins than before are always constant."""
    target = Bins.of_edges(np.asarray(edges, float))
    if method == "constant" or len(target) < len(source):
        return df.withColumn(out, remap_density(F.col(column), source, edges))
    if callable(method):
        return by_row(df, column, out, lambda a: method(a, source, target))
    if method != "log_pchip":
        raise ValueError(f"{method} is no remapping; known are constant and log_pchip")
    return by_row(df, column, out, lambda a: log_pchip_density(a, source, target))


def resample_drop_counts(df: DataFrame, column: str, out: str, source: Bins, edges: Sequence[float], method: str | Callable = "constant") -> DataFrame:
    """Counts on new edges, as resample_concentration."""
    target = Bins.of_edges(np.asarray(edges, float))
    if method == "constant" or len(target) < len(source):
        return df.withColumn(out, remap_counts(F.col(column), source, edges))
    if callable(method):
        return by_row(df, column, out, lambda a: method(a, source, target))
    if method != "log_pchip":
        raise ValueError(f"{method} is no remapping; known are constant and log_pchip")
    return by_row(df, column, out, lambda a: log_pchip_density(a / source.width, source, target) * target.width)


def interpolate_bins(df: DataFrame, column: str, out: str, source: np.ndarray, at: np.ndarray, method: str = "linear") -> DataFrame:
    """Values at other diameters: linear or pchip, NaN outside."""
    if method not in ("linear", "pchip"):
        raise ValueError(f"{method} is no interpolation; known are linear and pchip")

    def one(values: np.ndarray) -> np.ndarray:
        known = np.isfinite(values)
        if not known.any():
            return np.full(len(at), np.nan)
        x, y = np.asarray(source, float)[known], values[known]
        return pchip(x, y, at) if method == "pchip" and len(x) > 1 else np.interp(at, x, y, left=np.nan, right=np.nan)

    return by_row(df, column, out, one)


def normalized_dsd(df: DataFrame, diameter: Column, nd: str = "drop_number_concentration", nc: str = "Nw", dc: str = "Dm", high: float = 6.0, step: float = 0.001, out: str = "normalized_dsd") -> DataFrame:
    """N(D)/Nc against D/Dc, linear between bins, on a regular grid from 0 to ``high``; NaN outside the bins."""
    n = int(round(high / step)) + 1
    grid = np.round(np.arange(n) * step, 10)

    @F.arrow_udf("array<double>")
    def apply(d: pa.Array, values: pa.Array, scale: pa.Array, size: pa.Array) -> pa.Array:
        rows = []
        for a, b, c, s in zip(d.to_pylist(), values.to_pylist(), scale.to_pylist(), size.to_pylist()):
            valid = a is not None and b is not None and s and np.isfinite(s) and c and np.isfinite(c)
            rows.append(np.interp(grid, np.asarray(a, float) / s, np.asarray(b, float) / c, left=np.nan, right=np.nan) if valid else np.full(n, np.nan))
        return _lists(rows)

    return df.withColumn(out, apply(diameter, F.col(nd), F.col(nc), F.col(dc)))
