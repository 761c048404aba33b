"""Expressions over arrays of numbers. Arrays hold no nulls; a missing number is NaN and spreads as in numpy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: expressions that repeat it would grow with every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    """Sum; NaN if any entry is, 0 of an empty array."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def times(*arrays: Column) -> Column:
    """Entry-wise product."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x * y), arrays)


def linear(array: Column, matrix: np.ndarray, skip_missing: bool = False, filled: np.ndarray | None = None) -> Column:
    """Many weighted sums of an array at once: entry k of the result is the dot product with row k of ``matrix``.

    One matrix product per Arrow batch on the flat buffer of the arrays. Expressions over arrays are
    interpreted entry by entry, which for a mask of a thousand cells is some fifty times slower. NaN
    spreads, or with ``skip_missing`` counts as 0; null and arrays of another length give NaN. After these
    sums come those by the rows of ``filled``, which count the entries above 0.
    """
    weights = np.ascontiguousarray(np.asarray(matrix, float).T)
    counting = None if filled is None else np.ascontiguousarray(np.asarray(filled, float).T)
    size, n_out = weights.shape[0], weights.shape[1] + (0 if counting is None else counting.shape[1])

    @F.arrow_udf("array<double>")
    def product(lists: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        fits = length == size
        out = np.full((len(lists), n_out), np.nan)
        if fits.any():
            chosen = lists if fits.all() else lists.filter(pa.array(fits))
            values = pc.fill_null(chosen.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
            sums = (np.nan_to_num(values) if skip_missing else values) @ weights
            out[fits] = sums if counting is None else np.concatenate([sums, (values > 0).astype(float) @ counting], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * n_out, pa.int32()), pa.array(out.ravel()))

    return product(array)


def masked(array: Column, masks: np.ndarray, which: Column) -> Column:
    """An array times row ``which`` (from 0) of ``masks``, an entry at a time; null and arrays of another length stay."""
    factors = np.asarray(masks, float)
    size = factors.shape[1]

    @F.arrow_udf("array<double>")
    def product(lists: pa.Array, rows: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        fits = length == size
        if not fits.any():
            return lists
        chosen = lists.filter(pa.array(fits))
        factor = factors[rows.to_numpy(zero_copy_only=False)[fits]]
        values = np.where(factor == 0, 0.0, pc.fill_null(chosen.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size) * factor)
        if fits.all():
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * size, pa.int32()), pa.array(values.ravel()))
        out = lists.to_pylist()
        for k, row in zip(np.flatnonzero(fits), values):
            out[k] = row
        return pa.array(out, pa.list_(pa.float64()))

    return product(array, which.cast("int"))


def dot(*arrays: Column) -> Column:
    return total(times(*arrays))


def powers(array: Column, exponent: float) -> Column:
    if exponent == 0:
        return F.transform(array, lambda x: F.lit(1.0))
    if exponent == 1:
        return array
    return F.transform(array, lambda x: F.pow(x, F.lit(float(exponent))))


def cumulative(array: Column) -> Column:
    """Running sums."""
    start = F.array().cast("array<double>")
    return F.aggregate(array, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


def first_true(mask: Column) -> Column:
    """1-based position of the first true entry, 0 if none."""
    return F.array_position(mask, F.lit(True)).cast("int")


def last_true(mask: Column) -> Column:
    """1-based position of the last true entry, 0 if none."""
    back = F.array_position(F.reverse(mask), F.lit(True)).cast("int")
    return F.when(back > 0, F.size(mask) + 1 - back).otherwise(0)


def constant(array: Column, value: float) -> Column:
    """An array of one value as long as ``array``."""
    return F.transform(array, lambda x: F.lit(float(value)))


def any_missing(array: Column) -> Column:
    return F.exists(array, lambda x: F.isnan(x) | x.isNull())


def over_velocity(spectrum: Column, n_velocity: int) -> Column:
    """Sums over the velocity bins of a flat spectrum in diameter-major order."""
    if n_velocity == 1:
        return spectrum
    starts = F.sequence(F.lit(1), F.size(spectrum), F.lit(n_velocity))
    return F.transform(starts, lambda i: total(F.slice(spectrum, i, n_velocity)))


def longest_run(mask: Column) -> Column:
    """Length of the longest run of true entries."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(mask, zero, step, lambda acc: acc["best"])
