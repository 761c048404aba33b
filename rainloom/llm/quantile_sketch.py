"""Percentiles of very large columns from mergeable sketches with bounded relative error.

A value falls in a signed logarithmic bucket of fixed relative width; a sketch is the table of bucket
counts. Sketches of partitions, days or files merge by adding the counts of equal buckets, and a
percentile read from the added counts is within ``accuracy`` of a value of that rank, whatever was
merged. Counting is an ordinary aggregation with partial counts before the shuffle, so that what moves
is bounded by groups times buckets, and a group with a third of all rows costs no task more than another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a percentile.
ACCURACY = 0.01
#: Distance of the first positive bucket from zero; more than any double needs.
_BIAS = 1 << 20
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def sketch(df: DataFrame, keys: Sequence[str], fields: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """Bucket counts: the keys, field, bucket, n. Buckets sort as their values do; zero is bucket 0.

    Null, NaN and infinite values do not count; a group without any other value of a field has no rows
    for it. Null keys are groups of their own. Repeated rows count each. Other columns are dropped.
    """
    step = math.log(_gamma(accuracy))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields]))
    values = df.select(*keys, pairs.alias("p")).select(*keys, "p.field", "p.x").where("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    size = F.ceil(F.log(F.abs("x")) / F.lit(step)) + _BIAS
    bucket = F.when(F.col("x") == 0, 0).when(F.col("x") > 0, size).otherwise(-size)
    return values.groupBy(*keys, "field", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketch per ``keys`` of all rows of ``sketches``: counts of equal buckets add up."""
    return sketches.groupBy(*keys, "field", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], percents: Sequence[float] = PERCENTILES, accuracy: float = ACCURACY) -> DataFrame:
    """One row per keys and field: n and p01, p05 ... of ``percents``.

    The value of rank floor(q * (n - 1)) from 0 lies within ``accuracy`` of the result; zeros are exact.
    """
    gamma = _gamma(accuracy)
    group = [*keys, "field"]
    order = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    counted = sketches.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.signum("bucket") * 2 * F.pow(F.lit(gamma), F.abs("bucket") - _BIAS) / (gamma + 1))
    counted = counted.withColumn("value", value)
    found = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), F.struct("bucket", "value")))["value"].alias(f"p{round(q * 100):02d}") for q in percents]
    return counted.groupBy(*group).agg(F.max("total").alias("n"), *found)
