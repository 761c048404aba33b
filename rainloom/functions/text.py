"""What the texts of raw columns look like: tests and counts as expressions, and candidates for column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom import sensors

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(_NUMBER) | F.lower(F.trim(text)).isin("nan", "inf", "-inf"), F.lit(False))


def is_integer(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[+-]?\d+$"), F.lit(False))


def has_decimals(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"\.\d"), F.lit(False)) & is_number(text)


def decimal_digits(text: Column) -> Column:
    """Digits after the point; 0 of a text that is no number."""
    return F.when(has_decimals(text), F.length(F.regexp_extract(text, r"\.(\d*)", 1))).otherwise(0)


def natural_digits(text: Column) -> Column:
    """Digits before the point."""
    return F.when(is_number(text), F.length(F.regexp_extract(F.trim(text), r"^[+-]?(\d*)", 1))).otherwise(0)


def digits(text: Column) -> Column:
    return F.when(is_number(text), F.length(F.regexp_replace(text, r"\D", ""))).otherwise(0)


def characters(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0))


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: how often its texts are numbers, integers, have decimals, and the largest counts of digits and characters."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("t")) for c in df.columns]
    long = df.select(F.inline(F.array(*rows)))
    t = F.col("t")
    return long.groupBy("column").agg(
        F.count("t").alias("n"), F.count_if(is_number(t)).alias("numbers"), F.count_if(is_integer(t)).alias("integers"), F.count_if(has_decimals(t)).alias("with_decimals"),
        F.max(natural_digits(t)).alias("natural_digits"), F.max(decimal_digits(t)).alias("decimal_digits"), F.max(characters(t)).alias("characters"), F.count_distinct("t").alias("distinct"),
    )


def candidate_names(df: DataFrame, sensor: str) -> DataFrame:
    """column, candidates: the sensor's columns that the texts could be, by kind and by range of values."""
    ranges, kinds = sensors.data_ranges(sensor), sensors.l0a_dtypes(sensor)
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("t")) for c in df.columns]
    long = df.select(F.inline(F.array(*rows))).where("t is not null")
    seen = long.groupBy("column").agg(F.min(F.trim("t").try_cast("double")).alias("low"), F.max(F.trim("t").try_cast("double")).alias("high"), F.bool_and(is_number(F.col("t"))).alias("numeric"), F.max(F.length("t")).alias("length"))
    found = []
    for name, kind in kinds.items():
        if name.startswith("raw_drop"):
            fits = (F.col("length") > sensors.packed_sizes(sensor)[name]) & ~F.col("numeric")
        elif kind == "string":
            fits = F.lit(True)
        else:
            low, high = ranges.get(name, (float("-inf"), float("inf")))
            fits = F.col("numeric") & (F.col("low") >= low) & (F.col("high") <= high)
        found.append(F.when(fits, F.lit(name)))
    return seen.select("column", F.array_compact(F.array(*found)).alias("candidates"))
