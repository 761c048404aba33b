"""Aggregation over time: tumbling and rolling intervals with a quality weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.operators.time_axis import chunked, fill_grid, from_seconds, resolution_seconds, seconds

TEMPERATURES = ("air_temperature", "air_temperature_min", "temperature_ambient", "temperature_interior", "sensor_temperature")
# How the known variables are aggregated.
AVERAGED = ("fall_velocity",)
SUMMED = ("raw_drop_number", "raw_particle_counts", "drop_number", "drop_counts", "drop_number_concentration", "raw_drop_counts", "N", "Nraw", "Nremoved")
SMALLEST = ("Dmin", *TEMPERATURES)
LARGEST = ("Dmax", "qc_time", "precip_flag", *(c for c in sensors.WEATHER_COLUMNS if c not in TEMPERATURES))
SPECTRA = ("drop_number", "raw_drop_number", "drop_counts", "raw_drop_counts", "drop_number_concentration", "raw_particle_counts")


def window_rows(sample_interval: int, accumulation: int) -> int:
    """Rows of a rolling window."""
    if accumulation < sample_interval:
        raise ValueError("the accumulation interval is shorter than the sample interval")
    if accumulation % sample_interval:
        raise ValueError("the accumulation interval is no multiple of the sample interval")
    return accumulation // sample_interval


def _is_array(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("array")


def _missing(df: DataFrame, column: str) -> Column:
    """Whether a value, or any entry of an array, is missing."""
    if _is_array(df, column):
        return F.coalesce(A.any_missing(F.col(column)), F.lit(True))
    return F.col(column).isNull() | F.isnan(F.col(column).cast("double"))


def qc_share(weights: Column, expected: float) -> Column:
    """Share of missing time steps, to one digit, halves to even."""
    return F.bround(1 - weights / F.lit(float(expected)), 1)


def _aggregate(df: DataFrame, column: str, how: str, over) -> Column:
    """One variable over a group or window; a missing value makes the result NaN."""
    c = F.col(column).cast("double")
    number = F.when(c.isNull(), A.nan()).otherwise(c)
    plain = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](number)
    if how == "min":  # the smallest of numbers and NaN is a number in Spark
        return F.when(over(F.max(F.isnan(number))), A.nan()).otherwise(over(plain))
    return over(plain)


def _plan(df: DataFrame, average: Sequence[str], cumulate: Sequence[str], largest: Sequence[str], smallest: Sequence[str]) -> dict[str, str]:
    asked = [*average, *cumulate, *largest, *smallest]
    unknown = [c for c in asked if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    plan: dict[str, str] = {}
    for how, names in (("mean", (*AVERAGED, *average)), ("sum", (*SUMMED, *cumulate)), ("min", (*SMALLEST, *smallest)), ("max", (*LARGEST, *largest))):
        plan |= {c: how for c in names if c in df.columns}
    return plan


def resample(
    df: DataFrame, sample_interval: int, resolution: str, keys: Sequence[str] = ("station_id",), time_is_end: bool = True,
    average: Sequence[str] = (), cumulate: Sequence[str] = (), largest: Sequence[str] = (), smallest: Sequence[str] = (),
) -> DataFrame:
    """Variables over intervals of ``resolution`` ("5MIN", or rolling "ROLL5MIN"), labelled by the interval's end or start.

    Known variables are averaged, summed, or their smallest or largest taken; others by the arguments.
    Rows with a missing entry in a spectrum count as empty with weight 0. ``qc_resampling`` is the share of
    missing steps; where it is 1 all variables are NaN. Array sums are taken bin by bin. Extra columns are
    dropped. Equal resolution and sample interval return the input with weights only.
    """
    accumulation, rolling = resolution_seconds(resolution)
    n = window_rows(sample_interval, accumulation)
    plan = _plan(df, average, cumulate, largest, smallest)
    if n == 1:
        return df.withColumns({"qc_resampling": F.lit(0.0), "sample_interval": F.lit(accumulation)})
    bad = F.lit(False)
    for c in SPECTRA:
        if c in df.columns:
            bad = bad | _missing(df, c)
    marked = df.withColumn("_bad", bad)
    spectra = [c for c in SPECTRA if c in df.columns]
    cleaned = {c: F.when(F.col("_bad"), A.constant(F.col(c), 0.0) if _is_array(df, c) else F.lit(0.0)).otherwise(F.col(c)) for c in spectra}
    marked = marked.withColumns(cleaned | {"_weight": F.when(F.col("_bad"), 0.0).otherwise(1.0)}).select(*keys, "time", "_weight", *plan)
    shift = sample_interval if time_is_end else 0
    arrays = [c for c in plan if _is_array(df, c)]
    scalars = [c for c in plan if c not in arrays]
    if rolling:
        out = _rolling(marked, plan, scalars, arrays, sample_interval, n, keys)
        label = F.col("_s") - (n - 1) * sample_interval - shift + (accumulation if time_is_end else 0)
    else:
        out = _tumbling(marked, plan, scalars, arrays, accumulation, shift, keys)
        label = F.col("_s") + (accumulation if time_is_end else 0)
        # The first and last interval of a key hold fewer steps than others: those from its first to its last time.
        spans = marked.groupBy(*keys).agg((F.min(seconds(F.col("time"))) - shift).alias("_a"), (F.max(seconds(F.col("time"))) - shift).alias("_b"))
        steps = (F.least(F.col("_s") + accumulation - sample_interval, F.col("_b")) - F.greatest("_s", "_a")) / sample_interval + 1
        out = out.join(spans, list(keys)).withColumn("_expected", steps).drop("_a", "_b")
    # Steps that are absent within are missing: they spread NaN into sums, as a filled grid would.
    whole = F.col("_rows") == (F.lit(n) if rolling else F.col("_expected"))
    values = {c: F.when(whole & (F.col("qc_resampling") != 1), F.col(c)).otherwise(A.constant(F.col(c), float("nan")) if c in arrays else A.nan()) for c in plan}
    out = out.withColumns({"qc_resampling": qc_share(F.col("_weight"), n), "time": from_seconds(label)})
    return out.withColumns(values | {"sample_interval": F.lit(accumulation)}).select(*keys, "time", *plan, "qc_resampling", "sample_interval")


def _tumbling(df: DataFrame, plan, scalars, arrays, accumulation: int, shift: int, keys) -> DataFrame:
    start = F.floor((seconds(F.col("time")) - shift) / accumulation).cast("long") * accumulation
    placed = df.withColumn("_s", start)
    same = lambda c: c
    grouped = placed.groupBy(*keys, "_s").agg(F.sum("_weight").alias("_weight"), F.count("*").alias("_rows"), *[_aggregate(df, c, plan[c], same).alias(c) for c in scalars])
    for c in arrays:
        # Bin by bin: sums combine before the exchange, so no array of arrays is gathered.
        bins = placed.select(*keys, "_s", F.posexplode(c).alias("_pos", "_x")).groupBy(*keys, "_s", "_pos").agg(F.sum("_x").alias("_x"), F.avg("_x").alias("_m"))
        ordered = bins.groupBy(*keys, "_s").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", ("_x" if plan[c] == "sum" else "_m")))), lambda p: p["_x" if plan[c] == "sum" else "_m"]).alias(c))
        grouped = grouped.join(ordered, [*keys, "_s"], "left")
    return grouped


def _rolling(df: DataFrame, plan, scalars, arrays, step: int, n: int, keys) -> DataFrame:
    grid = fill_grid(df, step, keys).withColumn("_s", seconds(F.col("time")))
    present = F.col("_weight").isNotNull()
    grid = grid.withColumns({"_here": present.cast("int"), "_weight": F.coalesce("_weight", F.lit(0.0))})
    # Each day with the steps before it that its windows reach back to.
    grid = chunked(grid, (n - 1) * step)
    window = Window.partitionBy(*keys, "_bucket").orderBy("_s").rowsBetween(-(n - 1), 0)
    over = lambda c: c.over(window)
    sums = {c: over(F.collect_list(F.col(c))) for c in arrays}
    out = grid.select(*keys, "_s", "_core", over(F.sum("_weight")).alias("_weight"), over(F.sum("_here")).alias("_rows"), over(F.count("*")).alias("_all"), *[_aggregate(df, c, plan[c], over).alias(c) for c in scalars], *[v.alias(c) for c, v in sums.items()])
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    start = F.array().cast("array<double>")
    summed = {c: F.aggregate(F.col(c), start, add) for c in arrays}
    means = {c: F.transform(v, lambda x: x / n) for c, v in summed.items() if plan[c] == "mean"}
    return out.withColumns(summed | means).where(F.col("_core") & (F.col("_all") == n)).drop("_core")
