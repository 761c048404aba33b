"""Raw telegram tables to clean L0A tables, and their packed spectra to arrays (L0B)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.session import staged

SPECTRUM_COLUMNS = ("raw_drop_number", "raw_drop_concentration", "raw_drop_average_velocity")
PLACE_COLUMNS = ("latitude", "longitude", "altitude")
KEY_COLUMNS = ("time", "station_id", *PLACE_COLUMNS)


def remove_missing_time(df: DataFrame) -> DataFrame:
    return df.where(F.col("time").isNotNull())


def remove_duplicated_times(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each time per ``keys``, in the order of ``order`` (file and line, arrival)."""
    window = Window.partitionBy(*keys, "time").orderBy(*order)
    return df.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def drop_times(df: DataFrame, times: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose time is not listed in ``times`` (columns ``keys`` and time)."""
    return df.join(times.select(*keys, "time").where("time is not null").distinct(), [*keys, "time"], "left_anti")


def drop_periods(df: DataFrame, periods: DataFrame, keys: Sequence[str] = (), bucket_s: int = 86_400) -> DataFrame:
    """Rows outside all closed periods [start, end] of ``periods`` (columns ``keys``, start, end).

    Periods are cut at multiples of ``bucket_s``, so that the anti-join is an equality on keys and bucket
    with the bounds as a remaining condition, instead of a comparison of every row with every period.
    """

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(bucket_s * 1_000_000))

    cut = periods.where("start is not null and end is not null and start <= end").select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("_p_bucket")
    )
    marked = df.withColumn("_bucket", bucket(F.col("time")))
    same = [F.col(k) == F.col(f"_p_{k}") for k in keys]
    inside = reduce(lambda a, b: a & b, [*same, F.col("_bucket") == F.col("_p_bucket"), F.col("time") >= F.col("_start"), F.col("time") <= F.col("_end")])
    return marked.join(cut, inside, "left_anti").drop("_bucket")


def remove_issues(df: DataFrame, times: DataFrame | None = None, periods: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Without the listed times and periods."""
    df = df if times is None else drop_times(df, times, keys)
    return df if periods is None else drop_periods(df, periods, keys)


def coerced(df: DataFrame, sensor: str) -> DataFrame:
    """Number columns as doubles; what is no number is NaN."""
    numbers = [c for c, k in sensors.l0a_dtypes(sensor).items() if k == "float" and c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), A.nan()) for c in numbers})


def stripped(df: DataFrame, sensor: str) -> DataFrame:
    texts = [c for c, k in sensors.l0a_dtypes(sensor).items() if k == "string" and c in df.columns]
    return df.withColumns({c: F.trim(F.col(c)) for c in texts})


def delimiter(text: Column) -> Column:
    """The separator of a packed list: the more frequent of semicolon and comma, null if it has neither."""
    semicolons, commas = F.length(F.regexp_replace(text, "[^;]", "")), F.length(F.regexp_replace(text, "[^,]", ""))
    counts = F.struct(semicolons.alias("s"), commas.alias("c"))
    return A.let(counts, lambda n: F.when((n["s"] == 0) & (n["c"] == 0), F.lit(None).cast("string")).when(n["s"] >= n["c"], ";").otherwise(","))


def strip_delimiter(text: Column) -> Column:
    """Without separators at either end."""
    return A.let(F.struct(text.alias("t"), delimiter(text).alias("d")), lambda p: F.when(p["d"] == ";", F.regexp_replace(p["t"], "^;+|;+$", "")).when(p["d"] == ",", F.regexp_replace(p["t"], "^,+|,+$", "")).otherwise(p["t"]))


def _entries(text: Column) -> Column:
    return A.let(F.struct(text.alias("t"), delimiter(text).alias("d")), lambda p: F.when(p["d"].isNull(), F.array(p["t"])).when(p["d"] == ";", F.split(p["t"], ";")).otherwise(F.split(p["t"], ",")))


def is_sound_list(text: Column) -> Column:
    """All entries are numbers, empty or NaN; null is not sound."""
    sound = F.forall(_entries(text), lambda x: F.trim(x).isin("", "NaN", "NAN") | F.trim(x).try_cast("double").isNotNull())
    return F.coalesce(sound, F.lit(False))


def remove_corrupted_rows(df: DataFrame) -> DataFrame:
    """Rows whose packed lists are all sound."""
    present = [c for c in SPECTRUM_COLUMNS if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, [is_sound_list(F.col(c)) for c in present])) if present else df


def cast_columns(df: DataFrame, sensor: str) -> DataFrame:
    """L0A types; time in whole seconds, places as doubles. A value of another type raises, naming the column's cast."""
    kinds = {c: k for c, k in sensors.l0a_dtypes(sensor).items() if c in df.columns}
    casts = {c: F.col(c).cast(k) for c, k in kinds.items()} | {c: F.col(c).cast("double") for c in PLACE_COLUMNS if c in df.columns}
    return df.withColumns(casts | {"time": F.date_trunc("second", F.col("time"))})


def without_flag(value: Column, flags: Sequence[float]) -> Column:
    """NaN where the value is close to a flag."""
    near = reduce(lambda a, b: a | b, [F.abs(value - F.lit(float(f))) <= 1e-8 + 1e-5 * abs(f) for f in flags])
    return F.when(near, A.nan()).otherwise(value)


def replace_flags(df: DataFrame, sensor: str) -> DataFrame:
    """Values that mean "none": numbers become NaN, texts the text NaN."""
    numbers = {c: without_flag(F.col(c), f) for c, f in sensors.nan_flags(sensor).items() if c in df.columns}
    texts = {c: F.when(F.col(c).isin(*f), F.lit("NaN")).otherwise(F.col(c)) for c, f in sensors.TEXT_FLAGS.get(sensor, {}).items() if c in df.columns and dict(df.dtypes)[c] == "string"}
    return df.withColumns(numbers | texts)


def replace_custom_flags(df: DataFrame, flags: dict[str, Sequence[float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(*f), A.nan()).otherwise(F.col(c)) for c, f in flags.items() if c in df.columns})


def within_range(value: Column, low: float, high: float) -> Column:
    """NaN outside [low, high]; NaN stays. NaN is above every number in Spark and must be kept apart."""
    return F.when(F.isnan(value) | value.between(float(low), float(high)), value).otherwise(A.nan())


def mask_out_of_range(df: DataFrame, sensor: str) -> DataFrame:
    return df.withColumns({c: within_range(F.col(c), *r) for c, r in sensors.data_ranges(sensor).items() if c in df.columns})


def mask_invalid_values(df: DataFrame, sensor: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(*v), F.col(c)).otherwise(A.nan()) for c, v in sensors.valid_values(sensor).items() if c in df.columns})


def array_within_range(array: Column, low: float, high: float) -> Column:
    return F.transform(array, lambda x: within_range(x, low, high))


def array_without_flags(array: Column, flags: Sequence[float]) -> Column:
    return F.transform(array, lambda x: without_flag(x, flags))


def array_valid_values(array: Column, valid: Sequence[float]) -> Column:
    return F.transform(array, lambda x: F.when(x.isin(*[float(v) for v in valid]), x).otherwise(A.nan()))


def check_columns(columns: Sequence[str], sensor: str, needs_spectrum: bool = True) -> None:
    """Raises for columns that the sensor's tables do not have, and for missing time or spectrum."""
    unknown = sorted(set(columns) - set(sensors.columns(sensor)) - set(KEY_COLUMNS))
    if unknown:
        raise ValueError(f"unknown columns for {sensor}: {', '.join(unknown)}")
    missing = {"time"} | ({"raw_drop_number"} if needs_spectrum else set())
    if missing - set(columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing - set(columns)))}")


def standard_violations(df: DataFrame, sensor: str) -> DataFrame:
    """Number of values outside the sensor's ranges: column, n_violations; one row per checked column."""
    ranges = {c: r for c, r in sensors.data_ranges(sensor).items() if c in df.columns}
    if not ranges:
        return df.sparkSession.createDataFrame([], "column string, n_violations bigint")
    # Bounds are compared in the column's type: as a double, a float's nearest value to a bound may lie beyond it.
    kinds = dict(df.dtypes)
    bound = lambda c, x: F.lit(x).cast("float" if kinds[c] == "float" else "double")
    counted = df.agg(*[F.count_if(~F.isnan(c) & ~F.col(c).between(bound(c, r[0]), bound(c, r[1]))).alias(c) for c, r in ranges.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_violations")) for c in ranges])))


def sanitize(df: DataFrame, sensor: str, keys: Sequence[str] = ("station_id",), order: Sequence[str] = ("time",), issue_times: DataFrame | None = None, issue_periods: DataFrame | None = None) -> DataFrame:
    """The whole chain from strings to a clean L0A table.

    Null times go, of repeated times the first row stays, then issues go, numbers are coerced, texts and
    lists stripped, rows with broken lists dropped, types cast, flags, ranges and valid values applied.
    The only exchanges are that of the repeated times and, if given, of the issues.
    """
    df = remove_duplicated_times(remove_missing_time(df), keys, order)
    df = remove_issues(df, issue_times, issue_periods, keys)
    df = stripped(coerced(df, sensor), sensor)
    # A step of its own: the optimiser would else copy the stripping into each of the tests that follow.
    df = staged(df, {c: strip_delimiter(F.col(c)) for c in SPECTRUM_COLUMNS if c in df.columns})
    df = cast_columns(remove_corrupted_rows(df), sensor)
    return mask_invalid_values(mask_out_of_range(replace_flags(df, sensor), sensor), sensor)


# --- packed spectra to arrays ---------------------------------------------------------------------------


def parse_list(text: Column, n: int) -> Column:
    """A packed list as an array of n doubles.

    Empty and "0" are zeros, "NaN" and a wrong number of entries NaN, an empty entry 0.
    """
    zeros, missing = F.array_repeat(F.lit(0.0), n), F.array_repeat(A.nan(), n)
    entries = F.transform(_entries(strip_delimiter(text)), lambda x: F.when(F.trim(x) == "", 0.0).otherwise(F.coalesce(F.trim(x).try_cast("double"), A.nan())))
    parsed = A.let(entries, lambda e: F.when(F.size(e) == n, e).otherwise(missing))
    return F.when(F.trim(text).isin("", "0"), zeros).when(text.isNull() | (F.upper(F.trim(text)) == "NAN"), missing).otherwise(parsed)


def diameter_major(flat: Column, sensor: str) -> Column:
    """A list in the sensor's order as a flat array with the velocity bins of a diameter side by side."""
    if sensors.LIST_ORDER[sensor] != "VD":
        return flat
    n_d, n_v = len(sensors.diameter_bins(sensor)), len(sensors.velocity_bins(sensor))
    # Entry (d, v) of the result is entry v * n_d + d of the list.
    return A.let(flat, lambda f: F.transform(F.sequence(F.lit(0), F.lit(n_d * n_v - 1)), lambda i: F.element_at(f, (i % n_v * n_d + F.floor(i / n_v) + 1).cast("int"))))


def spectrum_matrix(flat: Column, n_velocity: int) -> Column:
    """A flat spectrum as an array of one array per diameter."""
    return F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(n_velocity)), lambda i: F.slice(flat, i, n_velocity))


def spectra(df: DataFrame, sensor: str) -> DataFrame:
    """Packed columns as arrays; logarithmic PARSIVEL concentrations become linear, -9.999 becomes 0."""
    out = {}
    for c, n in sensors.packed_sizes(sensor).items():
        if c not in df.columns:
            continue
        parsed = parse_list(F.col(c), n)
        if c == "raw_drop_number":
            parsed = diameter_major(parsed, sensor)
        if c == "raw_drop_concentration":
            parsed = F.transform(parsed, lambda x: F.when(F.abs(x + 9.999) < 1e-9, 0.0).otherwise(F.pow(F.lit(10.0), x)))
        out[c] = parsed
    return staged(df, out) if out else df


def valid_place(value: Column, low: float, high: float, errors: str = "coerce") -> Column:
    """A coordinate within its bounds; else null ("coerce"), an error ("raise") or itself ("ignore")."""
    if errors == "ignore":
        return value
    inside = value.isNull() | F.isnan(value) | value.between(low, high)
    return F.when(inside, value) if errors == "coerce" else F.when(inside, value).otherwise(F.raise_error(F.lit("coordinate out of bounds")).cast("double"))


def generate_l0b(df: DataFrame, sensor: str, stations: DataFrame | None = None) -> DataFrame:
    """An L0A table with arrays, sensor_name and the station's valid place."""
    df = spectra(df, sensor).withColumn("sensor_name", F.lit(sensor))
    if stations is None:
        return df
    bounds = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "altitude": (-450.0, 9000.0)}
    places = stations.dropDuplicates(["station_id"]).select("station_id", *[valid_place(F.col(c).cast("double"), *b).alias(c) for c, b in bounds.items()])
    return df.drop(*PLACE_COLUMNS).join(places, "station_id", "left")


def standardized(df: DataFrame, names: dict[str, str], sensor: str) -> DataFrame:
    """Raw arrays of another archive: renamed, cut to the sensor's columns, missing ones added as NaN or null."""
    renamed = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if "raw_drop_number" not in renamed.columns:
        raise ValueError("no column becomes raw_drop_number")
    kinds = sensors.l0a_dtypes(sensor)
    added = {c: A.nan() if kinds[c] == "float" else F.lit(None).cast("string") for c in names.values() if c in kinds and c not in renamed.columns}
    full = renamed.withColumns(added)
    return full.select(*[c for c in full.columns if c in kinds or c in KEY_COLUMNS])
