"""Events: isolated times, sessions by gap, spikes of precipitation, runs of one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.operators.time_axis import carried, chunked, day_of, resolution_seconds, seconds


def _interval(resolution: str | int) -> int:
    return resolution if isinstance(resolution, int) else resolution_seconds(resolution)[0]


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def candidates(df: DataFrame, variable: str, threshold: float | None = None) -> DataFrame:
    """Rows whose variable is above the threshold, or true if there is none."""
    if threshold is None:
        return df.where(F.col(variable))
    value = F.col(variable).cast("double")
    return df.where(~F.isnan(value) & (value > float(threshold)))


def remove_isolated(df: DataFrame, neighbours: int, within: str | int, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Rows with at least ``neighbours`` others within the interval before or after, bounds included."""
    if neighbours <= 0:
        return df
    second = F.unix_micros(F.col("time").cast("timestamp"))
    reach = _interval(within) * 1_000_000
    window = Window.partitionBy(*keys, "_bucket").orderBy(second).rangeBetween(-reach, reach)
    counted = chunked(df.where("time is not null"), _interval(within)).withColumn("_n", F.count("*").over(window) - 1)
    return counted.where((F.col("_n") >= neighbours) & F.col("_core")).drop("_n", "_bucket", "_core")


def group_events(df: DataFrame, max_gap: str | int, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Adds ``event_id`` per key, from 1: a new event begins after a gap longer than ``max_gap``."""
    order = Window.partitionBy(*keys).orderBy("time")
    gap = _micros(F.col("time")) - _micros(F.lag("time").over(order))
    begins = F.when(gap.isNull() | (gap > _interval(max_gap) * 1_000_000), 1).otherwise(0)
    return df.withColumn("_new", begins).withColumn("event_id", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def event_table(df: DataFrame, max_gap: str | int = "6H", min_size: int = 0, min_duration: str | int = 0, neighbours: int = 0, within: str | int = 0, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """keys, event_id, start_time, end_time, duration_min, n_timesteps of candidate rows.

    Durations are whole minutes, rounded down, before they are compared. Only one row per event leaves
    the exchange; an empty input gives no events.
    """
    kept = remove_isolated(df.where("time is not null"), neighbours, within, keys)
    # Stretches without a gap within each day first; those of successive days are then joined, of which
    # there are few.
    daily = kept.select(*keys, "time", F.floor(seconds(F.col("time")) / 86_400).alias("_day"))
    stretches = group_events(daily, max_gap, [*keys, "_day"]).groupBy(*keys, "_day", "event_id").agg(F.min("time").alias("_a"), F.max("time").alias("_b"), F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_a")
    gap = _micros(F.col("_a")) - _micros(F.lag("_b").over(order))
    begins = stretches.withColumn("_new", F.when(gap.isNull() | (gap > _interval(max_gap) * 1_000_000), 1).otherwise(0))
    joined = begins.withColumn("event_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    events = joined.groupBy(*keys, "event_id").agg(F.min("_a").alias("start_time"), F.max("_b").alias("end_time"), F.sum("_n").alias("n_timesteps"))
    minutes = F.floor((seconds(F.col("end_time")) - seconds(F.col("start_time"))) / 60)
    events = events.withColumn("duration_min", minutes)
    least = _interval(min_duration) // 60
    return events.where((F.col("n_timesteps") >= min_size) & (F.col("duration_min") >= least))


def split_into_events(
    df: DataFrame, variable: str, threshold: float | None = None, neighbours: int = 2, within: str | int = "5MIN", max_gap: str | int = "6H",
    min_duration: str | int = "5MIN", min_size: int = 3, keys: Sequence[str] = ("station_id",), sort_by: Column | str | None = None, decreasing: bool = True,
) -> DataFrame:
    """All rows, candidates or not, that lie within an event, with its event_id, start, end, duration and rank.

    ``sort_by`` is a column of the event table or an aggregate over the event's rows; ``event_rank``
    counts in that order, else in time. Columns of ``df`` with the names of the added ones are dropped.
    """
    df = df.drop("event_id", "event_rank", "start_time", "end_time", "duration_min", "n_timesteps")
    events = event_table(candidates(df, variable, threshold), max_gap, min_size, min_duration, neighbours, within, keys)
    # Rows join their event by the day buckets it touches, an equality instead of a range comparison.
    day = lambda c: F.floor(seconds(c) / 86_400)
    spans = events.withColumn("_day", F.explode(F.sequence(day(F.col("start_time")), day(F.col("end_time")))))
    rows = df.withColumn("_day", day(F.col("time"))).join(spans, [*keys, "_day"]).where((F.col("time") >= F.col("start_time")) & (F.col("time") <= F.col("end_time"))).drop("_day")
    if sort_by is None:
        ranked = events.withColumn("event_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("start_time")))
    else:
        if isinstance(sort_by, str) and sort_by in events.columns:
            scored = events.withColumn("_score", F.col(sort_by))
        else:
            score = F.max(sort_by) if isinstance(sort_by, str) else sort_by
            scored = events.join(rows.groupBy(*keys, "event_id").agg(score.alias("_score")), [*keys, "event_id"])
        order = F.desc("_score") if decreasing else F.asc("_score")
        ranked = scored.withColumn("event_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "start_time")))
    return rows.join(ranked.select(*keys, "event_id", "event_rank"), [*keys, "event_id"])


def precipitation_spikes(df: DataFrame, hydrometeor: str, sample_interval: Column | int, keys: Sequence[str] = ("station_id",), reach_s: int = 60) -> DataFrame:
    """Adds ``flag_spikes``: 1 for precipitation whose neighbouring precipitation is over ``reach_s`` away on both sides.

    Intervals of two minutes and more are never flagged.
    """
    interval = sample_interval if isinstance(sample_interval, Column) else F.lit(sample_interval)
    # Only neighbours within the reach decide, so each day sees its margin and no more.
    parts = chunked(df, reach_s)
    wet = F.col(hydrometeor) >= 1
    second = F.when(wet, seconds(F.col("time")))
    window = Window.partitionBy(*keys, "_bucket")
    before = F.last(second, ignorenulls=True).over(window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(second, ignorenulls=True).over(window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, -1))
    alone = (before.isNull() | (second - before > reach_s)) & (after.isNull() | (after - second > reach_s))
    flagged = parts.withColumn("flag_spikes", F.when(wet & alone & (interval < 120), 1).otherwise(0))
    return flagged.where("_core").drop("_bucket", "_core")


def constant_runs(df: DataFrame, value: Column, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Adds ``run_id`` per key and ``run_length``: successive rows of one value (null and NaN are values)."""
    # Runs within each day; those of successive days that show one value are one run, told by a table
    # with one row per key and day.
    marked = df.withColumns({"_v": value, "_day": day_of(F.col("time"))})
    order = Window.partitionBy(*keys, "_day").orderBy("time")
    new = F.row_number().over(order) == 1
    marked = marked.withColumn("_c", (new | ~F.lag("_v").over(order).eqNullSafe(F.col("_v"))).cast("int"))
    marked = marked.withColumn("_r", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_day", "_r")))
    last = marked.groupBy(*keys, "_day").agg(F.max("_r").alias("_runs"), F.max(F.struct("_r", F.struct("_v").alias("v"), F.col("_n").alias("n"))).alias("_t"), F.min(F.struct("_r", F.struct("_v").alias("v"), F.col("_n").alias("n"))).alias("_h"))
    days = Window.partitionBy(*keys).orderBy("_day")
    linked = F.lag("_day").over(days).isNotNull() & F.lag("_t.v._v").over(days).eqNullSafe(F.col("_h.v._v"))
    table = last.withColumn("_linked", linked.cast("int"))
    upto = days.rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("_base", F.sum("_runs").over(upto) - F.col("_runs") - F.sum("_linked").over(upto))
    ends = F.array(F.struct((F.col("_base") + 1).alias("id"), F.col("_h.n").alias("n")), F.when(F.col("_runs") > 1, F.struct((F.col("_base") + F.col("_runs")).alias("id"), F.col("_t.n").alias("n"))))
    totals = table.select(*keys, "_day", F.inline(F.array_compact(ends))).withColumn("_total", F.sum("n").over(Window.partitionBy(*keys, "id")))
    totals = totals.groupBy(*keys, "_day").agg(F.min_by("_total", "id").alias("_head"), F.max_by("_total", "id").alias("_tail"))
    placed = marked.join(table.select(*keys, "_day", "_runs", "_base"), [*keys, "_day"]).join(totals, [*keys, "_day"])
    length = F.when(F.col("_r") == 1, F.col("_head")).when(F.col("_r") == F.col("_runs"), F.col("_tail")).otherwise(F.col("_n"))
    return placed.withColumns({"run_id": F.col("_base") + F.col("_r"), "run_length": length}).select(*df.columns, "run_id", "run_length")


def qc_temperature(df: DataFrame, temperature: str, sample_interval: Column | int, keys: Sequence[str] = ("station_id",), threshold_minutes: int = 360) -> DataFrame:
    """Adds ``qc_temperature``: 1 within a run of one rounded temperature of at least the threshold, 2 without any, else 0.

    Missing values take the last known one, at the start the next.
    """
    known = F.nanvl(F.col(temperature).cast("double"), F.lit(None).cast("double"))
    days = df.withColumn("_day", day_of(F.col("time")))
    filled = carried(carried(days, {"_f": known}, keys), {"_b": known}, keys, ahead=True)
    filled = filled.withColumn("_t", F.bround(F.coalesce("_f", "_b"), 0)).drop("_day")
    runs = constant_runs(filled, F.col("_t"), keys)
    interval = sample_interval if isinstance(sample_interval, Column) else F.lit(sample_interval)
    flag = F.when(F.col("_t").isNull(), 2).when(F.col("run_length") * interval >= threshold_minutes * 60, 1).otherwise(0)
    return runs.withColumn("qc_temperature", flag).drop("_f", "_b", "_t", "run_id", "run_length")


def _median(column: str) -> Column:
    return F.percentile(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), 0.5)


# Rain rates in mm/h above which minutes are counted.
RAIN_THRESHOLDS = (0.1, 1, 5, 10, 20, 50, 100)


def event_summary(df: DataFrame, resolution: str, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """One row per rain event (R > 0, gaps up to an hour): duration, minutes above rates, totals, means, medians and maxima."""
    accumulation = resolution_seconds(resolution)[0]
    minutes = accumulation / 60
    coarse = minutes >= 5
    rows = split_into_events(
        df.where(~F.isnan("R")), "R", 0.0, neighbours=1 if coarse else 2, within=accumulation if coarse else 300, max_gap=3600, min_duration=accumulation if coarse else 300, min_size=3, keys=keys
    ).where("R > 0")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    stats = []
    for c, digits in (("R", 2), ("Dm", 2), ("sigma_m", 2), ("LWC", 3)):
        stats += [F.bround(F.avg(number(c)), digits).alias(f"mean_{c}"), F.bround(_median(c), digits).alias(f"median_{c}"), F.bround(F.max(number(c)), digits).alias(f"max_{c}")]
    return rows.groupBy(*keys, "start_time", "end_time").agg(
        (F.max("duration_min") + F.lit(minutes)).cast("int").alias("duration"),
        *[(F.count_if(F.col("R") > t) * F.lit(minutes)).cast("int").alias(f"rainy_minutes_>{t}") for t in RAIN_THRESHOLDS],
        F.bround(F.sum(number("P")), 3).alias("P_total"),
        *stats,
        F.bround(F.max(number("Dmax")), 2).alias("max_Dmax"),
        F.bround(F.max(number("Z")), 2).alias("max_Z"),
        F.floor(F.avg(number("Nbins"))).cast("int").alias("mean_Nbins"),
        F.max(number("Nbins")).cast("int").alias("max_Nbins"),
    )


def phase_summary(df: DataFrame, variable: str = "n_particles", threshold: float = 4, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """One row per particle event: counts and shares of rain, snow, mixed and undefined steps, hail and graupel."""
    rows = split_into_events(df, variable, threshold, neighbours=2, within="5MIN", max_gap="1H", min_duration="20MIN", min_size=5, keys=keys)
    phase = F.col("precipitation_type")
    counts = {"n_rainy": phase == 0, "n_snow": phase == 1, "n_mixed": phase == 2, "n_precip": phase >= 0, "n_undefined": phase == -2, "n_small_hail": F.col("flag_hail") == 1, "n_large_hail": F.col("flag_hail") == 2, "n_graupel": F.col("hydrometeor_type") == 8}
    table = rows.groupBy(*keys, "start_time", "end_time").agg(F.count("*").alias("n"), F.sum(variable).alias("total_particles"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    share = lambda n, d: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), A.nan())
    hours = (seconds(F.col("end_time")) - seconds(F.col("start_time"))) / 3600
    return table.withColumns(
        {"duration_hours": hours, "fraction_precip": share("n_precip", "n"), "fraction_rain": share("n_rainy", "n_precip"), "fraction_snow": share("n_snow", "n_precip"), "fraction_mixed": share("n_mixed", "n_precip"), "fraction_undefined": share("n_undefined", "n_precip")}
    ).drop("n")
