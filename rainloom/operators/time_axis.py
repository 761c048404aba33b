"""The time axis of a station (L0C): intervals, repeated and shifted times, gaps, calendar blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Quality flags of a time.
GOOD, PREVIOUS_MISSING, NEXT_MISSING, ISOLATED, SOLVED_DUPLICATE, DROPPED_DUPLICATE = range(6)
#: Seconds read beyond a block at either side.
BLOCK_TOLERANCE_S = 180
_UNITS = {"D": 86_400, "H": 3_600, "MIN": 60, "S": 1}


def resolution_seconds(resolution: str) -> tuple[int, bool]:
    """Seconds of "1H30MIN" or "ROLL5MIN", and whether it rolls."""
    text = resolution.strip().upper()
    rolling = text.startswith("ROLL")
    body = text[4:] if rolling else text
    parts = re.findall(r"(\d+)(D|H|MIN|S)", body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"{resolution} is no temporal resolution")
    return sum(int(n) * _UNITS[u] for n, u in parts), rolling


def seconds_resolution(seconds: int) -> str:
    """The resolution text of a number of seconds."""
    if seconds <= 0 or seconds != int(seconds):
        raise ValueError("a resolution is a positive number of whole seconds")
    out, rest = "", int(seconds)
    for unit, size in _UNITS.items():
        n, rest = divmod(rest, size)
        out += f"{n}{unit}" if n else ""
    return out


def seconds(time: Column) -> Column:
    """Whole seconds since 1970-01-01, down."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def from_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value)


def whole_seconds(interval: Column) -> Column:
    """An interval as an integer; a fraction of a second is an error."""
    number = interval.cast("double")
    return F.when(number.isNull() | (number == F.floor(number)), number.cast("int")).otherwise(F.raise_error(F.lit("interval is not in whole seconds")).cast("int"))


def chunked(df: DataFrame, margin_s: int, bucket_s: int | None = None, time: str = "time") -> DataFrame:
    """Rows with ``_bucket`` (a stretch of time) and ``_core``; rows within the margin of a neighbouring bucket are also in that, not as core.

    A window keyed by bucket then sees all neighbours within the margin, and a key that holds a third of
    all rows is spread over its buckets instead of being sorted by one task.
    """
    width = bucket_s or max(86_400, 4 * margin_s)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    wide, reach = width * 1_000_000, margin_s * 1_000_000
    own = F.floor(at / F.lit(wide))
    spread = F.explode(F.sequence(F.floor((at - reach) / F.lit(wide)), F.floor((at + reach) / F.lit(wide))))
    return df.withColumn("_bucket", spread).withColumn("_core", F.col("_bucket") == own)


def day_of(time: Column) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(86_400_000_000))


def carried(df: DataFrame, values: dict[str, Column], keys: Sequence[str], ahead: bool = False, day: str = "_day") -> DataFrame:
    """Adds for each named value the last known one at or before a row, or with ``ahead`` the first at or after it.

    Looks within the row's day, then into a table with one row per key and day of what each day knows
    first and last; so a key's series is never one sort. ``df`` has the column ``day``.
    """
    named = {f"_in_{n}": v for n, v in values.items()}
    order = Window.partitionBy(*keys, day).orderBy(F.desc("time") if ahead else F.asc("time")).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumns(named)
    local = marked.withColumns({f"_own_{n}": F.last(f"_in_{n}", ignorenulls=True).over(order) for n in values})
    pick = F.min_by if ahead else F.max_by
    edges = marked.groupBy(*keys, day).agg(*[pick(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), F.col("time"))).alias(f"_edge_{n}") for n in values])
    days = Window.partitionBy(*keys).orderBy(F.desc(day) if ahead else F.asc(day)).rowsBetween(Window.unboundedPreceding, -1)
    beyond = edges.select(*keys, day, *[F.last(f"_edge_{n}", ignorenulls=True).over(days).alias(f"_far_{n}") for n in values])
    joined = local.join(beyond, [*keys, day], "left")
    out = joined.withColumns({n: F.coalesce(f"_own_{n}", f"_far_{n}") for n in values})
    return out.drop(*[f"{p}{n}" for n in values for p in ("_in_", "_own_", "_far_")])


def keep_intervals(df: DataFrame, intervals: Sequence[int]) -> DataFrame:
    """Rows whose logged sample_interval is one of the expected."""
    return df.where(F.col("sample_interval").isin(*[int(i) for i in intervals]))


def resolve_duplicates(df: DataFrame, keys: Sequence[str] = ("station_id",), spectrum: str = "raw_drop_number", all_equal: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Repeated times: none stays if their spectra, or with ``all_equal`` any other columns, differ; else the first."""
    others = [c for c in df.columns if c not in (*keys, "time", spectrum, *order)]
    whole = Window.partitionBy(*keys, "time")
    ranked = Window.partitionBy(*keys, "time").orderBy(*(order or (spectrum,)))
    # NaN equals NaN and null equals null in a packed hash of the values.
    marks = {"_same": F.min(F.xxhash64(spectrum)).over(whole) == F.max(F.xxhash64(spectrum)).over(whole), "_k": F.row_number().over(ranked)}
    if others and all_equal:
        print_ = F.xxhash64(*others)
        marks["_equal"] = F.min(print_).over(whole) == F.max(print_).over(whole)
    marked = df.withColumns(marks)
    return marked.where(F.col("_same") & F.col("_equal") & (F.col("_k") == 1) if "_equal" in marks else F.col("_same") & (F.col("_k") == 1)).drop(*marks)


def nearest_slot(second: Column, start: Column | int, step: Column | int) -> Column:
    """The slot nearest to a second; half way the earlier one."""
    steps = F.ceil((second - start) / step - F.lit(0.5))
    return (start + steps * step).cast("long")


def interval_histogram(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """keys, dt, n, share: how often successive times are dt seconds apart.

    Distances are taken within days, and between the last and first time of successive days.
    """
    timed = df.where("time is not null").select(*keys, seconds(F.col("time")).alias("_s")).withColumn("_day", F.floor(F.col("_s") / 86_400))
    within = timed.withColumn("dt", F.col("_s") - F.lag("_s").over(Window.partitionBy(*keys, "_day").orderBy("_s"))).where("dt is not null").groupBy(*keys, "dt").agg(F.count("*").alias("n"))
    ends = timed.groupBy(*keys, "_day").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    between = ends.select(*keys, (F.col("_a") - F.lag("_b").over(Window.partitionBy(*keys).orderBy("_day"))).alias("dt")).where("dt is not null").groupBy(*keys, "dt").agg(F.count("*").alias("n"))
    counts = within.unionByName(between).groupBy(*keys, "dt").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def infer_interval(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """keys, sample_interval, share: the most frequent distance rounded to 5 s, of equally frequent ones the shortest."""
    rounded = interval_histogram(df, keys).withColumn("dt", (F.bround(F.col("dt") / 5) * 5).cast("int")).groupBy(*keys, "dt").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    best = rounded.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("dt")).alias("m"), "share")).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("sample_interval"), F.col("b.share").alias("share"))


def interval_warnings(df: DataFrame, expected: int, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """keys, warning: expected interval in under 60 %, another more frequent, an unexpected one in over 5 %."""
    shares = interval_histogram(df, keys)
    per_key = shares.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("dt") == expected, F.col("share"))), F.lit(0.0)).alias("expected_share"),
        (-F.max(F.struct("n", (-F.col("dt")).alias("m")))["m"]).alias("mode"),
        F.count_if((F.col("dt") != expected) & (F.bround(F.col("share") * 100, 2) > 5)).alias("frequent"),
    )
    texts = F.array_compact(
        F.array(
            F.when(F.bround(F.col("expected_share") * 100, 2) < 60, F.lit("expected interval is rare")),
            F.when(F.col("mode") != expected, F.lit("another interval is more frequent")),
            F.when(F.col("frequent") > 0, F.lit("unexpected intervals are frequent")),
        )
    )
    return per_key.select(*keys, F.explode(texts).alias("warning"))


def time_bounds(time: Column, interval: Column) -> Column:
    """[time - interval, time] as a struct of start and end."""
    stop = seconds(time)
    return F.struct(from_seconds(stop - interval).alias("start"), from_seconds(stop).alias("end"))


def problem_slots(slots: DataFrame, step: int, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Adds ``flag`` to distinct ``slot`` seconds: previous slot missing, next missing, both, or none.

    The first slot never lacks its previous one, the last never its next.
    """
    order = Window.partitionBy(*keys).orderBy("slot")
    before, after = F.lag("slot").over(order), F.lead("slot").over(order)
    no_before, no_after = before.isNotNull() & (F.col("slot") - before != step), after.isNotNull() & (after - F.col("slot") != step)
    return slots.withColumn("flag", F.when(no_before & no_after, ISOLATED).when(no_after, NEXT_MISSING).when(no_before, PREVIOUS_MISSING).otherwise(GOOD))


def _regular(times: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, flag and whether to keep, of sorted times in seconds."""
    start = times[0] // step * step
    slot = start + np.ceil((times - start) / step - 0.5).astype(np.int64) * step
    flag = np.zeros(len(slot), np.int64)
    keep = np.ones(len(slot), bool)
    taken, first, count = np.unique(slot, return_index=True, return_counts=True)
    occupied = dict(zip(taken.tolist(), count.tolist()))
    for value, a, n in zip(taken[count > 1].tolist(), first[count > 1].tolist(), count[count > 1].tolist()):
        # Earlier groups may have moved a reading here since, which counts as one more.
        rows = np.flatnonzero(slot == value) if occupied.get(value) != n else np.arange(a, a + n)
        n, moved = len(rows), 0
        free_before, free_after = value - step not in occupied, value + step not in occupied
        if n in (2, 3) and free_before:
            moved += _move(slot, flag, occupied, rows[0], value - step)
        if (n == 2 and not free_before and free_after) or (n == 3 and free_after):
            moved += _move(slot, flag, occupied, rows[-1], value + step)
        if moved != n - 1:
            keep[rows[:-1]] = False
            flag[rows[-1]] = DROPPED_DUPLICATE
    present = np.array(sorted(set(slot.tolist())))
    lacks_before = ~np.isin(slot - step, present)
    lacks_after = ~np.isin(slot + step, present)
    before, after = np.flatnonzero(lacks_before)[1:], np.flatnonzero(lacks_after)[:-1]
    both = np.intersect1d(before, after)
    for rows, value in ((np.setdiff1d(before, both), PREVIOUS_MISSING), (np.setdiff1d(after, both), NEXT_MISSING), (both, ISOLATED)):
        flag[rows] = np.maximum(flag[rows], value)
    return slot, flag, keep


def _move(slot: np.ndarray, flag: np.ndarray, occupied: dict[int, int], row: int, to: int) -> int:
    occupied[int(slot[row])] -= 1
    occupied[to] = occupied.get(to, 0) + 1
    slot[row], flag[row] = to, SOLVED_DUPLICATE
    return 1


def regularize_times(df: DataFrame, step: int, keys: Sequence[str] = ("station_id",), block_s: int = 86_400) -> DataFrame:
    """Times snapped to their nearest slot, with ``qc_time``.

    Two or three rows at a slot are spread to free neighbouring slots where that resolves them, else the
    last stays. The rule looks at a slot's neighbours in order, which is sequential, so each block (a
    calendar day of a key) goes through a numpy kernel. A block also reads BLOCK_TOLERANCE_S beyond its
    ends and is then cut to its own slots, so that rows and gaps at midnight are judged like all others.
    Rows without time are left out.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("qc_time", T.IntegerType())])
    columns = df.columns

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time", kind="stable").reset_index(drop=True)
        second = rows["time"].to_numpy("datetime64[s]").astype(np.int64)
        slot, flag, keep = _regular(second, step)
        keep = keep & (slot // block_s == rows["_bucket"].to_numpy())
        rows["time"] = pd.Series(slot.astype("datetime64[s]")).astype(rows["time"].dtype)
        rows["qc_time"] = flag
        return rows[keep][[*columns, "qc_time"]]

    blocks = chunked(df.where("time is not null"), BLOCK_TOLERANCE_S, block_s)
    return blocks.groupBy(*keys, "_bucket").applyInPandas(lambda rows: kernel(rows), schema)


def split_by_interval(df: DataFrame, intervals: Sequence[int], keys: Sequence[str] = ("station_id",), least_rows: int = 5, time_is_end: bool = True, chunk: str = "day") -> DataFrame:
    """Adds ``interval_s``, the sampling interval that each row belongs to; rows of none are left out.

    With one expected interval it is that. A logged sample_interval counts if it is expected and more
    than two rows of the chunk carry it. Else the distances of successive times are matched with the
    expected ones, runs of one interval shorter than ``least_rows`` are dropped; that scan is sequential
    and runs in a numpy kernel per key and calendar chunk.
    """
    if len(intervals) == 1:
        return df.withColumn("interval_s", F.lit(int(intervals[0])))
    block = F.date_trunc(chunk, F.col("time").cast("timestamp"))
    if "sample_interval" in df.columns:
        expected = df.where(F.col("sample_interval").isin(*[int(i) for i in intervals])).withColumn("_block", block)
        enough = expected.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_block", "sample_interval"))).where("_n > 2")
        return enough.withColumn("interval_s", F.col("sample_interval").cast("int")).drop("_n", "_block")
    schema = T.StructType([*df.schema.fields, T.StructField("interval_s", T.IntegerType())])
    allowed = np.array(sorted(intervals), float)

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time", kind="stable").reset_index(drop=True)
        label = _interval_runs(rows["time"].to_numpy("datetime64[s]").astype(np.int64), allowed, least_rows, time_is_end)
        rows["interval_s"] = label
        return rows[label > 0]

    return df.where("time is not null").groupBy(*keys, block).applyInPandas(lambda rows: kernel(rows), schema)


def _interval_runs(second: np.ndarray, allowed: np.ndarray, least_rows: int, time_is_end: bool) -> np.ndarray:
    """The interval of each row, 0 for none."""
    n = len(second)
    if n < 2:
        return np.zeros(n, np.int64)
    gap = np.round(np.abs(np.diff(second)) / 5) * 5
    seen = np.where(np.isin(gap, allowed), gap, np.nan)
    kinds = np.unique(seen[~np.isnan(seen)])
    if len(kinds) <= 1:
        return np.full(n, int(kinds[0]) if len(kinds) else 0)
    # An unmatched distance follows the next one, or the previous if the next is unmatched too.
    for i in np.flatnonzero(np.isnan(seen)):
        last = i + 1 >= len(seen)
        use_previous = last or (np.isnan(seen[i + 1]) and i > 0)
        seen[i] = seen[i - 1] if use_previous else seen[i + 1]
    cuts = np.flatnonzero(seen[:-1] != seen[1:]) + 1 + (1 if time_is_end else 0)
    out = np.zeros(n, np.int64)
    for rows in np.split(np.arange(n), cuts):
        if len(rows) >= least_rows and not np.isnan(seen[min(rows[0], len(seen) - 1)]):
            out[rows] = int(seen[min(rows[0], len(seen) - 1)])
    return out


def fill_grid(df: DataFrame, step: int, keys: Sequence[str] = ("station_id",), fill: str | None = None) -> DataFrame:
    """All slots from a key's first to last time; new rows hold nulls or, with ``fill`` "forward" or "backward", the neighbour.

    A time off the grid of the first one is an error.
    """
    second = seconds(F.col("time"))
    days = 86_400
    spans = df.groupBy(*keys).agg(F.min(second).alias("_a"), F.max(second).alias("_b"))
    # The grid is made day by day, so that no row explodes into a whole series at once.
    per_day = spans.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_a") / days), F.floor(F.col("_b") / days))))
    first = F.greatest(F.col("_a"), F.col("_a") + F.ceil((F.col("_d") * days - F.col("_a")) / step) * step)
    last = F.least(F.col("_b"), F.col("_d") * days + days - 1)
    slots = per_day.where(first <= last).select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("_s"))
    off = (second - F.col("_a")) % step != 0
    keyed = df.join(spans, list(keys)).withColumn("_s", F.when(off, F.raise_error(F.lit("a time is off the grid")).cast("long")).otherwise(second)).drop("_a", "_b", "time")
    full = slots.join(keyed, [*keys, "_s"], "left").withColumn("time", from_seconds(F.col("_s")))
    values = [c for c in df.columns if c not in (*keys, "time")]
    if fill:
        days = full.withColumn("_day", day_of(F.col("time")))
        full = carried(days, {f"_f_{c}": F.col(c) for c in values}, keys, ahead=fill == "backward").withColumns({c: F.col(f"_f_{c}") for c in values})
    return full.select(*df.columns)


# --- calendar -----------------------------------------------------------------------------------------


def season(time: Column) -> Column:
    month = F.month(time)
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isNotNull(), "SON")


def block_start(time: Column, freq: str) -> Column:
    """Start of the calendar block: hour, day, month, quarter, season (December starts one) or year."""
    if freq == "season":
        return F.date_trunc("month", F.add_months(F.date_trunc("quarter", F.add_months(F.date_trunc("month", time), 1)), -1))
    if freq not in ("hour", "day", "month", "quarter", "year"):
        raise ValueError(f"{freq} is no block; known are hour, day, month, quarter, season, year")
    return F.date_trunc(freq, time)


def block_end(time: Column, freq: str) -> Column:
    """Last second of the block."""
    months = {"month": 1, "quarter": 3, "season": 3, "year": 12}
    start = block_start(time, freq)
    if freq in months:
        return (F.add_months(start, months[freq]).cast("timestamp") - F.expr("interval 1 second")).cast("timestamp")
    return start + F.expr(f"interval {3599 if freq == 'hour' else 86_399} seconds")


def time_blocks(df: DataFrame, freq: str, keys: Sequence[str] = ("station_id",), time_is_end: bool = True) -> DataFrame:
    """keys, block_start, block_end of every block from a key's first to last time; a time that ends an interval counts a second earlier."""
    shift = F.expr("interval 1 second") if time_is_end else F.expr("interval 0 seconds")
    time = F.col("time").cast("timestamp") - shift
    step = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month", "quarter": "interval 3 months", "season": "interval 3 months", "year": "interval 1 year"}
    spans = df.groupBy(*keys).agg(block_start(F.min(time), freq).cast("timestamp").alias("a"), block_start(F.max(time), freq).cast("timestamp").alias("b"))
    starts = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr(step[freq]))).alias("block_start"))
    return starts.withColumn("block_end", block_end(F.col("block_start"), freq))


def overlapping(files: DataFrame, blocks: DataFrame, keys: Sequence[str] = (), tolerance_s: int = 0, bucket_s: int = 86_400) -> DataFrame:
    """Files (start, end) with the blocks (block_start, block_end) they overlap, bounds included, blocks widened by the tolerance.

    Both sides are cut at multiples of ``bucket_s`` and joined on the bucket; a pair is kept in the
    bucket in which its overlap begins.
    """

    def buckets(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / bucket_s), F.floor(b / bucket_s)))

    f0, f1 = seconds(F.col("start")), seconds(F.col("end"))
    b0, b1 = seconds(F.col("block_start")) - tolerance_s, seconds(F.col("block_end")) + tolerance_s
    left = files.where("start <= end").withColumns({"_f0": f0, "_f1": f1}).withColumn("_bucket", buckets(F.col("_f0"), F.col("_f1")))
    right = blocks.withColumns({"_b0": b0, "_b1": b1}).withColumn("_bucket", buckets(F.col("_b0"), F.col("_b1")))
    joined = left.join(right, [*keys, "_bucket"])
    meets = (F.col("_f0") <= F.col("_b1")) & (F.col("_f1") >= F.col("_b0"))
    begins = F.floor(F.greatest("_f0", "_b0") / bucket_s) == F.col("_bucket")
    return joined.where(meets & begins).drop("_f0", "_f1", "_b0", "_b1", "_bucket")


def time_component(time: Column, component: str) -> Column:
    """A part of a time by name; dow counts from Monday 0."""
    parts = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "doy": F.dayofyear, "dow": F.weekday, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "season": season,
        "month_name": lambda t: F.date_format(t, "MMMM"),
    }
    if component not in parts:
        raise ValueError(f"{component} is no part of a time; known are {', '.join(parts)}")
    return parts[component](time)


def generate_l0c(df: DataFrame, intervals: Sequence[int], keys: Sequence[str] = ("station_id",), all_equal: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """L0B to L0C: rows of expected intervals, repeated times resolved, times snapped per interval, with interval_s and qc_time."""
    split = split_by_interval(df, intervals, keys)
    parts: list[DataFrame] = []
    for interval in intervals:
        own = resolve_duplicates(split.where(F.col("interval_s") == int(interval)), keys, all_equal=all_equal, order=order)
        parts.append(regularize_times(own, int(interval), keys))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("sample_interval", F.col("interval_s"))




def blocks_offsets(sample_interval: int, resolution: str, time_is_end: bool = True) -> tuple[int, int]:
    """Seconds by which a block's start and end move for a resolution: a rolling window looks back beyond the block."""
    accumulation, rolling = resolution_seconds(resolution)
    if not rolling:
        return 0, 0
    reach = accumulation - sample_interval
    return (-reach, 0) if time_is_end else (0, reach)


def temporal_partitions(files: DataFrame, strategy: str, freq: str = "day", rows: DataFrame | None = None, variable: str = "N", threshold: float = 5, keys: Sequence[str] = ("station_id",), time_is_end: bool = True) -> DataFrame:
    """keys, block_start, block_end to work on: calendar blocks that files (start, end) touch, or the events of ``rows``."""
    if strategy == "event":
        from rainloom.operators import events

        if rows is None:
            raise ValueError("events need the rows they are found in")
        found = events.event_table(events.candidates(rows, variable, threshold), "6H", 3, "5MIN", 2, "5MIN", keys)
        return found.select(*keys, F.col("start_time").alias("block_start"), F.col("end_time").alias("block_end"))
    if strategy != "time_block":
        raise ValueError(f"{strategy} is no strategy; known are time_block and event")
    if freq == "none":
        return files.groupBy(*keys).agg(F.min("start").alias("block_start"), F.max("end").alias("block_end"))
    both = files.select(*keys, F.explode(F.array("start", "end")).alias("time"))
    blocks = time_blocks(both, freq, keys, time_is_end)
    return overlapping(files.select(*keys, "start", "end"), blocks, keys).select(*keys, "block_start", "block_end").distinct()


def check_time_range(start: Column, end: Column) -> Column:
    """Whether a period begins before it ends and is not in the future; null bounds are not."""
    return F.coalesce((start <= end) & (end <= F.current_timestamp()), F.lit(False))
