"""Implausible readings: spikes, stuck values and impossible values, judged per source.

Spikes come from a Hampel filter (rolling median and the median absolute deviation of the source),
stuck values from run lengths against the runs the source otherwise shows, impossible values from
bounds. Work is cut into chunks of one source and one day, so that a source with a third of all rows is
spread over its days. The first pass over the chunks only counts: a histogram of residuals, a histogram of
run lengths, and the few values at the edges of each day. From the added counts one task per source makes
its thresholds and, for each day, the known readings just before and after it and the whole lengths of the
runs at its edges. In the second pass that row leads its chunk, which is flagged with it; no join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.arrow_groups import group_starts, whole_groups

US = 1_000_000
DAY_US = 86_400 * US


@dataclass(frozen=True)
class Field:
    """How one field is judged."""

    name: str
    #: Values outside cannot occur in nature or in the sensor.
    low: float
    high: float
    #: Value that means "no value", if any.
    flag: float | None = None
    #: Deviations are taken relative to the rolling median plus this, for a field of bursts; else absolute.
    relative_to: float | None = None
    #: Deviations below this many of ``relative_to`` are never spikes.
    least_deviation: float = 0.0
    #: Runs of this value are normal.
    resting: float | None = None


FIELDS = (
    Field("rainfall_rate_32bit", 0.0, 2_000.0, flag=9999.999, relative_to=0.5, least_deviation=4.0, resting=0.0),
    Field("sensor_temperature", -70.0, 80.0),
    Field("laser_amplitude", 0.0, 60_000.0, flag=99_999.0),
)

#: Readings on either side in the rolling median, and the least number of readings in it.
HALF_WINDOW, LEAST_WINDOW = 5, 6
#: Longest spike in successive times, and the scales it must stand out by.
LONGEST_SPIKE, SPIKE_SCALES = 3, 7.0
#: A spike's neighbours deviate by at most this share of the spike.
NEIGHBOUR_SHARE = 0.35
#: A stuck run has at least this length, and one that by the tail of the source's own run lengths at most
#: this share of its runs reaches; neither the number of runs nor how long stuck runs are moves that length.
LEAST_RUN, RUN_CHANCE = 6, 1e-7
#: The tail is laid through the lengths that these shares of the runs reach: first through the former two, to
#: set far longer runs aside, then through the latter two of the rest.
FIRST_SHARES, TAIL_SHARES = (0.10, 0.05), (0.05, 0.01)
#: Known readings of the days around a chunk, on either side: with them all its verdicts are those of the whole series.
MARGIN = HALF_WINDOW + LONGEST_SPIKE
#: Histogram of residuals: logarithmic buckets of this relative width.
BUCKET = 1.02
_ZERO = -1_000_000
#: Before all instants.
_FIRST_US = -(1 << 63)


def _chunks(readings: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    at = F.unix_micros(F.col("time").cast("timestamp"))
    day = F.floor(at / F.lit(DAY_US)).cast("int")
    small = {name for name, kind in readings.dtypes if kind in ("float", "double")}
    values = [F.col(f.name) if f.name in small else F.col(f.name).cast("double").alias(f.name) for f in fields]
    return readings.where(F.col("time").isNotNull() & F.col("station_id").isNotNull()).select("station_id", day.alias("day"), "obs_id", at.alias("us"), *values)


@dataclass
class _Series:
    """The known values of one field at distinct times, over all groups of a table."""

    row: np.ndarray  # first row of each value's time; -1 for a value of another day
    group: np.ndarray
    value: np.ndarray
    deviation: np.ndarray  # NaN where the window is too small
    median: np.ndarray


def _group_of_row(starts: np.ndarray, n: int) -> np.ndarray:
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    return np.cumsum(group)


def _known(table: pa.Table, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Values of a field, and whether each is one."""
    value = table.column(field.name).to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(value)
    if field.flag is not None:
        known &= np.abs(value - field.flag) > 0.01
    return value, known


def _series(table: pa.Table, starts: np.ndarray, field: Field, before: np.ndarray | None = None, after: np.ndarray | None = None) -> _Series:
    """``before`` and ``after`` hold a row per group of known values of other days, filled up with NaN."""
    value, known = _known(table, field)
    us = table.column("us").to_numpy()
    group = _group_of_row(starts, table.num_rows)
    row = np.flatnonzero(known)
    first = np.concatenate(([True], (us[row][1:] != us[row][:-1]) | (group[row][1:] != group[row][:-1])))[: len(row)]
    row = row[first]
    v, g = value[row], group[row]
    if before is not None and after is not None:
        ahead, behind = (~np.isnan(before)).sum(axis=1), (~np.isnan(after)).sum(axis=1)
        own = np.bincount(g, minlength=len(starts))
        size = ahead + own + behind
        g_all = np.repeat(np.arange(len(starts)), size)
        within = np.arange(len(g_all)) - np.repeat(np.cumsum(size) - size, size)
        core = (within >= ahead[g_all]) & (within < (ahead + own)[g_all])
        values, rows = np.empty(len(g_all)), np.full(len(g_all), -1)
        values[core], rows[core] = v, row
        values[within < ahead[g_all]] = before[~np.isnan(before)]
        values[within >= (ahead + own)[g_all]] = after[~np.isnan(after)]
        v, g, row = values, g_all, rows
    # Each group is padded, so that windows end at its edges.
    place = np.arange(len(v)) + HALF_WINDOW * (g + 1)
    padded = np.full((int(place[-1]) if len(v) else 0) + HALF_WINDOW + 1, np.nan)
    padded[place] = v
    median = np.full(len(v), np.nan)
    width = 2 * HALF_WINDOW + 1
    windows = np.lib.stride_tricks.sliding_window_view(padded, width) if len(padded) >= width else np.zeros((0, width))
    for a in range(0, len(v), 200_000):
        part = np.sort(windows[place[a : a + 200_000] - HALF_WINDOW], axis=1)
        count = (~np.isnan(part)).sum(axis=1)
        at = np.arange(len(part))
        middle = (part[at, (count - 1) // 2] + part[at, count // 2]) / 2
        median[a : a + 200_000] = np.where(count >= LEAST_WINDOW, middle, np.nan)
    deviation = v - median
    if field.relative_to is not None:
        deviation = deviation / (np.maximum(median, 0) + field.relative_to)
    return _Series(row, g, v, deviation, median)


def _runs(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of one value within a group."""
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])))[: len(value)])
    return first, np.diff(np.append(first, len(value)))


_COUNT_SCHEMA = "kind string, station_id string, field int, day int, key bigint, value double, n bigint"
_COUNT_ARROW = pa.schema([("kind", pa.string()), ("station_id", pa.string()), ("field", pa.int32()), ("day", pa.int32()), ("key", pa.int64()), ("value", pa.float64()), ("n", pa.int64())])


def _counts(fields: tuple[Field, ...]):
    """First pass. Kinds of rows: r residuals by bucket, L inner runs by length, H and T the runs at a day's
    edges (T where it is another than H), B and A the day's first and last MARGIN known values, D that there is such a day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            starts = group_starts(table)
            stations = table.column(0).take(pa.array(starts)).to_pylist()
            days = table.column(1).take(pa.array(starts)).to_numpy()
            names, code = np.unique(np.array(stations, dtype=object), return_inverse=True)
            out: dict[str, list] = {c: [] for c in _COUNT_ARROW.names}

            def add(kind, station, field, day, key, value, n):
                size = len(station)
                for c, x in zip(_COUNT_ARROW.names, (kind, station, field, day, key, value, n)):
                    out[c].append(np.broadcast_to(np.asarray(x), size) if np.ndim(x) == 0 else x)

            add("D", names[code], -1, days, 0, 0.0, 1)
            for number, field in enumerate(fields):
                s = _series(table, starts, field)
                if not len(s.value):
                    continue
                counted = ~np.isnan(s.deviation)
                if field.relative_to is not None:
                    counted &= (s.value != 0) | (s.median != 0)
                size = np.abs(s.deviation[counted])
                with np.errstate(divide="ignore"):
                    bucket = np.where(size > 0, np.floor(np.log(size) / np.log(BUCKET)), _ZERO).astype(np.int64)
                pairs, n = np.unique(np.stack([code[s.group[counted]], bucket]), axis=1, return_counts=True)
                add("r", names[pairs[0]], number, 0, pairs[1], 0.0, n)
                first, length = _runs(s.value, s.group)
                value, group = s.value[first], s.group[first]
                head = np.concatenate(([True], group[1:] != group[:-1]))
                tail = np.concatenate((group[1:] != group[:-1], [True]))
                inner = ~head & ~tail
                if field.resting is not None:
                    inner &= value != field.resting
                pairs, n = np.unique(np.stack([code[group[inner]], length[inner]]), axis=1, return_counts=True)
                add("L", names[pairs[0]], number, 0, pairs[1], 0.0, n)
                for kind, at in (("H", head), ("T", tail & ~head)):
                    add(kind, names[code[group[at]]], number, days[group[at]], 0 if kind == "H" else 1, value[at], length[at])
                of_group = np.bincount(s.group, minlength=len(starts))
                place = np.arange(len(s.value)) - np.repeat(np.cumsum(of_group) - of_group, of_group)
                for kind, at in (("B", place), ("A", place - of_group[s.group] + MARGIN)):
                    near = np.flatnonzero((at < MARGIN) if kind == "B" else (at >= 0))
                    add(kind, names[code[s.group[near]]], number, days[s.group[near]], at[near], s.value[near], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[f.name]), f.type) for f in _COUNT_ARROW], schema=_COUNT_ARROW)

    return run


def _reached(key: np.ndarray, n: np.ndarray, share: float) -> tuple[float, float]:
    """The number of repeats up to which at least ``share`` of the runs go, and minus the logarithm of how many do."""
    reach = np.cumsum(n[::-1])[::-1] / n.sum()
    at = np.flatnonzero(reach >= share)[-1]
    return float(key[at] - 1), -math.log(reach[at])


def _tail(key: np.ndarray, n: np.ndarray, shares: tuple[float, float]) -> float:
    """Repeats that RUN_CHANCE of the runs reach by the Weibull tail through two points; never lighter than exponential."""
    (x1, h1), (x2, h2) = (_reached(key, n, share) for share in shares)
    if x2 == 0:
        return 0.0
    if h2 <= 0:
        return math.inf  # no run ends before: nothing tells how long is too long
    if x1 == 0:
        return (x2 - 0.5) * -math.log(RUN_CHANCE) / h2  # one point, in the middle of its step
    power = min(1.0, math.log(h2 / h1) / math.log(x2 / x1)) if x1 < x2 and h1 > 0 else 1.0
    return x2 * (-math.log(RUN_CHANCE) / h2) ** (1 / power)


def stuck_length(key: np.ndarray, n: np.ndarray) -> float:
    """The length from which a run is stuck; key and n are the lengths of a source's runs, ascending, and how many have them.

    A run goes on with the chance that a value repeats; one more of either kind keeps few runs from
    certainty. Where long runs are likelier than that, a Weibull tail gives the length.
    """
    if not len(key):
        return math.inf
    again = (n[key > 1].sum() + 1) / (n.sum() + 2)
    usual = max(LEAST_RUN - 1, math.log(RUN_CHANCE) / math.log(again))
    body = key <= 1 + max(usual, _tail(key, n, FIRST_SHARES))
    return 1 + max(usual, _tail(key[body], n[body], TAIL_SHARES)) if body.any() else math.inf


def _spike_size(bucket: np.ndarray, n: np.ndarray, field: Field) -> float:
    """The deviation from which a reading stands out."""
    if not len(bucket):
        return math.nan
    value = np.where(bucket == _ZERO, 0.0, BUCKET ** (np.maximum(bucket, -10_000) + 0.5))
    upto = np.cumsum(n)
    middle, high = (value[np.searchsorted(upto, q * upto[-1])] for q in (0.5, 0.95))
    # 1.4826 and 1.96 make the median and the 95th percentile of absolute deviations standard deviations.
    # In a field of bursts spikes may be more than a twentieth of what is counted; there the median serves.
    if field.relative_to is not None:
        return max(SPIKE_SCALES * 1.4826 * middle, field.least_deviation)
    unit = value[value > 0]
    return max(SPIKE_SCALES * max(1.4826 * middle, high / 1.96), 3 * unit[0] if len(unit) else 0.0, field.least_deviation)


#: Of each field what the second pass knows of a day: scalars, then the MARGIN known values before and after it.
_SCALARS = ("spike", "stuck", "head", "tail")
_OF_DAY = len(_SCALARS) + 2 * MARGIN
_DAY_ARROW = pa.schema([("station_id", pa.string()), ("day", pa.int32()), ("of_day", pa.list_(pa.float64()))])


def _judged_days(fields: tuple[Field, ...]):
    """From all counts of one source, one row per day with what the second pass needs to know of the others."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("kind").to_pylist(), dtype=object)
        field, day, key, value, n = (table.column(c).to_numpy() for c in ("field", "day", "key", "value", "n"))
        days = np.sort(day[kind == "D"])
        out = np.full((len(days), len(fields), _OF_DAY), np.nan)
        for i, f in enumerate(fields):
            of = {k: np.flatnonzero((kind == k) & (field == i)) for k in "rLHTBA"}
            at = of["r"][np.argsort(key[of["r"]])]
            spike = _spike_size(key[at], n[at], f)
            # Runs over midnight: edges of successive days that show one value form a chain; its lengths add up.
            edge = np.concatenate([of["H"], of["T"]])
            edge = edge[np.lexsort((key[edge], day[edge]))]
            linked = (key[edge] == 0) & np.concatenate(([False], value[edge][1:] == value[edge][:-1]))[: len(edge)]
            chain = np.cumsum(~linked) - 1
            total = np.bincount(chain, n[edge]) if len(edge) else np.zeros(0)
            whole = total[chain] if len(edge) else np.zeros(0)
            begins = np.flatnonzero(~linked)
            if f.resting is not None:
                begins = begins[value[edge[begins]] != f.resting]
            lengths = np.concatenate([key[of["L"]], total[chain[begins]].astype(np.int64)])
            times = np.concatenate([n[of["L"]], np.ones(len(begins), np.int64)])
            unique, back = np.unique(lengths, return_inverse=True)
            stuck = stuck_length(unique, np.bincount(back, times, minlength=len(unique)) if len(unique) else np.zeros(0))
            out[:, i, 0], out[:, i, 1] = spike, stuck
            for k in (0, 1):
                at = key[edge] == k
                out[np.searchsorted(days, day[edge[at]]), i, 2 + k] = whole[at]
            # The last known values before a day are among the last ones of each day before it.
            last, start = (of[k][np.lexsort((key[of[k]], day[of[k]]))] for k in "AB")
            for k, (a, b) in enumerate(zip(np.searchsorted(day[last], days, "left"), np.searchsorted(day[start], days, "right"))):
                before, after = value[last[max(0, a - MARGIN) : a]], value[start[b : b + MARGIN]]
                out[k, i, len(_SCALARS) : len(_SCALARS) + len(before)] = before
                out[k, i, len(_SCALARS) + MARGIN : len(_SCALARS) + MARGIN + len(after)] = after
        station = [table.column("station_id")[0].as_py()] * len(days)
        return pa.table([pa.array(station, pa.string()), pa.array(days, pa.int32()), pa.array(list(out.reshape(len(days), -1)), pa.list_(pa.float64()))], schema=_DAY_ARROW)

    return run


def _flags(fields: tuple[Field, ...]):
    """Second pass. The first row of each chunk is no reading; it brings what is known of its day in ``of_day``."""
    schema = pa.schema([("obs_id", pa.int64()), ("field_name", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            leads = table.column("of_day").is_valid()
            of_day = table.column("of_day").filter(leads).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(fields), _OF_DAY)
            table = table.filter(pa.compute.invert(leads))
            starts = group_starts(table)
            us, obs = table.column("us").to_numpy(), table.column("obs_id")
            group = _group_of_row(starts, table.num_rows)
            # Number of each row's time: copies at one time share it.
            time_row = np.cumsum(np.concatenate(([True], (us[1:] != us[:-1]) | (group[1:] != group[:-1])))) - 1
            for i, field in enumerate(fields):
                scalar = {c: of_day[:, i, k] for k, c in enumerate(_SCALARS)}
                near = of_day[:, i, len(_SCALARS) :]
                s = _series(table, starts, field, near[:, :MARGIN], near[:, MARGIN:])
                value, known = _known(table, field)
                impossible = known & ((value < field.low) | (value > field.high))
                by_time = np.zeros(int(time_row[-1]) + 1, np.int8)
                for bit, at in ((1, _spikes(s, scalar["spike"])), (2, _stuck(s, scalar, field))):
                    rows = s.row[at]
                    by_time[time_row[rows[rows >= 0]]] |= bit
                kind = np.where(known, by_time[time_row], 0)
                for reason, hit in (("impossible", impossible), ("spike", (kind & 1 > 0) & ~impossible), ("stuck", (kind & 2 > 0) & ~impossible & (kind & 1 == 0))):
                    at = np.flatnonzero(hit)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([obs.take(pa.array(at)).combine_chunks().cast(pa.int64()), pa.array([field.name] * len(at)), pa.array([reason] * len(at))], schema=schema)

    return run


def _spikes(s: _Series, threshold: np.ndarray) -> np.ndarray:
    limit = threshold[s.group] if len(s.group) else np.zeros(0)
    with np.errstate(invalid="ignore"):
        out = np.abs(s.deviation) > limit
    if not out.any():
        return np.zeros(0, np.int64)
    sign = np.where(out, np.sign(s.deviation), 0)
    new = np.concatenate(([True], (sign[1:] != sign[:-1]) | (s.group[1:] != s.group[:-1])))
    run = np.cumsum(new) - 1
    length = np.bincount(run)
    first = np.flatnonzero(new)
    last = first + length - 1
    spike = (sign[first] != 0) & (length <= LONGEST_SPIKE)
    # The run must start and end within its group, beside readings that are back.
    inside = (first > 0) & (last < len(run) - 1)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(run) - 1)
    inside &= (s.group[before] == s.group[first]) & (s.group[after] == s.group[last])
    weakest = np.minimum.reduceat(np.where(np.isnan(s.deviation), 0, np.abs(s.deviation)), first)
    signed = lambda at: np.nan_to_num(s.deviation[at]) * sign[first]
    spike &= inside & (np.maximum(signed(before), signed(after)) <= NEIGHBOUR_SHARE * weakest)
    return np.flatnonzero(spike[run])


def _stuck(s: _Series, of_day: dict[str, np.ndarray], field: Field) -> np.ndarray:
    own = np.flatnonzero(s.row >= 0)
    if not len(own):
        return own
    first, length = _runs(s.value[own], s.group[own])
    value, group = s.value[own[first]], s.group[own[first]]
    head = np.concatenate(([True], group[1:] != group[:-1]))
    tail = np.concatenate((group[1:] != group[:-1], [True]))
    whole = length.astype(float)
    whole = np.where(head, np.fmax(whole, of_day["head"][group]), whole)
    whole = np.where(tail & ~head, np.fmax(whole, of_day["tail"][group]), whole)
    with np.errstate(invalid="ignore"):
        stuck = whole >= of_day["stuck"][group]
    if field.resting is not None:
        stuck &= value != field.resting
    return own[np.repeat(stuck, length)]


def implausible(readings: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """obs_id, field_name, reason (``impossible``, ``spike`` or ``stuck``) of the implausible readings.

    Null, NaN and flag values are no values: they are passed over, also inside a run. Readings at one
    time count once in medians and runs, and all of them are flagged. The first and last readings of a
    source are never spikes, as nothing shows a return. Readings without station or time are left out;
    an empty table gives no rows.
    """
    chunks = _chunks(readings, fields)
    order = ("station_id", "day", "us", "obs_id")
    counts = chunks.repartition("station_id", "day").sortWithinPartitions(*order).mapInArrow(_counts(fields), _COUNT_SCHEMA)
    counts = counts.groupBy("kind", "station_id", "field", "day", "key", "value").agg(F.sum("n").alias("n"))
    days = counts.groupBy("station_id").applyInArrow(_judged_days(fields), "station_id string, day int, of_day array<double>")
    judged = days.withColumn("us", F.lit(_FIRST_US)).unionByName(chunks, allowMissingColumns=True)
    return judged.repartition("station_id", "day").sortWithinPartitions(*order).mapInArrow(_flags(fields), "obs_id bigint, field_name string, reason string")
