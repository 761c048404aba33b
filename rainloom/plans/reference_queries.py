"""Named queries of the engine's own operators, each with its SQL where SQL can say it.

Spectra come from the ``embeddings`` table (64 bins of 0.125 mm, counts = |x| * 1000), series from
``events`` and ``sensor_readings``, statistics from ``lineitem`` and ``l2e_params``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.functions import arrays as A
from rainloom.functions import axis_ratio, fall_velocity, goodness, permittivity, physics, psd, radar
from rainloom.functions import spectrum as S
from rainloom.operators import classification, events, fitting, joins, packed_lists, products, remap, resample, sanitize, statistics, time_axis
from rainloom.sensors import Bins
from rainloom.session import checkpointed, staged, table
from rainloom.sources import files
from rainloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


N_BINS, BIN_WIDTH = 64, 0.125
_BINS = Bins.of_edges(np.arange(N_BINS + 1) * BIN_WIDTH)
_D = ", ".join(f"CAST({x!r} AS DOUBLE)" for x in _BINS.center.tolist())


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a series: station_id (user), time, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), F.col("ts").alias("time"), "event_id", "event_type", "value")


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as concentrations: station_id (label), vec_id, nd."""
    counts = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("station_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 60).alias("time"), counts.alias("nd"))


#: The same spectra in SQL: one row per vector and bin.
_LONG = f"""b AS (SELECT unnest([{_D}]) AS d, unnest(range(1, {N_BINS + 1})) AS i),
    n AS (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, {N_BINS + 1})) AS i FROM embeddings),
    s AS (SELECT n.vec_id, n.label, n.i, b.d, abs(CAST(n.e AS DOUBLE)) * 1000 AS nd FROM n JOIN b ON n.i = b.i)"""
_W = BIN_WIDTH
_CENTERS = lambda: sensors.literal(_BINS.center)
_WIDTHS = lambda: sensors.literal(_BINS.width)


# --- filters and cleaning ---------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN value BETWEEN 1 AND 200 THEN round(value, 6) ELSE 'NaN'::DOUBLE END AS value FROM events")
def flag_range_nan(spark, sf_dir):
    return _series(spark, sf_dir).select("event_id", F.round(sanitize.within_range(F.col("value"), 1, 200), 6).alias("value"))


@query(
    """SELECT obs_id, CASE WHEN rainfall_rate_32bit IS NULL OR isnan(rainfall_rate_32bit) OR abs(CAST(rainfall_rate_32bit AS DOUBLE) - 9999.999) <= 1e-8 + 1e-5 * 9999.999 THEN NULL
    ELSE CAST(rainfall_rate_32bit AS DOUBLE) END AS rainfall_rate_32bit FROM sensor_readings"""
)
def replace_nan_flags(spark, sf_dir):
    value = sanitize.without_flag(F.col("rainfall_rate_32bit").cast("double"), (9999.999,))
    return table(spark, sf_dir, "sensor_readings").select("obs_id", F.nanvl(value, F.lit(None).cast("double")).alias("rainfall_rate_32bit"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("time"), "l_linenumber", "l_partkey")
    return sanitize.remove_duplicated_times(rows, (), ("l_linenumber", "l_partkey")).select(F.col("time").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query(
    """SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS k,
    min(l_returnflag) OVER (PARTITION BY l_orderkey) AS a, max(l_returnflag) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE k = 1 AND a = b"""
)
def dedup_conflict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("time"), "l_returnflag")
    return time_axis.resolve_duplicates(rows, (), spectrum="l_returnflag").select(F.col("time").alias("l_orderkey"), "l_returnflag")


@query(
    """SELECT event_id FROM events WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00')
    AND NOT (ts BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-20 07:30:00')"""
)
def issue_anti_join(spark, sf_dir):
    periods = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-05 00:00:00', TIMESTAMP_NTZ'2024-01-06 12:00:00'), (TIMESTAMP_NTZ'2024-01-20 06:00:00', TIMESTAMP_NTZ'2024-01-20 07:30:00') AS t(start, end)")
    return sanitize.drop_periods(_series(spark, sf_dir), periods).select("event_id")


@query("SELECT obs_id FROM sensor_readings WHERE sample_interval IN (60, 120)")
def keep_sample_intervals(spark, sf_dir):
    return time_axis.keep_intervals(table(spark, sf_dir, "sensor_readings"), (60, 120)).select("obs_id")


# --- time axis ----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(ceil((epoch_us(ts) // 1000000 - 1704067200) / 600.0 - 0.5) * 600 + 1704067200 AS BIGINT) AS slot FROM events")
def snap_grid(spark, sf_dir):
    return _series(spark, sf_dir).select("event_id", time_axis.nearest_slot(time_axis.seconds(F.col("time")), 1_704_067_200, 600).alias("slot"))


@query(
    """WITH s AS (SELECT DISTINCT user_id AS station_id, epoch_us(ts) // 3600000000 * 3600 AS slot FROM events),
    w AS (SELECT *, lag(slot) OVER o AS p, lead(slot) OVER o AS n FROM s WINDOW o AS (PARTITION BY station_id ORDER BY slot))
    SELECT station_id, CAST(slot AS BIGINT) AS slot, CASE WHEN slot - p <> 3600 AND n - slot <> 3600 THEN 3 WHEN n - slot <> 3600 THEN 2 WHEN slot - p <> 3600 THEN 1 ELSE 0 END AS flag FROM w"""
)
def qc_time_flags(spark, sf_dir):
    hour = (F.floor(time_axis.seconds(F.col("time")) / 3600) * 3600).cast("long")
    return time_axis.problem_slots(_series(spark, sf_dir).select("station_id", hour.alias("slot")).distinct(), 3600)


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS dt FROM events),
    r AS (SELECT user_id, CAST(round_even(dt / 5.0, 0) * 5 AS INTEGER) AS dt, count(*) AS n FROM g WHERE dt IS NOT NULL GROUP BY 1, 2)
    SELECT user_id AS station_id, dt AS sample_interval FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, dt) AS k FROM r) WHERE k = 1"""
)
def infer_interval(spark, sf_dir):
    return time_axis.infer_interval(_series(spark, sf_dir)).select("station_id", "sample_interval")


@query(
    """WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, sum(value) AS total FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY user_id)
    SELECT g.user_id AS station_id, CAST(g.hour * 3600 AS BIGINT) AS epoch_s, round(h.total, 6) AS total FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.hour = h.hour"""
)
def gapfill_grid(spark, sf_dir):
    return time_axis.fill_grid(_hourly(spark, sf_dir), 3600).select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), F.round("total", 6).alias("total"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.timestamp_seconds(F.floor(time_axis.seconds(F.col("time")) / 3600) * 3600)
    return _series(spark, sf_dir).groupBy("station_id", hour.alias("time")).agg(F.sum("value").alias("total"))


@query(
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season,
    CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, monthname(o_orderdate) AS month_name FROM orders"""
)
def season_group(spark, sf_dir):
    t = F.col("o_orderdate")
    parts = {p: time_axis.time_component(t, p) for p in ("season", "dow", "doy", "quarter", "month_name")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    """SELECT DISTINCT strftime(date_trunc('quarter', o_orderdate + INTERVAL 1 MONTH) - INTERVAL 1 MONTH, '%Y-%m-%d') AS season_start,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start FROM orders"""
)
def calendar_blocks(spark, sf_dir):
    t = F.col("o_orderdate")
    names = {"season_start": "season", "month_start": "month", "quarter_start": "quarter"}
    return table(spark, sf_dir, "orders").select(*[F.date_format(time_axis.block_start(t, f), "yyyy-MM-dd").alias(n) for n, f in names.items()]).distinct()


@query(
    """WITH f AS (SELECT p_partkey AS file_id, TIMESTAMP '2024-01-01' + (p_partkey % 700) * INTERVAL 1 HOUR AS s, TIMESTAMP '2024-01-01' + ((p_partkey % 700) + p_size) * INTERVAL 1 HOUR AS e FROM part),
    b AS (SELECT i AS block_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 DAY AS s, TIMESTAMP '2024-01-01' + (i + 1) * INTERVAL 1 DAY - INTERVAL 1 SECOND AS e FROM range(0, 32) t(i))
    SELECT file_id, CAST(block_id AS INTEGER) AS block_id FROM f JOIN b ON f.s <= b.e + INTERVAL 120 SECOND AND f.e >= b.s - INTERVAL 120 SECOND"""
)
def interval_overlap(spark, sf_dir):
    start = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("p_partkey") % 700) * 3600)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), start.alias("start"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("p_size") * 3600).alias("end"))
    days = spark.range(32).select(F.col("id").cast("int").alias("block_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 86_400).alias("block_start"), F.timestamp_seconds(1_704_067_200 + (F.col("id") + 1) * 86_400 - 1).alias("block_end"))
    return time_axis.overlapping(parts, days, tolerance_s=120).select("file_id", "block_id")


@query()
def regularize_timesteps(spark, sf_dir):
    """The readings of every logged interval on the grid of that interval."""
    readings = table(spark, sf_dir, "sensor_readings").where("station_id is not null and time is not null").select("station_id", "obs_id", "time", "sample_interval")
    parts = [time_axis.regularize_times(readings.where(F.col("sample_interval") == step), step) for step in (30, 60, 120, 300, 600)]
    return _together(parts)


@query()
def split_sampling_intervals(spark, sf_dir):
    readings = table(spark, sf_dir, "sensor_readings").where("station_id is not null and time is not null").select("station_id", "obs_id", "time")
    return time_axis.split_by_interval(readings, (30, 60, 120, 300, 600))


# --- resampling and events ------------------------------------------------------------------------------------------


@query(
    """SELECT user_id AS station_id, CAST((epoch_us(ts) // 3600000000 + 1) * 3600 AS BIGINT) AS epoch_s, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(value), 6) AS sum_value FROM events GROUP BY 1, 2"""
)
def tumbling_agg(spark, sf_dir):
    out = streams.resampled(_series(spark, sf_dir), 3600, ["value"], ["value"], late=None)
    return out.select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), "n", F.round("mean_value", 6).alias("mean_value"), F.round("sum_value", 6).alias("sum_value"))


_HOURLY_N = """h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, CAST(count(*) AS DOUBLE) AS n, max(value) AS m FROM events GROUP BY 1, 2)"""


def _hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.timestamp_seconds((F.floor(time_axis.seconds(F.col("time")) / 3600) + 1) * 3600)
    return _series(spark, sf_dir).groupBy("station_id", hour.alias("time")).agg(F.count("*").cast("double").alias("N"), F.max("value").alias("Dmax"))


@query(
    f"""WITH {_HOURLY_N}, x AS (SELECT user_id, min(hour) AS a, max(hour) AS b FROM h GROUP BY user_id),
    g AS (SELECT user_id, hour // 6 AS block, sum(n) AS n, max(m) AS m, count(*) AS c FROM h GROUP BY 1, 2), e AS (SELECT g.*, least(block * 6 + 5, b) - greatest(block * 6, a) + 1 AS e FROM g JOIN x ON g.user_id = x.user_id)
    SELECT user_id AS station_id, CAST((block + 1) * 21600 AS BIGINT) AS epoch_s, CASE WHEN c = e THEN n END AS N, CASE WHEN c = e THEN m END AS Dmax, round_even(1 - c / 6.0, 1) AS qc_resampling FROM e"""
)
def resample_blocks(spark, sf_dir):
    out = resample.resample(_hourly_counts(spark, sf_dir), 3600, "6H")
    null = F.lit(None).cast("double")
    return out.select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), F.nanvl("N", null).alias("N"), F.nanvl("Dmax", null).alias("Dmax"), "qc_resampling")


@query(
    f"""WITH {_HOURLY_N}, g AS (SELECT user_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY user_id),
    f AS (SELECT g.user_id, g.hour, h.n FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.hour = h.hour),
    w AS (SELECT user_id, hour, sum(n) OVER o AS n, count(n) OVER o AS c, count(*) OVER o AS a FROM f WINDOW o AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT user_id AS station_id, CAST((hour + 1) * 3600 AS BIGINT) AS epoch_s, CASE WHEN c = 3 THEN n END AS N, round_even(1 - c / 3.0, 1) AS qc_resampling FROM w WHERE a = 3"""
)
def rolling_agg(spark, sf_dir):
    out = resample.resample(_hourly_counts(spark, sf_dir), 3600, "ROLL3H")
    return out.select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), F.nanvl("N", F.lit(None).cast("double")).alias("N"), "qc_resampling")


@query(
    """SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND INTERVAL 12 HOUR FOLLOWING) - 1 AS n FROM events) WHERE n >= 2"""
)
def isolated_removal(spark, sf_dir):
    return events.remove_isolated(_series(spark, sf_dir), 2, "12H").select("event_id")


_SESSIONS = """g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event_id FROM g)"""


@query(
    f"""WITH {_SESSIONS} SELECT user_id AS station_id, CAST(event_id AS BIGINT) AS event_id, count(*) AS n_timesteps, CAST((max(epoch_us(ts)) // 1000000 - min(epoch_us(ts)) // 1000000) // 60 AS BIGINT) AS duration_min
    FROM k GROUP BY 1, 2 HAVING count(*) >= 2 AND (max(epoch_us(ts)) // 1000000 - min(epoch_us(ts)) // 1000000) // 60 >= 5"""
)
def events_sessions(spark, sf_dir):
    return events.event_table(_series(spark, sf_dir), "6H", min_size=2, min_duration="5MIN").select("station_id", "event_id", "n_timesteps", "duration_min")


@query(
    """WITH p AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS wet FROM events),
    q AS (SELECT event_id, ts - lag(ts) OVER w AS b, lead(ts) OVER w - ts AS a FROM p WHERE wet WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT p.event_id, CASE WHEN wet AND (b IS NULL OR b > INTERVAL 1 DAY) AND (a IS NULL OR a > INTERVAL 1 DAY) THEN 1 ELSE 0 END AS flag_spikes FROM p LEFT JOIN q ON p.event_id = q.event_id"""
)
def spike_flag(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return events.precipitation_spikes(rows, "kind", 60, reach_s=86_400).select("event_id", "flag_spikes")


@query(
    """WITH v AS (SELECT event_id, user_id, ts, value > 100 AS v FROM events), c AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS c FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT event_id, CAST(run AS BIGINT) AS run_id, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r"""
)
def const_runs(spark, sf_dir):
    return events.constant_runs(_series(spark, sf_dir), F.col("value") > 100).select("event_id", "run_id", "run_length")


@query(
    """WITH u AS (SELECT station_id, time, "R", "Dm" FROM (SELECT *, row_number() OVER (PARTITION BY station_id, time ORDER BY row_id) AS k FROM l2e_params WHERE station_id IS NOT NULL AND time IS NOT NULL) WHERE k = 1),
    w AS (SELECT * FROM u WHERE "R" > 0 AND NOT isnan("R") AND "R" < 1000),
    n AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY station_id ORDER BY time RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND INTERVAL 300 SECOND FOLLOWING) - 1 AS c FROM w) WHERE c >= 2),
    g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY station_id ORDER BY time) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM n),
    e AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS event FROM g),
    t AS (SELECT station_id, event, min(time) AS a, max(time) AS b FROM e GROUP BY 1, 2 HAVING count(*) >= 3 AND (epoch_us(max(time)) // 1000000 - epoch_us(min(time)) // 1000000) // 60 >= 5)
    SELECT t.station_id, CAST(epoch_us(t.a) // 1000000 AS BIGINT) AS start_s, CAST((epoch_us(t.b) // 1000000 - epoch_us(t.a) // 1000000) // 60 + 1 AS INTEGER) AS duration, CAST(count(*) FILTER ("R" > 5) AS INTEGER) AS rainy_minutes_5 FROM t JOIN w ON w.station_id = t.station_id AND w.time BETWEEN t.a AND t.b GROUP BY t.station_id, t.a, t.b"""
)
def event_summary(spark, sf_dir):
    first = Window.partitionBy("station_id", "time").orderBy("row_id")
    params = table(spark, sf_dir, "l2e_params").where("station_id is not null and time is not null").withColumn("k", F.row_number().over(first)).where("k = 1 and R < 1000")
    zero = F.lit(0.0)
    wide = params.select("station_id", "time", "R", "Dm", (F.col("R") / 60).alias("P"), (F.col("Dm") * 2).alias("Dmax"), zero.alias("sigma_m"), zero.alias("LWC"), zero.alias("Z"), F.lit(3).alias("Nbins"))
    out = events.event_summary(wide, "1MIN")
    return out.select("station_id", time_axis.seconds(F.col("start_time")).alias("start_s"), "duration", F.col("`rainy_minutes_>5`").alias("rainy_minutes_5"))


# --- spectrum reductions ---------------------------------------------------------------------------------------------

_MOMENTS = ", ".join(f"round(sum(pow(d, {k}) * nd * {_W}), 4) AS M{k}" for k in range(7))


@query(f"WITH {_LONG} SELECT vec_id, {_MOMENTS} FROM s GROUP BY vec_id")
def bin_dot_moments(spark, sf_dir):
    nd = F.col("nd")
    return _spectra(spark, sf_dir).select("vec_id", *[F.round(S.moment(nd, _CENTERS(), _WIDTHS(), k), 4).alias(f"M{k}") for k in range(7)])


@query(
    f"""WITH {_LONG}, m AS (SELECT vec_id, sum(pow(d, 3) * nd * {_W}) AS m3, sum(pow(d, 4) * nd * {_W}) AS m4, sum(pow(d, 5) * nd * {_W}) AS m5, sum(pow(d, 6) * nd * {_W}) AS m6,
        sum(nd * (9.65 - 10.3 * exp(-0.6 * d)) * pow(d, 3) * {_W}) FILTER (9.65 - 10.3 * exp(-0.6 * d) > 0) * 6 * pi() * 1e-4 AS r FROM s GROUP BY vec_id)
    SELECT vec_id, round(r, 5) AS R, round(10 * log10(m6), 5) AS Z, round(m4 / m3, 6) AS Dm, round(sqrt((m3 * m5 - m4 * m4) / (m3 * m3)), 6) AS sigma_m,
        round(256 / 6.0 * pow(m3, 5) / pow(m4, 4), 4) AS Nw, round(pi() / 6 * 1e-3 * m3, 6) AS LWC FROM m"""
)
def spectrum_params(spark, sf_dir):
    speed = np.maximum(9.65 - 10.3 * np.exp(-0.6 * _BINS.center), 0)
    out = S.integral_parameters(_spectra(spark, sf_dir), "nd", speed, _BINS.center, _BINS.width, F.lit(60.0))
    digits = {"R": 5, "Z": 5, "Dm": 6, "sigma_m": 6, "Nw": 4, "LWC": 6}
    return out.select("vec_id", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(
    f"""WITH {_LONG}, c AS (SELECT vec_id, d, i, sum(pow(d, 3) * nd * {_W}) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, sum(pow(d, 3) * nd * {_W}) OVER (PARTITION BY vec_id) * 0.5 AS t FROM s),
    u AS (SELECT vec_id, arg_min(d, i) AS d1, arg_min(cum, i) AS c1 FROM c WHERE cum >= t GROUP BY vec_id), l AS (SELECT vec_id, arg_max(d, i) AS d0, arg_max(cum, i) AS c0, any_value(t) AS t FROM c WHERE cum <= t GROUP BY vec_id)
    SELECT u.vec_id, round(CASE WHEN d0 = d1 THEN d0 ELSE d0 + (d1 - d0) * (t - c0) / (c1 - c0) END, 6) AS D50 FROM u JOIN l ON u.vec_id = l.vec_id"""
)
def quantile_diameter(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", F.round(S.median_volume_diameter(F.col("nd"), _CENTERS(), _WIDTHS()), 6).alias("D50"))


@query(f"WITH {_LONG} SELECT vec_id, min(d) FILTER (nd > 150) AS Dmin, max(d) FILTER (nd > 150) AS Dmax, arg_min(d, i) FILTER (nd = top) AS Dmode FROM (SELECT *, max(nd) OVER (PARTITION BY vec_id) AS top FROM s) GROUP BY vec_id")
def minmax_mode_bin(spark, sf_dir):
    many = F.transform("nd", lambda x: F.when(x > 150, x).otherwise(0.0))
    null = F.lit(None).cast("double")
    return _spectra(spark, sf_dir).select("vec_id", F.nanvl(S.min_diameter(many, _CENTERS()), null).alias("Dmin"), F.nanvl(S.max_diameter(many, _CENTERS()), null).alias("Dmax"), S.mode_diameter(F.col("nd"), _CENTERS()).alias("Dmode"))


@query(
    f"""WITH {_LONG}, f AS (SELECT vec_id, i, nd > 80 AS filled FROM s), e AS (SELECT vec_id, min(i) AS a, max(i) AS b, count(*) AS n FROM f WHERE filled GROUP BY vec_id),
    g AS (SELECT f.vec_id, f.i, f.filled, i - row_number() OVER (PARTITION BY f.vec_id, f.filled ORDER BY i) AS island FROM f JOIN e ON f.vec_id = e.vec_id AND i BETWEEN a AND b),
    r AS (SELECT vec_id, max(c) AS longest FROM (SELECT vec_id, island, count(*) AS c FROM g WHERE NOT filled GROUP BY 1, 2) GROUP BY vec_id)
    SELECT v.vec_id, CAST(coalesce(n, 0) AS INTEGER) AS "Nbins", CAST(CASE WHEN n IS NULL THEN {N_BINS} ELSE b - a + 1 - n END AS INTEGER) AS "Nbins_missing",
        round(CASE WHEN n IS NULL THEN 1.0 ELSE (b - a + 1 - n) / (b - a + 1) END, 6) AS "Nbins_missing_fraction", CAST(CASE WHEN n IS NULL THEN {N_BINS} ELSE coalesce(longest, 0) END AS INTEGER) AS "Nbins_missing_consecutive"
    FROM (SELECT DISTINCT vec_id FROM embeddings) v LEFT JOIN e ON v.vec_id = e.vec_id LEFT JOIN r ON v.vec_id = r.vec_id"""
)
def bin_runs(spark, sf_dir):
    counts = _spectra(spark, sf_dir).select("vec_id", F.transform("nd", lambda x: F.when(x > 80, x).otherwise(0.0)).alias("n"))
    metrics = S.bin_metrics(F.col("n"))
    return counts.select("vec_id", *[(F.round(c, 6) if n.endswith("fraction") else c).alias(n) for n, c in metrics.items()])


@query(
    f"""WITH {_LONG}, p AS (SELECT vec_id, sum(nd * {_W}) FILTER (i <= 8) AS a, sum(nd * {_W}) FILTER (i BETWEEN 9 AND 16) AS b, sum(nd * {_W}) FILTER (i BETWEEN 17 AND 32) AS c FROM s GROUP BY vec_id)
    SELECT vec_id, diameter, width, round(n / width, 6) AS drop_number_concentration FROM (SELECT vec_id, CAST(0.5 AS DOUBLE) AS diameter, CAST(1 AS DOUBLE) AS width, a AS n FROM p UNION ALL SELECT vec_id, 1.5, 1, b FROM p UNION ALL SELECT vec_id, 3, 2, c FROM p)"""
)
def unpivot_bins(spark, sf_dir):
    parts = S.partial_number_concentrations(F.col("nd"), _BINS.lower, _BINS.upper, (0.0, 1.0, 2.0, 4.0))
    wide = _spectra(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in parts.items()])
    out = S.concentration_from_partials(wide, ["vec_id"])
    return out.select("vec_id", "diameter", "width", F.round("drop_number_concentration", 6).alias("drop_number_concentration"))


@query(f"WITH {_LONG} SELECT vec_id, CAST((i - 1) // 4 AS INTEGER) AS bin, round(sum(nd * {_W}) / (4 * {_W}), 6) AS nd FROM s GROUP BY 1, 2")
def conservative_remap(spark, sf_dir):
    edges = np.arange(17) * 4 * BIN_WIDTH
    out = _spectra(spark, sf_dir).select("vec_id", remap.remap_density(F.col("nd"), _BINS, edges.tolist()).alias("x"))
    return out.select("vec_id", F.posexplode("x").alias("bin", "nd")).select("vec_id", "bin", F.round("nd", 6).alias("nd"))


@query()
def log_pchip_remap(spark, sf_dir):
    edges = np.arange(129) * BIN_WIDTH / 2
    return remap.resample_concentration(_spectra(spark, sf_dir), "nd", "fine", _BINS, edges.tolist()).select("vec_id", F.posexplode("fine").alias("bin", "value"))


@query(
    f"""WITH {_LONG}, t AS (SELECT *, sum(nd) OVER (PARTITION BY vec_id) AS total FROM s), p AS (SELECT vec_id, i, nd / total AS p FROM t), pq AS (SELECT a.vec_id, a.i, a.p AS p, b.p AS q FROM p a JOIN p b ON b.vec_id = 0 AND a.i = b.i),
    k AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM pq WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT vec_id, round(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / CASE WHEN q = 0 THEN 1e-12 ELSE q END) ELSE 0 END), 0), 6) AS kl, round(sqrt((greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END), 0) + greatest(sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) / 2), 6) AS js, round(max(abs(cp - cq)), 6) AS ks, round(sum(abs(cp - cq)) * {_W}, 6) AS wd FROM k GROUP BY vec_id"""
)
def kl_js_wd_ks(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    first = F.broadcast(spectra.where("vec_id = 0").select(F.col("nd").alias("q")))  # one row
    shares = spectra.join(first).select("vec_id", goodness.probabilities(F.col("nd"), _WIDTHS()).alias("p"), goodness.probabilities(F.col("q"), _WIDTHS()).alias("q"))
    p, q = F.col("p"), F.col("q")
    return shares.select("vec_id", F.round(goodness.kl_divergence(p, q), 6).alias("kl"), F.round(goodness.jensen_shannon(p, q), 6).alias("js"), F.round(goodness.kolmogorov_smirnov(p, q)[0], 6).alias("ks"), F.round(goodness.wasserstein(p, q, _CENTERS(), _WIDTHS()), 6).alias("wd"))


# --- scalar physics ----------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN d > 0 AND d < 10 THEN 4.874 * d * exp(-0.195 * d) * pow(1.225 / 1.2176510537764393, 0.025 * d + 0.375) END, 6) AS speed,
    round(greatest(0, least(1, 1.03 - 0.062 * d)), 6) AS ratio FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5.0 AS d FROM lineitem)"""
)
def rain_fall_speed(spark, sf_dir):
    d = F.col("l_quantity") / 5.0
    speed = F.nanvl(fall_velocity.rain_speed(d, "Uplinger1981"), F.lit(None).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(speed, 6).alias("speed"), F.round(axis_ratio.axis_ratio(d, "Pruppacher1970"), 6).alias("ratio"))


@query(
    """SELECT station_id, round(9.806229 - 0.025889372 * cos(2 * radians(latitude)) - 2.879513e-6 * altitude, 8) AS gravity,
    round(101325 * exp(-(9.806229 - 0.025889372 * cos(2 * radians(latitude)) - 2.879513e-6 * altitude) / (0.0065 * 287.04) * ln(1 + 0.0065 * altitude / 288.15)), 4) AS pressure
    FROM stations WHERE latitude IS NOT NULL AND altitude IS NOT NULL"""
)
def air_at_stations(spark, sf_dir):
    stations = table(spark, sf_dir, "stations").where("latitude is not null and altitude is not null")
    gravity = physics.gravitational_acceleration(F.col("latitude"), F.col("altitude"))
    pressure = physics.air_pressure_at_height(F.col("altitude"), F.col("latitude"), F.lit(288.15))
    return stations.select("station_id", F.round(gravity, 8).alias("gravity"), F.round(pressure, 4).alias("pressure"))


# --- statistics -----------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT * FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 30.0), (3, 30.0, 40.0), (4, 40.0, 50.0), (5, 50.0, 60.0)) t(bin, lo, hi)),
    v AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 WHEN l_quantity <= 50 THEN 4 ELSE 5 END AS bin, l_extendedprice AS p FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60),
    m AS (SELECT bin, median(p) AS med FROM v GROUP BY bin), d AS (SELECT v.bin, median(abs(p - med)) AS mad FROM v JOIN m ON v.bin = m.bin GROUP BY v.bin),
    g AS (SELECT bin, count(*) AS n, avg(p) AS mean, stddev_samp(p) AS std, min(p) AS lo, max(p) AS hi, median(p) AS med, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS iqr FROM v GROUP BY bin)
    SELECT (e.lo + e.hi) / 2 AS l_quantity, coalesce(g.n, 0) AS count, round(mean, 4) AS mean, round(std, 4) AS std, round(g.lo, 4) AS min, round(g.hi, 4) AS max, round(med, 4) AS median, round(iqr, 4) AS iqr, round(mad, 4) AS mad
    FROM e LEFT JOIN g ON e.bin = g.bin LEFT JOIN d ON e.bin = d.bin"""
)
def hist1d_stats(spark, sf_dir):
    out = statistics.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_extendedprice"], [0, 10, 20, 30, 40, 50, 60])
    return out.select("l_quantity", F.coalesce("count", F.lit(0)).alias("count"), *[F.round(f"l_extendedprice_{c}", 4).alias(c) for c in ("mean", "std", "min", "max", "median", "iqr", "mad")])


@query(
    """WITH g AS (SELECT CAST(ceil(l_quantity / 10.0) - 1 AS INTEGER) AS qb, CAST(ceil(l_discount / 0.02 - 1e-9) - 1 AS INTEGER) AS db, l_extendedprice AS p FROM lineitem WHERE l_quantity > 0 AND l_quantity < 50 AND l_discount >= 0 AND l_discount < 0.1),
    c AS (SELECT qb, greatest(db, 0) AS db, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT CAST(x AS INTEGER) AS q_bin, CAST(y AS INTEGER) AS d_bin, coalesce(n, 0) AS count FROM range(0, 5) a(x), range(0, 5) b(y) LEFT JOIN c ON qb = x AND db = y"""
)
def hist2d_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.round("l_discount", 4))
    out = statistics.histogram_2d(rows, "l_quantity", "l_discount", (), [0, 10, 20, 30, 40, 50], [0, 0.02, 0.04, 0.06, 0.08, 0.1])
    return out.select(F.col("l_quantity_bin").alias("q_bin"), F.col("l_discount_bin").alias("d_bin"), F.coalesce("count", F.lit(0)).alias("count"))


@query(
    """SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY floor(l_quantity / 5), floor(l_extendedprice / 10000)) AS n FROM lineitem
    WHERE l_quantity >= 0 AND l_quantity < 55 AND l_extendedprice >= 0 AND l_extendedprice < 120000) WHERE n >= 100"""
)
def outlier_cells(spark, sf_dir):
    cells = statistics.dense_cells(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", list(range(0, 60, 5)), list(range(0, 130_000, 10_000)), 100)
    return cells.select("l_orderkey", "l_linenumber")


_DSD_SQL = """WITH x AS (SELECT event_type, value AS x FROM events), b AS (SELECT event_type, count(*) AS n, avg(x) AS mean, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS std, quantile_cont(x, 0.01) AS q1, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.5) AS q50,
    quantile_cont(x, 0.99) AS q99 FROM x GROUP BY event_type), d AS (SELECT x.event_type, avg(abs(x - mean)) AS mad, avg(pow(x - mean, 2)) AS m2, avg(pow(x - mean, 3)) AS m3, avg(pow(x - mean, 4)) AS m4 FROM x JOIN b ON x.event_type = b.event_type GROUP BY x.event_type)
    SELECT b.event_type, round(lo, 4) AS MIN, round(q1, 4) AS Q1, round(q10, 4) AS Q10, round(q50, 4) AS Q50, round(q99, 4) AS Q99, round(hi, 4) AS MAX, round(mean, 4) AS MEAN, round(std, 4) AS STD, round(mad, 4) AS MAD,
    round(sqrt(n * (n - 1.0)) / (n - 2) * m3 / pow(m2, 1.5), 4) AS SKEWNESS, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 4) AS KURTOSIS FROM b JOIN d ON b.event_type = d.event_type"""


@query(_DSD_SQL)
def dsd_table(spark, sf_dir):
    out = statistics.distribution_table(_series(spark, sf_dir), ("value",), ("event_type",), None)
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("MIN", "Q1", "Q10", "Q50", "Q99", "MAX", "MEAN", "STD", "MAD", "SKEWNESS", "KURTOSIS")])


@query(
    """WITH p AS (SELECT floor(l_quantity / 5) AS bin, l_extendedprice AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_quantity >= 0 AND l_quantity < 55),
    m AS (SELECT bin, median(y) AS y, count(*) AS n FROM p GROUP BY bin), d AS (SELECT p.bin, median(abs(p.y - m.y)) AS mad FROM p JOIN m ON p.bin = m.bin GROUP BY p.bin)
    SELECT CAST(m.bin AS INTEGER) AS bin, m.bin * 5 + 2.5 AS x, round(m.y, 4) AS y, n, round(mad, 4) AS mad FROM m JOIN d ON m.bin = d.bin WHERE m.y > 0 AND n > 10"""
)
def powerlaw_points(spark, sf_dir):
    out = statistics.power_law_points(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", list(range(0, 60, 5)))
    return out.select("bin", "x", F.round("y", 4).alias("y"), "n", F.round("mad", 4).alias("mad"))


@query(
    """SELECT station_id, CAST(count(*) AS BIGINT) AS n_rainy_minutes, count(*) FILTER ("R" > 0 AND "R" <= 0.1) AS "n_rainy_minutes_<0.1", count(*) FILTER ("R" > 0.1 AND "R" <= 1) AS n_rainy_minutes_0_1_1,
    count(*) FILTER ("R" > 10 AND "R" <= 25) AS n_rainy_minutes_10_25, count(*) FILTER ("R" > 200) AS "n_rainy_minutes_>200" FROM l2e_params WHERE "R" > 0 AND NOT isnan("R") AND "R" IS NOT NULL GROUP BY station_id"""
)
def rain_statistics(spark, sf_dir):
    out = statistics.rain_statistics(table(spark, sf_dir, "l2e_params").withColumn("Dmax", F.col("Dm") * 2), "1MIN")
    return out.select("station_id", "n_rainy_minutes", "`n_rainy_minutes_<0.1`", F.col("`n_rainy_minutes_0.1_1`").alias("n_rainy_minutes_0_1_1"), "n_rainy_minutes_10_25", "`n_rainy_minutes_>200`")


@query()
def stratified_sample(spark, sf_dir):
    return statistics.sample_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 20, id_columns=["l_orderkey", "l_linenumber"], stratum="l_quantity", edges=[0, 10, 20, 30, 40, 50])


# --- classification ----------------------------------------------------------------------------------------------------


@query(
    """SELECT report_id, CAST(CASE WHEN c IN (51, 52, 53) THEN 1 WHEN c IN (57, 58) THEN 2 WHEN c IN (61, 62, 63) THEN 3 WHEN c IN (67, 68) THEN 4 WHEN c IN (71, 72, 73) THEN 5 WHEN c = 77 THEN 6 WHEN c IN (74, 75, 76) THEN 7 WHEN c IN (89, 90) THEN 9
    WHEN c IN (-2, -1, 0) THEN c END AS DOUBLE) AS hydrometeor FROM (SELECT report_id, CAST(weather_code_synop_4680 AS DOUBLE) AS c FROM weather_reports)"""
)
def classify_weather_code(spark, sf_dir):
    kind = classification.hydrometeor_of_code(F.col("weather_code_synop_4680").cast("double"), "weather_code_synop_4680")
    return table(spark, sf_dir, "weather_reports").select("report_id", F.nanvl(kind, F.lit(None).cast("double")).alias("hydrometeor"))


@query(
    """SELECT row_id, CASE WHEN "Dm" > 0 AND "Nw" > 0 AND NOT isnan("Dm") AND NOT isnan("Nw") AND "Dm" IS NOT NULL AND "Nw" IS NOT NULL THEN CASE WHEN log10("Nw") > 6.3 - 1.6 * "Dm" THEN 2 ELSE 1 END ELSE 0 END AS kind FROM l2e_params"""
)
def stratiform_convective(spark, sf_dir):
    dm, nw = (F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("Dm", "Nw"))
    return table(spark, sf_dir, "l2e_params").select("row_id", S.stratiform_or_convective(dm, nw).alias("kind"))


@query("SELECT obs_id, CASE WHEN CAST(sensor_temperature AS DOUBLE) BETWEEN -40 AND 35 THEN CAST(sensor_temperature AS DOUBLE) END AS temperature FROM sensor_readings")
def coalesce_priority(spark, sf_dir):
    readings = table(spark, sf_dir, "sensor_readings")
    value, _ = classification.best_temperature(readings)
    return readings.select("obs_id", F.nanvl(value, F.lit(None).cast("double")).alias("temperature"))


# --- joins ----------------------------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'),
    p AS (SELECT c.event_id AS click_id, v.event_id AS view_id, abs(epoch_us(c.ts) - epoch_us(v.ts)) AS off, v.ts FROM c JOIN v ON c.user_id = v.user_id AND v.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR),
    b AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY off, ts) AS k FROM p)
    SELECT c.event_id AS click_id, coalesce(b.view_id, -1) AS view_id FROM c LEFT JOIN b ON c.event_id = b.click_id AND b.k = 1"""
)
def asof_nearest(spark, sf_dir):
    series = _series(spark, sf_dir)
    clicks = series.where("event_type = 'click'").select("station_id", "time", F.col("event_id").alias("click_id"))
    views = series.where("event_type = 'view'").select("station_id", "time", F.col("event_id").alias("view_id"))
    return joins.asof_nearest(clicks, views, ["station_id"], 21_600, ["view_id"]).select("click_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query(
    """WITH g AS (SELECT CAST(p_size AS DOUBLE) AS k FROM part GROUP BY 1), q AS (SELECT l_orderkey, l_linenumber, l_quantity + 0.3 AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, (SELECT arg_min(k, abs(k - q) * 1000000 + k / 1000000) FROM g) AS x FROM q"""
)
def nn_lookup(spark, sf_dir):
    grid = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.3).alias("q"))
    return joins.nearest_value(rows, grid, "q", "x").select("l_orderkey", "l_linenumber", "x")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 INTERSECT SELECT o_orderkey FROM orders")
def align_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    frames = joins.align([lines.where("l_returnflag = 'R'").select("l_orderkey"), lines.where("l_linenumber = 2").select("l_orderkey"), orders], ["l_orderkey"])
    return frames[0].distinct()


@query(
    f"""WITH {_HOURLY_N}, g AS (SELECT user_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY user_id), f AS (SELECT g.user_id, g.hour, h.m FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.hour = h.hour),
    l AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS h0, last_value(m IGNORE NULLS) OVER a AS m0, first_value(CASE WHEN m IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS h1, first_value(m IGNORE NULLS) OVER b AS m1 FROM f
        WINDOW a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id AS station_id, CAST((hour + 1) * 3600 AS BIGINT) AS epoch_s, round(CASE WHEN m IS NOT NULL THEN m WHEN hour - h0 <= 9 THEN m0 + (m1 - m0) * (hour - h0) / (h1 - h0) END, 9) AS m FROM l"""
)
def interp_limit(spark, sf_dir):
    filled = time_axis.fill_grid(_hourly_counts(spark, sf_dir).select("station_id", "time", F.col("Dmax").alias("m")), 3600)
    return joins.interpolate(filled, ["m"], limit=9).select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), F.round("m", 9).alias("m"))


@query(
    """SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS q_A, max(l_quantity) FILTER (l_returnflag = 'N') AS q_N, max(l_quantity) FILTER (l_returnflag = 'R') AS q_R
    FROM (SELECT l_orderkey, l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey"""
)
def pivot_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("l_quantity"))
    return joins.pivot(rows, ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "N", "R"], "q_")


# --- parsing ----------------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 3))), 3) AS total FROM embeddings")
def delimited_parse(spark, sf_dir):
    text = F.concat(F.lit(","), F.array_join(F.transform("embedding", lambda x: F.format_number(F.round(x.cast("double"), 3), 3)), ","), F.lit(","))
    parsed = table(spark, sf_dir, "embeddings").select("vec_id", sanitize.parse_list(text, 64).alias("x"))
    return parsed.select("vec_id", F.size("x").alias("n"), F.round(A.total(F.col("x")), 3).alias("total"))


@query("SELECT file_id, regexp_extract(file_name, '\\.(L\\d+)\\.s', 1) AS station, strftime(strptime(regexp_extract(file_name, '\\.s(\\d{14})', 1), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS start FROM raw_files")
def filename_parse(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_files")
    name = F.concat(F.lit("L1.1MIN."), F.regexp_extract("file_name", r"^([^.]+)", 1), F.lit("."), F.regexp_extract("file_name", r"\.(L\d+)\.s", 1), F.lit("."), F.regexp_extract("file_name", r"(s\d{14})", 1), F.lit(".e20300101000000.V0.parquet"))
    parts = files.filename_columns(name)
    return raw.select("file_id", parts["station_name"].alias("station"), F.date_format(parts["start_time"], "yyyy-MM-dd HH:mm:ss").alias("start"))


# --- fits ----------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_LONG}, m AS (SELECT vec_id, sum(pow(d, 3) * nd * {_W}) AS m3, sum(pow(d, 4) * nd * {_W}) AS m4, sum(pow(d, 6) * nd * {_W}) AS m6 FROM s GROUP BY vec_id), g AS (SELECT *, pow(m4, 3) / (m3 * m3 * m6) AS g FROM m)
    SELECT vec_id, round((5.5 * g - 4 + sqrt(g * (g * 0.25 + 2))) / (1 - g), 6) AS mu, round(((5.5 * g - 4 + sqrt(g * (g * 0.25 + 2))) / (1 - g) + 4) * m3 / m4, 6) AS "Lambda" FROM g"""
)
def mom_gamma(spark, sf_dir):
    out = fitting.fit_moments(_spectra(spark, sf_dir), "GammaPSD", ["M346"], "nd", _CENTERS(), _WIDTHS(), ["vec_id"])
    return out.select("vec_id", F.round("mu", 6).alias("mu"), F.round("Lambda", 6).alias("Lambda"))


@query(
    f"""WITH {_LONG}, t AS (SELECT vec_id, sum(nd * {_W}) AS nt FROM s GROUP BY vec_id), g AS (SELECT l / 100.0 AS l FROM range(1, 1000) r(l)),
    e AS (SELECT s.vec_id, g.l, sum(pow(nd - CASE WHEN nt * g.l * exp(-g.l * d) < 1e-3 THEN 0 ELSE nt * g.l * exp(-g.l * d) END, 2)) AS loss FROM s JOIN t ON s.vec_id = t.vec_id, g GROUP BY 1, 2)
    SELECT vec_id, round(arg_min(l, loss), 6) AS "Lambda" FROM e GROUP BY vec_id"""
)
def gs_exponential(spark, sf_dir):
    out = fitting.fit_grid(_spectra(spark, sf_dir), "ExponentialPSD", _BINS.center, _BINS.width, np.ones(N_BINS), "nd", ("vec_id",), (fitting.Objective(),))
    return out.select("vec_id", F.round("Lambda", 6).alias("Lambda"))


@query()
def ml_gamma(spark, sf_dir):
    return fitting.fit_likelihood(_spectra(spark, sf_dir), "GammaPSD", _BINS.lower, _BINS.upper, "nd", ("vec_id",), init_method="M346")


# --- products -----------------------------------------------------------------------------------------------------------------------


#: The sensors of the telegrams, and which of them measure velocities.
_SENSORS = ("PARSIVEL", "PARSIVEL2", "LPM", "ODM470", "RD80")
_WITH_VELOCITY = ("PARSIVEL", "PARSIVEL2", "LPM")


def _unique_telegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telegrams with their instant and sensor; of those of one station and time the first.

    They meet by station and day as texts, once for all sensors, and are written once: the chain of every
    sensor starts from that table instead of from five copies of the plan that makes it.
    """
    from rainloom.operators import timestamps

    stations = table(spark, sf_dir, "stations")
    stamped = timestamps.utc_instants(table(spark, sf_dir, "l0a_telegrams"), stations, ("sample_interval", "raw_drop_number")).where("utc_us is not null and not isnan(sample_interval)")
    rows = stamped.select("telegram_id", "station_id", F.col("sample_interval").cast("int").alias("sample_interval"), "raw_drop_number", F.timestamp_micros("utc_us").alias("time"))
    rows = rows.join(stations.select("station_id", "sensor_name"), "station_id").withColumn("_day", F.to_date("time"))
    return checkpointed(sanitize.remove_duplicated_times(rows.repartition("station_id", "_day"), ("station_id", "_day"), ("telegram_id",)).drop("_day"))


def _l0(telegrams: DataFrame, sensor: str) -> DataFrame:
    """Of one kind of sensor the telegrams as L0B rows with a flat spectrum; arrays are made after the exchange."""
    n_d, n_v = len(sensors.diameter_bins(sensor)), len(sensors.velocity_bins(sensor) or [0])
    order = [v * n_d + d for d in range(n_d) for v in range(n_v)] if sensors.LIST_ORDER[sensor] == "VD" else None
    mine = telegrams.where(F.col("sensor_name") == sensor).drop("sensor_name")
    return staged(mine, {"raw_drop_number": packed_lists.list_column(F.col("raw_drop_number"), n_d * n_v, order)}).where("raw_drop_number is not null")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _l2e(telegrams: DataFrame, sensor: str) -> DataFrame:
    return products.generate_l2e(classification.generate_l1(_l0(telegrams, sensor), sensor), sensor, methods=(products.THEORETICAL,))


@query()
def l1_classification(spark, sf_dir):
    columns = ("telegram_id", "n_particles", "Dmin", "Dmax", "hydrometeor_type", "precipitation_type", "flag_graupel", "flag_hail", "flag_splashing", "flag_noise", "flag_spikes")
    telegrams = _unique_telegrams(spark, sf_dir)
    return _together([classification.generate_l1(_l0(telegrams, s), s).select(*columns) for s in _WITH_VELOCITY])


@query()
def l2e_parameters(spark, sf_dir):
    columns = ("telegram_id", "station_id", "time", "N", "Nbins", "R", "Rm", "Z", "Dm", "sigma_m", "D10", "D50", "D90", "Nw", "LWC", "TKE", "KED")
    telegrams = _unique_telegrams(spark, sf_dir)
    return _together([_l2e(telegrams, s).select(*columns) for s in _SENSORS])


@query()
def l2m_normalized_gamma(spark, sf_dir):
    columns = ("telegram_id", "psd_Nw", "psd_Dm", "psd_mu", "R", "Z", "Dm", "R2", "KLDiv", "WD", "KS")
    telegrams = _unique_telegrams(spark, sf_dir)
    return _together([products.generate_l2m(_l2e(telegrams, s), "NormalizedGammaDmNwPSD", "GS", sensor=s, keys=("telegram_id",)).select(*columns) for s in _SENSORS])


@query()
def top_rain_times(spark, sf_dir):
    """The flagship: telegrams to spectra to rain rates, and the ten strongest minutes per station (a top-k report)."""
    telegrams = _unique_telegrams(spark, sf_dir)
    rates = _together([_l2e(telegrams, s).select("station_id", "time", "R", "Z", "Dm") for s in _SENSORS])
    return rates.withColumn("rank", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("R"), "time"))).where("rank <= 10")
