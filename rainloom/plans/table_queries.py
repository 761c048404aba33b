"""Named queries of cleaning, the time axis, statistics, stations and files, each against SQL written out by hand."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions import permittivity, spectrum, text
from rainloom.operators import classification, events, joins, remap, sanitize, statistics, time_axis
from rainloom.plans.reference_queries import _BINS, _CENTERS, _HOURLY_N, _LONG, _W, BIN_WIDTH, N_BINS, _hourly_counts, _series, _spectra, query
from rainloom.session import staged, table
from rainloom.sources import files


def _known(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


# --- cleaning ---------------------------------------------------------------------------------------------------------

_CLEAN = """u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, time ORDER BY obs_id) AS k FROM sensor_readings WHERE time IS NOT NULL) WHERE k = 1),
    f AS (SELECT obs_id, CAST(epoch_us(time) // 1000000 AS BIGINT) AS second, rainfall_rate_32bit AS r, sensor_temperature AS t, laser_amplitude AS a, number_particles AS n FROM u)"""


def _flagged(c: str, flag: float | None, low: float, high: float, name: str) -> str:
    near = f"abs({c} - {flag}) <= 1e-8 + 1e-5 * {flag} OR" if flag else ""
    return f'CASE WHEN isnan({c}) OR {near} {c} < {low} OR {c} > {high} THEN NULL ELSE round(CAST({c} AS DOUBLE), 4) END AS "{name}"'


@query(
    f"""WITH {_CLEAN} SELECT obs_id, second, {_flagged("r", 9999.999, 0, 9999.999, "rainfall_rate_32bit")}, {_flagged("t", None, -99, 100, "sensor_temperature")},
    {_flagged("a", 99999.0, 0, 99999, "laser_amplitude")}, {_flagged("n", 99999.0, 0, 99999, "number_particles")} FROM f"""
)
def clean_readings(spark, sf_dir):
    """The whole chain of cleaning over readings that come as text."""
    columns = ("rainfall_rate_32bit", "sensor_temperature", "laser_amplitude", "number_particles")
    raw = table(spark, sf_dir, "sensor_readings").select("obs_id", "station_id", "time", *[F.col(c).cast("string").alias(c) for c in columns])
    clean = sanitize.sanitize(raw, "PARSIVEL2", order=("obs_id",))
    return clean.select("obs_id", time_axis.seconds(F.col("time")).alias("second"), *[F.round(_known(F.col(c)), 4).alias(c) for c in columns])


@query(
    """SELECT 'rainfall_rate_32bit' AS "column", count(*) FILTER (rainfall_rate_32bit < 0 OR rainfall_rate_32bit > 9999.999::FLOAT) AS n_violations FROM sensor_readings WHERE NOT isnan(rainfall_rate_32bit)
    UNION ALL SELECT 'sensor_temperature', count(*) FILTER (sensor_temperature < -99 OR sensor_temperature > 100) FROM sensor_readings WHERE NOT isnan(sensor_temperature)
    UNION ALL SELECT 'laser_amplitude', count(*) FILTER (laser_amplitude < 0 OR laser_amplitude > 99999) FROM sensor_readings WHERE NOT isnan(laser_amplitude)
    UNION ALL SELECT 'number_particles', count(*) FILTER (number_particles < 0 OR number_particles > 99999) FROM sensor_readings WHERE NOT isnan(number_particles)"""
)
def range_violations(spark, sf_dir):
    return sanitize.standard_violations(table(spark, sf_dir, "sensor_readings").select("rainfall_rate_32bit", "sensor_temperature", "laser_amplitude", "number_particles"), "PARSIVEL2")


@query(
    """WITH c AS (SELECT telegram_id, raw_drop_number AS t, length(regexp_replace(raw_drop_number, '[^;]', '', 'g')) AS s, length(regexp_replace(raw_drop_number, '[^,]', '', 'g')) AS c FROM l0a_telegrams),
    d AS (SELECT *, CASE WHEN s = 0 AND c = 0 THEN NULL WHEN s >= c THEN ';' ELSE ',' END AS delimiter FROM c),
    e AS (SELECT *, CASE WHEN delimiter = ';' THEN regexp_replace(t, '^;+|;+$', '', 'g') WHEN delimiter = ',' THEN regexp_replace(t, '^,+|,+$', '', 'g') ELSE t END AS inner_text FROM d),
    f AS (SELECT *, CASE WHEN delimiter IS NULL THEN [inner_text] ELSE string_split(inner_text, delimiter) END AS entries FROM e)
    SELECT telegram_id, delimiter, CAST(length(inner_text) AS INTEGER) AS inner_length, coalesce(len(list_filter(entries, lambda x: NOT (trim(x) IN ('', 'NaN', 'NAN') OR regexp_matches(trim(x), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')))) = 0, false) AND t IS NOT NULL AS sound FROM f"""
)
def list_soundness(spark, sf_dir):
    raw = F.col("raw_drop_number")
    rows = staged(table(spark, sf_dir, "l0a_telegrams").select("telegram_id", "raw_drop_number"), {"delimiter": sanitize.delimiter(raw), "inner_text": sanitize.strip_delimiter(raw)})
    return rows.select("telegram_id", "delimiter", F.length("inner_text").alias("inner_length"), sanitize.is_sound_list(F.col("inner_text")).alias("sound"))


@query(
    """WITH c AS (SELECT l.telegram_id, s.latitude, s.altitude, trim(l.raw_drop_number) AS t, l.raw_drop_number AS raw FROM l0a_telegrams l JOIN stations s ON l.station_id = s.station_id WHERE s.sensor_name = 'PARSIVEL2'),
    d AS (SELECT *, CASE WHEN length(regexp_replace(raw, '[^;]', '', 'g')) + length(regexp_replace(raw, '[^,]', '', 'g')) = 0 THEN NULL WHEN length(regexp_replace(raw, '[^;]', '', 'g')) >= length(regexp_replace(raw, '[^,]', '', 'g')) THEN ';' ELSE ',' END AS delimiter FROM c),
    e AS (SELECT *, string_split(CASE WHEN delimiter = ';' THEN regexp_replace(raw, '^;+|;+$', '', 'g') WHEN delimiter = ',' THEN regexp_replace(raw, '^,+|,+$', '', 'g') ELSE raw END, coalesce(delimiter, '#')) AS x FROM d),
    f AS (SELECT telegram_id, latitude, altitude, t, CASE WHEN raw IS NULL OR upper(t) = 'NAN' OR (t NOT IN ('', '0') AND len(x) <> 1024) THEN NULL
        WHEN t IN ('', '0') THEN [CAST(0 AS DOUBLE)] ELSE list_transform(x, lambda y: CASE WHEN trim(y) = '' THEN CAST(0 AS DOUBLE) WHEN regexp_matches(trim(y), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(y) AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END) END AS n FROM e)
    SELECT telegram_id, latitude, altitude, CASE WHEN n IS NULL OR isnan(list_sum(n)) THEN NULL ELSE round(list_sum(n), 4) END AS total,
        CASE WHEN n IS NULL OR isnan(list_sum(n)) THEN NULL WHEN len(n) = 1 THEN 0 ELSE round(list_sum(list_transform(n, lambda y, i: y * (((i - 1) % 32) * 32 + (i - 1) // 32 + 1))), 4) END AS weighted FROM f"""
)
def l0b_arrays(spark, sf_dir):
    """PARSIVEL2 lists as diameter-major arrays with the station's place; sums that tell the order of the entries."""
    stations = table(spark, sf_dir, "stations").where("sensor_name = 'PARSIVEL2'")
    raw = table(spark, sf_dir, "l0a_telegrams").join(stations.select("station_id"), "station_id", "left_semi").select("telegram_id", "station_id", "raw_drop_number")
    arrays = sanitize.generate_l0b(raw, "PARSIVEL2", stations)
    weights = F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: i.cast("double"))
    sums = staged(arrays, {"total": A.total(F.col("raw_drop_number")), "weighted": A.dot(F.col("raw_drop_number"), weights)})
    return sums.select("telegram_id", "latitude", "altitude", *[F.round(_known(F.col(c)), 4).alias(c) for c in ("total", "weighted")])


_TEXTS = """t AS (SELECT telegram_id, 'sensor_date' AS field, sensor_date AS t FROM l0a_telegrams UNION ALL SELECT telegram_id, 'sensor_time', sensor_time FROM l0a_telegrams UNION ALL SELECT telegram_id, 'date', date FROM l0a_telegrams
    UNION ALL SELECT telegram_id, 'serial', sensor_serial_number FROM l0a_telegrams UNION ALL SELECT telegram_id, 'interval', CAST(sample_interval AS VARCHAR) FROM l0a_telegrams),
    n AS (SELECT *, coalesce(regexp_matches(trim(t), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') OR lower(trim(t)) IN ('nan', 'inf', '-inf'), false) AS is_number FROM t)"""


@query(
    f"""WITH {_TEXTS} SELECT telegram_id, field, is_number, coalesce(regexp_matches(trim(t), '^[+-]?[0-9]+$'), false) AS is_integer, is_number AND coalesce(regexp_matches(t, '[.][0-9]'), false) AS has_decimals,
    CAST(CASE WHEN is_number AND regexp_matches(t, '[.][0-9]') THEN length(regexp_extract(t, '[.]([0-9]*)', 1)) ELSE 0 END AS INTEGER) AS decimals, CAST(CASE WHEN is_number THEN length(regexp_extract(trim(t), '^[+-]?([0-9]*)', 1)) ELSE 0 END AS INTEGER) AS naturals,
    CAST(CASE WHEN is_number THEN length(regexp_replace(t, '[^0-9]', '', 'g')) ELSE 0 END AS INTEGER) AS digits, CAST(coalesce(length(t), 0) AS INTEGER) AS characters FROM n"""
)
def text_kinds(spark, sf_dir):
    names = {"sensor_date": "sensor_date", "sensor_time": "sensor_time", "date": "date", "serial": "sensor_serial_number", "interval": "sample_interval"}
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("t")) for n, c in names.items()])
    rows = table(spark, sf_dir, "l0a_telegrams").select("telegram_id", F.inline(pairs))
    t = F.col("t")
    kinds = {"is_number": text.is_number, "is_integer": text.is_integer, "has_decimals": text.has_decimals, "decimals": text.decimal_digits, "naturals": text.natural_digits, "digits": text.digits, "characters": text.characters}
    return rows.select("telegram_id", "field", *[f(t).alias(n) for n, f in kinds.items()])


@query(
    """SELECT report_id, CASE WHEN h IN (1, 2, 3, 9) THEN CAST(0 AS DOUBLE) WHEN h IN (5, 6, 7, 8) THEN 1 WHEN h = 4 THEN 2 WHEN h = 0 THEN -1 ELSE -2 END AS kind, CASE WHEN f IN (0, 1, 2, -1) THEN CAST(f AS DOUBLE) WHEN f IN (4, 5) THEN -2 END AS of_flag
    FROM (SELECT report_id, report_id % 12 AS h, report_id % 8 - 1 AS f FROM weather_reports)"""
)
def precipitation_types(spark, sf_dir):
    h, f = (F.col("report_id") % 12).cast("double"), (F.col("report_id") % 8 - 1).cast("double")
    return table(spark, sf_dir, "weather_reports").select("report_id", classification.precipitation_type(h).alias("kind"), _known(classification.precipitation_type_of_flag(f)).alias("of_flag"))


# --- time axis --------------------------------------------------------------------------------------------------------

_GAPS = """g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS dt FROM events),
    c AS (SELECT user_id, dt, count(*) AS n FROM g WHERE dt IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS share FROM c)"""


@query(f"WITH {_GAPS} SELECT user_id AS station_id, CAST(dt AS BIGINT) AS dt, n, round(share, 9) AS share FROM s")
def interval_shares(spark, sf_dir):
    return time_axis.interval_histogram(_series(spark, sf_dir)).select("station_id", "dt", "n", F.round("share", 9).alias("share"))


@query(
    """WITH u AS (SELECT DISTINCT station_id, epoch_us(time) // 1000000 AS s FROM sensor_readings WHERE station_id IS NOT NULL AND time IS NOT NULL), g AS (SELECT station_id, s - lag(s) OVER (PARTITION BY station_id ORDER BY s) AS dt FROM u),
    c AS (SELECT station_id, dt, count(*) AS n FROM g WHERE dt IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY station_id) AS share FROM c),
    k AS (SELECT station_id, coalesce(sum(share) FILTER (dt = 60), 0) AS expected, arg_min(dt, -n * 10000000 + dt) AS mode, count(*) FILTER (dt <> 60 AND round_even(share * 100, 2) > 5) AS frequent FROM h GROUP BY station_id)
    SELECT station_id, 'expected interval is rare' AS warning FROM k WHERE round_even(expected * 100, 2) < 60 UNION ALL SELECT station_id, 'another interval is more frequent' FROM k WHERE mode <> 60
    UNION ALL SELECT station_id, 'unexpected intervals are frequent' FROM k WHERE frequent > 0"""
)
def interval_warnings(spark, sf_dir):
    readings = table(spark, sf_dir, "sensor_readings").where("station_id is not null and time is not null").select("station_id", F.date_trunc("second", F.col("time").cast("timestamp")).alias("time")).distinct()
    return time_axis.interval_warnings(readings, 60)


@query("SELECT obs_id, CAST(epoch_us(time) // 1000000 - CAST(sample_interval AS INTEGER) AS BIGINT) AS start_s, CAST(epoch_us(time) // 1000000 AS BIGINT) AS end_s FROM sensor_readings WHERE time IS NOT NULL AND sample_interval BETWEEN 1 AND 3600")
def time_bounds(spark, sf_dir):
    bounds = time_axis.time_bounds(F.col("time"), time_axis.whole_seconds(F.col("sample_interval")))
    rows = table(spark, sf_dir, "sensor_readings").where("time is not null and sample_interval between 1 and 3600").select("obs_id", bounds.alias("b"))
    return rows.select("obs_id", time_axis.seconds(F.col("b.start")).alias("start_s"), time_axis.seconds(F.col("b.end")).alias("end_s"))


@query(
    """WITH s AS (SELECT user_id, date_trunc('month', min(ts) - INTERVAL 1 SECOND) AS a, date_trunc('month', max(ts) - INTERVAL 1 SECOND) AS b FROM events GROUP BY user_id),
    m AS (SELECT user_id, a + to_months(CAST(unnest(range(0, 60)) AS INTEGER)) AS start, b FROM s)
    SELECT user_id AS station_id, CAST(epoch_us(start) // 1000000 AS BIGINT) AS start_s, CAST(epoch_us(start + INTERVAL 1 MONTH) // 1000000 - 1 AS BIGINT) AS end_s FROM m WHERE start <= b"""
)
def monthly_blocks(spark, sf_dir):
    blocks = time_axis.time_blocks(_series(spark, sf_dir), "month")
    return blocks.select("station_id", time_axis.seconds(F.col("block_start")).alias("start_s"), time_axis.seconds(F.col("block_end")).alias("end_s"))


@query(
    """WITH f AS (SELECT file_id, logger_id, period_start AS a, period_start + INTERVAL 30 HOUR AS b FROM raw_files WHERE logger_id IS NOT NULL AND period_start IS NOT NULL)
    SELECT DISTINCT logger_id AS station_id, CAST(epoch_us(date_trunc('day', a) + to_days(CAST(i AS INTEGER))) // 1000000 AS BIGINT) AS start_s FROM f, range(0, 3) t(i)
    WHERE a <= date_trunc('day', a) + to_days(CAST(i + 1 AS INTEGER)) - INTERVAL 1 SECOND AND b >= date_trunc('day', a) + to_days(CAST(i AS INTEGER))"""
)
def daily_partitions(spark, sf_dir):
    spans = table(spark, sf_dir, "raw_files").where("logger_id is not null and period_start is not null").select(F.col("logger_id").alias("station_id"), F.col("period_start").cast("timestamp").alias("start"), (F.col("period_start") + F.expr("interval 30 hours")).cast("timestamp").alias("end"))
    out = time_axis.temporal_partitions(spans, "time_block", "day", time_is_end=False)
    return out.select("station_id", time_axis.seconds(F.col("block_start")).alias("start_s"))


@query(
    """WITH e AS (SELECT *, count(*) OVER (PARTITION BY station_id, date_trunc('day', time), sample_interval) AS n FROM sensor_readings WHERE station_id IS NOT NULL AND time IS NOT NULL AND sample_interval IN (30, 60, 120, 300, 600))
    SELECT obs_id, CAST(sample_interval AS INTEGER) AS interval_s FROM e WHERE n > 2"""
)
def split_logged_intervals(spark, sf_dir):
    readings = table(spark, sf_dir, "sensor_readings").where("station_id is not null and time is not null").select("station_id", "obs_id", "time", "sample_interval")
    return time_axis.split_by_interval(readings, (30, 60, 120, 300, 600)).select("obs_id", "interval_s")


@query(
    f"""WITH {_HOURLY_N}, g AS (SELECT user_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY user_id), f AS (SELECT g.user_id, g.hour, cos(radians(fmod(h.m, 360) + 0.003)) AS u, sin(radians(fmod(h.m, 360) + 0.003)) AS v FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.hour = h.hour),
    l AS (SELECT *, last_value(CASE WHEN u IS NOT NULL THEN hour END IGNORE NULLS) OVER a AS h0, last_value(u IGNORE NULLS) OVER a AS u0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN u IS NOT NULL THEN hour END IGNORE NULLS) OVER b AS h1, first_value(u IGNORE NULLS) OVER b AS u1, first_value(v IGNORE NULLS) OVER b AS v1 FROM f
        WINDOW a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    p AS (SELECT user_id, hour, CASE WHEN u IS NOT NULL THEN u WHEN hour - h0 <= 9 THEN u0 + (u1 - u0) * (hour - h0) / (h1 - h0) END AS x, CASE WHEN u IS NOT NULL THEN v WHEN hour - h0 <= 9 THEN v0 + (v1 - v0) * (hour - h0) / (h1 - h0) END AS y FROM l)
    SELECT user_id AS station_id, CAST((hour + 1) * 3600 AS BIGINT) AS epoch_s, fmod(round_even(fmod(degrees(atan2(y, x)) + 360, 360) / 10, 0) * 10, 360) AS direction FROM p"""
)
def interp_circular(spark, sf_dir):
    filled = time_axis.fill_grid(_hourly_counts(spark, sf_dir).select("station_id", "time", (F.col("Dmax") % 360 + 0.003).alias("direction")), 3600)
    return joins.interpolate_direction(filled, "direction", limit=9).select("station_id", time_axis.seconds(F.col("time")).alias("epoch_s"), "direction")


@query(
    """WITH r AS (SELECT event_id, user_id, ts, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS minute FROM events)
    SELECT event_id, CAST(minute * 60 + 10 * (row_number() OVER (PARTITION BY user_id, minute ORDER BY event_id) - 1) AS BIGINT) AS second FROM r"""
)
def sub_minute_times(spark, sf_dir):
    rows = _series(spark, sf_dir).select("station_id", "event_id", F.date_trunc("minute", F.col("time").cast("timestamp")).alias("time"))
    return joins.sub_minute_times(rows, 10, order=("event_id",)).select("event_id", time_axis.seconds(F.col("time")).alias("second"))


# --- events -------------------------------------------------------------------------------------------------------------

_EVENTS = """c AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING) - 1 AS n FROM events WHERE value > 50),
    g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM c WHERE n >= 1),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS event_id FROM g),
    t AS (SELECT user_id, event_id, min(ts) AS a, max(ts) AS b, (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) // 60 AS minutes FROM k GROUP BY 1, 2 HAVING count(*) >= 3 AND (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) // 60 >= 5),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minutes DESC, a) AS event_rank FROM t)"""


@query(f"WITH {_EVENTS} SELECT o.user_id AS station_id, CAST(o.event_id AS BIGINT) AS event_id, CAST(event_rank AS INTEGER) AS event_rank, e.event_id AS row_id, e.value FROM o JOIN events e ON e.user_id = o.user_id AND e.ts BETWEEN o.a AND o.b")
def split_into_events(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumnRenamed("event_id", "row_id")
    out = events.split_into_events(rows, "value", 50.0, neighbours=1, within="6H", max_gap="12H", min_duration="5MIN", min_size=3, sort_by="duration_min")
    return out.select("station_id", "event_id", "event_rank", "row_id", "value")


@query(
    """WITH r AS (SELECT event_id, user_id, ts, round_even(value / 40, 0) AS t FROM events), c AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY user_id ORDER BY ts) THEN 0 ELSE 1 END AS new FROM r),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, run) * 60 >= 10800 / 60 THEN 1 ELSE 0 END AS qc_temperature FROM k"""
)
def temperature_runs(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("t", F.col("value") / 40)
    return events.qc_temperature(rows, "t", 60, threshold_minutes=3).select("event_id", "qc_temperature")


@query(
    """WITH u AS (SELECT * FROM (SELECT station_id, time, obs_id, number_particles > 4 AND NOT isnan(number_particles) AS particle, CAST(obs_id % 5 - 1 AS INTEGER) AS phase, row_number() OVER (PARTITION BY station_id, time ORDER BY obs_id) AS k FROM sensor_readings WHERE station_id IS NOT NULL AND time IS NOT NULL) WHERE k = 1),
    c AS (SELECT station_id, time, count(*) OVER (PARTITION BY station_id ORDER BY time RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND INTERVAL 5 MINUTE FOLLOWING) - 1 AS n FROM u WHERE particle),
    g AS (SELECT station_id, time, CASE WHEN time - lag(time) OVER (PARTITION BY station_id ORDER BY time) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM c WHERE n >= 2),
    k AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS e FROM g),
    t AS (SELECT station_id, e, min(time) AS a, max(time) AS b FROM k GROUP BY 1, 2 HAVING count(*) >= 5 AND (epoch_us(max(time)) // 1000000 - epoch_us(min(time)) // 1000000) // 60 >= 20)
    SELECT t.station_id, CAST(epoch_us(a) // 1000000 AS BIGINT) AS start_s, count(*) FILTER (phase = 0) AS n_rainy, count(*) FILTER (phase = 1) AS n_snow, count(*) FILTER (phase = 2) AS n_mixed, count(*) FILTER (phase >= 0) AS n_precip,
        round(count(*) FILTER (phase >= 0) / count(*), 6) AS fraction_precip FROM t JOIN u ON u.station_id = t.station_id AND u.time BETWEEN t.a AND t.b GROUP BY t.station_id, t.e, t.a"""
)
def phase_summary(spark, sf_dir):
    """Particle events of the readings, with a phase by the number of the reading."""
    first = Window.partitionBy("station_id", "time").orderBy("obs_id")
    rows = table(spark, sf_dir, "sensor_readings").where("station_id is not null and time is not null").withColumn("k", F.row_number().over(first)).where("k = 1")
    rows = rows.select("station_id", "time", F.col("number_particles").alias("n_particles"), (F.col("obs_id") % 5 - 1).cast("int").alias("precipitation_type"), F.lit(0).alias("flag_hail"), F.lit(3).alias("hydrometeor_type"))
    out = events.phase_summary(rows)
    return out.select("station_id", time_axis.seconds(F.col("start_time")).alias("start_s"), "n_rainy", "n_snow", "n_mixed", "n_precip", F.round("fraction_precip", 6).alias("fraction_precip"))


# --- statistics ----------------------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT * FROM l2e_params WHERE "R" > 0 AND NOT isnan("R")), s AS (SELECT station_id, min(time) AS a, max(time) AS b, count(*) AS n, count(*) FILTER ("R" > 10 AND "R" <= 25) AS n25 FROM w GROUP BY station_id)
    SELECT station_id, CASE WHEN year(a) = year(b) THEN CAST(year(a) AS VARCHAR) ELSE concat(year(a), ' - ', year(b)) END AS years_coverage, CASE WHEN year(a) = year(b) THEN concat(strftime(a, '%b'), '-', strftime(b, '%b'), ' ', year(a)) ELSE concat(strftime(a, '%b'), ' ', year(a), ' - ', strftime(b, '%b'), ' ', year(b)) END AS years_month_coverage,
        CAST(n AS BIGINT) AS n_rainy_minutes, CAST(n25 AS BIGINT) AS n_rainy_minutes_10_25 FROM s"""
)
def rain_coverage(spark, sf_dir):
    out = statistics.rain_summary(table(spark, sf_dir, "l2e_params").withColumn("Dmax", F.col("Dm") * 2), "1MIN")
    return out.select("station_id", "years_coverage", "years_month_coverage", "n_rainy_minutes", "n_rainy_minutes_10_25")


_LOG = "SELECT row_id, CAST(floor((log10(\"R\" * 1.0000371) - log10(0.01137)) / 0.25) AS INTEGER) AS arange_bin, CAST(floor((log10(\"R\" * 1.0000371) - log10(0.01137)) / (4 / 15.0)) AS INTEGER) AS linspace_bin FROM l2e_params WHERE \"R\" >= 0.02 AND \"R\" < 100"


@query(_LOG)
def logarithmic_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "l2e_params").where("R >= 0.02 and R < 100")
    bins = {"arange_bin": statistics.log_arange(0.01137, 113.7, 0.25), "linspace_bin": statistics.log_linspace(0.01137, 113.7, 16)}
    return rows.select("row_id", *[statistics.bin_index(F.col("R") * 1.0000371, edges.tolist(), right=False).alias(n) for n, edges in bins.items()])


@query(
    """SELECT row_id, round(200 * pow(r, 1.6), 5) AS power, round(pow(r, 1 / 1.6) / pow(200, 1 / 1.6), 6) AS inverse, round(pow(200, -1 / 1.6) * pow(r, 1 / 1.6), 6) AS of_parameters, round(200 * pow(10, 1.6 * log10(r) - 0.1 * log10(r) * log10(r)), 5) AS quadratic
    FROM (SELECT row_id, "R" AS r FROM l2e_params WHERE "R" > 0.001 AND "R" < 1000 AND NOT isnan("R"))"""
)
def power_law_values(spark, sf_dir):
    law, bent, x = statistics.PowerLaw(200.0, 1.6), statistics.PowerLaw(200.0, 1.6, -0.1), F.col("R")
    rows = table(spark, sf_dir, "l2e_params").where("R > 0.001 and R < 1000 and not isnan(R)")
    return rows.select("row_id", F.round(law.predict(x), 5).alias("power"), F.round(law.predict_inverse(x), 6).alias("inverse"), F.round(law.inverse().predict(x), 6).alias("of_parameters"), F.round(bent.predict(x), 5).alias("quadratic"))


@query(
    """WITH p AS (SELECT floor(l_quantity / 5) AS bin, l_extendedprice AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_quantity < 55), m AS (SELECT bin, median(y) AS y, count(*) AS n FROM p GROUP BY bin),
    d AS (SELECT p.bin, median(abs(p.y - m.y)) AS mad FROM p JOIN m ON p.bin = m.bin GROUP BY p.bin), x AS (SELECT log10(m.bin * 5 + 2.5) AS lx, log10(m.y) AS ly, m.y, 1.4826 * mad AS sigma FROM m JOIN d ON m.bin = d.bin WHERE m.y > 0 AND n > 10),
    f AS (SELECT quantile_cont(sigma, 0.01) AS least FROM x WHERE sigma > 0), w AS (SELECT lx, ly, pow(y * ln(10) / greatest(sigma, least), 2) AS w FROM x, f),
    s AS (SELECT sum(w) AS s0, sum(w * lx) AS sx, sum(w * ly) AS sy, sum(w * lx * lx) AS sxx, sum(w * lx * ly) AS sxy FROM w)
    SELECT round(pow(10, (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx)), 4) AS a, round((s0 * sxy - sx * sy) / (s0 * sxx - sx * sx), 6) AS b, round(ln(10) * pow(10, (sxx * sy - sx * sxy) / (s0 * sxx - sx * sx)) * sqrt(sxx / (s0 * sxx - sx * sx)), 4) AS a_std, round(sqrt(s0 / (s0 * sxx - sx * sx)), 6) AS b_std FROM s"""
)
def powerlaw_fit(spark, sf_dir):
    law = statistics.fit_power_law(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", list(range(0, 60, 5)))
    return spark.createDataFrame([tuple(round(x, n) for x, n in ((law.a, 4), (law.b, 6), (law.a_std, 4), (law.b_std, 6)))], "a double, b double, a_std double, b_std double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 9) END AS ratio FROM lineitem")
def safe_ratios(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(_known(statistics.safe_ratio(F.col("l_discount"), F.col("l_tax"))), 9).alias("ratio"))


@query("SELECT DISTINCT 'l_returnflag' AS \"column\", l_returnflag AS value FROM lineitem UNION SELECT DISTINCT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem")
def unique_texts(spark, sf_dir):
    return statistics.unique_values(table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linenumber"))


@query(
    """WITH s AS (SELECT l_returnflag, max(l_quantity) AS hi, min(l_quantity) AS lo, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(l_quantity / hi, 9) AS by_max, round((l_quantity - lo) / (hi - lo), 9) AS by_range, round((l_quantity - m) / d, 9) AS by_spread, round(log10(l_quantity), 9) AS by_log FROM lineitem l JOIN s ON l.l_returnflag = s.l_returnflag"""
)
def normalizations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col("l_quantity").cast("double").alias(n) for n in ("by_max", "by_range", "by_spread", "by_log")])
    for column, method in (("by_max", "max"), ("by_range", "minmax"), ("by_spread", "zscore")):
        rows = statistics.normalized(rows, column, method, ["l_returnflag"])
    return statistics.normalized(rows, "by_log", "log").select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in ("by_max", "by_range", "by_spread", "by_log")])


@query(
    """WITH h AS (SELECT DISTINCT l_returnflag, l_linestatus, floor(l_quantity / 10)::INTEGER AS x_bin, floor(l_extendedprice / 20000)::INTEGER AS y_bin FROM lineitem WHERE l_quantity < 50 AND l_extendedprice < 100000),
    d AS (SELECT x_bin, y_bin, sum(1.0 / n) AS density FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, x_bin) AS n FROM h) GROUP BY 1, 2)
    SELECT x_bin, y_bin, round(density / (SELECT max(density) FROM d), 9) AS density FROM d"""
)
def line_density_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    out = statistics.line_density(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", [0, 10, 20, 30, 40, 50], [0, 20_000, 40_000, 60_000, 80_000, 100_000])
    return out.select("x_bin", "y_bin", F.round("density", 9).alias("density"))


@query(
    """SELECT p, round(max(alpha), 6) AS alpha, arg_max(l_partkey, alpha) AS red FROM (SELECT CAST(l_orderkey % 997 AS BIGINT) AS p, l_partkey, l_extendedprice + l_orderkey / 1e7 + l_linenumber / 1e9 AS alpha FROM lineitem) GROUP BY p"""
)
def blended_images(spark, sf_dir):
    alpha = F.col("l_extendedprice") + F.col("l_orderkey") / 1e7 + F.col("l_linenumber") / 1e9
    images = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 997).cast("bigint").alias("p"), F.col("l_partkey").alias("red"), alpha.alias("alpha"))
    return statistics.max_blend(images, ["p"], "alpha", ["red"]).select("p", F.round("alpha", 6).alias("alpha"), "red")


@query(
    f"""WITH {_LONG}, m AS (SELECT vec_id, sum(pow(d, 3) * nd * {_W}) AS m3, sum(pow(d, 4) * nd * {_W}) AS m4 FROM s GROUP BY vec_id), w AS (SELECT *, m4 / m3 AS dm, 256 / 6.0 * pow(m3, 5) / pow(m4, 4) AS nw FROM m)
    SELECT s.vec_id, CAST(i - 1 AS INTEGER) AS bin, round(d / dm, 9) AS "D_Dm", round(log10(nd / nw), 9) AS "log10_ND_Nw" FROM s JOIN w ON s.vec_id = w.vec_id WHERE nd <> 0"""
)
def normalized_points(spark, sf_dir):
    w = F.array(*[F.lit(BIN_WIDTH)] * N_BINS)
    rows = staged(_spectra(spark, sf_dir), {"m3": spectrum.moment(F.col("nd"), _CENTERS(), w, 3), "m4": spectrum.moment(F.col("nd"), _CENTERS(), w, 4)})
    rows = rows.withColumns({"R": F.lit(1.0), "Dm": spectrum.mean_volume_diameter(F.col("m3"), F.col("m4")), "D50": F.lit(1.0), "Nw": spectrum.normalized_intercept_from_moments(F.col("m3"), F.col("m4"))})
    out = statistics.dsd_points(rows, _CENTERS(), "nd", ("vec_id", "R", "Dm", "D50", "Nw"))
    return out.select("vec_id", "bin", F.round("D_Dm", 9).alias("D_Dm"), F.round("log10_ND_Nw", 9).alias("log10_ND_Nw"))


# --- lookups and bins -------------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CAST(x AS DOUBLE) AS nearest_x, CAST(y AS DOUBLE) AS nearest_y, CAST(x * y AS BIGINT) AS v FROM (
        SELECT l_orderkey, l_linenumber, greatest(0, least(50, ceil(l_quantity / 10 - 0.5) * 10)) AS x, greatest(0, least(100000, ceil(l_extendedprice / 20000 - 0.5) * 20000)) AS y FROM lineitem)"""
)
def grid_snap_lookup(spark, sf_dir):
    grid = spark.createDataFrame([(float(x), float(y), x * y) for x in range(0, 60, 10) for y in range(0, 120_000, 20_000)], "x double, y double, v long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return joins.grid_lookup(rows, grid, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "nearest_x", "nearest_y", "v")


@query(
    f"""WITH {_LONG} SELECT vec_id, CAST(j AS INTEGER) AS bin, round(sum(nd * greatest(0, least(i * {_W}, (j + 1) * 0.3) - greatest((i - 1) * {_W}, j * 0.3)) / {_W}), 6) AS counts FROM s, range(0, 26) t(j) GROUP BY 1, 2"""
)
def remapped_counts(spark, sf_dir):
    out = remap.resample_drop_counts(_spectra(spark, sf_dir), "nd", "x", _BINS, (np.arange(27) * 0.3).tolist())
    return out.select("vec_id", F.posexplode("x").alias("bin", "counts")).select("vec_id", "bin", F.round("counts", 6).alias("counts"))


@query(f"WITH {_LONG} SELECT vec_id, CAST(i - 9 AS INTEGER) AS bin, round(nd, 6) AS nd FROM s WHERE i BETWEEN 9 AND 40")
def kept_diameters(spark, sf_dir):
    keep = remap.kept_bins(_BINS, 1.0, 5.0)
    out = _spectra(spark, sf_dir).select("vec_id", F.posexplode(remap.select_bins(F.col("nd"), keep)).alias("bin", "nd"))
    return out.select("vec_id", "bin", F.round("nd", 6).alias("nd"))


@query(f"WITH {_LONG} SELECT a.vec_id, CAST(a.i - 1 AS INTEGER) AS bin, round((a.nd + b.nd) / 2, 6) AS nd FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.i = a.i + 1")
def between_diameters(spark, sf_dir):
    out = remap.interpolate_bins(_spectra(spark, sf_dir), "nd", "x", _BINS.center, _BINS.upper[:-1])
    return out.select("vec_id", F.posexplode("x").alias("bin", "nd")).select("vec_id", "bin", F.round("nd", 6).alias("nd"))


# --- stations and files -------------------------------------------------------------------------------------------------------


@query(
    """SELECT station_id, data_source FROM stations s WHERE sensor_name IN ('PARSIVEL', 'PARSIVEL2') AND platform_type = 'fixed' AND deployment_status = 'ongoing' AND EXISTS (SELECT 1 FROM l2e_params p WHERE p.station_id = s.station_id)"""
)
def chosen_stations(spark, sf_dir):
    stations = files.select_stations(table(spark, sf_dir, "stations"), with_data=table(spark, sf_dir, "l2e_params").select("station_id"), sensor_name=["PARSIVEL", "PARSIVEL2"], platform_type="fixed", deployment_status="ongoing")
    return stations.select("station_id", "data_source")


@query("SELECT DISTINCT data_source, campaign_name, station_name, sensor_name FROM stations")
def station_sensors(spark, sf_dir):
    return files.metadata_values(table(spark, sf_dir, "stations"), "sensor_name").distinct()


@query(
    """WITH s AS (SELECT station_id, sensor_name, platform_type, deployment_status, measurement_interval, latitude * 1.5 AS latitude, longitude * 1.2 AS longitude FROM stations)
    SELECT station_id, 'sensor_name is unknown' AS rule FROM s WHERE coalesce(sensor_name, '') NOT IN ('PARSIVEL', 'PARSIVEL2', 'LPM', 'LPM_V0', 'PWS100', 'SWS250', 'ODM470', 'RD80') UNION ALL SELECT station_id, 'latitude is out of bounds' FROM s WHERE latitude < -90 OR latitude > 90
    UNION ALL SELECT station_id, 'longitude is out of bounds' FROM s WHERE longitude < -180 OR longitude > 180 UNION ALL SELECT station_id, 'a fixed platform has no place' FROM s WHERE platform_type = 'fixed' AND (latitude IS NULL OR longitude IS NULL)
    UNION ALL SELECT station_id, 'deployment_status is unknown' FROM s WHERE coalesce(deployment_status, '') NOT IN ('ongoing', 'terminated') UNION ALL SELECT station_id, 'measurement_interval is missing' FROM s WHERE measurement_interval IS NULL"""
)
def station_rules(spark, sf_dir):
    """Rules that the stations break when their places are stretched, so that some do."""
    stretched = table(spark, sf_dir, "stations").withColumns({"latitude": F.col("latitude") * 1.5, "longitude": F.col("longitude") * 1.2})
    return files.metadata_violations(stretched).select("station_id", "rule")


_FILE_TIMES = """f AS (SELECT file_id, strptime(regexp_extract(file_name, '[.]s([0-9]{14})', 1), '%Y%m%d%H%M%S') AS a, regexp_extract(file_name, '^([^.]+)', 1) AS campaign, regexp_extract(file_name, '[.](L[0-9]+)[.]s', 1) AS station FROM raw_files)"""


def _product_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files under the names of products, with the parts of the names as columns."""
    start = F.regexp_extract("file_name", r"\.s(\d{14})", 1)
    name = F.concat(F.lit("L2E.1MIN."), F.regexp_extract("file_name", r"^([^.]+)", 1), F.lit("."), F.regexp_extract("file_name", r"\.(L\d+)\.s", 1), F.lit(".s"), start, F.lit(".e"), F.date_format(F.try_to_timestamp(start, F.lit("yyyyMMddHHmmss")) + F.expr("interval 1 day"), "yyyyMMddHHmmss"), F.lit(".V0.parquet"))
    raw = table(spark, sf_dir, "raw_files").select("file_id", name.alias("path"))
    return raw.withColumns(files.filename_columns(F.col("path")))


@query(f"WITH {_FILE_TIMES} SELECT file_id FROM f WHERE a <= TIMESTAMP '2020-06-30 00:00:00' AND a + INTERVAL 1 DAY >= TIMESTAMP '2017-05-01 00:00:00' AND NOT a + INTERVAL 1 DAY = TIMESTAMP '2017-05-01 00:00:00' AND NOT a = TIMESTAMP '2020-06-30 00:00:00'")
def files_of_period(spark, sf_dir):
    return files.prune_by_time(_product_files(spark, sf_dir), "2017-05-01 00:00:00", "2020-06-30 00:00:00").select("file_id")


@query(f"WITH {_FILE_TIMES} SELECT concat(campaign, '/', station, '/', year(a), '/', CASE WHEN month(a) IN (12, 1, 2) THEN 'DJF' WHEN month(a) <= 5 THEN 'MAM' WHEN month(a) <= 8 THEN 'JJA' ELSE 'SON' END) AS \"group\", CAST(count(*) AS INTEGER) AS n FROM f GROUP BY 1")
def file_groups(spark, sf_dir):
    grouped = files.group_files(_product_files(spark, sf_dir), ["campaign_name", "station_name", "year", "season"])
    return grouped.select("group", F.size("paths").alias("n"))


# --- permittivity -----------------------------------------------------------------------------------------------------------

_DEBYE = """WITH p AS (SELECT row_id, (row_id % 400) / 10.0 AS t, 1.0 + (row_id % 93) AS f FROM l2e_params), q AS (SELECT *, 1 - 300 / (t + 273.15) AS h FROM p),
    l AS (SELECT *, 77.66 - 103.3 * h AS e0, 20.20 + 146.5 * h + 316 * h * h AS g1, 20.27 + 146.5 * h + 314 * h * h AS gs, (37088.6 - 82.168 * t) / (421.854 + t) AS n0, 5.723 + 2.2379e-2 * t - 7.1237e-4 * t * t AS n1, 3.6143 + 2.8841e-2 * t AS ni,
        (5.0478 - 7.0315e-2 * t + 6.0059e-4 * t * t) / (45 + t) AS w1, (1.3652e-1 + 1.4825e-3 * t + 2.4166e-4 * t * t) / (45 + t) AS w2,
        2 * pi() * f * 1e9 * 1.302e-13 * exp(6.627e2 / (t + 1.342e2)) AS x1, 2 * pi() * f * 1e9 * 1.012e-14 * exp(6.089e2 / (t + 1.342e2)) AS x2, 8.111e1 * exp(-4.434e-3 * t) AS d1, 2.025 * exp(-1.073e-2 * t) AS d2 FROM q),
    e AS (SELECT row_id, f, (e0 - 0.066 * e0) / (1 + pow(f / gs, 2)) + 0.066 * e0 AS single_re, (e0 - 0.066 * e0) * (f / gs) / (1 + pow(f / gs, 2)) AS single_im,
        (e0 - 0.0671 * e0) / (1 + pow(f / g1, 2)) + (0.0671 * e0 - 3.52 - 7.52 * h) / (1 + pow(f / (39.8 * g1), 2)) + 3.52 + 7.52 * h AS double_re, (e0 - 0.0671 * e0) * (f / g1) / (1 + pow(f / g1, 2)) + (0.0671 * e0 - 3.52 - 7.52 * h) * (f / (39.8 * g1)) / (1 + pow(f / (39.8 * g1), 2)) AS double_im,
        (n0 - n1) / (1 + pow(f * w1, 2)) + (n1 - ni) / (1 + pow(f * w2, 2)) + ni AS ellison_re, (n0 - n1) * f * w1 / (1 + pow(f * w1, 2)) + (n1 - ni) * f * w2 / (1 + pow(f * w2, 2)) AS ellison_im,
        8.79144e1 - 4.04399e-1 * t + 9.58726e-4 * t * t - 1.32802e-6 * pow(t, 3) - d1 * x1 * x1 / (1 + x1 * x1) - d2 * x2 * x2 / (1 + x2 * x2) AS turner_re, d1 * x1 / (1 + x1 * x1) + d2 * x2 / (1 + x2 * x2) AS turner_im FROM l)"""
_PERMITTIVITY = {"single": "Liebe1991single", "double": "Liebe1991", "ellison": "Ellison2007", "turner": "Turner2016"}


def _root(name: str) -> str:
    size = f"sqrt({name}_re * {name}_re + {name}_im * {name}_im)"
    return f"round(sqrt(({size} + {name}_re) / 2), 7) AS {name}_n, round(sqrt(({size} - {name}_re) / 2), 7) AS {name}_k"


@query(
    f"{_DEBYE} SELECT row_id, {', '.join(_root(n) for n in _PERMITTIVITY)}, round((pow(turner_re - 1, 2) + turner_im * turner_im) / (pow(turner_re + 2, 2) + turner_im * turner_im), 7) AS k2 FROM e"
)
def refractive_index(spark, sf_dir):
    n = F.col("row_id")
    out = table(spark, sf_dir, "l2e_params").select("row_id", ((n % 400) / 10.0).alias("t"), (1.0 + n % 93).cast("double").alias("f"))
    for name, model in _PERMITTIVITY.items():
        re, im = permittivity.refractive_index(F.col("t"), F.col("f"), model)
        out = staged(out, {f"{name}_n": re, f"{name}_k": im})
    factor = permittivity.rayleigh_dielectric_factor(F.col("turner_n"), F.col("turner_k"))
    return out.select("row_id", *[F.round(f"{m}_{c}", 7).alias(f"{m}_{c}") for m in _PERMITTIVITY for c in "nk"], F.round(factor, 7).alias("k2"))
