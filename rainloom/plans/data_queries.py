"""Named queries of the data problems of the core, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.operators import implausible, packed_lists, regular_grid, schema_drift, timestamps
from rainloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "raw_files"), table(spark, sf_dir, "raw_lines"))


def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = schema_drift.schema_versions(table(spark, sf_dir, "raw_files"), table(spark, sf_dir, "raw_lines"))
    return versions.select("file_id", "logger_id", "version", "fingerprint", F.concat_ws("; ", "migration").alias("migration"))


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.consistent_lines(table(spark, sf_dir, "raw_files"), table(spark, sf_dir, "raw_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = timestamps.utc_instants(table(spark, sf_dir, "l0a_telegrams"), table(spark, sf_dir, "stations"))
    return instants.where("utc_us is not null").select("telegram_id", "utc_us")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = timestamps.utc_instants(table(spark, sf_dir, "l0a_telegrams"), table(spark, sf_dir, "stations"))
    return instants.select("telegram_id", "utc_us", "status", "notation", "format", "posterior")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed_lists.entries(table(spark, sf_dir, "l0a_telegrams"), table(spark, sf_dir, "stations"), drops_only=True)
    return found.select("telegram_id", "field_name", "pos")


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_lists.entries(table(spark, sf_dir, "l0a_telegrams"), table(spark, sf_dir, "stations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible.implausible(table(spark, sf_dir, "sensor_readings")).select("obs_id", "field_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid.missing_slots(table(spark, sf_dir, "sensor_readings"))


def p6_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("rainfall_rate_32bit", "sensor_temperature", "laser_amplitude", "number_particles")
    return regular_grid.regular_series(table(spark, sf_dir, "sensor_readings"), columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_versions, p1_lines, p2_found, p2_status, p4_found, p4_entries, p5_found, p6_found, p6_series)
}

ORACLES: dict[str, str] = {
    "p6_found": """
        WITH r AS (
            SELECT station_id, epoch_us(time) AS t, epoch_us(time) // 86400000000 AS day, sample_interval
            FROM sensor_readings WHERE time IS NOT NULL AND station_id IS NOT NULL),
        votes AS (
            SELECT station_id, day, sample_interval, count(*) AS n FROM r
            WHERE sample_interval BETWEEN 1 AND 3600 GROUP BY station_id, day, sample_interval),
        steps AS (
            SELECT station_id, day, sample_interval AS step FROM (
                SELECT *, row_number() OVER (PARTITION BY station_id, day ORDER BY n DESC, sample_interval) AS k FROM votes)
            WHERE k = 1),
        p AS (
            SELECT r.station_id, r.day, step, t - r.day * 86400000000 AS us, (t - r.day * 86400000000) // (step * 1000000) * step AS low
            FROM r JOIN steps ON r.station_id = steps.station_id AND r.day = steps.day),
        filled AS (
            SELECT DISTINCT station_id, day * 86400 + CASE
                WHEN least(low + step, 86400) * 1000000 - us < us - low * 1000000 THEN least(low + step, 86400) ELSE low END AS slot
            FROM p),
        spans AS (SELECT station_id, slot // 86400 AS day, min(slot) AS a, max(slot) AS b FROM filled GROUP BY station_id, slot // 86400),
        slots AS (
            SELECT spans.station_id, unnest(range(a, b + 1, step)) AS slot
            FROM spans JOIN steps ON spans.station_id = steps.station_id AND spans.day = steps.day)
        SELECT station_id, CAST(slot AS BIGINT) AS slot_epoch_s FROM slots
        WHERE NOT EXISTS (SELECT 1 FROM filled WHERE filled.station_id = slots.station_id AND filled.slot = slots.slot)""",
}
