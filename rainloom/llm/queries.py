"""Named queries of the llm operators, with SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import keyword_pages, leaks, mixing, nearest_time, quantile_sketch
from rainloom.session import table

SKETCH_FIELDS = ("R", "Dm", "Nw")
SKETCH_KEYS = ("station_id", "velocity_method", "day")
PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)
PAIR_TOLERANCE_S = 45
#: Every source that has documents reaches its share; the mix is as large as the scarcest allows.
MIX_SHORT_SHARE = 0.0


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "l2e_params").withColumn("day", F.to_date("time"))
    return quantile_sketch.sketch(params, SKETCH_KEYS, SKETCH_FIELDS)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_sketch.percentiles(_daily(spark, sf_dir), SKETCH_KEYS, PERCENTS)


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all days, from the sketches of single days."""
    keys = ("station_id", "velocity_method")
    return quantile_sketch.percentiles(quantile_sketch.merge(_daily(spark, sf_dir), keys), keys, PERCENTS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, readings = table(spark, sf_dir, "weather_reports"), table(spark, sf_dir, "sensor_readings")
    return nearest_time.nearest(reports, readings, "report_time", "time", "report_id", "obs_id", PAIR_TOLERANCE_S).select("obs_id", "report_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), short_share=MIX_SHORT_SHARE)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), short_share=MIX_SHORT_SHARE)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_pages.keyword_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_percentiles, p3_combined, p7_found, p8_found, p9_mix, p9_shares, p10_found)
}


def _percentile_sql(keys: str) -> str:
    gamma = (1 + quantile_sketch.ACCURACY) / (1 - quantile_sketch.ACCURACY)
    columns = ", ".join(f"min(CASE WHEN upto > floor({q} * (total - 1)) THEN bucket END) AS b{round(q * 100):02d}" for q in PERCENTS)
    values = ", ".join(
        f"CASE WHEN b{p} = 0 THEN 0.0 ELSE sign(b{p}) * 2 * pow({gamma!r}, abs(b{p}) - 1048576) / ({gamma!r} + 1) END AS p{p}" for p in (f"{round(q * 100):02d}" for q in PERCENTS)
    )
    fields = " UNION ALL ".join(f"SELECT station_id, velocity_method, CAST(time AS DATE) AS day, '{f}' AS field, {f} AS x FROM l2e_params" for f in SKETCH_FIELDS)
    return f"""
        WITH v AS ({fields}),
        b AS (
            SELECT {keys}, field, CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / {math.log(gamma)!r}) + 1048576) END AS bucket, count(*) AS n
            FROM v WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) GROUP BY ALL),
        c AS (
            SELECT *, sum(n) OVER (PARTITION BY {keys}, field ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}, field) AS total FROM b),
        q AS (SELECT {keys}, field, max(total) AS n, {columns} FROM c GROUP BY {keys}, field)
        SELECT {keys}, field, CAST(n AS BIGINT) AS n, {values} FROM q"""


ORACLES: dict[str, str] = {
    "p3_percentiles": _percentile_sql("station_id, velocity_method, day"),
    "p3_combined": _percentile_sql("station_id, velocity_method"),
    "p7_found": """
        WITH r AS (SELECT station_id, time, min(obs_id) AS obs_id FROM sensor_readings WHERE station_id IS NOT NULL AND time IS NOT NULL GROUP BY station_id, time),
        w AS (SELECT report_id, station_id, report_time FROM weather_reports WHERE station_id IS NOT NULL AND report_time IS NOT NULL),
        pairs AS (
            SELECT w.report_id, r.obs_id, abs(epoch_us(r.time) - epoch_us(w.report_time)) AS off, r.time
            FROM w JOIN r ON w.station_id = r.station_id AND r.time BETWEEN w.report_time - INTERVAL 45 SECOND AND w.report_time + INTERVAL 45 SECOND)
        SELECT obs_id, report_id FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY off, time) AS k FROM pairs) WHERE k = 1""",
}
