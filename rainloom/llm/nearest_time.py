"""Records of two tables paired by nearest time for the same entity, within a tolerance.

Both sides are hash-partitioned by entity and day and handed to DuckDB as Arrow groups: a backward and a
forward ASOF join per record, of which the nearer candidate within the tolerance stays. An entity with a
third of all rows is spread over its days; readings near midnight are also sent to the neighbouring day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.arrow_groups import whole_groups

DAY_US = 86_400_000_000
#: Memory of one DuckDB; a task holds one group of about a batch of rows at a time.
DUCKDB_MEMORY = "256MB"

_PAIR = """
    WITH candidates AS (SELECT station_id, day, us, min(id) AS id FROM rows WHERE side = 0 GROUP BY station_id, day, us),
    records AS (SELECT station_id, day, us, id FROM rows WHERE side = 1),
    back AS (
        SELECT r.id AS record, r.us AS at, c.us AS us, c.id AS id FROM records r ASOF JOIN candidates c
        ON r.station_id = c.station_id AND r.day = c.day AND r.us >= c.us),
    ahead AS (
        SELECT r.id AS record, r.us AS at, c.us AS us, c.id AS id FROM records r ASOF JOIN candidates c
        ON r.station_id = c.station_id AND r.day = c.day AND r.us <= c.us),
    near AS (
        SELECT coalesce(back.record, ahead.record) AS record,
               CASE WHEN ahead.id IS NULL OR back.at - back.us <= ahead.us - ahead.at THEN back.id ELSE ahead.id END AS id,
               CASE WHEN ahead.id IS NULL OR back.at - back.us <= ahead.us - ahead.at THEN back.us - back.at ELSE ahead.us - ahead.at END AS off
        FROM back FULL JOIN ahead ON back.record = ahead.record)
    SELECT id AS obs_id, record AS report_id, off AS offset_us FROM near WHERE abs(off) <= {tolerance}"""


def nearest(records: DataFrame, candidates: DataFrame, record_time: str, candidate_time: str, record_id: str, candidate_id: str, tolerance_s: float, entity: str = "station_id") -> DataFrame:
    """obs_id, report_id, offset_us: for each record the candidate of its entity nearest in time.

    Pairs further apart than ``tolerance_s`` are left out. Of two equally near candidates the earlier
    counts, of several at one time the one of smallest id. Records and candidates without entity, time
    or id pair with nothing. Record ids are unique; other columns are dropped. Empty tables give no
    rows.
    """
    tolerance = round(tolerance_s * 1_000_000)
    if not 0 <= tolerance < DAY_US:
        raise ValueError("the tolerance must be less than a day")

    def side(df: DataFrame, time: str, key: str, number: int) -> DataFrame:
        us = F.unix_micros(F.col(time).cast("timestamp"))
        return df.where(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(key).isNotNull()).select(
            F.col(entity).cast("string").alias("station_id"), F.floor(us / F.lit(DAY_US)).cast("int").alias("day"), us.alias("us"), F.col(key).cast("long").alias("id"), F.lit(number).alias("side")
        )

    left, right = side(records, record_time, record_id, 1), side(candidates, candidate_time, candidate_id, 0)
    of_day = F.col("us") - F.col("day").cast("long") * DAY_US
    days = F.array_compact(F.array(F.lit(0), F.when(of_day <= tolerance, -1), F.when(of_day >= DAY_US - tolerance, 1)))
    right = right.withColumn("step", F.explode(days)).select("station_id", (F.col("day") + F.col("step")).alias("day"), "us", "id", "side")
    schema = pa.schema([("obs_id", pa.int64()), ("report_id", pa.int64()), ("offset_us", pa.int64())])
    query = _PAIR.format(tolerance=tolerance)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": "1", "memory_limit": DUCKDB_MEMORY}) as db:
            for group in whole_groups(batches):
                db.register("rows", group)
                found = db.sql(query).to_arrow_table().cast(schema)
                db.unregister("rows")
                yield from found.to_batches()

    rows = left.unionByName(right).repartition("station_id", "day").sortWithinPartitions("station_id", "day")
    return rows.mapInArrow(kernel, "obs_id bigint, report_id bigint, offset_us bigint")
