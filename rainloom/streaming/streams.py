"""Structured Streaming variants of deduplication, resampling, events and the regular grid.

Watermarks bound the state: what arrives later than ``late`` is dropped, as a batch block would not wait
for it either. Each function takes and returns a streaming DataFrame; sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lateness that is waited for by default; the tolerance of a block's edges.
LATE = "180 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(stream: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, unless the stream has one already (``late`` None): it cannot be redefined."""
    return stream if late is None else stream.withWatermark(time, late)


def deduplicated(stream: DataFrame, keys: Sequence[str] = ("station_id",), time: str = "time", late: str | None = LATE) -> DataFrame:
    """The first row per keys and time within the watermark."""
    return _marked(stream, time, late).dropDuplicatesWithinWatermark([*keys, time])


def resampled(stream: DataFrame, resolution_s: int, averages: Sequence[str] = (), sums: Sequence[str] = (), keys: Sequence[str] = ("station_id",), time: str = "time", late: str | None = LATE, slide_s: int | None = None) -> DataFrame:
    """Tumbling, or with ``slide_s`` rolling, windows labelled by their end: counts, means and sums."""
    window = F.window(time, f"{resolution_s} seconds", f"{slide_s} seconds") if slide_s else F.window(time, f"{resolution_s} seconds")
    grouped = _marked(stream, time, late).groupBy(*keys, window.alias("w"))
    out = grouped.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in averages], *[F.sum(c).alias(f"sum_{c}") for c in sums])
    return out.select(*keys, F.col("w.end").alias("time"), *[c for c in out.columns if c not in (*keys, "w")])


def sessions(stream: DataFrame, max_gap_s: int, least: int = 1, keys: Sequence[str] = ("station_id",), time: str = "time", late: str | None = LATE) -> DataFrame:
    """Events by gap: start, end (of the last row), number of rows; emitted when the gap has passed the watermark."""
    # A session ends when the gap has passed; one more microsecond lets equal gaps merge as in batch.
    grouped = _marked(stream, time, late).groupBy(*keys, F.session_window(time, f"{max_gap_s} seconds").alias("s"))
    out = grouped.agg(F.count("*").alias("n_timesteps"), F.min(time).alias("start_time"), F.max(time).alias("end_time"))
    return out.where(F.col("n_timesteps") >= least).select(*keys, "start_time", "end_time", "n_timesteps")


def interval_joined(left: DataFrame, right: DataFrame, tolerance_s: int, keys: Sequence[str] = ("station_id",), left_time: str = "time", right_time: str = "report_time", late: str | None = LATE) -> DataFrame:
    """Rows of two streams of the same keys within a tolerance in time; state is bounded on both sides."""
    a, b = _marked(left, left_time, late).alias("a"), _marked(right, right_time, late).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = F.col(f"b.{right_time}").between(F.col(f"a.{left_time}") - F.expr(f"interval {tolerance_s} seconds"), F.col(f"a.{left_time}") + F.expr(f"interval {tolerance_s} seconds"))
    condition = near
    for c in same:
        condition = condition & c
    joined = a.join(b, condition)
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in keys])


#: Most missing slots handed out at once.
GAP_ROWS = 50_000


def gaps(stream: DataFrame, step_s: int, key: str = "station_id", time: str = "time", late: str | None = LATE) -> DataFrame:
    """Missing slots of a regular series as they become certain: station, slot_epoch_s.

    The state of a key is its last slot seen; a batch of later rows tells the slots between. Rows at or
    before it are late and change nothing.
    """

    def step(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for rows in batches:
            second = rows[time].astype("datetime64[ns]").astype("int64") // 1_000_000_000
            seen |= set((-(-(2 * second - step_s) // (2 * step_s)) * step_s).tolist())
        last = state.get[0] if state.exists else None
        new = sorted(s for s in seen if last is None or s > last)
        if new:
            state.update((new[-1],))
            # Between successive slots that were seen, a bounded number of missing ones at a time.
            for before, after in zip([new[0] if last is None else last, *new], new):
                for a in range(before + step_s, after, step_s * GAP_ROWS):
                    missing = np.arange(a, min(after, a + step_s * GAP_ROWS), step_s)
                    yield pd.DataFrame({key: [keys[0]] * len(missing), "slot_epoch_s": missing})

    schema = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("slot_epoch_s", T.LongType())])
    state = T.StructType([T.StructField("last", T.LongType())])
    return _marked(stream, time, late).groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there into Parquet, exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
