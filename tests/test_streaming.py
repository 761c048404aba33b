"""Streams worked off to the end equal their batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rainloom.operators import events
from rainloom.streaming import streams

T0 = datetime(2020, 1, 1)
SCHEMA = "station_id string, time timestamp, value double"


@pytest.fixture
def source(spark, tmp_path):
    """Three files in time order; a last late row pushes the watermark past all others."""
    rows = [("A", T0 + timedelta(seconds=60 * k), float(k)) for k in range(30) if k not in (7, 8, 20)] + [("B", T0 + timedelta(seconds=60 * k), 1.0) for k in (0, 1, 2, 25, 26)]
    rows += [("A", T0, 0.0), ("B", T0 + timedelta(seconds=60), 1.0)]  # copies
    for part in range(3):
        mine = [r for r in rows if (r[1] - T0).seconds // 600 == part]
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("Z", T0 + timedelta(days=9), 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(sorted(set(rows)), SCHEMA), streams.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1), tmp_path


def _worked_off(spark, stream, folder):
    streams.run_available(stream, str(folder / "out"), str(folder / "state"))
    return spark.read.parquet(str(folder / "out")).where("station_id <> 'Z'")


def test_deduplicated(spark, source):
    batch, stream, folder = source
    got = _worked_off(spark, streams.deduplicated(stream, late="1 hour"), folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_resampled(spark, source):
    batch, stream, folder = source
    got = _worked_off(spark, streams.resampled(streams.deduplicated(stream, late="1 hour"), 300, ["value"], ["value"], late=None), folder)
    expected = batch.groupBy("station_id", F.window("time", "300 seconds")["end"].alias("time")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.sum("value").alias("sum_value"))
    assert sorted(map(tuple, got.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_sessions(spark, source):
    batch, stream, folder = source
    got = _worked_off(spark, streams.sessions(streams.deduplicated(stream, late="1 hour"), 120, late=None), folder)
    expected = events.event_table(batch, 120)
    assert sorted(tuple(r) for r in got.select("station_id", "start_time", "end_time", "n_timesteps").collect()) == sorted(tuple(r) for r in expected.select("station_id", "start_time", "end_time", "n_timesteps").collect())


def test_gaps(spark, source):
    _, stream, folder = source
    got = _worked_off(spark, streams.gaps(stream, 60), folder)
    base = 1577836800
    assert sorted((r.slot_epoch_s - base) // 60 for r in got.where("station_id = 'A'").collect()) == [7, 8, 20]
    assert got.where("station_id = 'B'").count() == 22
