"""Methods on a series, chained as in ``series(df).regularize(60).resample("5MIN").df``."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.functions import psd
from rainloom.operators import events, joins, products, resample, time_axis


class Series:
    """A DataFrame of time series with its key columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = ("station_id",)):
        self.df, self.keys = df, tuple(keys)

    def _with(self, df: DataFrame) -> Series:
        return Series(df, self.keys)

    def regularize(self, step: int, fill: str | None = None) -> Series:
        return self._with(time_axis.fill_grid(self.df, step, self.keys, fill))

    def resample(self, sample_interval: int, resolution: str, **options: Any) -> Series:
        return self._with(resample.resample(self.df, sample_interval, resolution, self.keys, **options))

    def split_into_events(self, variable: str, **options: Any) -> Series:
        return self._with(events.split_into_events(self.df, variable, keys=self.keys, **options))

    def align(self, *others: Series, on: Sequence[str] = ("time",)) -> list[Series]:
        return [self._with(f) for f in joins.align([self.df, *[o.df for o in others]], [*self.keys, *on])]

    def isel(self, *positions: int) -> Series:
        """Rows by 0-based position in time, per key."""
        from pyspark.sql import Window

        ranked = self.df.withColumn("_i", F.row_number().over(Window.partitionBy(*self.keys).orderBy("time")) - 1)
        return self._with(ranked.where(F.col("_i").isin(*positions)).drop("_i"))

    def sel(self, start: Any = None, end: Any = None, nearest: Any = None, **values: Any) -> Series:
        """Rows by time range (bounds included), by values, or those nearest to a time per key."""
        df = self.df
        if start is not None:
            df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
        if end is not None:
            df = df.where(F.col("time") <= F.lit(end).cast("timestamp"))
        for column, value in values.items():
            df = df.where(F.col(column).isin(*(value if isinstance(value, (list, tuple, set)) else [value])))
        if nearest is not None:
            away = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lit(nearest).cast("timestamp")))
            df = df.groupBy(*self.keys).agg(F.min_by(F.struct(*df.columns), F.struct(away, "time")).alias("_r")).select("_r.*")
        return self._with(df)

    def time_range(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))

    def psd(self) -> psd.Model:
        """The distribution that an L2M table's parameters belong to."""
        return psd.model_of_columns([c.removeprefix("psd_") for c in self.df.columns])

    def summary(self, **options: Any) -> Series:
        return self._with(products.summary_rows(self.df, **options))


def series(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> Series:
    return Series(df, keys)
