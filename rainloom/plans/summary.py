"""The summary of stations as one product: tables of their rain, distributions, events, spectra and points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom import sensors
from rainloom.operators import events, products, statistics

TABLES = ("spectrum", "rain", "distributions", "events", "points")


def summed_spectra(df: DataFrame, columns: Sequence[str] = ("raw_drop_number", "drop_number"), key: str = "station_id") -> DataFrame:
    """key, column, cell (from 0), total: flat spectra added up over all times.

    Each task adds its own batches up first; one row per key, column and cell of each leaves it. Null
    spectra and NaN cells add nothing; spectra of one column may differ in length.
    """
    schema = pa.schema([(key, pa.string()), ("column", pa.string()), ("cell", pa.int32()), ("total", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str | None, str], np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy()
            for k, column in enumerate(columns, start=1):
                lists = batch.column(k)
                lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                values = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
                row = np.repeat(np.arange(len(lengths)), lengths)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                for code in np.unique(of):
                    mine = of[row] == code
                    if not mine.any():
                        continue
                    total = np.bincount(cell[mine], values[mine])
                    place = (names[code] if code >= 0 else None, column)
                    before = sums.get(place, np.zeros(0))
                    size = max(len(before), len(total))
                    sums[place] = np.pad(before, (0, size - len(before))) + np.pad(total, (0, size - len(total)))
        for (name, column), total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([column] * n), pa.array(np.arange(n), pa.int32()), pa.array(total)], schema=schema)

    parts = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("array<double>").alias(c) for c in columns]).mapInArrow(kernel, f"`{key}` string, column string, cell int, total double")
    return parts.groupBy(key, "column", "cell").agg(F.sum("total").alias("total"))


def station_summary(l2e: DataFrame, sensor: str, resolution: str, keys: Sequence[str] = ("station_id",)) -> dict[str, DataFrame]:
    """The tables of TABLES from an L2E product of all stations, by name.

    Rainy rows of the theoretical speed count; distributions, spectra and points leave out noisy ones (few
    or scattered bins), events and minutes of rain do not. A product without rain gives empty tables.
    """
    rainy = l2e.where(F.col("velocity_method") == products.THEORETICAL).where(~F.isnan("R") & (F.col("R") > 0))
    clean = products.summary_rows(l2e)
    present = [c for c in ("raw_drop_number", "drop_number") if c in l2e.columns]
    known = [v for v in statistics.DSD_VARIABLES if v.removeprefix("log10(").removesuffix(")") in l2e.columns]
    out = {
        "rain": statistics.rain_summary(rainy, resolution, keys),
        "distributions": statistics.distribution_table(clean, known, keys),
        "events": events.event_summary(rainy, resolution, keys),
        "points": statistics.dsd_points(clean, sensors.literal(_centres(sensor)), keep=(*keys, "time", "R", "Dm", "D50", "Nw")),
    }
    if present:
        out["spectrum"] = summed_spectra(clean, present, keys[0])
    return out


def _centres(sensor: str) -> np.ndarray:
    """Centres of the diameter bins of an L2E product with its default limits."""
    from rainloom.operators.remap import kept_bins

    bins = sensors.diameter_bins(sensor)
    return bins.center[kept_bins(bins, 0.0, 10.0)]


def write_summary(tables: dict[str, DataFrame], path: str, force: bool = False) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite" if force else "errorifexists").parquet(f"{path}/{name}")
