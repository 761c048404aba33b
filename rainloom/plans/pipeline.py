"""Whole chains over all stations at once: a product is one Spark job, partitioned by station and time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rainloom.operators import classification, products, resample, sanitize, time_axis
from rainloom.plans.options import is_possible, product_options
from rainloom.plans.summary import station_summary, write_summary
from rainloom.sources.files import write_product


@dataclass
class Run:
    """What to make: products up to L2M for one kind of sensor, written below ``archive`` if given."""

    sensor: str
    intervals: Sequence[int]
    resolutions: Sequence[str] = ("1MIN",)
    models: dict[str, dict[str, Any]] = field(default_factory=dict)
    archive: str | None = None
    force: bool = False
    layers: dict[str, dict[str, Any]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def _keep(self, df: DataFrame, product: str, *folders: str) -> DataFrame:
        if self.archive is None:
            return df
        path = "/".join([self.archive, product, *folders])
        options = product_options(product, self.sensor, None, self.layers) if product in ("L0C", "L1", "L2E", "L2M") else {}
        write_product(df, path, ["station_id"], options.get("archive_options", {}).get("folder_partitioning", "year/month"), self.force)
        return df.sparkSession.read.parquet(path).select(*df.columns)

    def l0a(self, raw: DataFrame, order: Sequence[str] = ("time",), issue_times: DataFrame | None = None, issue_periods: DataFrame | None = None) -> DataFrame:
        return self._keep(sanitize.sanitize(raw, self.sensor, order=order, issue_times=issue_times, issue_periods=issue_periods), "L0A")

    def l0b(self, l0a: DataFrame, stations: DataFrame | None = None) -> DataFrame:
        return self._keep(sanitize.generate_l0b(l0a, self.sensor, stations), "L0B")

    def l0c(self, l0b: DataFrame) -> DataFrame:
        return self._keep(time_axis.generate_l0c(l0b, self.intervals), "L0C")

    def l1(self, l0c: DataFrame) -> dict[str, DataFrame]:
        """L1 per resolution; those that no interval makes possible are left out."""
        out = {}
        for resolution in self.resolutions:
            parts = []
            for interval in self.intervals:
                if is_possible(resolution, interval):
                    own = l0c.where(f"sample_interval = {int(interval)}")
                    parts.append(resample.resample(own, int(interval), resolution))
            if parts:
                joined = parts[0]
                for p in parts[1:]:
                    joined = joined.unionByName(p)
                out[resolution] = self._keep(classification.generate_l1(joined, self.sensor), "L1", resolution)
        return out

    def l2e(self, l1: DataFrame, resolution: str) -> DataFrame:
        options = product_options("L2E", self.sensor, resolution, self.layers)["product_options"]
        arguments = {k: v for k, v in options.items() if k != "fall_velocity_model"}
        return self._keep(products.generate_l2e(l1, self.sensor, model=options["fall_velocity_model"], **arguments), "L2E", resolution)

    def l2m(self, l2e: DataFrame, resolution: str) -> dict[str, DataFrame]:
        """L2M per model, of the rows of theoretical speeds."""
        rows = l2e.where(f"velocity_method = '{products.THEORETICAL}'")
        out = {}
        for name, model in self.models.items():
            settings = {k: v for k, v in model.items() if k not in ("psd_model", "optimization")}
            fitted = products.generate_l2m(rows, model["psd_model"], model.get("optimization"), sensor=self.sensor, **settings)
            out[name] = self._keep(fitted, "L2M", f"{name}_{resolution}")
        return out

    def summary(self, l2e: DataFrame, resolution: str) -> dict[str, DataFrame]:
        """The tables of the stations' summary, by name."""
        tables = station_summary(l2e, self.sensor, resolution)
        if self.archive is not None:
            write_summary(tables, f"{self.archive}/SUMMARY/{resolution}", self.force)
        return tables

    def all(self, raw: DataFrame, stations: DataFrame | None = None) -> dict[str, DataFrame]:
        """Every product by name; what fails, and what needs it, is missing and told in ``failures``."""
        made: dict[str, DataFrame] = {}
        self.failures = {}

        def make(name: str, step: Callable[[], Any]) -> Any:
            result, error = guarded(lambda _: step(), raw.sparkSession)
            if error is not None:
                self.failures[name] = error
            elif isinstance(result, DataFrame):
                made[name] = result
            return result

        l0a = make("L0A", lambda: self.l0a(raw))
        l0b = None if l0a is None else make("L0B", lambda: self.l0b(l0a, stations))
        l0c = None if l0b is None else make("L0C", lambda: self.l0c(l0b))
        l1s = {} if l0c is None else make("L1", lambda: self.l1(l0c)) or {}
        for resolution, l1 in l1s.items():
            made[f"L1_{resolution}"] = l1
            l2e = make(f"L2E_{resolution}", lambda: self.l2e(l1, resolution))  # noqa: B023
            if l2e is None:
                continue
            for name, l2m in (make(f"L2M_{resolution}", lambda: self.l2m(l2e, resolution)) or {}).items():  # noqa: B023
                made[f"L2M_{name}_{resolution}"] = l2m
        return made


def guarded(step: Callable[[SparkSession], Any], spark: SparkSession) -> tuple[Any, str | None]:
    """A step's result, or the text of its error: what fails does not stop the rest."""
    try:
        return step(spark), None
    except Exception as e:  # the caller reports it and goes on
        return None, f"{type(e).__name__}: {e}"
