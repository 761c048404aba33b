"""Reading and writing: product tables, delimited raw texts, catalogues of files, stations and issues."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCTS = ("RAW", "L0A", "L0B", "L0C", "L1", "L2E", "L2M")
#: Start of a time range that is not given.
FIRST_TIME = "1978-01-01"


def open_table(spark: SparkSession, paths: str | Sequence[str], variables: Sequence[str] | None = None, start: Any = None, end: Any = None, keys: Sequence[str] = ("station_id",), time: str = "time") -> DataFrame:
    """A Parquet product: only the asked columns (keys and time always), times within [start, end]; both reach the scan."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if variables is not None:
        kept = [c for c in (*keys, time, *variables) if c in df.columns]
        df = df.select(*dict.fromkeys(kept))
    return within_time(df, start, end, time)


def within_time(df: DataFrame, start: Any = None, end: Any = None, time: str = "time") -> DataFrame:
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    return df if end is None else df.where(F.col(time) <= F.lit(end).cast(df.schema[time].dataType))


def open_dataset(spark: SparkSession, archive: str, product: str, data_source: str | None = None, campaign_name: str | None = None, station_name: str | None = None, variables: Sequence[str] | None = None, start: Any = None, end: Any = None, resolution: str | None = None) -> DataFrame:
    """A product of an archive written by ``write_product``: partitions of source, campaign and station are pruned."""
    if product not in PRODUCTS:
        raise ValueError(f"{product} is no product; known are {', '.join(PRODUCTS)}")
    df = spark.read.parquet(f"{archive}/{product}" + (f"/{resolution}" if resolution else ""))
    for column, value in (("data_source", data_source), ("campaign_name", campaign_name), ("station_name", station_name)):
        if value is not None:
            df = df.where(F.col(column) == value)
    df = within_time(df, start, end)
    if variables is not None:
        df = df.select(*dict.fromkeys(c for c in ("data_source", "campaign_name", "station_name", "station_id", "time", "sample_interval", *variables) if c in df.columns))
    return df


def time_partitions(time: Column, folder: str) -> dict[str, Column]:
    """Partition columns of a folder pattern: "", year, year/month, year/month/day, year/month_name, year/quarter."""
    parts = {"year": F.year(time), "month": F.lpad(F.month(time).cast("string"), 2, "0"), "day": F.lpad(F.dayofmonth(time).cast("string"), 2, "0"), "month_name": F.date_format(time, "MMMM"), "quarter": F.concat(F.lit("Q"), F.quarter(time))}
    valid = ("", "year", "year/month", "year/month/day", "year/month_name", "year/quarter")
    if folder not in valid:
        raise ValueError(f"{folder} is no partitioning; known are {', '.join(repr(v) for v in valid)}")
    return {p: parts[p] for p in folder.split("/") if p}


def write_product(df: DataFrame, path: str, by: Sequence[str] = (), folder: str = "", force: bool = False, rows_per_file: int = 1_000_000) -> None:
    """A product as Parquet, partitioned by columns and time folders; existing data are an error unless ``force``.

    With ``force`` only the partitions that are written are replaced. Rows are clustered by partition
    first, so that a partition gets few files whatever the number of tasks.
    """
    extra = time_partitions(F.col("time"), folder)
    wide = df.withColumns(extra) if extra else df
    columns = [*by, *extra]
    clustered = wide.repartition(*columns) if columns else wide
    writer = clustered.write.option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if force else "errorifexists").partitionBy(*columns).parquet(path)


def remove_product(spark: SparkSession, path: str) -> bool:
    """Delete a product's files; whether there were any. Works on every file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def read_delimited(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], separator: str = ",", header: bool = False, comment: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited texts, every column a string; lines with another number of cells are kept in ``_corrupt_record``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_corrupt_record")])
    reader = spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("encoding", encoding)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(paths if isinstance(paths, str) else list(paths)).withColumn("file_path", F.input_file_name())


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file_path, line_no (from 1 within the file), payload.

    Lines are numbered within the parts that Spark splits a file into, after the lines of the parts before,
    of which one row each is counted; so a large file is no single task.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    lines = lines.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy("file_path", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file_path", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = lines.withColumn("_k", F.row_number().over(Window.partitionBy("file_path", "_part").orderBy("_at"))).join(offsets, ["file_path", "_part"])
    return numbered.select("file_path", (F.col("_before") + F.col("_k")).cast("int").alias("line_no"), "payload")


def fixed_width(lines: DataFrame, spans: dict[str, tuple[int, int]], text: str = "payload", skip: int = 0) -> DataFrame:
    """Columns cut at fixed (0-based start, end) positions, trimmed, after the first ``skip`` lines."""
    kept = lines.where(F.col("line_no") > skip)
    return kept.select("file_path", "line_no", *[F.trim(F.substring(text, a + 1, b - a)).alias(c) for c, (a, b) in spans.items()])


def csv_options(options: dict[str, Any]) -> dict[str, Any]:
    """Reader options of other tools as Spark's; a delimiter is required."""
    if "delimiter" not in options and "sep" not in options:
        raise ValueError("a delimiter is required")
    names = {"delimiter": "sep", "sep": "sep", "encoding": "encoding", "comment": "comment", "header": "header", "quotechar": "quote", "escapechar": "escape", "na_values": "nullValue"}
    dropped = {"dtype", "blocksize", "assume_missing", "on_bad_lines", "engine"}
    return {names.get(k, k): v for k, v in options.items() if k not in dropped}


# --- readers by name ------------------------------------------------------------------------------------------

Reader = Callable[[SparkSession, Sequence[str]], DataFrame]
_READERS: dict[tuple[str, str], Reader] = {}


def register_reader(sensor: str, reference: str) -> Callable[[Reader], Reader]:
    """Decorator that makes a reader known as "SOURCE/NAME" for a sensor."""

    def add(function: Reader) -> Reader:
        _READERS[(sensor, reference)] = function
        return function

    return add


def available_readers(sensor: str | None = None, source: str | None = None) -> list[str]:
    return sorted(r for s, r in _READERS if (sensor is None or s == sensor) and (source is None or r.split("/")[0] == source))


def reader(sensor: str, reference: str) -> Reader:
    if (sensor, reference) not in _READERS:
        raise ValueError(f"no reader {reference} for {sensor}; known are {', '.join(available_readers(sensor)) or 'none'}")
    return _READERS[(sensor, reference)]


def delimited_reader(columns: Sequence[str], separator: str, time: Column, sensor_columns: Sequence[str], header: bool = False) -> Reader:
    """A reader of the commonest kind: one telegram per line, a time made of some of its columns."""

    def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        raw = read_delimited(spark, paths, columns, separator, header)
        return raw.where("_corrupt_record is null").select(time.alias("time"), *sensor_columns, "file_path")

    return read


# --- file names -----------------------------------------------------------------------------------------------

_NAME = re.compile(
    r"^(?P<product>L0A|L0B|L0C|L1|L2E|L2M)(?:_(?P<model>[A-Za-z]\w*?))?(?:\.(?P<resolution>(?:ROLL)?(?:\d+(?:D|H|MIN|S))+))?\.(?P<campaign_name>[^.]+)\.(?P<station_name>[^.]+)"
    r"\.s(?P<start_time>\d{14})\.e(?P<end_time>\d{14})\.(?P<version>V[^.]+)\.(?P<extension>parquet|nc)$"
)
_NAME_PARTS = ("product", "model", "resolution", "campaign_name", "station_name", "start_time", "end_time", "version", "extension")


def parse_filename(name: str) -> dict[str, str | None]:
    """The parts of a product file's name."""
    found = _NAME.match(name.rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"{name} is no product file name")
    return found.groupdict()


def filename_columns(name: Column) -> dict[str, Column]:
    """The parts of a name as columns; null where the name is no product's."""
    pattern = re.sub(r"\?P<\w+>", "", _NAME.pattern)
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    part = lambda i: F.when(F.regexp_extract(base, pattern, i) != "", F.regexp_extract(base, pattern, i))
    out = {p: part(i) for i, p in enumerate(_NAME_PARTS, start=1)}
    for p in ("start_time", "end_time"):
        out[p] = F.try_to_timestamp(out[p], F.lit("yyyyMMddHHmmss"))
    return out


def define_filename(product: str, campaign_name: str, station_name: str, start: datetime, end: datetime, resolution: str | None = None, model: str | None = None, version: str = "V0", extension: str = "parquet", prefix: str = "", suffix: str = "") -> str:
    if product not in PRODUCTS:
        raise ValueError(f"{product} is no product")
    head = product + (f"_{model}" if model else "") + (f".{resolution}" if resolution else "")
    body = f"{head}.{campaign_name}.{station_name}.s{start:%Y%m%d%H%M%S}.e{end:%Y%m%d%H%M%S}.{version}.{extension}"
    return (f"{prefix}." if prefix else "") + body + (f".{suffix}" if suffix else "")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length and modification time of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def overlaps(start: Column, end: Column, query_start: Column | Any, query_end: Column | Any) -> Column:
    """Whether a file's period and a query's meet: it holds the start, lies within, or holds the end."""
    a, b = (q if isinstance(q, Column) else F.lit(q).cast("timestamp") for q in (query_start, query_end))
    return ((start <= a) & (end > a)) | ((start >= a) & (end <= b)) | ((start < b) & (end > b))


def prune_by_time(files: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Files whose period meets [start, end]; by default from FIRST_TIME to now."""
    return files.where(overlaps(F.col("start_time"), F.col("end_time"), start or FIRST_TIME, end or datetime.now(timezone.utc).replace(tzinfo=None)))


def group_files(files: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Files by parts of their names or of their start times: group (joined by "/"), paths."""
    from rainloom.operators.time_axis import time_component

    parts = [F.col(g) if g in files.columns else time_component(F.col("start_time"), g) for g in groups]
    return files.groupBy(F.concat_ws("/", *[p.cast("string") for p in parts]).alias("group")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


# --- stations and issues ----------------------------------------------------------------------------------------

METADATA_SCHEMA = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("data_source", "campaign_name", "station_name", "sensor_name", "reader", "raw_data_format")],
        T.StructField("measurement_interval", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.StringType()) for c in ("deployment_status", "deployment_mode", "platform_type", "data_url", "raw_data_glob_pattern")],
        *[T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "altitude")],
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Station files (YAML) as one table, one row per station; keys without a column are in ``extra``."""
    import pandas as pd

    names = [f.name for f in METADATA_SCHEMA.fields]

    def parse(batches):
        import yaml

        for batch in batches:
            rows = []
            for text in batch["value"]:
                found = yaml.safe_load(text) or {}
                row: dict[str, Any] = {}
                for f in METADATA_SCHEMA.fields:
                    # The address stands under a key that may carry an archive's name before it.
                    value = next((v for k, v in found.items() if str(k).endswith("data_url")), None) if f.name == "data_url" else found.get(f.name)
                    if f.name == "measurement_interval":
                        value = None if value in (None, "") else [int(v) for v in (value if isinstance(value, list) else [value])]
                    elif isinstance(f.dataType, T.DoubleType):
                        value = None if value in (None, "") else float(value)
                    elif f.name == "extra":
                        value = {str(k): str(v) for k, v in found.items() if k not in names}
                    else:
                        value = None if value is None else str(value)
                    row[f.name] = value
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yml").text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return texts.mapInPandas(parse, METADATA_SCHEMA)


def select_stations(stations: DataFrame, data_sources: Sequence[str] | None = None, campaigns: Sequence[str] | None = None, names: Sequence[str] | None = None, with_data: DataFrame | None = None, with_url: bool = False, **values: Any) -> DataFrame:
    """Stations by source, campaign, name, any metadata value (or list of values), existing data, and a data address."""
    for column, chosen in (("data_source", data_sources), ("campaign_name", campaigns), ("station_name", names)):
        if chosen is not None:
            stations = stations.where(F.col(column).isin(*([chosen] if isinstance(chosen, str) else chosen)))
    for column, value in values.items():
        if column not in stations.columns:
            raise ValueError(f"{column} is no metadata key")
        stations = stations.where(F.col(column).isin(*(value if isinstance(value, (list, tuple, set)) else [value])))
    if with_url:
        stations = stations.where(F.length(F.trim("data_url")) > 0)
    if with_data is not None:
        shared = [c for c in ("data_source", "campaign_name", "station_name", "station_id") if c in stations.columns and c in with_data.columns]
        stations = stations.join(with_data.select(*shared).distinct(), shared, "left_semi")
    return stations


def metadata_values(stations: DataFrame, key: str) -> DataFrame:
    return stations.select("data_source", "campaign_name", "station_name", key)


def metadata_violations(stations: DataFrame) -> DataFrame:
    """Stations that break a rule: their names and the rule."""
    from rainloom import sensors

    def bad(c: str, low: float, high: float) -> Column:
        value = F.col(c).cast("double")
        return value.isNotNull() & ~F.isnan(value) & ~value.between(low, high)

    rules = {
        "sensor_name is unknown": ~F.coalesce(F.col("sensor_name"), F.lit("")).isin(*sensors.SENSORS),
        "latitude is out of bounds": bad("latitude", -90, 90),
        "longitude is out of bounds": bad("longitude", -180, 180),
        "a fixed platform has no place": (F.col("platform_type") == "fixed") & (F.col("latitude").isNull() | F.col("longitude").isNull()),
        "deployment_status is unknown": ~F.coalesce(F.col("deployment_status"), F.lit("")).isin("ongoing", "terminated"),
        "measurement_interval is missing": F.col("measurement_interval").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return stations.select(*[c for c in ("station_id", "data_source", "campaign_name", "station_name") if c in stations.columns], F.explode(broken).alias("rule"))


def read_issues(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Times and closed periods of an issue file's text (YAML keys timesteps and time_periods)."""
    import yaml

    found = yaml.load(text, yaml.BaseLoader) or {}
    unknown = set(found) - {"timesteps", "time_periods"}
    if unknown:
        raise ValueError(f"unknown keys in the issue file: {', '.join(sorted(unknown))}")

    def moment(value: str) -> datetime:
        return datetime.strptime(value, "%Y-%m-%d %H:%M:%S")

    times = [(moment(t),) for t in found.get("timesteps") or []]
    periods = [(moment(a), moment(b)) for a, b in found.get("time_periods") or []]
    if any(a >= b for a, b in periods):
        raise ValueError("a period of the issue file ends before it begins")
    return spark.createDataFrame(times, "time timestamp_ntz"), spark.createDataFrame(periods, "start timestamp_ntz, end timestamp_ntz")


def with_attributes(df: DataFrame, product: str, columns: dict[str, dict[str, str]] | None = None, **attributes: str) -> DataFrame:
    """Columns with metadata: their own (units, description) and, on the time column, the product's attributes."""
    if product not in PRODUCTS:
        raise ValueError(f"{product} is no product")
    for name, own in (columns or {}).items():
        if name in df.columns:
            df = df.withMetadata(name, own)
    return df.withMetadata("time", {"product": product, **attributes}) if "time" in df.columns else df
