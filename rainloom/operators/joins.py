"""Joins by label, time, interval and nearest value; interpolation between joined neighbours; pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom.operators.time_axis import carried, day_of, seconds

#: Rows of a lookup table up to which it is broadcast; a larger one is joined by ranges or cells.
BROADCAST_ROWS = 200_000
#: Points in a plane up to which each row looks at all of them, and of a larger table those that bound the distance.
PLANE_POINTS = 5_000
#: Ranges of values of a large lookup, and parts of each range's queries.
LOOKUP_RANGES, LOOKUP_PARTS = 256, 16


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The table, broadcast if it has at most ``rows`` rows, and whether it has. Counts at most rows + 1 of them."""
    small = len(table.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows
    return (F.broadcast(table) if small else table), small


def align(frames: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Each frame cut to the keys that all of them hold."""
    shared = reduce(lambda a, b: a.intersect(b), [f.select(*keys) for f in frames])
    return [f.join(shared, list(keys), "left_semi") for f in frames]


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance_s: float | None, columns: Sequence[str], inner: bool = False) -> DataFrame:
    """Left rows with the ``columns`` of the right row of their keys nearest in time, and its ``matched_time``.

    Both sides are merged in time order and each left row looks back and ahead for a right row; of two
    equally near ones the earlier counts. Beyond the tolerance the columns are null, or with ``inner``
    the row goes. Left rows without time match nothing. Partitioned by keys and by day where the
    tolerance is below a day, with right rows near midnight on both days.
    """
    daily = tolerance_s is not None and tolerance_s < 86_400
    at = F.unix_micros(F.col("time").cast("timestamp"))
    day_us = 86_400_000_000
    pair = F.struct(at.alias("t"), F.col("time").alias("time"), *[F.col(c) for c in columns])
    l_side = left.withColumns({"_at": at, "_day": F.floor(at / day_us) if daily else F.lit(0), "_r": F.lit(None).cast(right.select(pair.alias("p")).schema["p"].dataType), "_left": F.lit(1)})
    r_side = right.where("time is not null").select(*keys, at.alias("_at"), pair.alias("_r"))
    if daily:
        reach = int(tolerance_s * 1_000_000)
        first, last = F.floor((F.col("_at") - reach) / day_us), F.floor((F.col("_at") + reach) / day_us)
        r_side = r_side.withColumn("_day", F.explode(F.sequence(first, last)))
    else:
        r_side = r_side.withColumn("_day", F.lit(0))
    merged = l_side.unionByName(r_side.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    part = [*keys, "_day"]
    back = Window.partitionBy(*part).orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy(F.desc("_at"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    near = merged.withColumns({"_b": F.last("_r", ignorenulls=True).over(back), "_a": F.last("_r", ignorenulls=True).over(ahead)}).where("_left = 1")
    d_back, d_ahead = F.col("_at") - F.col("_b.t"), F.col("_a.t") - F.col("_at")
    chosen = F.when(F.col("_at").isNull(), None).when(F.col("_a").isNull() | (d_back <= d_ahead), F.col("_b")).otherwise(F.col("_a"))
    near = near.withColumn("_m", chosen)
    if tolerance_s is not None:
        near = near.withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col("_at")) <= tolerance_s * 1_000_000, F.col("_m")))
    out = near.select(*left.columns, F.col("_m.time").alias("matched_time"), *[F.col(f"_m.{c}").alias(f"matched_{c}" if c in left.columns else c) for c in columns])
    return out.where("matched_time is not null") if inner else out


def update(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose values are overwritten by the non-null values of the right row of equal keys."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    one = right.dropDuplicates(list(keys)).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in shared])
    joined = left.join(one, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in shared else c for c in left.columns])


def nearest_value(df: DataFrame, lut: DataFrame, column: str, lut_column: str = "x", max_distance: float | None = None) -> DataFrame:
    """Rows with the lookup row nearest in value; a tie goes to the lower one. Adds ``distance`` and the lookup's columns.

    A missing query, or one beyond ``max_distance``, gets nulls. Lookup values are merged with the
    queries in order and found by looking down and up, so neither side is multiplied by the other;
    ranges of values spread over partitions, each with the nearest lookup row beyond its bounds.
    """
    others = [c for c in lut.columns if c != lut_column]
    small, is_small = bounded(lut.where(F.col(lut_column).isNotNull() & ~F.isnan(F.col(lut_column).cast("double"))))
    if is_small:
        # The sorted values (checked size) go to the workers; a vectorised search gives the position.
        ordered = small.groupBy(F.col(lut_column).cast("double").alias("_k")).agg(F.first(F.struct(*others) if others else F.lit(0)).alias("_v")).orderBy("_k").collect()
        points = np.array([r["_k"] for r in ordered], float)
        schema = T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("k", T.DoubleType()), T.StructField("v", lut.select(F.struct(*others) if others else F.lit(0)).schema[0].dataType)])
        numbered = df.sparkSession.createDataFrame([(i, r["_k"], r["_v"]) for i, r in enumerate(ordered)], schema)

        @F.pandas_udf("int")
        def position(values: pd.Series) -> pd.Series:
            x = values.to_numpy(float)
            if not len(points):
                return pd.Series(np.full(len(x), -1), dtype="int32")
            right = np.clip(np.searchsorted(points, x), 0, len(points) - 1)
            left = np.maximum(right - 1, 0)
            nearest = np.where(np.abs(points[right] - x) < np.abs(x - points[left]), right, left)
            return pd.Series(np.where(np.isnan(x), -1, nearest).astype("int32"))

        queried = df.withColumn("_q", F.col(column).cast("double")).withColumn("_i", position(F.coalesce("_q", F.lit(float("nan")))))
        found = queried.join(F.broadcast(numbered.select("_i", F.struct("k", "v").alias("_m"))), "_i", "left")
    else:
        found = _merged_in_order(df, small, column, lut_column, others)
    distance = F.abs(F.col("_q") - F.col("_m.k"))
    keep = F.lit(True) if max_distance is None else distance <= max_distance
    return found.select(*df.columns, F.when(keep, F.col("_m.k")).alias(lut_column), *[F.when(keep, F.col(f"_m.v.{c}")).alias(c) for c in others], F.when(keep, distance).alias("distance"))


def _merged_in_order(df: DataFrame, lut: DataFrame, column: str, lut_column: str, others: Sequence[str]) -> DataFrame:
    """Queries and a lookup of any size merged in the order of their values: adds ``_q`` and the nearest ``_m``.

    Ranges of values come from quantiles of the lookup; each range is read down and up once, and beyond
    its ends the nearest lookup rows of the other ranges are known from a table of one row per range. A
    range's queries are spread over parts, to each of which its lookup rows are copied, so that a value
    that fills a third of the queries is no single task.
    """
    k = F.col(lut_column).cast("double")
    points = lut.groupBy(k.alias("_k")).agg(F.first(F.struct(*others) if others else F.lit(0)).alias("_v"))
    shares = [i / LOOKUP_RANGES for i in range(1, LOOKUP_RANGES)]
    bounds = points.agg(F.percentile_approx("_k", F.array(*[F.lit(x) for x in shares]), 10_000)).first()[0]
    edges = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))])
    range_of = lambda x: F.size(F.filter(edges, lambda e: e <= x))
    pair = F.struct(F.col("_k").alias("k"), F.col("_v").alias("v"))
    looked = points.select(F.col("_k").alias("_at"), pair.alias("_r"), range_of(F.col("_k")).alias("_range"))
    q = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(LOOKUP_PARTS)).cast("int")
    queries = df.withColumns({"_q": q, "_at": q, "_range": F.coalesce(range_of(q), F.lit(-1)), "_part": part, "_is": F.lit(1)})
    copies = looked.withColumns({"_part": F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_PARTS - 1))), "_is": F.lit(0)})
    both = queries.unionByName(copies, allowMissingColumns=True)
    down = Window.partitionBy("_range", "_part").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("_range", "_part").orderBy(F.desc("_at"), "_is").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_lo": F.last("_r", ignorenulls=True).over(down), "_hi": F.last("_r", ignorenulls=True).over(up)}).where("_is = 1")
    # One row per range: the last lookup row of the ranges below and the first of those above.
    ends = looked.groupBy("_range").agg(F.min_by("_r", "_at").alias("_first"), F.max_by("_r", "_at").alias("_last"))
    all_ranges = df.sparkSession.range(len(set(bounds)) + 1).select(F.col("id").cast("int").alias("_range")).join(ends, "_range", "left")
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    beyond = all_ranges.select("_range", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    near = near.join(F.broadcast(beyond), "_range", "left").withColumns({"_lo": F.coalesce("_lo", "_below"), "_hi": F.coalesce("_hi", "_above")})
    lower = F.col("_hi").isNull() | (F.col("_q") - F.col("_lo.k") <= F.col("_hi.k") - F.col("_q"))
    return near.withColumn("_m", F.when(F.col("_q").isNull(), None).when(F.col("_lo").isNotNull() & lower, F.col("_lo")).otherwise(F.col("_hi")))


def nearest_value_by_range(df: DataFrame, lut: DataFrame, column: str, lut_column: str, width: float, max_distance: float) -> DataFrame:
    """As nearest_value for a lookup of any size: joined on buckets of ``width``, searched up to ``max_distance``."""
    others = [c for c in lut.columns if c != lut_column]
    bucket = lambda c: F.floor(c / width)
    marked = df.withColumns({"_row": F.monotonically_increasing_id(), "_q": F.col(column).cast("double")})
    x = F.col(lut_column).cast("double")
    points = lut.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("_k"), F.struct(F.col(lut_column), *others).alias("_v"), F.explode(F.sequence(bucket(x - max_distance), bucket(x + max_distance))).alias("_bucket"))
    joined = marked.where("_q is not null and not isnan(_q)").withColumn("_bucket", bucket(F.col("_q"))).join(points, "_bucket").where(F.abs(F.col("_q") - F.col("_k")) <= max_distance)
    best = joined.groupBy("_row").agg(F.min(F.struct(F.abs(F.col("_q") - F.col("_k")).alias("distance"), "_k", "_v")).alias("_m"))
    return marked.join(best, "_row", "left").select(*df.columns, F.col(f"_m._v.{lut_column}").alias(lut_column), *[F.col(f"_m._v.{c}").alias(c) for c in others], F.col("_m.distance").alias("distance"))


def grid_lookup(df: DataFrame, lut: DataFrame, x: str, y: str, lut_x: str = "x", lut_y: str = "y", max_distance: tuple[float, float] | None = None) -> DataFrame:
    """Two-dimensional lookup: each axis snaps to its nearest grid value (of two the lower), then the cell is joined.

    A cell that the table lacks takes the table's point nearest to it by Euclid; each such cell is looked
    up once. ``nearest_x`` and ``nearest_y`` are the cell's, ``out_of_bound`` tells queries outside the
    convex hull of the table's points. Missing queries, and with ``max_distance`` those whose snapped value
    is farther off on either axis, get nulls.
    """
    values = [c for c in lut.columns if c not in (lut_x, lut_y)]
    points = lut.where(F.col(lut_x).isNotNull() & F.col(lut_y).isNotNull()).select(F.col(lut_x).cast("double").alias("_px"), F.col(lut_y).cast("double").alias("_py"), F.struct(*values).alias("_v") if values else F.lit(0).alias("_v"))
    snapped = df.withColumns({"_a": F.col(x).cast("double"), "_b": F.col(y).cast("double")})
    for query, axis, name in (("_a", "_px", "_sx"), ("_b", "_py", "_sy")):
        snapped = nearest_value(snapped, points.select(axis).distinct(), query, axis).withColumnRenamed(axis, name).drop("distance")
    known = F.col("_sx").isNotNull() & F.col("_sy").isNotNull()
    if max_distance is not None:
        known = known & (F.abs(F.col("_a") - F.col("_sx")) <= max_distance[0]) & (F.abs(F.col("_b") - F.col("_sy")) <= max_distance[1])
    snapped = snapped.withColumns({"_sx": F.when(known, F.col("_sx")), "_sy": F.when(known, F.col("_sy"))})
    cells = points.groupBy(F.col("_px").alias("_sx"), F.col("_py").alias("_sy")).agg(F.first("_v").alias("_cell"))
    wanted = snapped.where("_sx is not null and _sy is not null").select("_sx", "_sy").distinct()
    lacking = wanted.join(cells, ["_sx", "_sy"], "left_anti")
    filled = nearest_point(lacking, points, "_sx", "_sy", "_px", "_py").select("_sx", "_sy", F.col("_v").alias("_cell"))
    found = snapped.join(cells.unionByName(filled), ["_sx", "_sy"], "left")
    outside = F.coalesce(~in_hull(F.col("_a"), F.col("_b"), hull_of(points, "_px", "_py")), F.lit(False)) & ~F.isnan("_a") & ~F.isnan("_b")
    named = [F.col(f"_cell.{c}").alias(f"lut_{c}" if c in df.columns else c) for c in values]
    return found.select(*df.columns, F.col("_sx").alias(f"nearest_{lut_x}"), F.col("_sy").alias(f"nearest_{lut_y}"), F.coalesce(outside, F.lit(False)).alias("out_of_bound"), *named)


def nearest_point(df: DataFrame, lut: DataFrame, x: str, y: str, lut_x: str = "x", lut_y: str = "y", metric: str = "euclidean", max_distance: float | None = None) -> DataFrame:
    """Nearest lookup point by Euclid or Manhattan, of equally near ones the one of lower x, then y.

    Up to PLANE_POINTS points each row looks at all of them. Of a larger table that many bound the
    distance; then only points in the few cells around a row, of a size that fits its bound, are joined.
    """
    usable = lut.where(F.col(lut_x).isNotNull() & F.col(lut_y).isNotNull())
    values = [c for c in lut.columns if c not in (lut_x, lut_y)]
    packed = F.struct(F.col(lut_x).cast("double").alias("x"), F.col(lut_y).cast("double").alias("y"), F.struct(*values).alias("v") if values else F.lit(0).alias("v"))
    first, is_small = bounded(usable, PLANE_POINTS)
    some = (first if is_small else usable.limit(PLANE_POINTS)).agg(F.collect_list(packed).alias("_lut"))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    away = (lambda p: F.sqrt(F.pow(p["x"] - a, 2) + F.pow(p["y"] - b, 2))) if metric == "euclidean" else (lambda p: F.abs(p["x"] - a) + F.abs(p["y"] - b))
    found = lambda p: F.struct(away(p).alias("d"), p["x"].alias("x"), p["y"].alias("y"), p["v"].alias("v"))
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    out = df.join(F.broadcast(some)).withColumn("_m", F.when(known, F.array_min(F.transform(F.col("_lut"), found)))).drop("_lut")
    if not is_small:
        # Cells are as wide as the power of two above the bound, so that a row's box meets at most nine.
        level = F.ceil(F.log2(F.greatest(F.col("_m.d"), F.lit(1e-300)))).cast("int")
        marked = out.withColumns({"_row": F.monotonically_increasing_id(), "_level": level})
        levels = [r[0] for r in marked.where("_level is not null").select("_level").distinct().collect()]
        width = F.pow(F.lit(2.0), F.col("_level").cast("double"))
        span = lambda c: F.explode(F.sequence(F.floor((c - F.col("_m.d")) / width), F.floor((c + F.col("_m.d")) / width)))
        boxes = marked.where("_level is not null").withColumn("_cx", span(a)).withColumn("_cy", span(b))
        placed = usable.select(packed.alias("_p"), F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("_level"))
        placed = placed.withColumns({"_cx": F.floor(F.col("_p.x") / width), "_cy": F.floor(F.col("_p.y") / width)})
        best = boxes.join(placed, ["_level", "_cx", "_cy"]).groupBy("_row").agg(F.min(found(F.col("_p"))).alias("_best"))
        out = marked.join(best, "_row", "left").withColumn("_m", F.coalesce("_best", "_m"))
    if max_distance is not None:
        out = out.withColumn("_m", F.when(F.col("_m.d") <= max_distance, F.col("_m")))
    return out.select(*df.columns, F.col("_m.d").alias("distance"), F.col("_m.x").alias(f"nearest_{lut_x}"), F.col("_m.y").alias(f"nearest_{lut_y}"), *[F.col(f"_m.v.{c}").alias(f"lut_{c}" if c in df.columns else c) for c in values])


def hull_of(points: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    """Convex hull of a table's points: that of the hulls of its partitions, of which only the corners come to the driver."""

    def corners(batches):
        for batch in batches:
            hull = convex_hull(list(zip(batch["x"].tolist(), batch["y"].tolist())))
            yield pd.DataFrame(hull, columns=["x", "y"], dtype=float)

    found = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct().mapInPandas(corners, "x double, y double")
    return convex_hull([(r["x"], r["y"]) for r in found.collect()])


def convex_hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull of a bounded set of points, counter-clockwise."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def chain(sequence):
        out: list[tuple[float, float]] = []
        for p in sequence:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(ordered) + chain(reversed(ordered))


def in_hull(x: Column, y: Column, hull: Sequence[tuple[float, float]], tolerance: float = 1e-12) -> Column:
    """Whether a point lies in a counter-clockwise hull: on the inner side of every edge."""
    inside = F.lit(len(hull) >= 3)
    for (x0, y0), (x1, y1) in zip(hull, [*hull[1:], *hull[:1]]):
        inside = inside & ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) >= -tolerance)
    return inside & ~F.isnan(x) & ~F.isnan(y)


def interpolate(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("station_id",), limit: int | None = None) -> DataFrame:
    """Missing values between known ones of a key, linear in time; with ``limit`` at most so many rows after a known one."""
    days = df.withColumn("_day", day_of(F.col("time")))
    # The number of a row in its series: within its day, after the rows of the days before.
    sizes = days.groupBy(*keys, "_day").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_day", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy("time"))
    marked = days.withColumns({"_s": seconds(F.col("time")).cast("double"), "_k": local}).join(offsets, [*keys, "_day"]).withColumn("_n", F.col("_k") + F.col("_offset"))
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    pair = {c: F.when(v.isNotNull(), F.struct("_s", "_n", v.alias("v"))) for c, v in known.items()}
    near = carried(carried(marked, {f"_l_{c}": p for c, p in pair.items()}, keys), {f"_h_{c}": p for c, p in pair.items()}, keys, ahead=True)
    out = {}
    for c in columns:
        low, high = F.col(f"_l_{c}"), F.col(f"_h_{c}")
        line = F.when(high["_s"] == low["_s"], low["v"]).otherwise(low["v"] + (high["v"] - low["v"]) * (F.col("_s") - low["_s"]) / (high["_s"] - low["_s"]))
        near_enough = F.lit(True) if limit is None else F.col("_n") - low["_n"] <= limit
        out[c] = F.coalesce(known[c], F.when(near_enough, line))
    return near.withColumns(out).select(*df.columns)


def interpolate_direction(df: DataFrame, column: str, keys: Sequence[str] = ("station_id",), limit: int | None = None) -> DataFrame:
    """Directions in degrees, interpolated on the circle and rounded to 10 degrees, halves to even."""
    angle = F.radians(F.col(column).cast("double"))
    parts = interpolate(df.withColumns({"_u": F.cos(angle), "_v": F.sin(angle)}), ("_u", "_v"), keys, limit)
    degrees = F.pmod(F.degrees(F.atan2("_v", "_u")), F.lit(360.0))
    return parts.withColumn(column, F.pmod(F.bround(degrees / 10, 0) * 10, F.lit(360.0))).drop("_u", "_v")


def pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], prefix: str = "") -> DataFrame:
    """One column per given name; names that a key lacks are null. Naming them spares the pass that would find them."""
    wide = df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
    return wide.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names}) if prefix else wide


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def id_value_records(lines: DataFrame, ids: Sequence[str], keys: Sequence[str] = ("file_id",), text: str = "payload", order: str = "line_no") -> DataFrame:
    """Lines "ID:value" to one row per record: a record ends where the id does not grow; absent ids are "NaN"."""
    number, value = F.regexp_extract(text, r"^\s*(\d+)\s*:", 1), F.regexp_extract(text, r"^\s*\d+\s*:(.*)$", 1)
    parsed = lines.select(*keys, order, number.try_cast("int").alias("_id"), F.trim(value).alias("_value")).where("_id is not null")
    line = Window.partitionBy(*keys).orderBy(order)
    begins = F.coalesce(F.col("_id") <= F.lag("_id").over(line), F.lit(True))
    records = parsed.withColumn("_new", begins.cast("int")).withColumn("record", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    wide = pivot(records.withColumn("_id", F.col("_id").cast("string")), [*keys, "record"], "_id", "_value", [str(int(i)) for i in ids], "field_")
    return wide.fillna("NaN", [f"field_{int(i)}" for i in ids])


def sub_minute_times(df: DataFrame, step_s: int, keys: Sequence[str] = ("station_id",), order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Rows that share a minute get seconds 0, step, 2 step ... in their order."""
    rank = F.row_number().over(Window.partitionBy(*keys, "time").orderBy(*order)) - 1
    return df.withColumn("_k", rank).withColumn("time", F.timestamp_micros(F.unix_micros(F.col("time").cast("timestamp")) + F.col("_k") * (step_s * 1_000_000))).drop("_k")


class LookupTable:
    """A lookup of values by one or two coordinates, kept as Parquet."""

    def __init__(self, table: DataFrame, x: str = "x", y: str | None = None):
        self.table, self.x, self.y = table, x, y

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark, path: str, x: str = "x", y: str | None = None) -> LookupTable:
        return cls(spark.read.parquet(path), x, y)

    def predict(self, df: DataFrame, column: str, other: str | None = None, max_distance=None, distance: str = "grid") -> DataFrame:
        """The nearest row's values: along x, or in two dimensions by "grid", "euclidean" or "manhattan"."""
        if self.y is None:
            return nearest_value(df, self.table, column, self.x, max_distance)
        if other is None:
            raise ValueError("give both coordinates")
        if distance == "grid":
            return grid_lookup(df, self.table, column, other, self.x, self.y, max_distance)
        return nearest_point(df, self.table, column, other, self.x, self.y, distance, max_distance)

    def predict_dict(self, x: float) -> dict:
        """The nearest row of one value along x."""
        query = self.table.sparkSession.createDataFrame([(float(x),)], "_query double")
        return {k: v for k, v in nearest_value(query, self.table, "_query", self.x).first().asDict().items() if k not in ("_query", "distance")}
