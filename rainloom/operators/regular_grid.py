"""Irregular readings onto a regular grid per source and day.

The grid of a day is merged with the readings by time, and each slot takes its neighbours on both sides
by as-of lookup; between them values are interpolated linearly in time if the gap is short enough.
All steps are keyed by source and day, so that a source that holds a third of all rows is spread over
its days. Neighbours beyond a day come from one row per source and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000
DAY_S = 86_400
#: Sample intervals outside these bounds are no intervals.
MIN_STEP_S, MAX_STEP_S = 1, 3_600
#: Longest distance between two readings that is interpolated over, in steps.
MAX_GAP_STEPS = 10


def _known(column: str) -> Column:
    """The value as double, null where it is missing (null or NaN)."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def timed(readings: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """station_id, day (days since 1970-01-01), us (microseconds of the day), sample_interval and columns.

    Readings without station or time are left out.
    """
    at = F.unix_micros(F.col("time").cast("timestamp"))
    day = F.floor(at / F.lit(DAY_S * US)).cast("int")
    return readings.where(F.col("time").isNotNull() & F.col("station_id").isNotNull()).select(
        "station_id", day.alias("day"), (at - day.cast("long") * F.lit(DAY_S * US)).alias("us"), "sample_interval", *[_known(c).alias(c) for c in columns]
    )


def day_steps(readings: DataFrame) -> DataFrame:
    """station_id, day, step: the valid sample_interval that most readings of the day carry.

    A tie goes to the shorter interval. Days without a valid interval have no row.
    """
    valid = readings.where(F.col("sample_interval").between(MIN_STEP_S, MAX_STEP_S))
    counts = valid.groupBy("station_id", "day", "sample_interval").agg(F.count("*").alias("n"))
    return counts.groupBy("station_id", "day").agg(F.max(F.struct("n", (-F.col("sample_interval")).alias("s")))["s"].alias("s")).select("station_id", "day", (-F.col("s")).cast("int").alias("step"))


def slot_of(us: Column, step: Column) -> Column:
    """Second of the day of the slot nearest to ``us``; a tie is the earlier one, 86400 the next day's first."""
    width = step.cast("long") * US
    low = F.floor(us / width).cast("long") * width
    high = F.least(low + width, F.lit(DAY_S * US))
    return (F.when(high - us < us - low, high).otherwise(low) / US).cast("int")


def placed(readings: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Readings with the slot each one fills: station_id, day, us, slot and columns.

    A reading nearest to 24:00 belongs to slot 0 of the next day, at a negative ``us``. Readings of days
    without a valid interval are left out. ``step`` is the day's own, ``placed_by`` the step the reading was
    placed with, which for slot 0 may be that of the day before.
    """
    base = timed(readings, columns)
    joined = base.join(day_steps(base), ["station_id", "day"]).withColumn("slot", slot_of(F.col("us"), F.col("step")))
    over = F.col("slot") >= DAY_S
    return joined.select(
        "station_id",
        F.when(over, F.col("day") + 1).otherwise(F.col("day")).alias("day"),
        F.when(over, F.col("us") - DAY_S * US).otherwise(F.col("us")).alias("us"),
        F.when(over, 0).otherwise(F.col("slot")).alias("slot"),
        F.when(~over, F.col("step")).alias("step"),
        F.col("step").alias("placed_by"),
        *columns,
    )


def grid(placed_readings: DataFrame) -> DataFrame:
    """The slots from the first to the last filled one of each day: station_id, day, step, slot.

    Where only a reading of the day before fills slot 0 the day has no step of its own and that one slot.
    """
    days = placed_readings.groupBy("station_id", "day").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.max("step").alias("step"))
    return days.select("station_id", "day", "step", F.explode(F.sequence("first", "last", F.coalesce("step", F.lit(1)))).alias("slot"))


def whole_days(placed_readings: DataFrame) -> DataFrame:
    """Every day from a source's first to its last filled slot: station_id, day, step, and its first and last slot.

    Days between that hold no reading take the step of the day before them.
    """
    days = placed_readings.groupBy("station_id", "day").agg(
        F.min("slot").alias("first"), F.max("slot").alias("last"), F.coalesce(F.max("step"), F.max("placed_by")).alias("step")
    )
    by_day = Window.partitionBy("station_id").orderBy("day")
    days = days.withColumns({"previous": F.lag("day").over(by_day), "next": F.lead("day").over(by_day)})
    spread = days.withColumn("of", F.explode(F.sequence("day", F.coalesce(F.col("next") - 1, F.col("day")))))
    end = F.floor((F.lit(DAY_S) - 1) / F.col("step")).cast("int") * F.col("step")
    return spread.select(
        "station_id",
        F.col("of").alias("day"),
        "step",
        F.when((F.col("of") == F.col("day")) & F.col("previous").isNull(), F.col("first")).otherwise(0).alias("first"),
        F.when(F.col("next").isNull(), F.col("last")).otherwise(end).alias("last"),
    )


def regular_series(readings: DataFrame, columns: tuple[str, ...] = (), max_gap_steps: int = MAX_GAP_STEPS, by_day: bool = False) -> DataFrame:
    """The regular series: station_id, slot_epoch_s, step, is_missing, and per column a value and how it came.

    It holds every slot from a source's first to its last filled one, over midnight and days without
    readings; ``by_day`` from the first to the last filled one of each day.
    Grid and readings are merged in time order and each slot takes its neighbours on both sides. A slot
    is missing if neither neighbour's own nearest slot is this one. A column's value is interpolated in
    time between its nearest known readings at or before and after the slot. ``<column>_fill`` is
    ``exact``, ``interpolated``, ``gap`` (the neighbours are more than ``max_gap_steps`` steps apart;
    null) or ``edge`` (no neighbour on one side; null). Of several readings at one time the mean counts;
    null and NaN are unknown. Readings without station, time or a valid interval on their day are left
    out. An empty table gives an empty series.
    """
    # One exchange by source and day serves the grid, the grouping by time and both windows.
    base = placed(readings, columns).repartition("station_id", "day")
    at = F.col("day").cast("long") * (DAY_S * US) + F.col("us")
    known = base.groupBy("station_id", "day", "us").agg(F.first("slot").alias("slot"), *[F.avg(c).alias(c) for c in columns]) if columns else base.drop("step", "placed_by")
    nothing = F.lit(None).cast("double")
    # Days move, not their slots.
    all_days = None if by_day else whole_days(base)
    filled_grid = grid(base) if by_day else all_days.repartition("station_id", "day").select("station_id", "day", "step", F.explode(F.sequence("first", "last", "step")).alias("slot"))
    slots = filled_grid.select("station_id", "day", (F.col("slot").cast("long") * US).alias("us"), "slot", F.lit(1).alias("is_slot"), "step", *[nothing.alias(c) for c in columns])
    merged = slots.unionByName(known.withColumn("is_slot", F.lit(0)), allowMissingColumns=True)

    # A slot sorts after a reading of its very time, so that the reading is its neighbour at or before.
    order = Window.partitionBy("station_id", "day").orderBy("us", "is_slot")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back in the reverse order: both are running values, linear in the rows.
    pair = {c: F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(c).alias("v"))) for c in columns}
    reading_slot = F.when(F.col("is_slot") == 0, F.col("slot"))
    reverse = Window.partitionBy("station_id", "day").orderBy(F.desc("us"), F.desc("is_slot")).rowsBetween(Window.unboundedPreceding, 0)
    near = merged.select(
        "*",
        F.last(reading_slot, ignorenulls=True).over(before).alias("low_slot"),
        *[F.last(pair[c], ignorenulls=True).over(before).alias(f"low_{c}") for c in columns],
    )
    near = near.select(
        "*",
        F.last(reading_slot, ignorenulls=True).over(reverse).alias("high_slot"),
        *[F.last(pair[c], ignorenulls=True).over(reverse).alias(f"high_{c}") for c in columns],
    ).where("is_slot = 1")
    filled = F.coalesce(F.col("low_slot") == F.col("slot"), F.lit(False)) | F.coalesce(F.col("high_slot") == F.col("slot"), F.lit(False))

    if columns:
        # One row per source and day with its first and last known reading per column: what
        # neighbouring days need of each other.
        edges = known.groupBy("station_id", "day").agg(*[F.min(pair[c]).alias(f"first_{c}") for c in columns], *[F.max(pair[c]).alias(f"last_{c}") for c in columns])
        if all_days is not None:
            edges = all_days.select("station_id", "day").join(edges, ["station_id", "day"], "left")
        forward = Window.partitionBy("station_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        backward = Window.partitionBy("station_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
        days = edges.select(
            "station_id",
            "day",
            *[F.last(f"last_{c}", ignorenulls=True).over(forward).alias(f"before_{c}") for c in columns],
            *[F.last(f"first_{c}", ignorenulls=True).over(backward).alias(f"after_{c}") for c in columns],
        )
        near = near.join(days, ["station_id", "day"], "left")
    out = []
    for c in columns:
        low, high = F.coalesce(f"low_{c}", f"before_{c}"), F.coalesce(f"high_{c}", f"after_{c}")
        exact = low["t"] == at
        span = high["t"] - low["t"]
        short = span <= F.col("step").cast("long") * (US * max_gap_steps)
        value = F.when(exact, low["v"]).when(short, low["v"] + (high["v"] - low["v"]) * (at - low["t"]) / span)
        how = F.when(exact, "exact").when(low.isNull() | high.isNull(), "edge").when(short, "interpolated").otherwise("gap")
        out += [value.alias(c), how.alias(f"{c}_fill")]
    epoch = F.col("day").cast("long") * DAY_S + F.col("slot")
    return near.select("station_id", epoch.alias("slot_epoch_s"), "step", (~filled).alias("is_missing"), *out)


def missing_slots(readings: DataFrame) -> DataFrame:
    """station_id, slot_epoch_s of the slots between a day's first and last filled slot that no reading fills."""
    return regular_series(readings, by_day=True).where("is_missing").select("station_id", "slot_epoch_s")
