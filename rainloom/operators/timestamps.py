"""Stamps in mixed notations and zones, to one UTC instant each.

Every stamp is cut by native patterns into its date notation, clock time and zone. Each source mixes
formats; a stamp has a likelihood of one under every format that gives it a valid date. Per source an
expectation-maximisation over the mixture says how much each format is used, with the order of day and
month that the source declares as a strong prior; the posterior over a stamp's valid parses chooses. What
stays open is marked and gets no instant.

The values are not moved for the mixture: it needs the number of stamps per source and set of valid
formats, so that the only shuffle is of a dozen pre-aggregated rows per source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainloom.session import staged

US = 1_000_000
DAY_US = 86_400 * US

# English month abbreviations, and zone abbreviations with their offset in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONE_MINUTES = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120}

#: The formats of the mixture: notations of the date, numeric ones by order of day and month, epochs by unit.
FORMATS = ("ymd", "compact", "doy", "dmy", "mdy", "day_month", "month_day", "epoch_s", "epoch_ms", "epoch_us")
#: Steps of expectation-maximisation, and the change of all weights below which it ends.
EM_STEPS, EM_CHANGE = 200, 1e-9
#: A parse is chosen when its posterior reaches this.
MIN_POSTERIOR = 0.95
#: Pseudo-counts of every format, and of the order that a source declares.
PRIOR_COUNT, DECLARED_COUNT = 0.5, 1_000.0

_YMD = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?!\d)"
_DOY = r"^(\d{4})[-_](\d{3})(?!\d)"
_NUMERIC = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)"
_DAY_MONTH = r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*[- ](\d{4})(?!\d)"
_MONTH_DAY = r"^([A-Za-z]{3})[a-z]* (\d{1,2}), (\d{4})(?!\d)"
_TIME = r"^(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?|\.(\d{2})\.(\d{2})|(\d{2})(\d{2})(?!\d))\s*([AaPp][Mm])?\s*(Z|UTC|GMT|CEST|CET)?\s*([+-]\d{2}:?\d{2})?$"


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, null where there is no such date."""
    return F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))


def _said(text: Column) -> Column:
    """The trimmed text, null where it holds no digit (n/a, --, NaN, empty)."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean.rlike(r"\d"), clean)


def _by_notation(choices: dict[str, Column]) -> Column:
    out = None
    for name, column in choices.items():
        out = F.when(F.col("notation") == name, column) if out is None else out.when(F.col("notation") == name, column)
    return out


def assembled(stamps: DataFrame) -> DataFrame:
    """Adds ``stamp``, ``notation``, the days under each valid parse, time of day and offset.

    A stamp is sensor_date + sensor_time, or date + sensor_time, or whole in date. An epoch number in
    date is whole by itself: 10 digits are seconds, 13 milliseconds, 16 microseconds.

    Each step is its own projection over columns of the step before, so that the optimiser computes
    every part once instead of inlining the patterns into each other.
    """
    df = stamps.withColumns({"_sd": _said(F.col("sensor_date")), "_st": _said(F.col("sensor_time")), "_d": _said(F.col("date"))})
    whole = F.length(F.regexp_replace("_d", r"\D", "")) > 8
    stamp = (
        F.when(F.col("_sd").isNotNull() & F.col("_st").isNotNull(), F.concat_ws(" ", "_sd", "_st"))
        .when(F.col("_d").isNotNull() & F.col("_st").isNotNull() & ~whole, F.concat_ws(" ", "_d", "_st"))
        .otherwise(F.coalesce("_d", "_sd", "_st"))
    )
    df = staged(df, {"stamp": stamp}).drop("_sd", "_st", "_d")
    text = F.col("stamp")
    patterns = {"ymd": _YMD, "compact": _COMPACT, "doy": _DOY, "numeric": _NUMERIC, "day_month": _DAY_MONTH, "month_day": _MONTH_DAY}
    notation = F.when(text.isNull(), "missing").when(text.rlike(r"^(\d{10}|\d{13}|\d{16})$"), "epoch")
    for name, pattern in patterns.items():
        notation = notation.when(text.rlike(pattern), name)
    df = staged(df, {"notation": notation.otherwise("unknown")})

    # Three parts of the date in the order written, and the rest of the stamp.
    order = {"ymd": "$1,$3,$4", "compact": "$1,$2,$3", "doy": "$1,1,$2", "numeric": "$1,$3,$4", "day_month": "$1,$2,$3", "month_day": "$2,$1,$3"}
    df = staged(
        df,
        {
            "_parts": F.split(_by_notation({n: F.regexp_replace(text, p + ".*$", order[n]) for n, p in patterns.items()}), ","),
            "clock": F.regexp_replace(_by_notation({n: F.regexp_replace(text, p, "") for n, p in patterns.items()}), r"^(\s*[T;,]\s*|\s+|-(?=\d))", ""),
        }
    )
    named_month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.col("_parts")[1])).cast("int")
    df = staged(
        df,
        {
            "_a": F.col("_parts")[0].try_cast("int"),
            "_b": F.when(F.col("notation").isin("day_month", "month_day"), named_month).otherwise(F.col("_parts")[1].try_cast("int")),
            "_c": F.col("_parts")[2].try_cast("int") + F.when((F.col("notation") == "numeric") & (F.length(F.col("_parts")[2]) == 2), 2000).otherwise(0),
        }
    )
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    n = F.col("notation")
    df = staged(
        df,
        {
            # A day of the year counts from 1 January.
            "_fixed": _days(F.when(n.isin("day_month", "month_day"), c).otherwise(a), b, F.when(n == "doy", 1).when(n.isin("day_month", "month_day"), a).otherwise(c)),
            "days_dmy": F.when(n == "numeric", _days(c, b, a)),
            "days_mdy": F.when(n == "numeric", _days(c, a, b)),
        }
    )
    doy = F.when(c.between(1, 366), F.col("_fixed") + c - 1)
    df = df.withColumn("days_fixed", F.when(n == "doy", doy).when(n != "numeric", F.col("_fixed")))
    # Day 366 of a year that has none runs over into the next year.
    df = df.withColumn("days_fixed", F.when((n == "doy") & (F.year(F.date_from_unix_date("days_fixed")) != a), None).otherwise(F.col("days_fixed")))

    df = staged(df, {"_clock": F.when(F.col("clock").rlike(_TIME), F.split(F.regexp_replace("clock", _TIME, "$1,$2$5$7,$3$6$8,$4,$9,$10,$11"), ",", -1))})
    part = lambda i: F.when(F.col("_clock")[i] != "", F.col("_clock")[i])
    df = staged(
        df,
        {
            "_hour": part(0).cast("int"),
            "_minute": part(1).cast("int"),
            "_second": F.coalesce(part(2).cast("int"), F.lit(0)),
            "_micros": F.coalesce(F.substring(F.rpad(part(3), 9, "0"), 1, 6).cast("long"), F.lit(0)),
            "_half": F.lower(part(4)),
            "_zone": part(5),
            "_sign": F.when(F.substring(part(6), 1, 1) == "-", -1).otherwise(1),
            "_offset": F.regexp_replace(part(6), r"\D", ""),
            "has_clock": F.col("_clock").isNotNull(),
        }
    )
    hour = F.col("_hour")
    df = df.withColumn("_hour24", F.when(F.col("_half").isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(F.col("_half") == "pm", 12).otherwise(0)))
    df = df.withColumn("_of_day", (F.col("_hour24").cast("long") * 3600 + F.col("_minute") * 60 + F.col("_second")) * US + F.col("_micros"))
    valid = (F.col("_minute") <= 59) & (F.col("_second") <= 59) & ((F.col("_hour24") <= 23) | (F.col("_of_day") == DAY_US))
    abbreviation = F.coalesce(*[F.when(F.col("_zone") == name, F.lit(minutes)) for name, minutes in ZONE_MINUTES.items()])
    numeric = (F.substring("_offset", 1, 2).cast("int") * 60 + F.substring("_offset", 3, 2).cast("int")) * F.col("_sign")
    df = staged(
        df,
        {
            "time_of_day_us": F.when(valid, F.col("_of_day")),
            "offset_minutes": F.when(F.col("_offset").isNotNull(), F.when(F.abs(numeric) <= 14 * 60, numeric)).otherwise(abbreviation),
            "has_offset": F.col("_offset").isNotNull() | F.col("_zone").isNotNull(),
        }
    )
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def _bit(name: str) -> Column:
    return F.lit(1 << FORMATS.index(name))


def valid_formats(parsed: DataFrame) -> Column:
    """The formats that give a stamp a valid date, as bits; 0 of a stamp without any."""
    n, digits = F.col("notation"), F.length("stamp")
    fixed = [F.when((n == f) & F.col("days_fixed").isNotNull(), _bit(f)) for f in FORMATS if f not in ("dmy", "mdy") and not f.startswith("epoch")]
    epochs = [F.when((n == "epoch") & (digits == size), _bit(f)) for f, size in (("epoch_s", 10), ("epoch_ms", 13), ("epoch_us", 16))]
    orders = [F.coalesce(F.when(F.col(f"days_{f}").isNotNull(), _bit(f)), F.lit(0)) for f in ("dmy", "mdy")]
    return F.coalesce(*fixed, *epochs, orders[0] + orders[1])


def _mixture(counts: pa.Array, declared: pa.Array) -> pa.Array:
    """Weight of each format by expectation-maximisation, from how many stamps have which set of valid formats."""
    out = []
    for sets, order in zip(counts.to_pylist(), declared.to_pylist()):
        prior = np.full(len(FORMATS), PRIOR_COUNT)
        if order in ("DMY", "MDY"):
            prior[FORMATS.index(order.lower())] += DECLARED_COUNT
        sets = [x for x in sets or [] if x["valid"]]
        likelihood = np.array([[x["valid"] >> k & 1 for k in range(len(FORMATS))] for x in sets], float).reshape(len(sets), len(FORMATS))
        n = np.array([x["n"] for x in sets], float)
        weight = prior / prior.sum()
        for _ in range(EM_STEPS):
            share = likelihood * weight
            share /= share.sum(axis=1, keepdims=True)
            new = prior + n @ share
            new /= new.sum()
            change = np.abs(new - weight).sum()
            weight = new
            if change < EM_CHANGE:
                break
        out.append(weight.tolist())
    return pa.array(out, pa.list_(pa.float64()))


def format_mixture(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: clock_zone, declared order and ``weights``, the share of each of FORMATS among its stamps.

    A stamp that is valid under several formats is split by the current shares until they settle. A
    source without any telling stamp keeps its prior. One row per source of ``sources``.
    """
    counts = parsed.groupBy("station_id", "valid").agg(F.count("*").alias("n")).groupBy("station_id").agg(F.collect_list(F.struct("valid", "n")).alias("counts"))
    declared = F.upper(F.trim("date_order"))
    joined = sources.select("station_id", "clock_zone", F.when(declared.isin("DMY", "MDY"), declared).alias("declared")).join(counts, "station_id", "left")
    return joined.select("station_id", "clock_zone", "declared", F.arrow_udf(_mixture, "array<double>")(F.col("counts"), F.col("declared")).alias("weights"))


def utc_instants(stamps: DataFrame, sources: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per stamp: telegram_id, utc_us (null where open), status, notation, format, posterior.

    status is ``resolved``; ``missing`` (no digits), ``incomplete`` (no date or no time), ``impossible``
    (no such date or time), ``ambiguous_order`` (posterior of the likelier order below MIN_POSTERIOR),
    ``against_declared`` (a date only in the order that the source declares not to use),
    ``ambiguous_local`` or ``nonexistent_local`` (shown twice or never by the zone's clock), or
    ``unknown_source`` (a local time of a station that ``sources`` does not hold). ``format`` is the
    likeliest of the valid parses and ``posterior`` how likely it is, null without any. A null clock_zone
    is UTC. 24:00:00 is 00:00:00 of the next day; parts of the time not written are zero. Repeated stamps
    each get their row; extra columns are dropped but those of ``keep``.
    """
    parsed = assembled(stamps.select("telegram_id", "station_id", "sensor_date", "sensor_time", "date", *keep))
    parsed = staged(parsed, {"valid": valid_formats(parsed)})
    known = sources.dropDuplicates(["station_id"])
    mixture = format_mixture(parsed, known).withColumn("known", F.lit(True))
    df = parsed.join(mixture, "station_id", "left")
    dmy, mdy, numeric = F.col("days_dmy"), F.col("days_mdy"), F.col("notation") == "numeric"
    # The posterior over the valid parses: their weights in the source's mixture, alike where there is none.
    weight = {f: F.when(F.col("valid").bitwiseAND(_bit(f)) != 0, F.coalesce(F.col("weights")[k], F.lit(1.0))).otherwise(0.0) for k, f in enumerate(FORMATS)}
    best = F.greatest(*[F.struct(w.alias("w"), F.lit(f).alias("f")) for f, w in weight.items()])
    df = staged(df, {"_best": F.when(F.col("valid") != 0, best), "_all": sum(weight.values(), F.lit(0.0))})
    df = df.withColumns({"format": F.col("_best.f"), "posterior": F.try_divide(F.col("_best.w"), F.col("_all"))})
    against = numeric & (F.col("posterior") >= MIN_POSTERIOR) & F.coalesce(F.col("format") != F.lower("declared"), F.lit(False))
    chosen = F.when(dmy == mdy, dmy).when((F.col("posterior") >= MIN_POSTERIOR) & ~against, F.when(F.col("format") == "dmy", dmy).otherwise(mdy))
    df = df.withColumn("days", F.when(numeric, chosen).otherwise(F.col("days_fixed")))
    digits = F.length("stamp")
    epoch = F.when(F.col("notation") == "epoch", F.col("stamp").try_cast("long") * F.when(digits == 10, US).when(digits == 13, 1000).otherwise(1))
    df = df.withColumns({"local_us": F.col("days").cast("long") * DAY_US + F.col("time_of_day_us"), "epoch_us": epoch})
    plain = ~F.coalesce("has_offset", F.lit(False)) & F.col("known")
    df = df.withColumn("_plain", F.when(plain, F.col("local_us")))
    zone = F.coalesce("clock_zone", F.lit("UTC"))
    shift = lambda at: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone)) - at
    # The zone's offsets a day before and after cover every change between; each gives one candidate.
    df = staged(df, {"_u0": F.col("_plain") - shift(F.col("_plain") - DAY_US), "_u1": F.col("_plain") - shift(F.col("_plain") + DAY_US)})
    shown = [F.when(F.col(c) + shift(F.col(c)) == F.col("_plain"), F.col(c)) for c in ("_u0", "_u1")]
    df = df.withColumns({"first_us": F.least(*shown), "last_us": F.greatest(*shown)})
    utc = (
        F.when(F.col("epoch_us").isNotNull(), F.col("epoch_us"))
        .when(F.col("has_offset"), F.col("local_us") - F.col("offset_minutes").cast("long") * 60 * US)
        .when(F.col("first_us") == F.col("last_us"), F.col("first_us"))
    )
    df = staged(df, {"utc_us": utc})
    status = (
        F.when(F.col("notation") == "missing", "missing")
        .when(F.col("utc_us").isNotNull(), "resolved")
        .when((F.col("notation") == "unknown") | ~F.coalesce("has_clock", F.lit(False)), "incomplete")
        .when(F.col("days").isNull() & against, "against_declared")
        .when(numeric & (F.col("valid") != 0) & F.col("days").isNull(), "ambiguous_order")
        .when(F.col("local_us").isNull() | (F.col("has_offset") & F.col("offset_minutes").isNull()), "impossible")
        .when(F.col("known").isNull(), "unknown_source")
        .when(F.col("first_us").isNull(), "nonexistent_local")
        .otherwise("ambiguous_local")
    )
    return staged(df, {"status": status}).select("telegram_id", "station_id", "utc_us", "status", "notation", "format", "posterior", "stamp", *keep)
