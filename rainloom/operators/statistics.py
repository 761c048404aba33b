"""Grouped statistics: histograms with quantiles, tables of distributions, power laws, samples, line densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainloom.functions import arrays as A
from rainloom.operators.joins import BROADCAST_ROWS
from rainloom.operators.time_axis import resolution_seconds
from rainloom.session import checkpointed

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
#: Buckets per factor e in which the values of a group are counted to find its quantiles.
BUCKETS_PER_E = 4096
#: Seed of samples where none is given.
SAMPLE_SEED = 19_922_207


def log_arange(start: float, stop: float, log_step: float = 0.1, base: float = 10) -> np.ndarray:
    """Edges from start to stop, evenly spaced by ``log_step`` in the logarithm."""
    if start <= 0 or stop <= 0:
        raise ValueError("start and stop must be above 0")
    return base ** np.arange(math.log(start, base), math.log(stop, base) + log_step / 2, log_step)


def log_linspace(start: float, stop: float, n_bins: int, base: float = 10) -> np.ndarray:
    """``n_bins`` edges, evenly spaced in the logarithm."""
    if start <= 0 or stop <= 0:
        raise ValueError("start and stop must be above 0")
    if n_bins < 2:
        raise ValueError("at least start and stop are needed")
    return base ** np.linspace(math.log(start, base), math.log(stop, base), n_bins)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0/0 is 0, x/0 NaN."""
    return F.when((numerator == 0) & (denominator == 0), 0.0).otherwise(F.coalesce(F.try_divide(numerator, denominator), A.nan()))


def _number(column: str | Column) -> Column:
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def bin_index(value: Column, edges: Sequence[float], right: bool = True) -> Column:
    """0-based bin of a value; null outside. Right-closed bins include their lowest edge; ``right=False`` closes left."""
    points = F.array(*[F.lit(float(e)) for e in edges])
    if right:
        n = F.size(F.filter(points, lambda e: e < value))
        inside = (value >= float(edges[0])) & (value <= float(edges[-1]))
        return F.when(inside, F.greatest(n - 1, F.lit(0)))
    n = F.size(F.filter(points, lambda e: e <= value))
    return F.when((value >= float(edges[0])) & (value < float(edges[-1])), n - 1)


def unbiased(skew: Column, kurtosis: Column, n: Column) -> tuple[Column, Column]:
    """Sample-corrected skewness and excess kurtosis of Spark's population values; NaN for too few values."""
    n = n.cast("double")
    g1 = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * skew)
    g2 = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * kurtosis + 6))
    return F.coalesce(g1, A.nan()), F.coalesce(g2, A.nan())


def _settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table of a few rows per group, worked out once, and whether it is small enough to be sent to the workers."""
    rows = df.limit(BROADCAST_ROWS + 1).repartition(1).collect()
    if len(rows) <= BROADCAST_ROWS:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return checkpointed(df), False


def _settled_join(long: DataFrame, settled: tuple[DataFrame, bool], on: Sequence[str]) -> DataFrame:
    table, small = settled
    return long.join(F.broadcast(table) if small else table, list(on))


def quantiles(long: DataFrame, keys: Sequence[str], shares: Sequence[float], value: str = "x") -> DataFrame:
    """keys, n and ``q``, the exact quantiles of a column per group, linear between neighbouring values.

    No group is gathered: values are counted in narrow buckets that keep their order, partly before they
    move; the counts tell which bucket holds a wanted rank, and only the values of these buckets, a
    thousandth of a group or less, are counted one by one. Null and NaN do not count; a group without
    values has no row.
    """
    keys = list(keys)
    x = F.col(value)
    size = F.floor(F.log(F.abs(x)) * BUCKETS_PER_E).cast("long") + F.lit(1 << 32)
    bucket = F.when(x == 0, F.lit(0).cast("long")).when(F.abs(x) == float("inf"), F.lit(1 << 40) * F.signum(x).cast("long")).otherwise(F.signum(x).cast("long") * size)
    placed = long.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"), bucket.alias("_bucket"))
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_n").over(group)})
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * q) + 1, F.ceil((F.col("n") - 1) * q) + 1) for q in map(float, shares)])))
    inside = F.filter(ranks, lambda r: (r > F.col("_upto") - F.col("_n")) & (r <= F.col("_upto")))
    wanted = ranked.where(F.size(inside) > 0).select(*keys, "_bucket", "n", (F.col("_upto") - F.col("_n")).alias("_before"), inside.alias("_ranks"))
    found = _settled_join(placed, _settled(wanted), [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_x").agg(F.count("*").alias("_m"), F.first("n").alias("n"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*keys, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    at = found.withColumn("_upto", upto).withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r > F.col("_upto") - F.col("_m")) & (r <= F.col("_upto")))))
    table = at.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def one(q: float) -> Column:
        position = (F.col("n") - 1) * q
        low, high = (F.try_element_at("_at", f(position).cast("long") + 1) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))

    return table.select(*keys, "n", F.array(*[one(float(q)) for q in shares]).alias("q"))


#: The same under a name that parameters called ``quantiles`` do not hide.
order_quantiles = quantiles


def _long(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("_variable"), _number(v).alias("x")) for v in variables])))


def _order_statistics(df: DataFrame, keys: Sequence[str], variables: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """keys and, per variable, ``{v}_q`` (its quantiles) and ``_mad_{v}`` (median absolute deviation around the median)."""
    long = _long(df, keys, variables)
    group = [*keys, "_variable"]
    found, small = _settled(quantiles(long, group, [*shares, 0.5]))
    off = _settled_join(long, (found.select(*group, F.element_at("q", -1).alias("_median")), small), group).select(*group, F.abs(F.col("x") - F.col("_median")).alias("x"))
    mads = quantiles(off, group, [0.5]).select(*group, F.col("q")[0].alias("_mad"))
    both = found.join(mads, group, "left")
    return both.groupBy(*keys).agg(*[e for v in variables for e in (F.max(F.when(F.col("_variable") == v, F.col("q"))).alias(f"{v}_q"), F.max(F.when(F.col("_variable") == v, F.col("_mad"))).alias(f"_mad_{v}"))])


def group_statistics(df: DataFrame, keys: Sequence[str], variables: Sequence[str], quantiles: Sequence[float] = QUANTILES, with_quantiles: bool = True, prefix: bool = True) -> DataFrame:
    """count and per variable mean, std, skew, kurtosis, min, max, median, mad, ranges between quantiles, cv and robcv."""
    wanted = sorted({*quantiles, *QUANTILES})
    aggregates = [F.count("*").alias("count")]
    for v in variables:
        x = _number(v)
        aggregates += [
            F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_std"), F.skewness(x).alias(f"{v}_skew"), F.kurtosis(x).alias(f"{v}_kurtosis"), F.count(x).alias(f"{v}_n"),
            F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"),
        ]
    table = df.groupBy(*keys).agg(*aggregates).join(_order_statistics(df, keys, variables, wanted), list(keys), "left")
    out = [F.col("count")]
    for v in variables:
        p = f"{v}_" if prefix else ""
        at = {q: F.col(f"{v}_q")[i] for i, q in enumerate(wanted)}
        skew, kurtosis = unbiased(F.col(f"{v}_skew"), F.col(f"{v}_kurtosis"), F.col(f"{v}_n"))
        mean, std, mad = F.col(f"{v}_mean"), F.coalesce(f"{v}_std", A.nan()), F.col(f"_mad_{v}")
        out += [mean.alias(f"{p}mean"), std.alias(f"{p}std"), skew.alias(f"{p}skew"), kurtosis.alias(f"{p}kurtosis"), F.col(f"{v}_min").alias(f"{p}min"), F.col(f"{v}_max").alias(f"{p}max"), mad.alias(f"{p}mad")]
        out += [(F.col(f"{v}_max") - F.col(f"{v}_min")).alias(f"{p}range"), at[0.5].alias(f"{p}median")]
        out += [(at[b] - at[a]).alias(f"{p}{name}") for name, a, b in (("iqr", 0.25, 0.75), ("ipr80", 0.1, 0.9), ("ipr90", 0.05, 0.95), ("ipr98", 0.01, 0.99))]
        out += [safe_ratio(std, mean).alias(f"{p}cv"), safe_ratio(mad, at[0.5]).alias(f"{p}robcv")]
        if with_quantiles:
            out += [at[q].alias(f"{p}Q{round(q * 100)}") for q in quantiles if q != 0.5]
    return table.select(*keys, *out)


def _bin_table(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[float] | None) -> DataFrame:
    rows = [(i, float(a), float(b), float(labels[i]) if labels is not None else (float(a) + float(b)) / 2) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return df.sparkSession.createDataFrame(rows, f"{column}_bin int, {column}_lower double, {column}_upper double, {column} double")


def _edges(df: DataFrame, column: str, bins: int | Sequence[float]) -> list[float]:
    if not isinstance(bins, int):
        return [float(b) for b in bins]
    low, high = df.agg(F.min(_number(column)), F.max(_number(column))).first()
    if low is None:
        raise ValueError(f"{column} has no values")
    return [float(x) for x in np.linspace(low, high, bins + 1)]


def histogram(df: DataFrame, column: str, variables: Sequence[str] = (), bins: int | Sequence[float] = 10, labels: Sequence[float] | None = None, quantiles: Sequence[float] = QUANTILES, with_quantiles: bool = False) -> DataFrame:
    """One row per bin of ``column``, empty ones included: bounds, centre or label, count and statistics of the variables.

    Bins are right-closed with the lowest edge included; a value equal to the last edge is out. Rows with
    a missing column or variable are left out.
    """
    edges = _edges(df, column, bins)
    variables = [v for v in variables if v != column]
    known = df.where(_number(column).isNotNull())
    for v in variables:
        known = known.where(_number(v).isNotNull())
    placed = known.where((F.col(column) >= edges[0]) & (F.col(column) < edges[-1])).withColumn(f"{column}_bin", bin_index(F.col(column).cast("double"), edges))
    if variables:
        stats = group_statistics(placed, [f"{column}_bin"], variables, quantiles, with_quantiles)
    else:
        stats = placed.groupBy(f"{column}_bin").agg(F.count("*").alias("count"))
    return F.broadcast(_bin_table(df, column, edges, labels)).join(stats, f"{column}_bin", "left")


def histogram_2d(df: DataFrame, x: str, y: str, variables: Sequence[str] = (), x_bins: int | Sequence[float] = 10, y_bins: int | Sequence[float] = 10, quantiles: Sequence[float] = QUANTILES, with_quantiles: bool = False) -> DataFrame:
    """One row per cell of the full grid of bins of x and y."""
    ex, ey = _edges(df, x, x_bins), _edges(df, y, y_bins)
    variables = [v for v in variables if v not in (x, y)]
    known = df
    for v in (x, y, *variables):
        known = known.where(_number(v).isNotNull())
    for c, e in ((x, ex), (y, ey)):
        known = known.where((F.col(c) >= e[0]) & (F.col(c) < e[-1])).withColumn(f"{c}_bin", bin_index(F.col(c).cast("double"), e))
    keys = [f"{x}_bin", f"{y}_bin"]
    stats = group_statistics(known, keys, variables, quantiles, with_quantiles) if variables else known.groupBy(*keys).agg(F.count("*").alias("count"))
    tx, ty = _bin_table(df, x, ex, None), _bin_table(df, y, ey, None)
    # The grid has as many rows as the given edges make cells, whatever the data; it is built on the driver.
    cells = [(*a, *b) for a in tx.collect() for b in ty.collect()]
    grid = df.sparkSession.createDataFrame(cells, T.StructType([*tx.schema.fields, *ty.schema.fields]))
    return grid.join(stats, keys, "left")


def dense_cells(df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float], least: int) -> DataFrame:
    """Rows whose (x, y) cell, bins closed left, holds at least ``least`` rows.

    Counts per cell are joined back, so that a crowded cell is counted in parts and never gathered.
    """
    placed = df.withColumns({"_xb": bin_index(F.col(x).cast("double"), x_edges, right=False), "_yb": bin_index(F.col(y).cast("double"), y_edges, right=False)})
    placed = placed.where("_xb is not null and _yb is not null")
    counts = placed.groupBy("_xb", "_yb").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return placed.join(counts, ["_xb", "_yb"], "left_semi").drop("_xb", "_yb")


def rain_statistics(df: DataFrame, resolution: str, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Minutes with rain by class of rate, and with large drops; one row per key with rain."""
    minutes = resolution_seconds(resolution)[0] / 60
    rate = F.col("R")
    count = lambda c: (F.count_if(c) * F.lit(minutes)).cast("bigint")
    classes = (("<0.1", 0, 0.1), ("0.1_1", 0.1, 1), ("1_10", 1, 10), ("10_25", 10, 25), ("25_50", 25, 50), ("50_100", 50, 100), ("100_200", 100, 200))
    wet = df.where((rate > 0) & ~F.isnan(rate))
    return wet.groupBy(*keys).agg(
        count(F.lit(True)).alias("n_rainy_minutes"),
        *[count((rate > low) & (rate <= high)).alias(f"n_rainy_minutes_{name}") for name, low, high in classes],
        count(rate > 200).alias("n_rainy_minutes_>200"),
        *[count((F.col("Dmax") > d) & ~F.isnan("Dmax")).alias(f"n_minutes_Dmax_>{d}") for d in (7, 8, 9)],
    )


def rain_summary(df: DataFrame, resolution: str, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """rain_statistics with the years and months that the rainy rows cover, as text."""
    wet = df.where((F.col("R") > 0) & ~F.isnan("R"))
    spans = wet.groupBy(*keys).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    ya, yb, ma, mb = F.year(a).cast("string"), F.year(b).cast("string"), F.date_format(a, "MMM"), F.date_format(b, "MMM")
    same = ya == yb
    years = F.when(same, ya).otherwise(F.concat_ws(" - ", ya, yb))
    months = F.when(same, F.concat(ma, F.lit("-"), mb, F.lit(" "), ya)).otherwise(F.concat(ma, F.lit(" "), ya, F.lit(" - "), mb, F.lit(" "), yb))
    return spans.select(*keys, years.alias("years_coverage"), months.alias("years_month_coverage")).join(rain_statistics(df, resolution, keys), list(keys))


# Variables and statistics of the table of distributions.
DSD_VARIABLES = ("LWC", "R", "Z", "D50", "Dm", "sigma_m", "Dmax", "Nw", "log10(Nw)", "Nt", "log10(Nt)")
_DSD_QUANTILES = (("Q1", 0.01), ("Q5", 0.05), ("Q10", 0.10), ("Q50", 0.50), ("Q90", 0.90), ("Q95", 0.95), ("Q99", 0.99))


def distribution_table(df: DataFrame, variables: Sequence[str] = DSD_VARIABLES, keys: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """keys, variable, MIN, Q1 .. Q99, MAX, MEAN, STD, MAD (mean absolute deviation), SKEWNESS, KURTOSIS.

    Variables named log10(x) are the logarithm of x. Missing values are left out, variable by variable.
    """
    logs = {v: F.when(_number(v[6:-1]) > 0, F.log10(_number(v[6:-1]))) for v in variables if v.startswith("log10(")}
    values = F.array(*[F.struct(F.lit(v).alias("variable"), (logs[v] if v in logs else _number(v)).alias("x")) for v in variables])
    long = df.select(*keys, F.inline(values)).where("x is not null")
    group = [*keys, "variable"]
    base = long.groupBy(*group).agg(
        F.min("x").alias("MIN"), F.max("x").alias("MAX"), F.avg("x").alias("MEAN"), F.stddev_samp("x").alias("STD"), F.skewness("x").alias("_s"), F.kurtosis("x").alias("_k"), F.count("*").alias("_n"),
    )
    base, small = _settled(base.join(quantiles(long, group, [q for _, q in _DSD_QUANTILES]).select(*group, F.col("q").alias("_q")), group))
    deviation = _settled_join(long, (base.select(*group, "MEAN"), small), group).groupBy(*group).agg(F.avg(F.abs(F.col("x") - F.col("MEAN"))).alias("MAD"))
    skew, kurtosis = unbiased(F.col("_s"), F.col("_k"), F.col("_n"))
    columns = [("MIN", F.col("MIN")), *[(n, F.col("_q")[i]) for i, (n, _) in enumerate(_DSD_QUANTILES)], ("MAX", F.col("MAX")), ("MEAN", F.col("MEAN")), ("STD", F.coalesce("STD", A.nan())), ("MAD", F.col("MAD")), ("SKEWNESS", skew), ("KURTOSIS", kurtosis)]
    return base.join(deviation, group).select(*group, *[(c if digits is None else F.bround(c, digits)).alias(n) for n, c in columns])


# --- power laws -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PowerLaw:
    """y = a x^b, or with c also y = a 10^(b log x + c log^2 x); standard errors where they are known."""

    a: float
    b: float
    c: float | None = None
    a_std: float | None = None
    b_std: float | None = None
    c_std: float | None = None

    def predict(self, x: Column) -> Column:
        if self.c is None:
            return self.a * F.pow(x, F.lit(self.b))
        log = F.log10(x)
        return self.a * F.pow(F.lit(10.0), self.b * log + self.c * log * log)

    def inverse(self) -> PowerLaw:
        """x = A y^B."""
        return PowerLaw(self.a ** (-1 / self.b), 1 / self.b)

    def predict_inverse(self, y: Column) -> Column:
        return F.pow(y, F.lit(1 / self.b)) / self.a ** (1 / self.b)


def power_law_points(df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float] | None = None, quantile: float = 0.5, least: int = 10, x_in_db: bool = False) -> DataFrame:
    """One row per bin of x (closed left): x (its centre), y (the quantile), n, mad; bins with over ``least`` rows."""
    vx, vy = _number(x), _number(y)
    data = df.select(vx.alias("x"), vy.alias("y")).where("x > 0 and y > 0 and x < double('Infinity') and y < double('Infinity')")
    if y_edges is not None:
        data = dense_cells(data, "x", "y", x_edges, y_edges, least)
    placed = data.withColumn("bin", bin_index(F.col("x"), x_edges, right=False)).where("bin is not null")
    stats = placed.groupBy("bin").agg(F.count("*").alias("n")).join(_order_statistics(placed, ["bin"], ["y"], [quantile]), "bin").withColumn("q", F.col("y_q")[0])
    centres = F.array(*[F.lit((float(a) + float(b)) / 2) for a, b in zip(x_edges[:-1], x_edges[1:])])
    centre = F.element_at(centres, F.col("bin") + 1)
    centre = F.pow(F.lit(10.0), centre / 10) if x_in_db else centre
    return stats.where((F.col("q") > 0) & (F.col("n") > least)).select("bin", centre.alias("x"), F.col("q").alias("y"), "n", F.col("_mad_y").alias("mad"))


def weighted_power_law(x: np.ndarray, y: np.ndarray, sigma: np.ndarray, quadratic: bool = False) -> PowerLaw:
    """Weighted least squares in the logarithms; sigma is that of y."""
    lx, ly = np.log10(x), np.log10(y)
    weight = y * math.log(10) / sigma
    design = np.stack([np.ones_like(lx), lx, *([lx * lx] if quadratic else [])], axis=1)
    covariance = np.linalg.inv((design * weight[:, None]).T @ (design * weight[:, None]))
    solution = covariance @ (design * weight[:, None]).T @ (ly * weight)
    error = np.sqrt(np.diag(covariance))
    a = 10 ** solution[0]
    c = (float(solution[2]), float(error[2])) if quadratic else (None, None)
    return PowerLaw(float(a), float(solution[1]), c[0], float(math.log(10) * a * error[0]), float(error[1]), c[1])


def robust_power_law(x: np.ndarray, y: np.ndarray, quadratic: bool = False, residual: float = 0.3, trials: int = 100, seed: int = 42) -> PowerLaw:
    """RANSAC in the logarithms: random halves are fitted, the fit with the most points within ``residual`` is refined on them."""
    lx, ly = np.log10(x), np.log10(y)
    design = np.stack([np.ones_like(lx), lx, *([lx * lx] if quadratic else [])], axis=1)
    random = np.random.default_rng(seed)
    take = max(design.shape[1], math.ceil(len(x) / 2))
    best, most = np.ones(len(x), bool), (-1, -math.inf)
    for _ in range(trials):
        rows = random.choice(len(x), take, replace=False)
        solution = np.linalg.lstsq(design[rows], ly[rows], rcond=None)[0]
        off = np.abs(design @ solution - ly)
        inside = off <= residual
        if (score := (int(inside.sum()), -float(off[inside].sum()))) > most:
            best, most = inside, score
    solution = np.linalg.lstsq(design[best], ly[best], rcond=None)[0]
    return PowerLaw(float(10 ** solution[0]), float(solution[1]), float(solution[2]) if quadratic else None)


def fit_power_law(df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float] | None = None, quantile: float = 0.5, least: int = 10, x_in_db: bool = False, robust: bool = False, quadratic: bool = False) -> PowerLaw:
    """The power law through the quantiles of y per bin of x. Only the bins, as many as edges, come to the driver."""
    points = power_law_points(df, x, y, x_edges, y_edges, quantile, least, x_in_db).orderBy("bin").collect()
    if len(points) < 5:
        raise ValueError("not enough bins with data to fit a power law")
    px, py, mad = (np.array([p[c] for p in points], float) for c in ("x", "y", "mad"))
    if robust:
        return robust_power_law(px, py, quadratic)
    sigma = 1.4826 * mad
    positive = sigma[sigma > 0]
    sigma = np.maximum(sigma, np.percentile(positive, 1) if len(positive) else 1.0)
    return weighted_power_law(px, py, sigma, quadratic)


# --- samples --------------------------------------------------------------------------------------------


def stratum_edges(df: DataFrame, column: str, quantiles: Sequence[float]) -> list[float]:
    """Distinct edges at the quantiles of a column."""
    found = order_quantiles(df.select(F.lit(0).alias("_all"), _number(column).alias("x")), ["_all"], quantiles).first()
    return sorted({float(x) for x in found["q"]}) if found else []


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = (), id_columns: Sequence[str] = (), category: str | None = None, stratum: str | None = None, edges: Sequence[float] | None = None, quantiles: Sequence[float] | None = None, replace: bool = False, seed: int = SAMPLE_SEED) -> DataFrame:
    """n random rows, or n per category or per stratum of a column; repeatable by seed and ``id_columns``.

    Rows rank by a hash. A large group is cut to n rows per part before its parts meet, so no group is
    gathered whole. With replacement, each of the n draws takes the row of smallest hash of its own.
    """
    ids = list(id_columns) or df.columns
    group: list[str] = list(keys)
    marked = df
    if category is not None:
        group.append(category)
    if stratum is not None:
        bounds = list(edges) if edges is not None else stratum_edges(df, stratum, quantiles or (0, 0.25, 0.5, 0.75, 1))
        marked = marked.withColumn("stratum", bin_index(F.col(stratum).cast("double"), bounds)).where("stratum is not null")
        group.append("stratum")
    if replace:
        draws = marked.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
        best = draws.groupBy(*group, "_draw").agg(F.min_by(F.struct(*marked.columns), F.xxhash64(F.lit(seed), "_draw", *ids)).alias("_row"))
        return best.select("_row.*")
    hashed = marked.withColumns({"_h": F.xxhash64(F.lit(seed), *ids), "_part": F.pmod(F.xxhash64(F.lit(seed + 1), *ids), F.lit(64))})
    first = hashed.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_h", *ids))).where(F.col("_k") <= n)
    last = first.withColumn("_k", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_h", *ids))).where(F.col("_k") <= n)
    return last.drop("_h", "_part", "_k")


def unique_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, value: the distinct values of columns, as text."""
    chosen = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in chosen])
    return df.select(F.inline(pairs)).distinct()


def line_density(df: DataFrame, sample: Sequence[str], x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float], normalization: str = "max") -> DataFrame:
    """x_bin, y_bin, density: how many lines (one per sample) run through a cell; each line weighs 1 per column."""
    placed = df.withColumns({"x_bin": bin_index(F.col(x).cast("double"), x_edges, right=False), "y_bin": bin_index(F.col(y).cast("double"), y_edges, right=False)}).where("x_bin is not null and y_bin is not null")
    hits = placed.select(*sample, "x_bin", "y_bin").distinct()
    per_column = hits.groupBy(*sample, "x_bin").agg(F.count("*").alias("_n"))
    cells = hits.join(per_column, [*sample, "x_bin"]).groupBy("x_bin", "y_bin").agg(F.sum(1 / F.col("_n")).alias("density"))
    return normalized(cells, "density", normalization)


def normalized(df: DataFrame, column: str, method: str = "max", keys: Sequence[str] = ()) -> DataFrame:
    """A column scaled by its group's maximum, range or spread, or to its logarithm; "none" leaves it."""
    if method == "none":
        return df
    if method == "log":
        return df.withColumn(column, F.when(F.col(column) > 0, F.log10(column)).otherwise(A.nan()))
    c = _number(column)
    if method not in ("max", "minmax", "zscore"):
        raise ValueError(f"{method} is no normalization")
    # One row of statistics per group is joined, instead of a window over a whole group.
    stats = df.groupBy(*keys).agg(F.max(c).alias("_max"), F.min(c).alias("_min"), F.avg(c).alias("_mean"), F.stddev_pop(c).alias("_std"))
    joined = df.join(F.broadcast(stats)) if not keys else df.join(stats, list(keys))
    scaled = {"max": F.try_divide(c, F.col("_max")), "minmax": F.try_divide(c - F.col("_min"), F.col("_max") - F.col("_min")), "zscore": F.try_divide(c - F.col("_mean"), F.col("_std"))}[method]
    return joined.withColumn(column, F.coalesce(scaled, A.nan())).drop("_max", "_min", "_mean", "_std")


def max_blend(images: DataFrame, pixel: Sequence[str], alpha: str, channels: Sequence[str]) -> DataFrame:
    """Of several images the channels of the one with the largest alpha, pixel by pixel."""
    return images.groupBy(*pixel).agg(F.max_by(F.struct(*channels, alpha), F.col(alpha)).alias("_p")).select(*pixel, "_p.*")


def dsd_points(df: DataFrame, diameter: Column, concentration: str = "drop_number_concentration", keep: Sequence[str] = ("station_id", "time", "R", "Dm", "D50", "Nw")) -> DataFrame:
    """One row per time and bin with drops: D, N(D) and their normalised forms."""
    points = df.where("R != 0").select(*keep, F.posexplode(F.arrays_zip(diameter.alias("D"), F.col(concentration).alias("ND"))).alias("bin", "p")).select(*keep, "bin", F.col("p.D").alias("D"), F.col("p.ND").alias("ND")).where("ND != 0")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), A.nan())
    out = points.withColumns({"D_D50": ratio("D", "D50"), "D_Dm": ratio("D", "Dm"), "ND_Nw": ratio("ND", "Nw")})
    return out.withColumn("log10_ND_Nw", F.when(F.col("ND_Nw") > 0, F.log10("ND_Nw")).otherwise(A.nan()))
