"""Fits of distributions to spectra, row by row: moments (native), grid search and likelihood (numpy over Arrow batches)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.functions import arrays as A
from rainloom.functions import moments_fit, psd
from rainloom.functions import spectrum as S
from rainloom.functions.backend import lgamma

#: Cells of a grid evaluated at once for one row; bounds the memory of a task.
GRID_CHUNK = 20_000
DISTRIBUTION_LOSSES = ("SSE", "SAE", "MAE", "MSE", "RMSE", "relMAE", "KLDiv", "WD", "JSD", "KS")
INTEGRAL_LOSSES = ("SE", "AE")
INTEGRAL_TARGETS = ("Z", "R", "LWC", "M0", "M1", "M2", "M3", "M4", "M5", "M6")


def sanitized(nd):
    """A spectrum that is all zero or holds a number that is not finite, as all NaN."""
    bad = F.exists(nd, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(nd, lambda x: x == 0)
    return F.when(bad, A.constant(nd, float("nan"))).otherwise(nd)


# --- method of moments --------------------------------------------------------------------------------------


def fit_moments(df: DataFrame, model: str, methods: Sequence[str] | None = None, nd: str = "drop_number_concentration", diameter=None, width=None, keep: Sequence[str] | None = None) -> DataFrame:
    """Parameters by the method of moments, one row per input row and method (column mom_method)."""
    known = moments_fit.METHODS.get(model)
    if known is None:
        raise ValueError(f"{model} has no method of moments")
    chosen = list(methods or known)
    unknown = set(chosen) - set(known)
    if unknown:
        raise ValueError(f"unknown methods for {model}: {', '.join(sorted(unknown))}")
    orders = sorted({k for m in chosen for k in known[m][0]})
    clean = sanitized(F.col(nd))
    summed = df.withColumn("_nd", clean).withColumns({f"_M{k}": S.moment(F.col("_nd"), diameter, width, k) for k in orders})
    names = moments_fit.PARAMETERS[model]
    rows = [F.struct(F.lit(m).alias("mom_method"), *[c.alias(n) for n, c in zip(names, known[m][1](*[F.col(f"_M{k}") for k in known[m][0]]))]) for m in chosen]
    kept = list(keep) if keep is not None else df.columns
    return summed.select(*kept, F.inline(F.array(*rows)))


# --- losses ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Objective:
    """What a grid search minimises; weights count with several objectives."""

    target: str = "N(D)"
    loss: str = "SSE"
    transformation: str = "identity"
    censoring: str = "none"
    weight: float = 1.0
    clip_lower: float | None = None

    def __post_init__(self):
        if self.target in ("N(D)", "H(x)"):
            valid = DISTRIBUTION_LOSSES
        elif self.target in INTEGRAL_TARGETS:
            valid = INTEGRAL_LOSSES
        else:
            raise ValueError(f"{self.target} is no target")
        if self.loss not in valid:
            raise ValueError(f"{self.loss} is no loss of {self.target}")
        if self.transformation not in ("identity", "log", "log10", "sqrt"):
            raise ValueError(f"{self.transformation} is no transformation")
        if self.censoring not in ("none", "left", "right", "both"):
            raise ValueError(f"{self.censoring} is no censoring")
        if self.weight <= 0:
            raise ValueError("weights are above 0")


DEFAULT_OBJECTIVES = (Objective("N(D)", "SSE", weight=0.8), Objective("Z", "AE", weight=0.2))


def transformed(x: np.ndarray, how: str) -> np.ndarray:
    return {"identity": lambda v: v, "log": lambda v: np.log(v + 1), "log10": lambda v: np.log10(v + 1), "sqrt": np.sqrt}[how](x)


def target_values(target: str, nd: np.ndarray, d: np.ndarray, width: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """The quantity of a spectrum, or of each row of a matrix of spectra, that an objective compares."""
    if target in ("N(D)", "H(x)"):
        return nd
    if target == "R":
        return nd @ (velocity * d**3 * width) * (6e-4 * math.pi)
    if target == "LWC":
        return nd @ (d**3 * width) * (math.pi / 6 * 1e-3)
    order = 6 if target == "Z" else int(target[1])
    moment = nd @ (d**order * width)
    if target == "Z":
        with np.errstate(all="ignore"):
            return 10 * np.log10(np.where(moment > 0, moment, np.nan))
    return moment


def _shares(nd: np.ndarray, width: np.ndarray) -> np.ndarray:
    mass = nd * width
    return mass / (mass.sum(axis=-1, keepdims=True) + 1e-12)


def _kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.broadcast_arrays(p, q)
    with np.errstate(all="ignore"):
        terms = np.where(p > 0, p * np.log(p / np.maximum(q, 1e-12)), 0.0).sum(axis=-1)
    return np.where((p.sum(axis=-1) > 0) & (q.sum(axis=-1) > 0), np.maximum(terms, 0), np.nan)


def distribution_error(loss: str, obs: np.ndarray, pred: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Error of each row of ``pred`` against ``obs``."""
    if loss in ("KLDiv", "JSD", "WD", "KS"):
        p, q = _shares(obs[None, :], width), _shares(pred, width)
        if loss == "KLDiv":
            return _kl(p, q)
        if loss == "JSD":
            middle = (p + q) / 2
            return np.sqrt(np.maximum((_kl(p, middle) + _kl(q, middle)) / 2, 0))
        gap = np.abs(np.cumsum(p, axis=1) - np.cumsum(q, axis=1))
        out = (gap * width).sum(axis=1) if loss == "WD" else gap.max(axis=1)
        return np.where((p.sum() > 0) & (q.sum(axis=1) > 0), out, np.nan)
    off = np.abs(obs[None, :] - pred)
    if loss == "SAE":
        return off.sum(axis=1)
    if loss == "MAE":
        return off.mean(axis=1)
    if loss == "relMAE":
        return (off / (np.abs(obs) + 1e-12)).mean(axis=1)
    squares = off * off
    return {"SSE": squares.sum, "MSE": squares.mean}[loss](axis=1) if loss != "RMSE" else np.sqrt(squares.mean(axis=1))


def objective_error(objective: Objective, obs: np.ndarray, pred: np.ndarray, d: np.ndarray, width: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """Errors of candidate spectra; infinite for an empty observation under censoring, NaN where they are not finite."""
    low = objective.clip_lower if objective.clip_lower is not None else (1e-5 if objective.target == "H(x)" else 1e-3)
    obs, pred = np.where(obs < low, 0.0, obs), np.where(pred < low, 0.0, pred)
    filled = np.flatnonzero(obs > 0)
    if objective.censoring != "none":
        if not len(filled):
            return np.full(len(pred), np.inf)
        cut = slice(filled[0] if objective.censoring in ("left", "both") else 0, filled[-1] + 1 if objective.censoring in ("right", "both") else len(obs))
        obs, pred, d, width, velocity = obs[cut], pred[:, cut], d[cut], width[cut], velocity[cut]
    with np.errstate(all="ignore"):
        o, q = (transformed(target_values(objective.target, x, d, width, velocity), objective.transformation) for x in (obs, pred))
        if objective.target in ("N(D)", "H(x)"):
            error = distribution_error(objective.loss, o, q, width)
        else:
            error = np.abs(o - q) if objective.loss == "AE" else (o - q) ** 2
    return np.where(np.isfinite(error), error, np.nan)


def scaled_errors(error: np.ndarray) -> np.ndarray:
    """Errors divided by the median of their lowest tenth, unless that is 0."""
    known = error[~np.isnan(error)]
    if not len(known):
        return error
    scale = np.median(known[known <= np.percentile(known, 10)])
    return error / scale if scale != 0 else error


def combined_error(objectives: Sequence[Objective], obs: np.ndarray, pred: np.ndarray, d: np.ndarray, width: np.ndarray, velocity: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Weighted mean of the objectives' errors, each scaled; ``scale`` divides spectra for H(x)."""
    if len(objectives) == 1:
        by = scale if objectives[0].target == "H(x)" else 1.0
        return objective_error(objectives[0], obs / by, pred / by, d, width, velocity)
    total, weight = np.zeros(len(pred)), 0.0
    for o in objectives:
        by = scale if o.target == "H(x)" else 1.0
        total = total + o.weight * scaled_errors(objective_error(o, obs / by, pred / by, d, width, velocity))
        weight += o.weight
    return total / weight


# --- grid search ----------------------------------------------------------------------------------------------

# Default search spaces, (start, stop, step), the stop left out.
SEARCH_SPACES: dict[str, dict[str, tuple[float, float, float]]] = {
    "ExponentialPSD": {"Lambda": (0.01, 10, 0.01)},
    "GammaPSD": {"mu": (-1, 20, 0.1), "Lambda": (0, 40, 0.1)},
    "LognormalPSD": {"mu": (-1.5, 1, 0.025), "sigma": (0, 1, 0.01)},
    "GeneralizedGammaPSD": {"mu": (-1, 10, 0.2), "c": (0, 6, 0.1), "Lambda": (0.5, 20, 0.1)},
    "NormalizedGammaD50NwPSD": {"mu": (-1, 30, 0.01)},
    "NormalizedGammaDmNwPSD": {"mu": (-1, 30, 0.01)},
    "NormalizedGammaDmNtPSD": {"mu": (-1, 30, 0.01)},
    "NormalizedGeneralizedGammaPSD": {"mu": (-1, 10, 0.1), "c": (0.01, 10, 0.1)},
}


def search_grid(model: str, fixed: dict[str, float] | None = None, space: dict[str, tuple[float, float, float] | Sequence[float]] | None = None) -> dict[str, np.ndarray]:
    """The candidates of a model as equally long arrays; fixed parameters take one value."""
    axes = {}
    for name, default in SEARCH_SPACES[model].items():
        chosen = (space or {}).get(name, default)
        if fixed and name in fixed:
            axes[name] = np.array([float(fixed[name])])
        elif isinstance(chosen, tuple) and len(chosen) == 3:
            axes[name] = np.round(np.arange(*chosen), 10)
        else:
            axes[name] = np.asarray(chosen, float)
    mesh = np.meshgrid(*axes.values(), indexing="ij")
    return {n: m.ravel() for n, m in zip(axes, mesh)}


@dataclass(frozen=True)
class Grid:
    """Shapes of a model's candidates, made once per task: each spectrum is a factor of its row times a shape.

    A factor that only depends on the row (Nt, Nw and the like) is not part of the grid, so the N(D) of
    all candidates are one scaled matrix and no candidate is evaluated twice.
    """

    model: str
    candidates: dict[str, np.ndarray]
    i: float = 3.0
    j: float = 4.0
    objectives: tuple[Objective, ...] = field(default=DEFAULT_OBJECTIVES)

    def shapes(self, d: np.ndarray, scale_diameter: float | None, rows: slice) -> np.ndarray:
        c = {k: v[rows, None] for k, v in self.candidates.items()}
        x = d[None, :]
        with np.errstate(all="ignore"):
            if self.model == "ExponentialPSD":
                return c["Lambda"] * np.exp(-c["Lambda"] * x)
            if self.model == "GammaPSD":
                log = (c["mu"] + 1) * np.log(c["Lambda"]) - lgamma(c["mu"] + 1) + c["mu"] * np.log(x) - c["Lambda"] * x
                return np.exp(log)
            if self.model == "LognormalPSD":
                return psd.lognormal(x, 1.0, c["mu"], c["sigma"])
            if self.model == "GeneralizedGammaPSD":
                return psd.generalized_gamma(x, 1.0, c["Lambda"], c["mu"], c["c"])
            if self.model == "NormalizedGeneralizedGammaPSD":
                return psd.normalized_generalized_gamma(x, 1.0, scale_diameter, self.i, self.j, c["mu"], c["c"])
            formula = psd.MODELS[self.model].formula
            return formula(x, 1.0, scale_diameter, c["mu"])

    @property
    def scales_with_diameter(self) -> bool:
        return self.model.startswith("Normalized")


def fit_grid(df: DataFrame, model: str, d: np.ndarray, width: np.ndarray, velocity: np.ndarray, nd: str = "drop_number_concentration", keys: Sequence[str] = ("station_id", "time"), objectives: Sequence[Objective] = DEFAULT_OBJECTIVES, fixed: dict[str, float] | None = None, space: dict | None = None, i: float = 3, j: float = 4) -> DataFrame:
    """Parameters of the candidate with the smallest error, one row per input row: keys, parameters, loss.

    Scaling parameters come from the spectrum (Nt, or Nw with D50 or Dm, or Nc and Dc of moments i and j);
    the others are searched. Rows without a valid spectrum, and rows for which every candidate's error is
    NaN, get NaN parameters; of equal errors the first candidate counts.
    """
    if model not in SEARCH_SPACES:
        raise ValueError(f"{model} has no grid search")
    grid = Grid(model, search_grid(model, fixed, space), float(i), float(j), tuple(objectives))
    names = psd.MODELS[model].parameters
    wide = df.select(*keys, sanitized(F.col(nd)).alias("_nd"))
    dcol, wcol = F.array(*[F.lit(float(v)) for v in d]), F.array(*[F.lit(float(v)) for v in width])
    moments = {f"_M{k:g}": S.moment(F.col("_nd"), dcol, wcol, k) for k in {0, 3, 4, i, j}}
    wide = wide.withColumns(moments | {"_D50": S.median_volume_diameter(F.col("_nd"), dcol, wcol)})
    out_schema = ", ".join([f"`{k}` {t}" for k, t in wide.select(*keys).dtypes] + [f"`{n}` double" for n in names] + ["loss double"])
    size = len(next(iter(grid.candidates.values())))

    def search(obs: np.ndarray, concentration: float, diameter: float | None, cache: list[np.ndarray] | None) -> tuple[int, float]:
        errors = []
        for k, a in enumerate(range(0, size, GRID_CHUNK)):
            shape = cache[k] if cache else grid.shapes(d, diameter, slice(a, a + GRID_CHUNK))
            errors.append([objective_error(o, obs / (concentration if o.target == "H(x)" else 1), shape * (1 if o.target == "H(x)" else concentration), d, width, velocity) for o in grid.objectives])
        joined = [np.concatenate(parts) for parts in zip(*errors)]
        if len(joined) > 1:
            error = sum(o.weight * scaled_errors(e) for o, e in zip(grid.objectives, joined)) / sum(o.weight for o in grid.objectives)
        else:
            error = joined[0]
        if np.isnan(error).all():
            return -1, float("nan")
        best = int(np.nanargmin(error))
        return best, float(error[best])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shapes that do not depend on a row are made once; a grid that is too large to keep is made per row.
        cache = None
        if not grid.scales_with_diameter and size * len(d) <= 12_000_000:
            cache = [grid.shapes(d, None, slice(a, a + GRID_CHUNK)) for a in range(0, size, GRID_CHUNK)]
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            spectra = batch.column(batch.schema.get_field_index("_nd")).to_pylist()
            m0, m3, m4, d50 = get("_M0"), get("_M3"), get("_M4"), get("_D50")
            mi, mj = get(f"_M{i:g}"), get(f"_M{j:g}")
            found: dict[str, list[float]] = {n: [] for n in (*names, "loss")}
            for r, obs in enumerate(spectra):
                obs = np.array(obs, float)
                with np.errstate(all="ignore"):
                    nw, dm = 256 / 6 * m3[r] ** 5 / m4[r] ** 4, m4[r] / m3[r]
                    scale = {
                        "NormalizedGammaD50NwPSD": {"Nw": nw, "D50": d50[r]}, "NormalizedGammaDmNwPSD": {"Nw": nw, "Dm": dm}, "NormalizedGammaDmNtPSD": {"Nt": m0[r], "Dm": dm},
                        "NormalizedGeneralizedGammaPSD": {"Nc": psd.scaling_concentration(i, j, mi[r], mj[r]), "Dc": psd.scaling_diameter(i, j, mi[r], mj[r]), "i": i, "j": j},
                    }.get(model, {"Nt": m0[r]})
                first, second = list(scale.values())[0], (list(scale.values())[1] if len(scale) > 1 else None)
                best, loss = (-1, float("nan")) if np.isnan(obs).any() or not np.isfinite(first) else search(obs, float(first), second, cache)
                values = {n: float("nan") for n in names} | {"loss": loss}
                if best >= 0:
                    values |= {k: float(v) for k, v in scale.items() if k in names} | {k: float(v[best]) for k, v in grid.candidates.items() if k in names}
                    if model == "ExponentialPSD":
                        values["N0"] = m0[r] * values["Lambda"]
                    if model == "GammaPSD":
                        values["N0"] = math.exp(math.log(m0[r]) + (values["mu"] + 1) * math.log(values["Lambda"]) - math.lgamma(values["mu"] + 1)) if values["mu"] > -1 and values["Lambda"] > 0 else float("nan")
                for n in found:
                    found[n].append(values[n])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keys], *[pa.array(v, pa.float64()) for v in found.values()]], names=[*keys, *found])

    return wide.mapInArrow(kernel, out_schema)


def fit_normalized_points(x: np.ndarray, normalized: np.ndarray, i: float, j: float, mu: Sequence[float], c: Sequence[float], limits: tuple[float, float] | None = None, transformation: str = "log10", loss: str = "SSE") -> tuple[float, float]:
    """mu and c of one normalised shape through pooled points of bounded number (binned or sampled)."""
    keep = np.isfinite(x) & np.isfinite(normalized) & (normalized > 0) & (x > 0)
    if limits is not None:
        keep &= (x >= limits[0]) & (x <= limits[1])
    x, normalized = x[keep], normalized[keep]
    m, s = (g.ravel() for g in np.meshgrid(mu, c, indexing="ij"))
    best, where = math.inf, (float("nan"), float("nan"))
    for a in range(0, len(m), 500):
        with np.errstate(all="ignore"):
            pred = psd.normalized_generalized_shape(x[None, :], i, j, s[a : a + 500, None], m[a : a + 500, None])
            error = distribution_error(loss, transformed(normalized, transformation), transformed(pred, transformation), np.ones(len(x)))
        error = np.where(np.isfinite(error), error, math.inf)
        if error.min() < best:
            k = int(error.argmin())
            best, where = float(error[k]), (float(m[a + k]), float(s[a + k]))
    return where


# --- maximum likelihood -------------------------------------------------------------------------------------


def gamma_cdf(x: np.ndarray, shape: np.ndarray | float) -> np.ndarray:
    """Regularised lower incomplete gamma function, entry by entry: a series below shape + 1, a continued fraction above."""
    x, shape = np.broadcast_arrays(np.asarray(x, float), np.asarray(shape, float))
    out = np.where(shape > 0, np.where(np.isposinf(x), 1.0, 0.0), np.nan)
    usable = (shape > 0) & (x > 0) & np.isfinite(x)

    def lead(v: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.exp(a * np.log(v) - v - lgamma(a))

    small = usable & (x < shape + 1)
    if small.any():
        v, a = x[small], shape[small]
        term = 1 / a
        total = term.copy()
        for k in range(1, 500):
            term = term * v / (a + k)
            total += term
            if (term < total * 1e-13).all():
                break
        out[small] = total * lead(v, a)
    large = usable & ~small
    if large.any():
        v, a = x[large], shape[large]
        tiny = 1e-300
        b = v + 1 - a
        c, f = np.full_like(v, 1 / tiny), 1 / b
        h = f.copy()
        for k in range(1, 500):
            numerator = -k * (k - a)
            b = b + 2
            f = numerator * f + b
            f = 1 / np.where(np.abs(f) < tiny, tiny, f)
            c = b + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * f
            h = h * step
            if (np.abs(step - 1) < 1e-12).all():
                break
        out[large] = 1 - lead(v, a) * h
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """By the incomplete gamma function of one half."""
    z = np.asarray(z, float)
    half = gamma_cdf(z * z / 2, 0.5) / 2
    return np.where(z >= 0, 0.5 + half, 0.5 - half)


def _cdf(model: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each row of parameters at each x."""
    if model == "GammaPSD":
        return gamma_cdf(x[None, :] / p[:, 1:2], p[:, 0:1])
    if model == "ExponentialPSD":
        return 1 - np.exp(-x[None, :] / p[:, 0:1])
    with np.errstate(divide="ignore"):
        return normal_cdf((np.log(np.maximum(x, 1e-300))[None, :] - p[:, 0:1]) / p[:, 1:2])


def _pdf(model: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    x = x[None, :]
    with np.errstate(all="ignore"):
        if model == "GammaPSD":
            a, scale = p[:, 0:1], p[:, 1:2]
            return np.exp((a - 1) * np.log(x) - x / scale - lgamma(a) - a * np.log(scale))
        if model == "ExponentialPSD":
            return np.exp(-x / p[:, 0:1]) / p[:, 0:1]
        return np.exp(-((np.log(x) - p[:, 0:1]) ** 2) / (2 * p[:, 1:2] ** 2)) / (x * p[:, 1:2] * math.sqrt(2 * math.pi))


def _valid(model: str, p: np.ndarray) -> np.ndarray:
    known = np.isfinite(p).all(axis=1)
    return known & {"GammaPSD": (p[:, 0] > 0.1) & (p[:, -1] > 0), "ExponentialPSD": p[:, 0] > 0, "LognormalPSD": p[:, -1] > 0}[model]


def negative_log_likelihood(model: str, p: np.ndarray, edges: np.ndarray, counts: np.ndarray, probability: str = "cdf", likelihood: str = "multinomial", truncated: bool = True) -> np.ndarray:
    """Of each row of counts under its row of parameters; infinite for parameters out of bounds."""
    out = np.full(len(p), np.inf)
    rows = np.flatnonzero(_valid(model, p))
    if not len(rows):
        return out
    p, counts = p[rows], counts[rows]
    if probability == "cdf":
        share = np.maximum(np.diff(_cdf(model, edges, p), axis=1), 1e-10)
    else:  # midpoints of eight parts of each bin
        parts = (edges[:-1, None] + (np.arange(8)[None, :] + 0.5) / 8 * np.diff(edges)[:, None]).ravel()
        share = np.maximum(_pdf(model, parts, p).reshape(len(p), -1, 8).mean(axis=2) * np.diff(edges), 1e-10)
    if truncated:
        share = share / share.sum(axis=1, keepdims=True)
    if likelihood == "poisson":
        expected = np.maximum(share * counts.sum(axis=1, keepdims=True), 1e-10)
        value = -(counts * np.log(expected) - expected).sum(axis=1)
    else:
        value = -(counts * np.log(share)).sum(axis=1)
    out[rows] = np.where(np.isfinite(value), value, np.inf)
    return out


def nelder_mead(f, start: np.ndarray, tolerance: float = 1e-4, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Downhill simplex on many problems at once: ``f(rows, points)`` gives values of points of the given problems.

    Returns the best point of each and whether it converged. All problems step together; those that have
    converged drop out.
    """
    n_rows, n = start.shape
    points = np.repeat(start[:, None, :], n + 1, axis=1)
    for k in range(n):
        points[:, k + 1, k] = np.where(start[:, k] != 0, start[:, k] * 1.05, 0.00025)
    every = np.arange(n_rows)
    values = np.stack([f(every, points[:, k]) for k in range(n + 1)], axis=1)
    active, done = every, np.zeros(n_rows, bool)
    for _ in range(most * n):
        order = np.argsort(values[active], axis=1, kind="stable")
        points[active] = np.take_along_axis(points[active], order[:, :, None], axis=1)
        values[active] = np.take_along_axis(values[active], order, axis=1)
        p, v = points[active], values[active]
        with np.errstate(invalid="ignore"):
            close = (np.abs(p[:, 1:] - p[:, :1]).max(axis=(1, 2)) <= tolerance) & (v[:, -1] - v[:, 0] <= tolerance)
        done[active[close]] = True
        active, p, v = active[~close], p[~close], v[~close]
        if not len(active):
            break
        centre = p[:, :-1].mean(axis=1)
        away = centre - p[:, -1]
        reflected = centre + away
        fr = f(active, reflected)
        new, fn = reflected.copy(), fr.copy()
        grow = fr < v[:, 0]
        if grow.any():
            expanded = centre[grow] + 2 * away[grow]
            fe = f(active[grow], expanded)
            better = fe < fr[grow]
            new[grow], fn[grow] = np.where(better[:, None], expanded, reflected[grow]), np.where(better, fe, fr[grow])
        poor = fr >= v[:, -2]
        shrink = np.zeros(len(active), bool)
        if poor.any():
            outside = (fr < v[:, -1])[poor]
            inner = centre[poor] + 0.5 * np.where(outside[:, None], away[poor], -away[poor])
            fi = f(active[poor], inner)
            works = fi < np.minimum(fr[poor], v[poor, -1])
            new[poor], fn[poor] = np.where(works[:, None], inner, new[poor]), np.where(works, fi, fn[poor])
            shrink[np.flatnonzero(poor)[~works]] = True
        keep = ~shrink
        points[active[keep], -1], values[active[keep], -1] = new[keep], fn[keep]
        if shrink.any():
            rows = active[shrink]
            points[rows] = points[rows, :1] + 0.5 * (points[rows] - points[rows, :1])
            for k in range(1, n + 1):
                values[rows, k] = f(rows, points[rows, k])
    best = values.argmin(axis=1)
    return points[every, best], done


def _fit_rows(model: str, counts: np.ndarray, edges: np.ndarray, start: np.ndarray, probability: str, likelihood: str, truncated: bool) -> dict[str, np.ndarray]:
    """Parameters of each row of counts; NaN for rows without counts and fits that do not converge."""
    names = psd.MODELS[model].parameters
    out = {n: np.full(len(counts), np.nan) for n in names}
    with np.errstate(invalid="ignore"):
        usable = np.flatnonzero(np.isfinite(counts).all(axis=1) & (np.nan_to_num(counts).sum(axis=1) > 0) & _valid(model, start))
    if not len(usable):
        return out
    counts = counts[usable]
    p, converged = nelder_mead(lambda rows, q: negative_log_likelihood(model, q, edges, counts[rows], probability, likelihood, truncated), start[usable])
    p, counts, usable = p[converged], counts[converged], usable[converged]
    if not len(usable):
        return out
    nt = counts.sum(axis=1)
    with np.errstate(all="ignore"):
        if truncated:  # the mass that the bins do not cover
            seen = np.diff(_cdf(model, edges[[0, -1]], p), axis=1)[:, 0]
            nt = np.where(seen > 1e-12, nt / seen, np.nan)
        if model == "LognormalPSD":
            found = {"Nt": nt, "mu": p[:, 0], "sigma": p[:, 1]}
        elif model == "ExponentialPSD":
            found = {"N0": nt / p[:, 0], "Lambda": 1 / p[:, 0]}
        else:
            mu, slope = p[:, 0] - 1, 1 / p[:, 1]
            found = {"N0": np.exp(np.log(nt) + (mu + 1) * np.log(slope) - lgamma(mu + 1)), "mu": mu, "Lambda": slope}
        sound = np.logical_and.reduce([np.isfinite(v) for v in found.values()])
    for n in names:
        out[n][usable] = np.where(sound, found[n], np.nan)
    return out


def fit_likelihood(df: DataFrame, model: str, lower: np.ndarray, upper: np.ndarray, nd: str = "drop_number_concentration", keys: Sequence[str] = ("station_id", "time"), init_method: str | None = None, probability: str = "cdf", likelihood: str = "multinomial", truncated: bool = True) -> DataFrame:
    """Maximum likelihood parameters, one row per input row: keys, parameters.

    Counts are N(D) times bin width. The start is fixed, or by ``init_method`` from moments. Rows without
    a valid spectrum, and fits that do not converge, get NaN.
    """
    if model not in moments_fit.METHODS:
        raise ValueError(f"{model} has no likelihood fit")
    if init_method is not None and init_method not in moments_fit.METHODS[model]:
        raise ValueError(f"{init_method} is no method of moments of {model}")
    names = psd.MODELS[model].parameters
    edges, d, width = np.append(lower, upper[-1]), (np.asarray(lower) + np.asarray(upper)) / 2, np.asarray(upper) - np.asarray(lower)
    wide = df.select(*keys, sanitized(F.col(nd)).alias("_nd"))
    out_schema = ", ".join([f"`{k}` {t}" for k, t in wide.select(*keys).dtypes] + [f"`{n}` double" for n in names])

    fixed = np.array({"GammaPSD": (1.0, 1.0), "ExponentialPSD": (1.0,), "LognormalPSD": (0.0, 1.0)}[model])

    def starts(spectra: np.ndarray) -> np.ndarray:
        out = np.repeat(fixed[None, :], len(spectra), axis=0)
        if init_method is None:
            return out
        orders, method = moments_fit.METHODS[model][init_method]
        with np.errstate(all="ignore"):
            found = dict(zip(moments_fit.PARAMETERS[model], method(*[np.atleast_1d((spectra * d**k * width).sum(axis=1)) for k in orders])))
            start = {"GammaPSD": lambda: (found["mu"] + 1, 1 / found["Lambda"]), "ExponentialPSD": lambda: (1 / found["Lambda"],), "LognormalPSD": lambda: (found["mu"], np.sqrt(np.abs(found["sigma"])))}[model]()
        start = np.stack([np.atleast_1d(x) for x in start], axis=1)
        return np.where(_valid(model, start)[:, None], start, out)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("_nd")).to_pylist()
            spectra = np.array([x if x is not None and len(x) == len(d) else [math.nan] * len(d) for x in lists], float)
            found = _fit_rows(model, spectra * width, edges, starts(spectra), probability, likelihood, truncated)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keys], *[pa.array(found[n], pa.float64()) for n in names]], names=[*keys, *names])

    return wide.mapInArrow(kernel, out_schema)


def estimate(df: DataFrame, model: str, optimization: str, d: np.ndarray, width: np.ndarray, velocity: np.ndarray, keys: Sequence[str] = ("station_id", "time"), **settings: Any) -> DataFrame:
    """Parameters by moments ("MOM"), likelihood ("ML") or grid search ("GS")."""
    if optimization == "MOM":
        dcol, wcol = F.array(*[F.lit(float(v)) for v in d]), F.array(*[F.lit(float(v)) for v in width])
        return fit_moments(df, model, diameter=dcol, width=wcol, keep=keys, **settings)
    if optimization == "ML":
        return fit_likelihood(df, model, d - width / 2, d + width / 2, keys=keys, **settings)
    if optimization == "GS":
        return fit_grid(df, model, d, width, velocity, keys=keys, **settings)
    raise ValueError(f"{optimization} is no way to fit; known are MOM, ML, GS")
