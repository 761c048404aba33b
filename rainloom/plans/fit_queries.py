"""Named queries of grid searches with the default candidates, each against SQL that scores every candidate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rainloom.operators import fitting
from rainloom.operators.fitting import Objective
from rainloom.plans.reference_queries import _BINS, _LONG, _W, N_BINS, _spectra, query

#: Spectra, their number of drops, and for every candidate slope the fitted values, small ones as 0.
_CANDIDATES = f"""WITH {_LONG}, t AS (SELECT vec_id, sum(nd * {_W}) AS nt, sum(nd) AS total FROM s GROUP BY vec_id), g AS (SELECT l / 100.0 AS l FROM range(1, 1000) r(l)),
    x AS (SELECT g.l, b.i, b.d, g.l * exp(-g.l * b.d) AS shape FROM g, b),
    c AS (SELECT s.vec_id, x.l, s.i, s.d, s.nd AS o, CASE WHEN nt * shape < 1e-3 THEN 0 ELSE nt * shape END AS q, s.nd * {_W} / (total * {_W} + 1e-12) AS p FROM s JOIN t ON s.vec_id = t.vec_id JOIN x ON x.i = s.i)"""


def _slopes(spark, sf_dir, objectives: dict[str, Objective]):
    spectra = _spectra(spark, sf_dir)
    out = spectra.select("vec_id")
    for name, objective in objectives.items():
        found = fitting.fit_grid(spectra, "ExponentialPSD", _BINS.center, _BINS.width, np.ones(N_BINS), "nd", ("vec_id",), (objective,))
        out = out.join(found.select("vec_id", F.round("Lambda", 6).alias(name)), "vec_id")
    return out


@query(
    f"""{_CANDIDATES}, e AS (SELECT vec_id, l, sum(abs(o - q)) AS sae, avg(abs(o - q)) AS mae, avg(abs(o - q) / (o + 1e-12)) AS relmae, sqrt(avg(pow(o - q, 2))) AS rmse, sum(pow(log10(o + 1) - log10(q + 1), 2)) AS sse_log,
        abs(10 * log10(sum(o * pow(d, 6) * {_W})) - 10 * log10(sum(q * pow(d, 6) * {_W}))) AS z, pow(sum(o * pow(d, 3)) - sum(q * pow(d, 3)), 2) AS lwc FROM c GROUP BY 1, 2)
    SELECT vec_id, round(arg_min(l, sae), 6) AS sae, round(arg_min(l, mae), 6) AS mae, round(arg_min(l, relmae), 6) AS relmae, round(arg_min(l, rmse), 6) AS rmse, round(arg_min(l, sse_log), 6) AS sse_log, round(arg_min(l, z), 6) AS z, round(arg_min(l, lwc), 6) AS lwc FROM e GROUP BY vec_id"""
)
def gs_errors(spark, sf_dir):
    wanted = {"sae": Objective("N(D)", "SAE"), "mae": Objective("N(D)", "MAE"), "relmae": Objective("N(D)", "relMAE"), "rmse": Objective("N(D)", "RMSE"), "sse_log": Objective("N(D)", "SSE", "log10"), "z": Objective("Z", "AE"), "lwc": Objective("LWC", "SE")}
    return _slopes(spark, sf_dir, wanted)


@query(
    f"""{_CANDIDATES}, w AS (SELECT vec_id, l, sum(q) AS total FROM c GROUP BY 1, 2), y AS (SELECT c.vec_id, c.l, c.i, c.p, c.q * {_W} / (w.total * {_W} + 1e-12) AS q FROM c JOIN w ON c.vec_id = w.vec_id AND c.l = w.l),
    e AS (SELECT vec_id, l, greatest(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-12)) ELSE 0 END), 0) AS kl,
        sqrt((greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END), 0) + greatest(sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) / 2) AS js FROM y GROUP BY 1, 2)
    SELECT vec_id, round(arg_min(l, kl), 6) AS kl, round(arg_min(l, js), 6) AS js FROM e GROUP BY vec_id"""
)
def gs_divergences(spark, sf_dir):
    return _slopes(spark, sf_dir, {"kl": Objective("N(D)", "KLDiv"), "js": Objective("N(D)", "JSD")})


@query(
    f"""{_CANDIDATES}, w AS (SELECT vec_id, l, sum(q) AS total FROM c GROUP BY 1, 2), y AS (SELECT c.vec_id, c.l, c.i, c.p - c.q * {_W} / (w.total * {_W} + 1e-12) AS off FROM c JOIN w ON c.vec_id = w.vec_id AND c.l = w.l),
    k AS (SELECT vec_id, l, abs(sum(off) OVER (PARTITION BY vec_id, l ORDER BY i ROWS UNBOUNDED PRECEDING)) AS gap FROM y), e AS (SELECT vec_id, l, sum(gap) AS wd, max(gap) AS ks FROM k GROUP BY 1, 2)
    SELECT vec_id, round(arg_min(l, wd), 6) AS wd, round(arg_min(l, ks), 6) AS ks FROM e GROUP BY vec_id"""
)
def gs_distances(spark, sf_dir):
    return _slopes(spark, sf_dir, {"wd": Objective("N(D)", "WD"), "ks": Objective("N(D)", "KS")})


@query(
    f"""WITH {_LONG}, t AS (SELECT vec_id, sum(nd * {_W}) AS nt FROM s GROUP BY vec_id), m AS (SELECT i / 40.0 - 1.5 AS mu FROM range(0, 100) r(i)), w AS (SELECT i / 100.0 AS sg FROM range(1, 100) r(i)),
    x AS (SELECT mu, sg, b.i, exp(-pow(ln(b.d) - mu, 2) / (2 * sg * sg)) / (sqrt(2 * pi()) * sg * b.d) AS shape FROM m, w, b),
    o AS (SELECT s.vec_id, s.i, s.nd, t.nt FROM s JOIN t ON s.vec_id = t.vec_id),
    e AS (SELECT o.vec_id, x.mu, x.sg, sum(pow(nd - CASE WHEN nt * shape < 1e-3 THEN 0 ELSE nt * shape END, 2)) AS loss FROM o JOIN x ON x.i = o.i GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY loss, mu, sg) AS k FROM e) SELECT vec_id, round(mu, 6) AS mu, round(sg, 6) AS sigma FROM k WHERE k = 1"""
)
def gs_lognormal(spark, sf_dir):
    out = fitting.fit_grid(_spectra(spark, sf_dir), "LognormalPSD", _BINS.center, _BINS.width, np.ones(N_BINS), "nd", ("vec_id",), (Objective(),))
    return out.select("vec_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(
    f"""WITH {_LONG}, t AS (SELECT vec_id, sum(pow(d, 4) * nd) / sum(pow(d, 3) * nd) AS dm, 256 / 6.0 * pow(sum(pow(d, 3) * nd * {_W}), 5) / pow(sum(pow(d, 4) * nd * {_W}), 4) AS nw FROM s GROUP BY vec_id), m AS (SELECT i / 100.0 - 1 AS mu FROM range(0, 3100) r(i)),
    f AS (SELECT mu, 6 / 256.0 * exp((mu + 4) * ln(mu + 4) - lgamma(mu + 4)) AS lead FROM m),
    e AS (SELECT s.vec_id, f.mu, sum(pow(s.nd - CASE WHEN nw * lead * exp(mu * ln(s.d / dm) - (mu + 4) * s.d / dm) < 1e-3 THEN 0 ELSE nw * lead * exp(mu * ln(s.d / dm) - (mu + 4) * s.d / dm) END, 2)) AS loss FROM s JOIN t ON s.vec_id = t.vec_id, f GROUP BY 1, 2)
    SELECT vec_id, round(arg_min(mu, loss), 6) AS mu FROM e GROUP BY vec_id"""
)
def gs_normalized_gamma(spark, sf_dir):
    out = fitting.fit_grid(_spectra(spark, sf_dir), "NormalizedGammaDmNwPSD", _BINS.center, _BINS.width, np.ones(N_BINS), "nd", ("vec_id",), (Objective(),))
    return out.select("vec_id", F.round("mu", 6).alias("mu"))
