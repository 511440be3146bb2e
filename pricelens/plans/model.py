"""The scoring model of the scenario and validation queries, fitted on the feature table.

Spark: two Gram aggregations (OLS of the funding ratio, 2SLS of the price), written as a seven-row stage table.
DuckDB: the same normal equations by the sweep operator over a one-row covariance table. Coefficients are kept to
nine significant digits, so both engines score with the same bits whatever order their sums ran in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from pricelens.operators import linear as L
from pricelens.operators.bundle import Bundle
from pricelens.operators.quantile_trees import QuantileModel, fit_quantiles
from pricelens.operators.scenario import ScoringModel
from pricelens.plans.common import features, staged

# The causal roles of the configuration (features, instruments, confounders, target).
FEATURES = ["avg_reward_price", "goal_ambition", "campaign_duration_days", "trend_index", "concurrent_campaigns"]
INSTRUMENTS = ["is_weekend_launch", "holiday_proximity", "trend_spike"]
CONFOUNDERS = ["competition_intensity", "creator_experience_proxy"]
TARGET = "funding_ratio"
TREATMENT = "avg_reward_price"
CONTROLS = [c for c in FEATURES if c != TREATMENT]


def fit_model(f) -> ScoringModel:
    """OLS on all features (M2) and the 2SLS price effect (M3), coefficients at nine significant digits."""
    fit = L.ols(L.fit_gram(f, FEATURES + [TARGET]), TARGET, FEATURES)
    gr = L.fit_gram(f, [TREATMENT] + CONTROLS + INSTRUMENTS + [TARGET])
    iv = L.tsls(gr, TARGET, TREATMENT, INSTRUMENTS, CONTROLS)
    return ScoringModel.from_fit(fit, iv.effect).rounded(9)


def fitted_model(spark: SparkSession, sf_dir: str) -> ScoringModel:
    """The model of these tables; fitted once, then read back from its stage table (seven rows)."""
    def build():
        m = fit_model(features(spark, sf_dir))
        rows = [("intercept", m.intercept), ("tsls", m.tsls_coef), *m.coefs.items()]
        return spark.createDataFrame(rows, "term string, value double").coalesce(1)
    c = {r["term"]: r["value"] for r in staged(spark, sf_dir, "model", build).collect()}
    return ScoringModel(c.pop("intercept"), {n: c[n] for n in FEATURES}, c.pop("tsls"), list(FEATURES))


# Quantiles, rounds and depth of the configuration's quantile model.
QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
ROUNDS, DEPTH, RATE = 100, 6, 0.1


def quantile_model(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS, depth: int = DEPTH) -> QuantileModel:
    """The quantile model of these tables (M12); fitted once, then read back from its stage table of trees."""
    def build():
        return fit_quantiles(features(spark, sf_dir), FEATURES, TARGET, QUANTILES, rounds, depth, RATE).table(spark).coalesce(1)
    trees = staged(spark, sf_dir, f"quantile-trees-{rounds}-{depth}", build)
    return QuantileModel.from_table(trees, FEATURES, QUANTILES, rounds, depth, RATE)


def fit_bundle(f, forest, quantiles: QuantileModel) -> Bundle:
    """The whole predictor of a feature table: scaler, OLS and 2SLS from two Gram aggregations, with the given effect
    forest (on the controls) and quantile model."""
    gr = L.fit_gram(f, FEATURES + [TARGET])
    iv_gr = L.fit_gram(f, [TREATMENT] + CONTROLS + INSTRUMENTS + [TARGET])
    iv = L.tsls(iv_gr, TARGET, TREATMENT, INSTRUMENTS, CONTROLS)
    scaler = {c: (float(gr.mean[i]), float(gr.sd[i]) or 1.0) for i, c in enumerate(FEATURES)}
    linear = ScoringModel.from_fit(L.ols(gr, TARGET, FEATURES), iv.effect)
    tsls = ScoringModel(float(iv.intercept), {n: float(b) for n, b in zip(iv.names, iv.coef)}, float(iv.effect), list(iv.names))
    return Bundle(list(FEATURES), TREATMENT, TARGET, scaler, linear, tsls, list(CONTROLS), forest, quantiles)


# --- the same estimators as DuckDB text ------------------------------------------------------------

def gram_sql(name: str, source: str, cols: Sequence[str], group: str | None = None) -> str:
    """CTE ``name``: per group the row count n, the means m_i and the centred cross products a_i_j of complete rows."""
    p = range(len(cols))
    x = [f"CAST({c} AS DOUBLE)" for c in cols]
    sums = [f"avg({x[i]}) AS m_{i}" for i in p]
    sums += [f"count(*) * covar_pop({x[i]}, {x[j]}) AS a_{i}_{j}" for i in p for j in p]
    key = f"{group}, " if group else ""
    return (f"{name} AS (SELECT {key}count(*) AS n, {', '.join(sums)} FROM {source} WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in cols) + (f" GROUP BY {group}" if group else "") + ")")


def sweep_sql(source: str, size: int, pivots: Sequence[int], tag: str) -> tuple[str, str]:
    """CTEs that sweep ``pivots`` one after the other: afterwards a_i_y holds slopes, a_y_y the residual sum of
    squares and a_i_i the diagonal of the inverse. A pivot without variance of its own is left out.
    Returns (CTE text, name of the last one)."""
    out, prev = [], source
    for k in pivots:
        cur = f"{tag}_{k}"
        d = f"(CASE WHEN a_{k}_{k} > 1e-10::DOUBLE * o_{k} THEN 1.0::DOUBLE / a_{k}_{k} ELSE 0.0::DOUBLE END)"
        cols = []
        for i in range(size):
            for j in range(size):
                if i == k and j == k:
                    e = d
                elif i == k:
                    e = f"a_{k}_{j} * {d}"
                elif j == k:
                    e = f"-a_{i}_{k} * {d}"
                else:
                    e = f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} * {d}"
                cols.append(f"{e} AS a_{i}_{j}")
        first = prev == source
        base = f"(SELECT *, {', '.join(f'a_{i}_{i} AS o_{i}' for i in range(size))} FROM {source})" if first else prev
        out.append(f"{cur} AS (SELECT * REPLACE ({', '.join(cols)}) FROM {base})")
        prev = cur
    return ",\n".join(out), prev


def ols_sql(tag: str, source: str, y: str = TARGET, xs: Sequence[str] = FEATURES, group: str | None = None) -> str:
    """CTE ``tag``: n, k0 (intercept), b_<x>, inverse diagonals v_<x>, ssr and sst of an OLS fit, per group."""
    k = len(xs)
    sweep, last = sweep_sql(f"{tag}_g", k + 1, range(k), f"{tag}_s")
    b0 = f"m_{k}" + "".join(f" - a_{i}_{k} * m_{i}" for i in range(k))
    cols = [f"{b0} AS k0"] + [f"a_{i}_{k} AS b_{x}" for i, x in enumerate(xs)]
    cols += [f"a_{i}_{i} AS v_{x}" for i, x in enumerate(xs)] + [f"sqrt(o_{i} / n) AS sd_{x}" for i, x in enumerate(xs)]
    cols += [f"a_{k}_{k} AS ssr", f"o_{k} AS sst", "n"] + ([group] if group else [])
    return f"{gram_sql(f'{tag}_g', source, [*xs, y], group)},\n{sweep},\n{tag} AS (SELECT {', '.join(cols)} FROM {last})"


def tsls_sql(tag: str, source: str) -> str:
    """CTE ``tag``: 2SLS effect and first-stage sums. Sweeping the controls, then the instruments, out of the
    covariances of price (t) and outcome (y) leaves the part of each that the instruments explain."""
    cols = [*CONTROLS, *INSTRUMENTS, TREATMENT, TARGET]
    w, z = len(CONTROLS), len(INSTRUMENTS)
    t, y = w + z, w + z + 1
    s1, l1 = sweep_sql(f"{tag}_g", len(cols), range(w), f"{tag}_w")
    s2, l2 = sweep_sql(l1, len(cols), range(w, w + z), f"{tag}_z")
    s2 = s2.replace(f"(SELECT *, {', '.join(f'a_{i}_{i} AS o_{i}' for i in range(len(cols)))} FROM {l1})", l1)
    used = " + ".join(f"CASE WHEN o_{i} > 0 THEN 1 ELSE 0 END" for i in range(w, w + z))
    unused = ", ".join(f"CASE WHEN b.o_{w + i} = 0 THEN '{c}' END" for i, c in enumerate(INSTRUMENTS))
    names = ", ".join(f"CASE WHEN b.o_{w + i} > 0 THEN '{c}' END" for i, c in enumerate(INSTRUMENTS))
    return (f"{gram_sql(f'{tag}_g', source, cols)},\n{s1},\n{s2},\n{tag} AS (SELECT (a.a_{t}_{y} - b.a_{t}_{y}) / "
            f"(a.a_{t}_{t} - b.a_{t}_{t}) AS effect, 1.0::DOUBLE - b.a_{t}_{t} / b.o_{t} AS r2_first, b.n AS n, "
            f"a.a_{t}_{t} - b.a_{t}_{t} AS explained, b.a_{t}_{t} AS ssr_first, "
            f"a.a_{y}_{y} AS ssr_controls, b.o_{y} AS sst_y, concat_ws(',', {unused}) AS dropped, "
            f"{used.replace('o_', 'b.o_')} AS k_iv, concat_ws(',', {names}) AS instruments FROM {l1} a, {l2} b)")


def t_two_sided_sql(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t: Simpson's rule over the density from 0 to |t| (beyond 40 nothing is left)."""
    n = 4000
    top, d = f"least(abs({t}), 40.0::DOUBLE)", f"CAST({dof} AS DOUBLE)"
    weight = f"(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    density = f"exp(lgamma(({d} + 1) / 2) - lgamma({d} / 2)) / sqrt({d} * pi()) * pow(1 + pow(i * {top} / {n}, 2) / {d}, -({d} + 1) / 2)"
    return f"greatest(0.0::DOUBLE, 1 - 2 * {top} / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * {density})))"


def sig9(x: str) -> str:
    return f"CAST(format('{{:.8e}}', {x}) AS DOUBLE)"


#: `_model`: one row of coefficients; `fm`: the feature rows with them alongside.
MODEL_SQL = f"""
{ols_sql('_ols', 'features')},
{tsls_sql('_iv', 'features')},
_model AS (SELECT {sig9('k0')} AS k_intercept, {', '.join(f"{sig9(f'b_{c}')} AS k_{c}" for c in FEATURES)},
                  {sig9('effect')} AS k_tsls FROM _ols, _iv),
fm AS (SELECT f.*, k.* FROM features f CROSS JOIN _model k)"""


def predict_sql(values: dict) -> str:
    """The fitted predictor over feature expressions, in the operation order of ``ScoringModel.predict``."""
    out = "k_intercept"
    for name in FEATURES:
        out = f"({out} + k_{name} * CAST({values.get(name, '0.0')} AS DOUBLE))"
    return out
