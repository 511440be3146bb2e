"""Validation queries V1-V15."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from pricelens.functions.exprs import hash_unit, r6, round_to, safe_div
from pricelens.operators import linear as L
from pricelens.operators import ranking as rk
from pricelens.operators import validate as va
from pricelens.operators.aggregates import pooled_ttest, t_two_sided_p
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import features
from pricelens.plans.model import CONTROLS, FEATURES, INSTRUMENTS, MODEL_SQL, TARGET, TREATMENT, fitted_model, ols_sql, predict_sql, t_two_sided_sql, tsls_sql
from pricelens.plans.q_window import PAIRS_SQL, pairs_df
from pricelens.plans.q_model import s9, v10_cv_summary
from pricelens.plans.registry import ORACLES, query
from pricelens.plans.sql import nz, with_views
from pricelens.plans.sql import r6 as s6

UNCERTAINTY = 0.3
PLACEBO_THRESHOLD = 0.01


def _vals_sql(scale=None, overrides=None):
    v = {c: (f"(coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) * {scale!r}::DOUBLE)" if scale
             else f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE)") for c in FEATURES}
    v.update(overrides or {})
    return v


PRED_SQL = predict_sql(_vals_sql())


def _fsql(body, *ctes):
    return with_views(body, *ctes, level="features")


def _msql(body, *ctes):
    """Over the feature rows with the fitted coefficients alongside (``fm``)."""
    return _fsql(body, *ctes, MODEL_SQL)


# --- V1 -----------------------------------------------------------------------------------------

_V1_CTE = f"""
, _pe AS (
  SELECT p.campaign_1_id, p.campaign_2_id,
         {predict_sql(_vals_sql(overrides={'avg_reward_price': '(f.avg_reward_price * (1.0::DOUBLE + p.price_change_pct / 100))'}))
          .replace('coalesce(CAST(goal_ambition', 'coalesce(CAST(f.goal_ambition')
          .replace('coalesce(CAST(campaign_duration_days', 'coalesce(CAST(f.campaign_duration_days')
          .replace('coalesce(CAST(trend_index', 'coalesce(CAST(f.trend_index')
          .replace('coalesce(CAST(concurrent_campaigns', 'coalesce(CAST(f.concurrent_campaigns')} AS predicted,
         p.outcome_2 AS actual
  FROM pairs p JOIN fm f ON p.campaign_1_id = f.project_id
),
_er AS (SELECT *, abs(predicted - actual) AS error FROM _pe WHERE abs(predicted - actual) IS NOT NULL)"""


@query("v1_pair_errors", _msql(_V1_CTE + f"""
SELECT count(*) AS n_pairs, {s6('avg(error)')} AS mae, {s6('sqrt(avg(error * error))')} AS rmse,
       {s6('median(error)')} AS median_error, {s6('quantile_cont(error, 0.25)')} AS p25,
       {s6('quantile_cont(error, 0.5)')} AS p50, {s6('quantile_cont(error, 0.75)')} AS p75,
       {s6('quantile_cont(error, 0.9)')} AS p90
FROM _er""", PAIRS_SQL))
def v1_pair_errors(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    errs = va.pair_errors(pairs_df(spark, sf_dir), features(spark, sf_dir), m)
    return va.error_summary(errs)


# --- V2 / V3 -------------------------------------------------------------------------------------

@query("v2_changers", _msql(f"""
, _t AS (SELECT funding_ratio AS y, {PRED_SQL} AS yhat FROM fm ORDER BY price_spread DESC, project_id LIMIT 10)
SELECT count(*) AS n_samples, {s6('avg(abs(y - yhat))')} AS mae, {s6('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
       CASE WHEN avg(abs(y - yhat)) < 1.0 THEN 'PASSED' ELSE 'WARNING' END AS status FROM _t"""))
def v2_changers(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    top = rk.top_n(features(spark, sf_dir), "price_spread", 10)
    t = top.select(F.col(TARGET).alias("y"), m.predict(va.model_values(m.features)).alias("yhat"))
    mae = F.avg(F.abs(F.col("y") - F.col("yhat")))
    return t.agg(F.count(F.lit(1)).alias("n_samples"), r6(mae).alias("mae"),
                 r6(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2))).alias("rmse"), va.status(mae < 1.0).alias("status"))


_V3_PRED_MIN = predict_sql(_vals_sql(overrides={"avg_reward_price": "min_reward_price"}))


@query("v3_min_price", _msql(f"""
, _t AS (SELECT project_id, funding_ratio AS y, {PRED_SQL} AS pred_now, {_V3_PRED_MIN} AS pred_min,
                min_reward_price - avg_reward_price AS price_change
         FROM fm ORDER BY price_spread / {nz('avg_reward_price')} DESC, project_id LIMIT 10)
SELECT project_id, {s6('abs(y - pred_now)')} AS error, {s6('pred_min - pred_now')} AS effect,
       {s6('price_change')} AS price_change,
       {s6('avg(abs(y - pred_now)) OVER ()')} AS mae, {s6('median(abs(y - pred_now)) OVER ()')} AS median_error,
       {s6('quantile_cont(abs(y - pred_now), 0.9) OVER ()')} AS p90_error
FROM _t"""))
def v3_min_price(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    f = features(spark, sf_dir).withColumn("price_variation", safe_div("price_spread", "avg_reward_price"))
    top = rk.top_n(f, "price_variation", 10)
    now = m.predict(va.model_values(m.features))
    at_min = m.predict(va.model_values(m.features, overrides={"avg_reward_price": F.col("min_reward_price").cast("double")}))
    t = top.select("project_id", F.abs(F.col(TARGET) - now).alias("err"), (at_min - now).alias("eff"),
                   (F.col("min_reward_price") - F.col("avg_reward_price")).alias("chg"))
    q = exact_percentiles(t, "err", [0.5, 0.9], names=["m", "p"]).select(F.struct("m", "p")).scalar()
    mae = t.select(F.avg("err")).scalar()
    return t.select("project_id", r6("err").alias("error"), r6("eff").alias("effect"), r6("chg").alias("price_change"),
                    r6(mae).alias("mae"), r6(q["m"]).alias("median_error"), r6(q["p"]).alias("p90_error"))


# --- V4-V6 placebo ------------------------------------------------------------------------------

_PRED_SCALED = predict_sql(_vals_sql(scale=1.001))


def _noise_sql():
    # Box-Muller from two id hashes: N(0, 0.01)
    u1 = "(((((project_id + 11) % 2147483648) * 2654435761) % 4294967296) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    u2 = "(((((project_id + 12) % 2147483648) * 2654435761) % 4294967296) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"(0.01::DOUBLE * sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * {u2}))"


_PRED_NOISE = predict_sql(_vals_sql(overrides={"avg_reward_price": f"(coalesce(CAST(avg_reward_price AS DOUBLE), 0.0::DOUBLE) * (1.0::DOUBLE + {_noise_sql()}))"}))


@query("v4_v6_placebo", _msql(f"""
, _b AS (SELECT abs({_PRED_SCALED} - {PRED_SQL}) AS d FROM fm ORDER BY price_spread ASC, project_id LIMIT 50),
_a AS (SELECT abs({PRED_SQL} - funding_ratio) AS d FROM fm
       ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 50),
_c0 AS (SELECT * FROM fm ORDER BY price_spread ASC, project_id LIMIT 100),
_c AS (SELECT abs({_PRED_NOISE} - {PRED_SQL}) AS d FROM _c0
       ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 50)
SELECT 'placebo_scaled' AS test, count(*) AS n, {s6('avg(d)')} AS mean_effect, {s6('stddev_pop(d)')} AS std_effect,
       {s6('max(d)')} AS max_effect, {s6('quantile_cont(d, 0.95)')} AS p95_effect,
       CASE WHEN avg(d) < {PLACEBO_THRESHOLD} THEN 'PASSED' ELSE 'FAILED' END AS status FROM _b
UNION ALL
SELECT 'placebo_zero_change', count(*), {s6('avg(d)')}, {s6('stddev_pop(d)')}, {s6('max(d)')},
       {s6('quantile_cont(d, 0.95)')}, CASE WHEN avg(d) < 0.5 THEN 'PASSED' ELSE 'FAILED' END FROM _a
UNION ALL
SELECT 'placebo_price_noise', count(*), {s6('avg(d)')}, {s6('stddev_pop(d)')}, {s6('max(d)')},
       {s6('quantile_cont(d, 0.95)')}, CASE WHEN avg(d) < {PLACEBO_THRESHOLD} THEN 'PASSED' ELSE 'FAILED' END FROM _c"""))
def v4_v6_placebo(spark, sf_dir):
    m = fitted_model(spark, sf_dir)
    f = features(spark, sf_dir)
    base = m.predict(va.model_values(m.features))

    def summary(d, name, threshold):
        q = exact_percentiles(d, "d", [0.95], names=["p"]).select("p").scalar()
        m = F.avg("d")
        return d.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("n"), r6(m).alias("mean_effect"),
                     r6(F.stddev_pop("d")).alias("std_effect"), r6(F.max("d")).alias("max_effect"),
                     r6(q).alias("p95_effect"), va.status(m < threshold, "PASSED", "FAILED").alias("status"))
    b = rk.top_n(f, "price_spread", 50, largest=False).select(
        F.abs(m.predict(va.model_values(m.features, scale=1.001)) - base).alias("d"))
    a = rk.hash_sample(f, 50).select(F.abs(base - F.col(TARGET)).alias("d"))
    u1 = (hash_unit("project_id", 11) + 0.5) / 4294967296.0
    u2 = (hash_unit("project_id", 12) + 0.5) / 4294967296.0
    noise = F.lit(0.01) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.lit(np.pi) * u2)
    noisy_price = F.coalesce(F.col("avg_reward_price").cast("double"), F.lit(0.0)) * (F.lit(1.0) + noise)
    c = rk.hash_sample(rk.top_n(f, "price_spread", 100, largest=False), 50).select(
        F.abs(m.predict(va.model_values(m.features, overrides={"avg_reward_price": noisy_price})) - base).alias("d"))
    return reduce(lambda x, y: x.unionByName(y), [summary(b, "placebo_scaled", PLACEBO_THRESHOLD),
                                                  summary(a, "placebo_zero_change", 0.5),
                                                  summary(c, "placebo_price_noise", PLACEBO_THRESHOLD)])


# --- V7-V9 bounds -----------------------------------------------------------------------------------

_U = "0.3::DOUBLE"
_Z = "0.0::DOUBLE"
_TEN = "10.0::DOUBLE"
_K = "k_tsls"
_IN1 = f"CASE WHEN yhat >= y - {_U} AND yhat <= y + {_U} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_IN2 = (f"CASE WHEN yhat >= y + {_K} * price - {_U} AND yhat <= y + {_K} * price + {_U} "
        f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


@query("v7_v9_bounds", _msql(f"""
, _s AS (SELECT funding_ratio AS y, {PRED_SQL} AS yhat, avg_reward_price AS price, k_tsls FROM fm
         ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 100)
SELECT 'bounds_observed' AS test, count(*) AS n, {s6(f'avg({_IN1}) * 100')} AS pct_within,
       {s6(f'avg(least(y + {_U}, {_TEN}) - greatest(y - {_U}, {_Z}))')} AS mean_width,
       CASE WHEN avg({_IN1}) * 100 > 80 THEN 'PASSED' ELSE 'WARNING' END AS status
FROM _s
UNION ALL
SELECT 'bounds_effect_shifted', count(*), {s6(f'avg({_IN2}) * 100')},
       {s6(f'avg(least(y + abs({_K}) * price + {_U}, {_TEN}) - greatest(y - abs({_K}) * price - {_U}, {_Z}))')},
       CASE WHEN avg({_IN2}) * 100 > 80 THEN 'PASSED' ELSE 'WARNING' END
FROM _s"""))
def v7_v9_bounds(spark, sf_dir):
    """V8 (prediction within observed ± 0.3, PASSED above 80 %) and V9 (observed shifted by the
    2SLS coefficient × price). Widths floor only the lower end at 0 and cap only the upper at 10."""
    m = fitted_model(spark, sf_dir)
    s = rk.hash_sample(features(spark, sf_dir), 100).select(
        F.col(TARGET).alias("y"), m.predict(va.model_values(m.features)).alias("yhat"),
        F.col("avg_reward_price").alias("price"))
    u = UNCERTAINTY
    low, high = lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.least(x, F.lit(10.0))
    y, yh, p = F.col("y"), F.col("yhat"), F.col("price")
    inside = ((yh >= y - u) & (yh <= y + u)).cast("double")
    shifted = y + F.lit(m.tsls_coef) * p
    inside2 = ((yh >= shifted - u) & (yh <= shifted + u)).cast("double")
    eff = F.abs(F.lit(m.tsls_coef)) * p
    a = s.agg(F.lit("bounds_observed").alias("test"), F.count(F.lit(1)).alias("n"),
              r6(F.avg(inside) * 100).alias("pct_within"),
              r6(F.avg(high(y + u) - low(y - u))).alias("mean_width"),
              va.status(F.avg(inside) * 100 > 80).alias("status"))
    b = s.agg(F.lit("bounds_effect_shifted").alias("test"), F.count(F.lit(1)).alias("n"),
              r6(F.avg(inside2) * 100).alias("pct_within"),
              r6(F.avg(high(y + eff + u) - low(y - eff - u))).alias("mean_width"),
              va.status(F.avg(inside2) * 100 > 80).alias("status"))
    return a.unionByName(b)


PRICE_CHANGE = -0.2
_E7 = f"(k_tsls * {PRICE_CHANGE!r}::DOUBLE * price)"


@query("v7_manski", _msql(f"""
, _s AS (SELECT funding_ratio AS y, avg_reward_price AS price, k_tsls FROM fm
         ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 100),
_m AS (SELECT y + {_E7} AS point, greatest(y - abs({_E7}) - {_U}, {_Z}) AS lo, least(y + abs({_E7}) + {_U}, {_TEN}) AS hi FROM _s)
SELECT count(*) AS n, {s6('avg(point)')} AS avg_point_estimate, {s6('avg(hi - lo)')} AS avg_interval_width,
       {s6('avg(CASE WHEN point BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share_inside FROM _m"""))
def v7_manski(spark, sf_dir):
    """V7: bounds of the outcome after a price cut of 20 %: observed outcome plus causal effect, lower end
    floored at 0, upper end capped at 10; mean point estimate, mean width and share of points inside."""
    m = fitted_model(spark, sf_dir)
    eff = F.lit(m.tsls_coef * PRICE_CHANGE) * F.col("avg_reward_price")
    y = F.col(TARGET)
    s = rk.hash_sample(features(spark, sf_dir), 100).select(
        (y + eff).alias("point"), F.greatest(y - F.abs(eff) - UNCERTAINTY, F.lit(0.0)).alias("lo"),
        F.least(y + F.abs(eff) + UNCERTAINTY, F.lit(10.0)).alias("hi"))
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("point")).alias("avg_point_estimate"),
                 r6(F.avg(F.col("hi") - F.col("lo"))).alias("avg_interval_width"),
                 r6(F.avg(F.col("point").between(F.col("lo"), F.col("hi")).cast("double"))).alias("share_inside"))


# --- V11-V15 -------------------------------------------------------------------------------------------

_V11_PRED = "k0" + "".join(f" + b_{c} * CAST({c} AS DOUBLE)" for c in FEATURES)


@query("v11_time_cv", _fsql(f""",
_f AS (SELECT {', '.join([*FEATURES, TARGET])}, CASE WHEN year(launch_date) <= 2022 THEN 'train' ELSE 'test' END AS split
       FROM features WHERE launch_date IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES, TARGET])}),
_tr AS (SELECT * FROM _f WHERE split = 'train'),
{ols_sql('_full', '_f')},
{ols_sql('_fit', '_tr')},
_e AS (SELECT {TARGET} AS y, {TARGET} - ({_V11_PRED}) AS e FROM _f CROSS JOIN _fit WHERE split = 'test'),
_m AS (SELECT count(*) AS n_test, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM _e)
SELECT n_test, {s6('r2')} AS r2, {s6('mae')} AS mae, {s9(f'_fit.b_{TREATMENT}')} AS price_coef_train,
       {s9(f'_full.b_{TREATMENT}')} AS price_coef_full,
       {s9(f'abs(_fit.b_{TREATMENT} - _full.b_{TREATMENT})')} AS coef_change,
       CASE WHEN abs(_fit.b_{TREATMENT} - _full.b_{TREATMENT}) < 0.01 THEN 'stable' ELSE 'unstable' END AS stability
FROM _m, _fit, _full"""))
def v11_time_cv(spark, sf_dir):
    """Train ≤ 2022 / test ≥ 2023 (Gram OLS twice): test R², MAE, price-coefficient change vs the
    full model, stable if the change < 0.01."""
    f = rk.time_split(features(spark, sf_dir)).select("split", TARGET, *FEATURES).na.drop()
    full = L.ols(L.fit_gram(f, FEATURES + [TARGET]), TARGET, FEATURES)
    tr = L.ols(L.fit_gram(f.where(F.col("split") == "train"), FEATURES + [TARGET]), TARGET, FEATURES)
    test = f.where(F.col("split") == "test").withColumn("_p", L.predict_expr(tr))
    e = F.col(TARGET) - F.col("_p")
    m = test.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(e)).alias("mae"),
                 (F.lit(1.0) - F.sum(e * e) / (F.var_pop(TARGET) * F.count(F.lit(1)))).alias("r2"))
    change = abs(float(tr.coef[0]) - float(full.coef[0]))
    return m.select("n_test", r6("r2").alias("r2"), r6("mae").alias("mae"),
                    round_to(F.lit(float(tr.coef[0])), 9).alias("price_coef_train"),
                    round_to(F.lit(float(full.coef[0])), 9).alias("price_coef_full"), round_to(F.lit(change), 9).alias("coef_change"),
                    F.lit("stable" if change < 0.01 else "unstable").alias("stability"))


_V12_R2 = "(r2_first / (k_iv + 4)) / ((1 - r2_first) / (n - k_iv - 5))"


@query("v12_instruments", _fsql(f""",
{tsls_sql('_iv', 'features')}
""" + "\nUNION ALL\n".join(f"""SELECT '{iv}' AS instrument, (SELECT {s6(f'corr({iv}, {TREATMENT})')} FROM features) AS corr_treatment,
  (SELECT {s6(f'corr({iv}, {TARGET})')} FROM features) AS corr_outcome,
  (SELECT CASE WHEN abs(corr({iv}, {TREATMENT})) < 0.2 THEN 'valid' ELSE 'weak' END FROM features) AS validity,
  {s6(_V12_R2)} AS first_stage_f, {s6('(explained / k_iv) / (ssr_first / (n - k_iv - 5))')} AS partial_f,
  CASE WHEN {_V12_R2} > 10 THEN 'Strong' ELSE 'Weak' END AS strength FROM _iv""" for iv in INSTRUMENTS)))
def v12_instruments(spark, sf_dir):
    """Instrument checks: |corr(IV, price)| < 0.2 labels, corr with outcome, and first-stage strength."""
    from pricelens.operators.aggregates import instrument_correlations
    f = features(spark, sf_dir)
    gr = L.fit_gram(f, [TREATMENT] + CONTROLS + INSTRUMENTS + [TARGET])
    r = L.tsls(gr, TARGET, TREATMENT, INSTRUMENTS, CONTROLS)
    ic = instrument_correlations(f, INSTRUMENTS, TREATMENT, TARGET)
    return ic.withColumn("first_stage_f", r6(F.lit(float(r.first_stage_f)))).withColumn(
        "partial_f", r6(F.lit(float(r.partial_f)))).withColumn(
        "strength", F.lit("Strong" if r.first_stage_f > 10 else "Weak"))


@query("v13_selection_bias", _fsql(f"""
, _g AS (SELECT count_if(success_binary = 1) AS n1, count_if(success_binary = 0) AS n0,
                avg({TREATMENT}) FILTER (WHERE success_binary = 1) AS m1, avg({TREATMENT}) FILTER (WHERE success_binary = 0) AS m0,
                var_samp({TREATMENT}) FILTER (WHERE success_binary = 1) AS v1, var_samp({TREATMENT}) FILTER (WHERE success_binary = 0) AS v0
         FROM features),
_t AS (SELECT *, n1 + n0 - 2 AS dof, {s6('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0))')} AS t_stat FROM _g),
_p AS (SELECT *, {t_two_sided_sql('t_stat', 'dof')} AS p FROM _t)
SELECT n1, n0, {s6('m1')} AS mean_1, {s6('m0')} AS mean_0, {s6('m1 - m0')} AS difference, t_stat, dof, {s6('p')} AS p_value,
       CASE WHEN p < 0.05 THEN 'selection_bias' ELSE 'no_selection_bias' END AS verdict FROM _p"""))
def v13_selection_bias(spark, sf_dir):
    """Pooled t-test of price between successful and failed campaigns, with its p-value."""
    t = pooled_ttest(features(spark, sf_dir), TREATMENT, "success_binary")
    row = t.first()
    p = t_two_sided_p(row["t_stat"], row["dof"]) if row["t_stat"] is not None else float("nan")
    return t.withColumn("p_value", r6(F.lit(float(p)))).withColumn(
        "verdict", F.lit("selection_bias" if p < 0.05 else "no_selection_bias"))


@query("v14_invariants", _fsql("""
, _v AS (SELECT count(*) AS n_rows,
  count_if(coalesce(project_id IS NULL OR funding_goal IS NULL OR pledged_amount IS NULL OR status IS NULL, false)) AS missing_required,
  count_if(coalesce(funding_goal < 0 OR pledged_amount < 0, false)) AS negative_money,
  count_if(coalesce(campaign_duration_days <= 0 OR campaign_duration_days > 90, false)) AS duration_out_of_range,
  count_if(coalesce(NOT status IN ('successful', 'failed'), false)) AS bad_status,
  count_if(coalesce(NOT is_weekend_launch IN (0, 1) OR NOT is_holiday_week IN (0, 1), false)) AS non_binary_flag,
  count_if(coalesce(trend_index < 0 OR trend_index > 100, false)) AS trend_out_of_range FROM features)
SELECT rule, violations, n_rows, CASE WHEN violations = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM _v UNPIVOT (violations FOR rule IN (missing_required, negative_money, duration_out_of_range, bad_status,
                                          non_binary_flag, trend_out_of_range))"""))
def v14_invariants(spark, sf_dir):
    return va.invariant_violations(features(spark, sf_dir))


_V15_ROWS = f"""
SELECT 'temporal_validation' AS test, 'mae' AS metric, mae AS value, status FROM ({ORACLES['v2_changers']})
UNION ALL SELECT 'placebo_test', 'mean_phantom_effect', mean_effect, status FROM ({ORACLES['v4_v6_placebo']}) WHERE test = 'placebo_scaled'
UNION ALL SELECT 'manski_bounds', 'pct_within_bounds', pct_within, status FROM ({ORACLES['v7_v9_bounds']}) WHERE test = 'bounds_observed'
UNION ALL SELECT 'cross_validation', 'mean_cv_mae', cv_mae_mean, 'INFO' FROM ({ORACLES['v10_cv_summary']})
UNION ALL SELECT 'time_split', 'coef_change', coef_change, CASE WHEN stability = 'stable' THEN 'PASSED' ELSE 'WARNING' END
          FROM ({ORACLES['v11_time_cv']})"""


@query("v15_summary", f"""
WITH _rows AS ({_V15_ROWS}),
_ok AS (SELECT CASE WHEN count_if(test IN ('placebo_test', 'time_split') AND status = 'PASSED') = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok
        FROM _rows)
SELECT * FROM _rows
UNION ALL SELECT 'overall', 'reliable', ok, CASE WHEN ok = 1 THEN 'PASSED' ELSE 'WARNING' END FROM _ok""")
def v15_summary(spark, sf_dir):
    """Validation summary rows (test, metric, value, status) and the overall verdict:
    reliable = placebo passed AND the time-split coefficient stable."""
    v2 = v2_changers(spark, sf_dir).select(F.lit("temporal_validation").alias("test"), F.lit("mae").alias("metric"),
                                             F.col("mae").alias("value"), "status")
    pl = v4_v6_placebo(spark, sf_dir).where(F.col("test") == "placebo_scaled").select(
        F.lit("placebo_test").alias("test"), F.lit("mean_phantom_effect").alias("metric"),
        F.col("mean_effect").alias("value"), "status")
    bd = v7_v9_bounds(spark, sf_dir).where(F.col("test") == "bounds_observed").select(
        F.lit("manski_bounds").alias("test"), F.lit("pct_within_bounds").alias("metric"),
        F.col("pct_within").alias("value"), "status")
    cv = v11_time_cv(spark, sf_dir)
    tc = cv.select(F.lit("time_split").alias("test"), F.lit("coef_change").alias("metric"),
                   F.col("coef_change").alias("value"),
                   F.when(F.col("stability") == "stable", F.lit("PASSED")).otherwise(F.lit("WARNING")).alias("status"))
    mae = v10_cv_summary(spark, sf_dir).select(F.lit("cross_validation").alias("test"), F.lit("mean_cv_mae").alias("metric"),
                                               F.col("cv_mae_mean").alias("value"), F.lit("INFO").alias("status"))
    rows = v2.unionByName(pl).unionByName(bd).unionByName(mae).unionByName(tc)
    placebo_ok = F.max(F.when((F.col("test") == "placebo_test") & (F.col("status") == "PASSED"), 1).otherwise(0))
    stable_ok = F.max(F.when((F.col("test") == "time_split") & (F.col("status") == "PASSED"), 1).otherwise(0))
    verdict = rows.agg((placebo_ok * stable_ok).alias("ok")).select(
        F.lit("overall").alias("test"), F.lit("reliable").alias("metric"), F.col("ok").cast("double").alias("value"),
        F.when(F.col("ok") == 1, F.lit("PASSED")).otherwise(F.lit("WARNING")).alias("status"))
    return rows.unionByName(verdict)
