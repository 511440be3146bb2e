"""Estimator queries: M1-M6, M11, M13, M14 (closed form) — ML forests live in q_ml."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.functions.exprs import r6, round_to
from pricelens.operators import linear as L
from pricelens.operators import ranking as rk
from pricelens.operators.aggregates import pearson
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import features
from pricelens.plans.model import CONTROLS, FEATURES, INSTRUMENTS, TARGET, TREATMENT, ols_sql, t_two_sided_sql, tsls_sql
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views

def _table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _fsql(body, *ctes):
    return with_views(body, *ctes, level="features")


# --- M1 -----------------------------------------------------------------------------------------

@query("m1_standardise", _fsql("SELECT project_id, " + ", ".join(
    f"{s6(f'({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END)')} AS z_{c}"
    for c in FEATURES) + " FROM features"))
def m1_standardise(spark, sf_dir):
    f = features(spark, sf_dir)
    st = f.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)])
    sub = st.select(F.struct(*st.columns)).scalar()
    cols = [r6((F.col(c) - sub[f"m{i}"]) / F.when(sub[f"s{i}"] == 0, F.lit(1.0)).otherwise(sub[f"s{i}"]))
            .alias(f"z_{c}") for i, c in enumerate(FEATURES)]
    return f.select("project_id", *cols)


# --- M2 -----------------------------------------------------------------------------------------

def ols_table(spark, f, y=TARGET, xs=FEATURES):
    gr = L.fit_gram(f, list(xs) + [y])
    fit = L.ols(gr, y, xs)
    std = L.standardised_coefs(fit, gr)
    se = fit.se()
    rows = [("intercept", float(fit.intercept), None, None, None)]
    rows += [(x, float(b), float(s), float(e), float(b / e) if e > 0 else None)
             for x, b, s, e in zip(xs, fit.coef, std, se)]
    rows += [("r2", float(fit.r2), None, None, None), ("n", float(fit.n), None, None, None)]
    return _table(spark, rows, "term string, coef double, std_coef double, se double, t double"), fit


def s9(x: str) -> str:
    return f"(round(({x}) * 1e9::DOUBLE) / 1e9::DOUBLE + 0.0::DOUBLE)"


def _m2_sql():
    se = {x: f"sqrt(ssr / (n - {len(FEATURES)} - 1) * v_{x})" for x in FEATURES}
    terms = " UNION ALL ".join(f"SELECT '{x}' AS term, b_{x} AS b, b_{x} * sd_{x} AS z, {se[x]} AS e FROM _o" for x in FEATURES)
    return _fsql(f""",
{ols_sql('_o', 'features')},
_t AS ({terms})
SELECT term, {s9('b')} AS coef, {s6('z')} AS std_coef, {s9('e')} AS se, CASE WHEN e > 0 THEN {s6('b / e')} END AS t,
       CAST(row_number() OVER (ORDER BY abs(z) DESC, term) AS INTEGER) AS importance_rank,
       CASE WHEN b > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM _t
UNION ALL SELECT 'intercept', {s9('k0')}, NULL, NULL, NULL, NULL, NULL FROM _o
UNION ALL SELECT 'r2', {s9('1 - ssr / sst')}, NULL, NULL, NULL, NULL, NULL FROM _o
UNION ALL SELECT 'n', CAST(n AS DOUBLE), NULL, NULL, NULL, NULL, NULL FROM _o""")


@query("m2_ols", _m2_sql())
def m2_ols(spark, sf_dir):
    """Multi-feature OLS from the Gram, with the coefficient ranking by absolute standardised size and a
    sign label (K1, M16). The twin solves the normal equations by sweeping."""
    t = ols_table(spark, features(spark, sf_dir))[0]
    ranked = t.where(F.col("std_coef").isNotNull())
    w = F.row_number().over(Window.orderBy(F.abs("std_coef").desc(), "term"))  # ≤ #features rows
    ranked = ranked.withColumn("importance_rank", w).withColumn(
        "direction", F.when(F.col("coef") > 0, F.lit("increases")).otherwise(F.lit("decreases")))
    rest = t.where(F.col("std_coef").isNull()).withColumn("importance_rank", F.lit(None).cast("int")).withColumn(
        "direction", F.lit(None).cast("string"))
    return ranked.unionByName(rest).select(
        "term", round_to("coef", 9).alias("coef"), r6("std_coef").alias("std_coef"), round_to("se", 9).alias("se"),
        r6("t").alias("t"), "importance_rank", "direction")


@query("m2_ols_single", _fsql(f"""
SELECT {s6('regr_intercept(funding_ratio, avg_reward_price)')} AS intercept,
       {s6('regr_slope(funding_ratio, avg_reward_price)')} AS slope,
       {s6('regr_r2(funding_ratio, avg_reward_price)')} AS r2, count(*) AS n
FROM features WHERE funding_ratio IS NOT NULL AND avg_reward_price IS NOT NULL"""))
def m2_ols_single(spark, sf_dir):
    """One-regressor OLS through the same Gram solver, checked against SQL regr_*."""
    f = features(spark, sf_dir)
    gr = L.fit_gram(f, [TREATMENT, TARGET])
    fit = L.ols(gr, TARGET, [TREATMENT])
    return _table(spark, [(float(fit.intercept), float(fit.coef[0]), float(fit.r2), int(fit.n))],
                  "intercept double, slope double, r2 double, n bigint").select(
        r6("intercept").alias("intercept"), r6("slope").alias("slope"), r6("r2").alias("r2"), "n")


# --- M3-M6 ----------------------------------------------------------------------------------------

def iv_fit(f, instruments=INSTRUMENTS, controls=CONTROLS):
    cols = [TREATMENT] + list(controls) + list(instruments) + [TARGET]
    gr = L.fit_gram(f, cols)
    return gr, L.tsls(gr, TARGET, TREATMENT, instruments, controls)


_K2 = 1 + len(CONTROLS)


@query("m3_2sls", _fsql(f""",
{tsls_sql('_iv', 'features')},
_s AS (SELECT *, ssr_controls - effect * effect * explained AS ssr2, n - {_K2} - 1 AS dof2, k_iv + {len(CONTROLS)} AS k1 FROM _iv),
_t AS (SELECT *, sqrt(ssr2 / dof2 / explained) AS se, (r2_first / k1) / ((1 - r2_first) / (n - k1 - 1)) AS f FROM _s)
SELECT {s9('effect')} AS treatment_effect, {s9('se')} AS treatment_se, {s6('effect / se')} AS t_stat,
       {s6(t_two_sided_sql('effect / se', 'dof2'))} AS p_value, {s6('f')} AS first_stage_f, {s9('r2_first')} AS first_stage_r2,
       {s9('1 - ssr2 / sst_y')} AS second_stage_r2, CASE WHEN f > 10 THEN 'Strong' ELSE 'Weak' END AS instrument_strength,
       n, dropped AS dropped_instruments FROM _t"""))
def m3_2sls(spark, sf_dir):
    """Form A: effect, naive SE/t/p, both R², overall first-stage F and strength label."""
    f = features(spark, sf_dir)
    gr, r = iv_fit(f)
    rows = [(float(r.effect), float(r.se), float(r.t), float(r.p), float(r.first_stage_f), float(r.first_stage_r2),
             float(r.second_stage_r2), "Strong" if r.first_stage_f > 10 else "Weak", int(r.n), ",".join(r.dropped))]
    out = _table(spark, rows, "treatment_effect double, treatment_se double, t_stat double, p_value double, "
                 "first_stage_f double, first_stage_r2 double, second_stage_r2 double, instrument_strength string, "
                 "n bigint, dropped_instruments string")
    digits = {"treatment_effect": 9, "treatment_se": 9, "t_stat": 6, "p_value": 6, "first_stage_f": 6, "first_stage_r2": 9, "second_stage_r2": 9}
    return out.select(*[round_to(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query("m3_iv_one_control", _fsql(f"""
, _c AS (SELECT covar_pop(is_weekend_launch, funding_ratio) AS zy, covar_pop(is_weekend_launch, goal_ambition) AS zw,
                covar_pop(goal_ambition, funding_ratio) AS wy, var_pop(goal_ambition) AS ww,
                covar_pop(is_weekend_launch, avg_reward_price) AS zt, covar_pop(goal_ambition, avg_reward_price) AS wt
         FROM features)
SELECT {s6('(zy - zw * wy / ww) / (zt - zw * wt / ww)')} AS iv_effect FROM _c"""))
def m3_iv_one_control(spark, sf_dir):
    """Just-identified 2SLS (one instrument, one control) from the Gram; SQL twin via partial covariances."""
    f = features(spark, sf_dir)
    gr, r = iv_fit(f, ["is_weekend_launch"], ["goal_ambition"])
    return _table(spark, [(float(r.effect),)], "iv_effect double").select(r6("iv_effect").alias("iv_effect"))


@query("m4_2sls_f", _fsql(f""",
{tsls_sql('_iv', 'features')}
SELECT {s9('effect')} AS tsls_coefficient, {s6('(r2_first / k_iv) / ((1 - r2_first) / (n - k_iv - 1))')} AS first_stage_f_stat,
       {s9('r2_first')} AS r2_first_stage, instruments FROM _iv"""))
def m4_2sls_f(spark, sf_dir):
    """Form B: coefficient on the fitted price and F = (R²/#instruments)/((1−R²)/(n−#instruments−1))."""
    f = features(spark, sf_dir)
    gr, r = iv_fit(f)
    return _table(spark, [(float(r.effect), float(r.first_stage_f_form_b), float(r.first_stage_r2),
                           ",".join(i for i in INSTRUMENTS if i not in r.dropped))],
                  "tsls_coefficient double, first_stage_f_stat double, r2_first_stage double, instruments string").select(
        round_to("tsls_coefficient", 9).alias("tsls_coefficient"), r6("first_stage_f_stat").alias("first_stage_f_stat"),
        round_to("r2_first_stage", 9).alias("r2_first_stage"), "instruments")


@query("m5_iv_robust")
def m5_iv_robust(spark, sf_dir):
    """Form C: robust (HC0) SEs from structural residuals and the partial F on the instruments."""
    f = features(spark, sf_dir)
    gr, r = iv_fit(f)
    cov = L.robust_cov(f, gr, r, TARGET, TREATMENT, INSTRUMENTS, CONTROLS)
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    rows = [(name, float(b), float(s)) for name, b, s in zip(["intercept"] + r.names,
                                                              [r.intercept] + list(r.coef), se)]
    rows += [("partial_f", float(r.partial_f), None), ("partial_f_p", float(r.partial_f_p), None),
             ("structural_r2", float(r.structural_r2), None)]
    return _table(spark, rows, "term string, value double, robust_se double")


@query("m6_iv_diagnostics")
def m6_iv_diagnostics(spark, sf_dir):
    """Documented-only diagnostics, computed: Sargan J (over-identification) and Durbin-Wu-Hausman."""
    f = features(spark, sf_dir)
    gr, r = iv_fit(f)
    return _table(spark, [(float(r.sargan_j), float(r.sargan_p), float(r.dwh_t), float(r.dwh_p))],
                  "sargan_j double, sargan_p double, dwh_t double, dwh_p double")


# --- M11: per goal-quartile slopes (fallback heterogeneity) ----------------------------------------

M11_SQL = """
, _e AS (SELECT quantile_cont(goal_ambition, 0.25) AS e1, quantile_cont(goal_ambition, 0.5) AS e2,
                quantile_cont(goal_ambition, 0.75) AS e3, min(goal_ambition) AS e0, max(goal_ambition) AS e4 FROM features),
_q AS (SELECT f.*, CASE WHEN goal_ambition >= e0 AND goal_ambition <= e1 THEN 'Low'
                        WHEN goal_ambition > e1 AND goal_ambition <= e2 THEN 'Medium-Low'
                        WHEN goal_ambition > e2 AND goal_ambition <= e3 THEN 'Medium-High'
                        WHEN goal_ambition > e3 AND goal_ambition <= e4 THEN 'High' END AS goal_quartile
       FROM features f, _e),
_s AS (SELECT goal_quartile, count(*) AS n,
              corr(avg_reward_price, funding_ratio) * stddev_samp(funding_ratio) / stddev_samp(avg_reward_price) AS slope
       FROM _q GROUP BY goal_quartile)"""


def quartile_slopes(f):
    q = exact_percentiles(f, "goal_ambition", [0.0, 0.25, 0.5, 0.75, 1.0], names=["e0", "e1", "e2", "e3", "e4"])
    s = q.select(F.struct("e0", "e1", "e2", "e3", "e4")).scalar()
    binned = rk.quantile_bins(f, "goal_ambition", [s[f"e{i}"] for i in range(5)])
    return binned.groupBy("goal_quartile").agg(
        F.count(F.lit(1)).alias("n"),
        (pearson("avg_reward_price", "funding_ratio") * F.stddev_samp("funding_ratio")
         / F.nullif(F.stddev_samp("avg_reward_price"), F.lit(0.0))).alias("slope"))


@query("m11_quartile_slopes", _fsql(f"""{M11_SQL}
SELECT goal_quartile, n, {s6('slope')} AS slope, {s6('avg(slope) OVER ()')} AS ate FROM _s"""))
def m11_quartile_slopes(spark, sf_dir):
    s = quartile_slopes(features(spark, sf_dir))
    ate = s.select(F.avg("slope")).scalar()
    return s.select("goal_quartile", "n", r6("slope").alias("slope"), r6(ate).alias("ate"))


# --- M13: k-fold CV of the linear model ------------------------------------------------------------

def cv_linear(f, k=5, xs=FEATURES, y=TARGET):
    """Contiguous folds; per-fold Grams in ONE groupBy; train Gram = total − fold; MAE per fold
    from one more grouped pass with the fold's coefficients inlined as literals."""
    folded = rk.contiguous_folds(f.select("project_id", *xs, y).na.drop(), ["project_id"], k)
    mom, grams = L.fold_grams(folded, list(xs) + [y], "fold")
    total = None
    for g in grams.values():
        total = g if total is None else total + g
    fits = {fold: L.ols(total - g, y, xs) for fold, g in grams.items()}
    pred = F.lit(None).cast("double")
    for fold, fit in fits.items():
        pred = F.when(F.col("fold") == fold, L.predict_expr(fit)).otherwise(pred)
    err = folded.withColumn("_e", F.col(y) - pred)
    per = err.groupBy("fold").agg(F.avg(F.abs("_e")).alias("mae"), F.sum(F.col("_e") * F.col("_e")).alias("sse"),
                                  F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"))
    return per.select("fold", "n", r6("mae").alias("mae"),
                      r6(F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"))


_CV_COLS = ", ".join([*FEATURES, TARGET])
_CV_PRED = "k0" + "".join(f" + b_{c} * CAST({c} AS DOUBLE)" for c in FEATURES)
CV_SQL = f""",
_cf AS (SELECT {_CV_COLS}, CAST(ntile(5) OVER (ORDER BY project_id) AS INTEGER) AS fold FROM features
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*FEATURES, TARGET])}),
_ct AS (SELECT h.fold AS held, {_CV_COLS} FROM _cf JOIN (SELECT DISTINCT fold FROM _cf) h ON _cf.fold <> h.fold),
{ols_sql('_co', '_ct', group='held')},
_ce AS (SELECT fold, {TARGET} AS y, {TARGET} - ({_CV_PRED}) AS e FROM _cf JOIN _co ON fold = held),
_cv AS (SELECT fold, count(*) AS n, {s6('avg(abs(e))')} AS mae, {s6('1 - sum(e * e) / (var_pop(y) * count(*))')} AS r2
        FROM _ce GROUP BY fold)"""


@query("m13_cv", _fsql(CV_SQL + "\nSELECT fold, n, mae, r2 FROM _cv"))
def m13_cv(spark, sf_dir):
    """5-fold unshuffled CV of the linear model: per-fold MAE and R² (summary in v10_cv_summary)."""
    return cv_linear(features(spark, sf_dir))


@query("v10_cv_summary", _fsql(CV_SQL + f"""
SELECT {s6('avg(mae)')} AS cv_mae_mean, {s6('stddev_pop(mae)')} AS cv_mae_std,
       list(mae ORDER BY fold) AS fold_maes FROM _cv"""))
def v10_cv_summary(spark, sf_dir):
    """Mean and population sd of the fold MAEs, and the list."""
    per = cv_linear(features(spark, sf_dir))
    return per.agg(r6(F.avg("mae")).alias("cv_mae_mean"), r6(F.stddev_pop("mae")).alias("cv_mae_std"),
                   F.transform(F.sort_array(F.collect_list(F.struct("fold", "mae"))), lambda f: f["mae"]).alias("fold_maes"))


# --- M14: alphabetical label encoding ----------------------------------------------------------------

@query("m14_label_encoding", _fsql("""
SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_index
FROM (SELECT DISTINCT category FROM features WHERE category IS NOT NULL)"""))
def m14_label_encoding(spark, sf_dir):
    from pyspark.ml.feature import StringIndexer
    f = features(spark, sf_dir).where(F.col("category").isNotNull())
    model = StringIndexer(inputCol="category", outputCol="category_index", stringOrderType="alphabetAsc").fit(f)
    cats = f.select("category").distinct()
    return model.transform(cats).select("category", "category_index")
