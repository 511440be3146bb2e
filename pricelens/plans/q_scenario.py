"""Scenario queries C1-C9: every campaign scored at once by the model fitted on the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.exprs import r6, round_to
from pricelens.operators import scenario as sc
from pricelens.operators.features import group_medians
from pricelens.operators.joins import join_small
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import features, staged
from pricelens.plans.model import MODEL_SQL, QUANTILES, fitted_model, predict_sql, quantile_model
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views

PCT_CHANGE = 10.0


def rt(x: str, d: int) -> str:
    s = float(10 ** d)
    return f"(round(({x}) * {s!r}::DOUBLE) / {s!r}::DOUBLE + 0.0::DOUBLE)"


def _dlist(vals) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in vals) + "]::DOUBLE[]"


SC_SQL = MODEL_SQL + """,
_cm AS (SELECT category, median(funding_goal) AS mg, median(avg_reward_price) AS mp,
               median(campaign_duration_days) AS md, median(trend_index) AS mt FROM features
        WHERE category IS NOT NULL GROUP BY category),
_sc AS (
  SELECT f.*, f.funding_goal / (SELECT median(funding_goal) FROM features) AS amb_global,
         CASE WHEN m.mg > 0 THEN f.funding_goal / m.mg ELSE 1.0::DOUBLE END AS amb_cat,
         m.mg AS cat_median_goal, m.mp AS cat_median_price, m.md AS cat_median_duration, m.mt AS cat_median_trend,
         (SELECT median(concurrent_campaigns) FROM features) AS conc_med
  FROM fm f LEFT JOIN _cm m ON f.category = m.category
)"""

API_SQL_VALUES = {"avg_reward_price": "avg_reward_price", "goal_ambition": "amb_global",
                  "campaign_duration_days": "campaign_duration_days", "trend_index": "trend_index",
                  "concurrent_campaigns": "0.5"}
DASH_SQL_VALUES = {"avg_reward_price": "avg_reward_price", "goal_ambition": "amb_cat",
                   "campaign_duration_days": "campaign_duration_days", "trend_index": "trend_index",
                   "concurrent_campaigns": "conc_med"}


def _sql(body):
    return with_views(body, SC_SQL, level="features")


def scored(spark, sf_dir):
    """Features + global/category medians needed by the scenario forms — a stage table shared by
    every scenario query."""
    return staged(spark, sf_dir, "scored", lambda: _scored(spark, sf_dir))


def _scored(spark, sf_dir):
    f = features(spark, sf_dir)
    med_goal = exact_percentiles(f, "funding_goal", [0.5], names=["m"]).select("m").scalar()
    conc = exact_percentiles(f, "concurrent_campaigns", [0.5], names=["m"]).select("m").scalar()
    cm = group_medians(f, {"cat_median_goal": "funding_goal", "cat_median_price": "avg_reward_price",
                           "cat_median_duration": "campaign_duration_days", "cat_median_trend": "trend_index"},
                       ["category"])
    f = join_small(f, cm, "category", "left")
    return (f.withColumn("amb_global", F.col("funding_goal") / med_goal)
            .withColumn("amb_cat", F.when(F.col("cat_median_goal") > 0, F.col("funding_goal") / F.col("cat_median_goal"))
                        .otherwise(F.lit(1.0)))
            .withColumn("conc_med", conc))


def api_vals():
    return sc.api_values(F.col("amb_global"))


def dash_vals():
    return {"avg_reward_price": F.col("avg_reward_price"), "goal_ambition": F.col("amb_cat"),
            "campaign_duration_days": F.col("campaign_duration_days"), "trend_index": F.col("trend_index"),
            "concurrent_campaigns": F.col("conc_med")}


_C1_RATIO = predict_sql(API_SQL_VALUES)


@query("c1_score", _sql(f"""
SELECT project_id, {rt(f'funding_goal * {_C1_RATIO}', 2)} AS expected_funding, {rt(_C1_RATIO, 3)} AS funding_ratio,
  {rt(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_C1_RATIO}))', 3)} AS success_probability,
  {rt(f'funding_goal * ({_C1_RATIO} * 0.5::DOUBLE)', 2)} AS confidence_low,
  {rt(f'funding_goal * ({_C1_RATIO} * 1.5::DOUBLE)', 2)} AS confidence_high,
  CASE WHEN {_C1_RATIO} >= 1.5 THEN 'Strong Success - Consider higher goal'
       WHEN {_C1_RATIO} >= 1.0 THEN 'Likely Success - On track'
       WHEN {_C1_RATIO} >= 0.7 THEN 'At Risk - Consider adjustments'
       ELSE 'Needs Work - Review pricing and goal' END AS recommendation
FROM _sc"""))
def c1_score(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    out = sc.score_api(m, api_vals(), F.col("funding_goal"))
    return s.select("project_id", *[v.alias(k) for k, v in out.items()])


def _names(quantiles=QUANTILES):
    return {q: f"q{int(round(q * 100)):02d}" for q in quantiles}


@query("c1_interval")
def c1_interval(spark, sf_dir):
    """C1 with the quantile model: the 10/90 interval is what the trees say about each campaign."""
    s, m, q = scored(spark, sf_dir), fitted_model(spark, sf_dir), quantile_model(spark, sf_dir)
    out = sc.score_api(m, api_vals(), F.col("funding_goal"), F.col("q10"), F.col("q90"))
    return q.score(s, api_vals(), _names((0.1, 0.9))).select("project_id", *[v.alias(k) for k, v in out.items()])


@query("c2_band")
def c2_band(spark, sf_dir):
    """C2 with the quantile model: the dashboard's five quantiles, floored at 0."""
    s, m, q = scored(spark, sf_dir), fitted_model(spark, sf_dir), quantile_model(spark, sf_dir)
    ratio = F.greatest(F.lit(0.0), m.predict(dash_vals()))
    return q.score(s, dash_vals(), _names()).select(
        "project_id", r6(ratio).alias("funding_ratio"), *[r6(F.greatest(F.lit(0.0), F.col(c))).alias(c) for c in _names().values()])


_C2_PRED = predict_sql(DASH_SQL_VALUES)
_C2_RATIO = f"greatest(0.0::DOUBLE, {_C2_PRED})"


@query("c2_score_variant", _sql(f"""
SELECT project_id, {s6(_C2_RATIO)} AS funding_ratio, {s6(f'{_C2_RATIO} * funding_goal')} AS expected_funding,
  {s6(f'least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_C2_RATIO} / 1.0::DOUBLE) * 0.7::DOUBLE))')} AS success_probability,
""" + ",\n".join(f"  {s6(f'{_C2_RATIO} * {m!r}::DOUBLE')} AS q{int(q * 100):02d}" for q, m in sc.FALLBACK_QUANTILES.items())
    + "\nFROM _sc"))
def c2_score_variant(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    ratio = F.greatest(F.lit(0.0), m.predict(dash_vals()))
    qs = [r6(ratio * F.lit(m)).alias(f"q{int(q * 100):02d}") for q, m in sc.FALLBACK_QUANTILES.items()]
    return s.select("project_id", r6(ratio).alias("funding_ratio"), r6(ratio * F.col("funding_goal")).alias("expected_funding"),
                    r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio / 1.0) * 0.7))).alias("success_probability"), *qs)


def _c3_sql_ratio(m_expr):
    v = dict(API_SQL_VALUES)
    v["avg_reward_price"] = f"(avg_reward_price * {m_expr})"
    return rt(predict_sql(v), 3)


_C3_CTE = f"""
, _c3 AS (SELECT project_id, avg_reward_price AS c3_price, {_dlist(sc.PRICE_MULTIPLIERS)} AS mults,
                 list_transform({_dlist(sc.PRICE_MULTIPLIERS)}, lambda m: {_c3_sql_ratio('m')}) AS ratios FROM _sc)"""


@query("c3_demand_curve", _sql(_C3_CTE + f"""
SELECT project_id, ratios AS curve_ratios, list_max(ratios) AS max_ratio,
  {rt('CASE WHEN list_max(ratios) > 0 THEN c3_price * mults[list_position(ratios, list_max(ratios))] ELSE c3_price END', 2)} AS optimal_price,
  CASE WHEN k_tsls > 0.01 THEN '{sc.price_effect_label(1.0)}' WHEN k_tsls < -0.01 THEN '{sc.price_effect_label(-1.0)}'
       ELSE '{sc.price_effect_label(0.0)}' END AS price_effect
FROM _c3, _model"""))
def c3_demand_curve(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    d = sc.demand_curve(m, api_vals(), F.col("avg_reward_price"))
    return s.select("project_id", d["curve_ratios"].alias("curve_ratios"), d["max_ratio"].alias("max_ratio"),
                    d["optimal_price"].alias("optimal_price"), F.lit(sc.price_effect_label(m.tsls_coef)).alias("price_effect"))


def _c4_sql_fund(p_expr):
    v = dict(DASH_SQL_VALUES)
    v["avg_reward_price"] = f"CAST({p_expr} AS DOUBLE)"
    return f"(greatest(0.0::DOUBLE, {predict_sql(v)}) * funding_goal)"


@query("c4_int_grid", _sql(f"""
, _g0 AS (SELECT *, greatest(10, CAST(trunc(avg_reward_price * 0.3::DOUBLE) AS INTEGER)) AS lo,
                 CAST(trunc(avg_reward_price * 2.5::DOUBLE) AS INTEGER) AS hi FROM _sc),
_g1 AS (SELECT *, CASE WHEN hi > lo THEN range(lo, hi, greatest(1, (hi - lo) // 30)) ELSE []::BIGINT[] END AS grid FROM _g0),
_g2 AS (SELECT *, list_transform(grid, lambda p: {_c4_sql_fund('p')}) AS fund FROM _g1)
SELECT project_id, CAST(len(grid) AS INTEGER) AS grid_size,
  CAST(CASE WHEN len(grid) > 0 THEN grid[list_position(fund, list_max(fund))] END AS BIGINT) AS optimal_int_price,
  {s6('list_max(fund)')} AS optimal_expected_funding
FROM _g2"""))
def c4_int_grid(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    g = sc.integer_price_grid(m, dash_vals(), F.col("avg_reward_price"), F.col("funding_goal"))
    return s.select("project_id", g["grid_size"].alias("grid_size"),
                    g["optimal_int_price"].cast("bigint").alias("optimal_int_price"),
                    r6(g["optimal_expected_funding"]).alias("optimal_expected_funding"))


def _c5_sql_prob(m_expr):
    v = dict(DASH_SQL_VALUES)
    v["goal_ambition"] = f"(CASE WHEN cat_median_goal > 0 THEN funding_goal * {m_expr} / cat_median_goal ELSE 1.0::DOUBLE END)"
    r = f"greatest(0.0::DOUBLE, {predict_sql(v)})"
    return f"(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {r} / 1.0::DOUBLE * 0.7::DOUBLE)) * 100)"


@query("c5_goal_curve", _sql(f"""
SELECT project_id, list_transform({_dlist(sc.GOAL_MULTIPLIERS)}, lambda m: {s6('funding_goal * m')}) AS goals,
       list_transform({_dlist(sc.GOAL_MULTIPLIERS)}, lambda m: {s6(_c5_sql_prob('m'))}) AS probabilities
FROM _sc"""))
def c5_goal_curve(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    g = sc.goal_curve(m, dash_vals(), F.col("funding_goal"), F.col("cat_median_goal"))
    return s.select("project_id", F.transform(g["goals"], r6).alias("goals"),
                    F.transform(g["probabilities"], r6).alias("probabilities"))


@query("c6_benchmark", _sql(f"""
SELECT project_id,
  {s6('CASE WHEN cat_median_price > 0 THEN least(2.0::DOUBLE, avg_reward_price / cat_median_price) ELSE 1.0::DOUBLE END')} AS price_score,
  {s6('CASE WHEN cat_median_duration > 0 THEN least(2.0::DOUBLE, campaign_duration_days / cat_median_duration) ELSE 1.0::DOUBLE END')} AS duration_score,
  {s6('least(2.0::DOUBLE, amb_cat)')} AS ambition_score, {s6('trend_index / 50.0::DOUBLE')} AS trend_score
FROM _sc"""))
def c6_benchmark(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select(
        "project_id",
        r6(F.when(F.col("cat_median_price") > 0, F.least(F.lit(2.0), F.col("avg_reward_price") / F.col("cat_median_price")))
           .otherwise(F.lit(1.0))).alias("price_score"),
        r6(F.when(F.col("cat_median_duration") > 0,
                  F.least(F.lit(2.0), F.col("campaign_duration_days") / F.col("cat_median_duration")))
           .otherwise(F.lit(1.0))).alias("duration_score"),
        r6(F.least(F.lit(2.0), F.col("amb_cat"))).alias("ambition_score"),
        r6(F.col("trend_index") / 50.0).alias("trend_score"))


_K7 = f"(k_tsls * {PCT_CHANGE!r}::DOUBLE / 100.0::DOUBLE)"


def _c7_sql():
    v = dict(API_SQL_VALUES)
    v["avg_reward_price"] = f"(avg_reward_price * {1 + PCT_CHANGE / 100.0!r}::DOUBLE)"
    return predict_sql(v), predict_sql(API_SQL_VALUES)


@query("c7_pct_change", _sql(f"""
SELECT project_id, {s6(f'{_c7_sql()[0]} - {_c7_sql()[1]}')} AS naive_effect,
       {s6(f'{_K7} * avg_reward_price')} AS causal_effect,
       {s6(f'{_c7_sql()[1]} + {_K7} * avg_reward_price')} AS counterfactual_ratio
FROM _sc"""))
def c7_pct_change(spark, sf_dir):
    """+10 % price — naive effect (prediction difference) vs causal effect (2SLS × Δprice)."""
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    v = dict(api_vals())
    v["avg_reward_price"] = F.col("avg_reward_price") * (1 + PCT_CHANGE / 100.0)
    base = m.predict(api_vals())
    causal = F.lit(m.tsls_coef * PCT_CHANGE / 100.0) * F.col("avg_reward_price")
    return s.select("project_id", r6(m.predict(v) - base).alias("naive_effect"), r6(causal).alias("causal_effect"),
                    r6(base + causal).alias("counterfactual_ratio"))


@query("c7_interval")
def c7_interval(spark, sf_dir):
    """C7 with its prediction interval: effects of +10 % price and the 10/90 quantiles at the current features."""
    s, m, q = scored(spark, sf_dir), fitted_model(spark, sf_dir), quantile_model(spark, sf_dir)
    base = m.predict(api_vals())
    raised = m.predict(api_vals() | {"avg_reward_price": F.col("avg_reward_price") * (1 + PCT_CHANGE / 100.0)})
    causal = F.lit(m.tsls_coef * PCT_CHANGE / 100.0) * F.col("avg_reward_price")
    return q.score(s, api_vals(), _names((0.1, 0.9))).select(
        "project_id", r6(base).alias("current_prediction"), r6(raised).alias("counterfactual_prediction"), r6(raised - base).alias("naive_effect"),
        r6(causal).alias("causal_effect"), r6("q10").alias("interval_low"), r6("q90").alias("interval_high"))


def _c8_sql(price):
    v = {"avg_reward_price": f"{price!r}", "goal_ambition": "1.0", "campaign_duration_days": "md",
         "trend_index": "mt", "concurrent_campaigns": "(SELECT median(concurrent_campaigns) FROM features)"}
    return f"greatest(0.0::DOUBLE, {predict_sql(v)})"


@query("c8_price_quantiles", _sql("\nUNION ALL\n".join(
    f"SELECT category, {p!r}::DOUBLE AS price, " + ", ".join(
        f"{s6(f'{_c8_sql(p)} * {m!r}::DOUBLE')} AS q{int(q * 100):02d}" for q, m in sc.FALLBACK_QUANTILES.items())
    + " FROM _cm, _model" for p in sc.FIXED_PRICES)))
def c8_price_quantiles(spark, sf_dir):
    """Quantile band at fixed prices for each category's median campaign (fallback multipliers)."""
    rows, values = _price_points(spark, sf_dir)
    ratio = F.greatest(F.lit(0.0), fitted_model(spark, sf_dir).predict(values))
    return rows.select("category", "price", *[r6(ratio * F.lit(m)).alias(f"q{int(q * 100):02d}")
                                              for q, m in sc.FALLBACK_QUANTILES.items()])


def _price_points(spark, sf_dir):
    """Each category's median campaign at the fixed prices, and its feature expressions."""
    f = features(spark, sf_dir)
    conc = exact_percentiles(f, "concurrent_campaigns", [0.5], names=["m"]).select("m").scalar()
    cm = group_medians(f, {"md": "campaign_duration_days", "mt": "trend_index"}, ["category"])
    cm = cm.where(F.col("category").isNotNull())
    rows = cm.select("category", "md", "mt", F.explode(F.array(*[F.lit(p) for p in sc.FIXED_PRICES])).alias("price"))
    return rows, {"avg_reward_price": F.col("price"), "goal_ambition": F.lit(1.0), "campaign_duration_days": F.col("md"),
                  "trend_index": F.col("mt"), "concurrent_campaigns": conc}


@query("c8_quantile_curves")
def c8_quantile_curves(spark, sf_dir):
    """C8 with the quantile model: funding ratio quantiles at fixed prices for each category's median campaign."""
    rows, values = _price_points(spark, sf_dir)
    return quantile_model(spark, sf_dir).score(rows, values, _names()).select("category", "price", *[r6(c).alias(c) for c in _names().values()])


@query("c9_advice", _sql(_C3_CTE + f"""
, _a AS (SELECT s.project_id, s.campaign_duration_days AS dur, s.amb_global AS amb, s.avg_reward_price AS price,
                {_C1_RATIO} AS ratio,
                {rt(f"funding_goal * ({_C1_RATIO} * 0.5::DOUBLE)", 2)} AS lo,
                {rt(f"funding_goal * ({_C1_RATIO} * 1.5::DOUBLE)", 2)} AS hi,
                {rt('CASE WHEN list_max(c.ratios) > 0 THEN c.c3_price * c.mults[list_position(c.ratios, list_max(c.ratios))] ELSE c.c3_price END', 2)} AS opt
         FROM _sc s JOIN _c3 c ON s.project_id = c.project_id),
_b AS (SELECT *, list_filter([CASE WHEN dur > 45 THEN 'shorten_campaign' END,
                              CASE WHEN hi - lo > 20000 THEN 'anchor_social_proof' END,
                              CASE WHEN amb > 1.5 THEN 'split_goal_phases' END], lambda x: x IS NOT NULL) AS st FROM _a)
SELECT project_id,
  CASE WHEN ratio >= 1.2 THEN 'enthusiastic' WHEN ratio >= 1.0 THEN 'positive' WHEN ratio >= 0.7 THEN 'cautious' ELSE 'critical' END AS tone,
  CASE WHEN abs(opt - price) < 5 THEN 'keep' WHEN opt - price > 0 THEN 'raise' ELSE 'lower' END AS price_advice,
  CASE WHEN len(st) = 0 THEN ['build_community'] ELSE st END AS strategies,
  greatest(1, 10 - CAST(trunc(ratio * 10) AS INTEGER)) AS risk_score
FROM _b"""))
def c9_advice(spark, sf_dir):
    s, m = scored(spark, sf_dir), fitted_model(spark, sf_dir)
    ratio = m.predict(api_vals())
    sc1 = sc.score_api(m, api_vals(), F.col("funding_goal"))
    d = sc.demand_curve(m, api_vals(), F.col("avg_reward_price"))
    a = sc.advice(ratio, d["optimal_price"], F.col("avg_reward_price"), F.col("campaign_duration_days"),
                  sc1["confidence_low"], sc1["confidence_high"], F.col("amb_global"))
    return s.select("project_id", *[v.alias(k) for k, v in a.items()])


@query("a3_effect_by_category", _sql(f"""
SELECT category, count(*) AS n, {s6(f'avg({_K7} * avg_reward_price)')} AS mean_effect,
       {s6(f'stddev_samp({_K7} * avg_reward_price)')} AS sd_effect
FROM _sc GROUP BY category"""))
def a3_effect_by_category(spark, sf_dir):
    """A3: group mean and sample sd of the per-campaign causal effect (C7's +10 % price), sorted
    by the mean."""
    m = fitted_model(spark, sf_dir)
    s = scored(spark, sf_dir).withColumn("_eff", F.lit(m.tsls_coef * PCT_CHANGE / 100.0) * F.col("avg_reward_price"))
    return (s.groupBy("category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("_eff")).alias("mean_effect"),
                                      r6(F.stddev_samp("_eff")).alias("sd_effect"))
            .orderBy("mean_effect", "category"))
