"""Aggregate queries A1-A24 over the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pricelens.functions.exprs import r6
from pricelens.operators import aggregates as ag
from pricelens.operators.features import length_bucket
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import campaigns, features
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views
from pricelens.sources import derived, ingest

# Category list served when there is no data, and the default trend keyword.
DEFAULT_CATEGORIES = ["Technology", "Games", "Design", "Film", "Music", "Art"]
DEFAULT_MODE = "kickstarter"


def _fsql(body, *ctes):
    return with_views(body, *ctes, level="features")


_MEASURES = {"success_rate": "success_binary", "mean_pledged": "pledged_amount",
             "mean_price": "avg_reward_price", "mean_ratio": "funding_ratio"}


def _group_sql(dim):
    m = ", ".join(f"{s6(f'avg({src})')} AS {name}" for name, src in _MEASURES.items())
    return f"SELECT '{dim}' AS dim, CAST({dim} AS VARCHAR) AS key, count(*) AS n, {m} FROM features GROUP BY {dim}"


@query("a1_group_means", _fsql("\nUNION ALL\n".join(_group_sql(d) for d in ("category", "day_of_week", "month"))))
def a1_group_means(spark, sf_dir):
    return ag.group_means(features(spark, sf_dir), ["category", "day_of_week", "month"], _MEASURES)


@query("a2_holiday_means", _fsql(f"""
SELECT is_holiday_week, count(*) AS n, {s6('avg(funding_ratio)')} AS mean_ratio,
       {s6('avg(avg_reward_price)')} AS mean_price
FROM features GROUP BY is_holiday_week"""))
def a2_holiday_means(spark, sf_dir):
    return features(spark, sf_dir).groupBy("is_holiday_week").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("funding_ratio")).alias("mean_ratio"),
        r6(F.avg("avg_reward_price")).alias("mean_price"))


_SHARE_COLS = ["status", "category", "quarter", "day_of_week", "country", "length_bucket"]


@query("a4_value_shares", _fsql("""
, _lb AS (SELECT *, CASE WHEN campaign_duration_days IS NULL THEN 'medium' WHEN campaign_duration_days < 30 THEN 'short'
                          WHEN campaign_duration_days <= 45 THEN 'medium' ELSE 'long' END AS length_bucket FROM features),
_vc AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM _lb GROUP BY {c}" for c in _SHARE_COLS) + f""")
SELECT column_name, value, n, {s6('n / sum(n) OVER (PARTITION BY column_name)')} AS share FROM _vc"""))
def a4_value_shares(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("length_bucket", length_bucket("campaign_duration_days"))
    return ag.value_shares(f, _SHARE_COLS)


@query("a5_distinct", _fsql("""
SELECT count(DISTINCT category) AS n_categories, count(DISTINCT subcategory) AS n_subcategories,
       count(DISTINCT country) AS n_countries, count(DISTINCT name) AS n_names FROM features"""))
def a5_distinct(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.agg(*[F.countDistinct(c).alias(n) for c, n in (
        ("category", "n_categories"), ("subcategory", "n_subcategories"), ("country", "n_countries"),
        ("name", "n_names"))])


@query("a6_categories", _fsql("""
, _c AS (SELECT DISTINCT category FROM features WHERE category IS NOT NULL ORDER BY category LIMIT 50)
SELECT category FROM _c
UNION ALL
SELECT d FROM (VALUES """ + ", ".join(f"('{x}')" for x in DEFAULT_CATEGORIES) + """) t(d)
WHERE NOT EXISTS (SELECT 1 FROM _c)"""))
def a6_categories(spark, sf_dir):
    f = features(spark, sf_dir)
    top = f.where(F.col("category").isNotNull()).select("category").distinct().orderBy("category").limit(50)
    defaults = spark.createDataFrame([(x,) for x in DEFAULT_CATEGORIES], "category string")
    fallback = defaults.where(~top.exists())  # uncorrelated EXISTS: a filter, not a join
    return top.unionByName(fallback)


_PROFILE_COLS = ["funding_goal", "pledged_amount", "backers_count", "avg_reward_price", "funding_ratio",
                 "concurrent_campaigns", "trend_index"]


@query("a7_profile", _fsql("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std,
       {s6(f'min({c})::DOUBLE')} AS min, {s6(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25,
       {s6(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50, {s6(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75,
       {s6(f'max({c})::DOUBLE')} AS max FROM features""" for c in _PROFILE_COLS)))
def a7_profile(spark, sf_dir):
    return ag.profile(features(spark, sf_dir), _PROFILE_COLS)


@query("a8_missing", with_views("""
, _m AS (
  SELECT 'launch_date' AS column_name, count_if(TRY_CAST(launched AS TIMESTAMP) IS NULL) AS n_missing, count(*) AS n FROM _raw
  UNION ALL SELECT 'end_date', count_if(TRY_CAST(deadline AS TIMESTAMP) IS NULL), count(*) FROM _raw
  UNION ALL SELECT 'goal_num', count_if(TRY_CAST(goal_text AS DOUBLE) IS NULL), count(*) FROM _raw
  UNION ALL SELECT 'state', count_if(state IS NULL), count(*) FROM _raw
  UNION ALL SELECT 'reward_tiers', count_if(reward_tiers IS NULL), count(*) FROM campaign
)
SELECT column_name, n_missing, round(n_missing * 100.0::DOUBLE / n * 100.0::DOUBLE) / 100.0::DOUBLE AS pct_missing
FROM _m WHERE n_missing > 0""", derived.RAW_SQL))
def a8_missing(spark, sf_dir):
    camp = campaigns(spark, sf_dir)
    raw = ingest.normalise_columns(derived.raw_dump(camp))
    coerced = raw.select(ingest.coerce_timestamp("launched").alias("launch_date"),
                         ingest.coerce_timestamp("deadline").alias("end_date"),
                         ingest.coerce_number("goal_text").alias("goal_num"), "state")
    return ag.missing_report(coerced).unionByName(ag.missing_report(camp, ["reward_tiers"]))


@query("a9_global_stats", _fsql(f"""
SELECT count(*) AS n_total, count_if(status = 'successful') AS n_successful, count_if(status = 'failed') AS n_failed,
       {s6('median(funding_goal)')} AS median_goal, {s6('avg(funding_ratio)')} AS mean_ratio,
       {s6('min(funding_goal)')} AS min_goal, {s6('max(funding_goal)')} AS max_goal,
       CAST(min(launch_date) AS DATE) AS first_launch, CAST(max(launch_date) AS DATE) AS last_launch,
       count_if(funding_ratio > 3) AS n_ratio_over_3
FROM features"""))
def a9_global_stats(spark, sf_dir):
    f = features(spark, sf_dir)
    med = exact_percentiles(f, "funding_goal", [0.5], names=["m"]).select("m").scalar()
    return f.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("status") == "successful").alias("n_successful"),
                 F.count_if(F.col("status") == "failed").alias("n_failed"), r6(med).alias("median_goal"),
                 r6(F.avg("funding_ratio")).alias("mean_ratio"), r6(F.min("funding_goal")).alias("min_goal"),
                 r6(F.max("funding_goal")).alias("max_goal"), F.to_date(F.min("launch_date")).alias("first_launch"),
                 F.to_date(F.max("launch_date")).alias("last_launch"),
                 F.count_if(F.col("funding_ratio") > 3).alias("n_ratio_over_3"))


_FLAGS = ["is_holiday_week", "is_weekend_launch", "trend_spike", "demand_censored", "is_outlier", "success_binary"]


@query("a10_flag_shares", _fsql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS flag, count_if({c} = 1) AS n_true, {s6(f'avg({c})')} AS share FROM features" for c in _FLAGS)))
def a10_flag_shares(spark, sf_dir):
    f = features(spark, sf_dir)
    row = f.agg(*[F.count_if(F.col(c) == 1).alias(f"n{i}") for i, c in enumerate(_FLAGS)],
                *[F.avg(c).alias(f"s{i}") for i, c in enumerate(_FLAGS)])
    stack = "stack({}, {}) as (flag, n_true, share)".format(
        len(_FLAGS), ", ".join(f"'{c}', n{i}, s{i}" for i, c in enumerate(_FLAGS)))
    return row.select(F.expr(stack)).select("flag", "n_true", r6("share").alias("share"))


_PCTS = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
_PCT_COLS = ["funding_ratio", "funding_goal", "avg_reward_price"]
_PCT_NAMES = ["p10", "p25", "p50", "p75", "p90", "p95"]


@query("a11_percentiles", _fsql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"{s6(f'quantile_cont({c}, {p})')} AS {n}" for p, n in zip(_PCTS, _PCT_NAMES))
    + " FROM features" for c in _PCT_COLS)))
def a11_percentiles(spark, sf_dir):
    f = features(spark, sf_dir)
    stacked = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"))
                                           for c in _PCT_COLS])).alias("s")).select("s.column_name", "s.x")
    q = exact_percentiles(stacked, "x", _PCTS, ["column_name"], names=_PCT_NAMES)
    return q.select("column_name", *[r6(n).alias(n) for n in _PCT_NAMES])


@query("a12_monthly", _fsql(f"""
, _m AS (SELECT CAST(date_trunc('month', launch_date) AS DATE) AS month, success_binary FROM features),
_c AS (SELECT month, count(*) AS n, avg(success_binary) AS sr FROM _m GROUP BY month),
_s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM _m)
SELECT s.month, coalesce(c.n, 0) AS n, {s6('c.sr')} AS success_rate FROM _s s LEFT JOIN _c c ON s.month = c.month"""))
def a12_monthly(spark, sf_dir):
    return ag.monthly_spine(features(spark, sf_dir), "launch_date", "success_binary")


def _hist_sql(name, expr, bins, lo=None, hi=None):
    cond = f"AND _x >= {lo} AND _x <= {hi}" if lo is not None else ""
    base = f"(SELECT _x FROM (SELECT {expr} AS _x FROM features) _i WHERE _x IS NOT NULL {cond})"
    rng = (f"(SELECT {float(lo)}::DOUBLE AS lo, {float(hi)}::DOUBLE AS hi)" if lo is not None
           else f"(SELECT min(_x) AS lo, max(_x) AS hi FROM {base} _b1)")
    return f"""SELECT '{name}' AS hist, s.bin, {s6(f'r.lo + s.bin * ((r.hi - r.lo) / {bins})')} AS bin_lo,
       {s6(f'r.lo + (s.bin + 1) * ((r.hi - r.lo) / {bins})')} AS bin_hi, coalesce(c.n, 0) AS n
FROM {rng} r CROSS JOIN (SELECT CAST(unnest(range(0, {bins})) AS INTEGER) AS bin) s
LEFT JOIN (
  SELECT CAST(CASE WHEN (r2.hi - r2.lo) / {bins} = 0 THEN 0
                   ELSE least(floor((b._x - r2.lo) / ((r2.hi - r2.lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
         count(*) AS n
  FROM {base} b CROSS JOIN {rng} r2 GROUP BY 1
) c ON s.bin = c.bin"""


@query("a13_histogram", _fsql("\nUNION ALL\n".join([
    _hist_sql("funding_ratio_0_5", "funding_ratio", 50, 0, 5),
    _hist_sql("log10_goal", "log10(greatest(funding_goal, 100.0::DOUBLE))", 30),
    _hist_sql("price_clip_500", "least(avg_reward_price, 500.0::DOUBLE)", 40)])))
def a13_histogram(spark, sf_dir):
    f = features(spark, sf_dir).select(
        "funding_ratio", F.log10(F.greatest(F.col("funding_goal"), F.lit(100.0))).alias("lg"),
        F.least(F.col("avg_reward_price"), F.lit(500.0)).alias("pc"))
    return reduce(lambda a, b: a.unionByName(b), [
        ag.histogram(f, "funding_ratio", 50, "funding_ratio_0_5", 0.0, 5.0),
        ag.histogram(f, "lg", 30, "log10_goal"),
        ag.histogram(f, "pc", 40, "price_clip_500")])


@query("a14_box", _fsql(f"""
, _q AS (SELECT category, count(funding_ratio) AS n, quantile_cont(funding_ratio, 0.25) AS q1,
                quantile_cont(funding_ratio, 0.5) AS med, quantile_cont(funding_ratio, 0.75) AS q3
         FROM features GROUP BY category)
SELECT q.category, q.n, {s6('q.q1')} AS q1, {s6('q.med')} AS median, {s6('q.q3')} AS q3, {s6('q.q3 - q.q1')} AS iqr,
       {s6('min(CASE WHEN f.funding_ratio >= q.q1 - 1.5 * (q.q3 - q.q1) THEN f.funding_ratio END)')} AS whisker_low,
       {s6('max(CASE WHEN f.funding_ratio <= q.q3 + 1.5 * (q.q3 - q.q1) THEN f.funding_ratio END)')} AS whisker_high,
       CAST(sum(CASE WHEN f.funding_ratio < q.q1 - 1.5 * (q.q3 - q.q1) OR f.funding_ratio > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM features f JOIN _q q ON f.category = q.category GROUP BY q.category, q.n, q.q1, q.med, q.q3"""))
def a14_box(spark, sf_dir):
    return ag.box_stats(features(spark, sf_dir), "funding_ratio", "category")


_CORR_COLS = ["funding_ratio", "avg_reward_price", "goal_ambition", "campaign_duration_days", "trend_index",
              "concurrent_campaigns"]


@query("a15_corr_matrix", _fsql("\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {s6(f'corr({a}, {b})')} AS r FROM features"
    for a in _CORR_COLS for b in _CORR_COLS)))
def a15_corr_matrix(spark, sf_dir):
    return ag.corr_matrix(features(spark, sf_dir), _CORR_COLS)


_IVS = ["day_of_week", "is_weekend_launch", "holiday_proximity", "trend_spike"]


@query("a16_instrument_corr", _fsql("\nUNION ALL\n".join(
    f"""SELECT '{iv}' AS instrument, {s6(f'corr({iv}, avg_reward_price)')} AS corr_treatment,
       {s6(f'corr({iv}, funding_ratio)')} AS corr_outcome,
       CASE WHEN abs(corr({iv}, avg_reward_price)) < 0.2 THEN 'valid' ELSE 'weak' END AS validity FROM features"""
    for iv in _IVS)))
def a16_instrument_corr(spark, sf_dir):
    return ag.instrument_correlations(features(spark, sf_dir), _IVS, "avg_reward_price", "funding_ratio")


@query("a17_ttest", _fsql(f"""
, _g AS (SELECT count_if(success_binary = 1) AS n1, count_if(success_binary = 0) AS n0,
                avg(CASE WHEN success_binary = 1 THEN avg_reward_price END) AS m1,
                avg(CASE WHEN success_binary = 0 THEN avg_reward_price END) AS m0,
                var_samp(CASE WHEN success_binary = 1 THEN avg_reward_price END) AS v1,
                var_samp(CASE WHEN success_binary = 0 THEN avg_reward_price END) AS v0 FROM features)
SELECT n1, n0, {s6('m1')} AS mean_1, {s6('m0')} AS mean_0, {s6('m1 - m0')} AS difference,
       {s6('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0))')} AS t_stat,
       n1 + n0 - 2 AS dof FROM _g"""))
def a17_ttest(spark, sf_dir):
    return ag.pooled_ttest(features(spark, sf_dir), "avg_reward_price", "success_binary")


@query("a18_trend_line", _fsql(f"""
SELECT category, {s6('regr_slope(funding_ratio, goal_ambition)')} AS slope,
       {s6('regr_intercept(funding_ratio, goal_ambition)')} AS intercept FROM features GROUP BY category
UNION ALL
SELECT 'ALL', {s6('regr_slope(funding_ratio, goal_ambition)')}, {s6('regr_intercept(funding_ratio, goal_ambition)')} FROM features"""))
def a18_trend_line(spark, sf_dir):
    f = features(spark, sf_dir)
    aggs = [r6(F.regr_slope("funding_ratio", "goal_ambition")).alias("slope"),
            r6(F.regr_intercept("funding_ratio", "goal_ambition")).alias("intercept")]
    return f.groupBy("category").agg(*aggs).unionByName(f.agg(*aggs).select(F.lit("ALL").alias("category"), "slope", "intercept"))


_FIT_SQL = """
_fit AS (SELECT regr_slope(funding_ratio, avg_reward_price) AS b, regr_intercept(funding_ratio, avg_reward_price) AS a,
                avg(funding_ratio) AS ybar FROM features),
_pred AS (SELECT f.funding_ratio AS y, _fit.a + _fit.b * f.avg_reward_price AS yhat, _fit.ybar FROM features f, _fit)"""


def _single_fit(f):
    fit = f.agg(F.regr_slope("funding_ratio", "avg_reward_price").alias("b"),
                F.regr_intercept("funding_ratio", "avg_reward_price").alias("a"),
                F.avg("funding_ratio").alias("ybar"))
    s = fit.select(F.struct("a", "b", "ybar")).scalar()
    return f.select(F.col("funding_ratio").alias("y"), (s["a"] + s["b"] * F.col("avg_reward_price")).alias("yhat"),
                    s["ybar"].alias("ybar"))


@query("a19_errors", _fsql(f"""
SELECT count(*) AS n, {s6('1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))')} AS r2,
       {s6('avg(abs(y - yhat))')} AS mae, {s6('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse,
       {s6('median(abs(y - yhat))')} AS median_ae FROM _pred""", _FIT_SQL))
def a19_errors(spark, sf_dir):
    return ag.error_metrics(_single_fit(features(spark, sf_dir)), "y", "yhat")


@query("a20_naive_baseline", _fsql(f"""
SELECT {s6('avg(abs(y - ybar))')} AS baseline_mae, {s6('avg(abs(y - yhat))')} AS model_mae,
       {s6('(avg(abs(y - ybar)) - avg(abs(y - yhat))) / avg(abs(y - ybar)) * 100')} AS improvement_pct FROM _pred""", _FIT_SQL))
def a20_naive_baseline(spark, sf_dir):
    p = _single_fit(features(spark, sf_dir))
    b, m = F.avg(F.abs(F.col("y") - F.col("ybar"))), F.avg(F.abs(F.col("y") - F.col("yhat")))
    return p.agg(r6(b).alias("baseline_mae"), r6(m).alias("model_mae"), r6((b - m) / b * 100).alias("improvement_pct"))


@query("a21_best_group", _fsql(f"""
, _g AS (SELECT category, avg(success_binary) AS rate FROM features GROUP BY category),
_top AS (SELECT country, avg(pledged_amount) AS mp FROM features GROUP BY country ORDER BY mp DESC, country LIMIT 10)
SELECT 'best_category' AS kind, (SELECT category FROM _g ORDER BY rate DESC, category LIMIT 1) AS key,
       {s6('(SELECT max(rate) FROM _g)')} AS value
UNION ALL SELECT 'top_country_pledged', country, {s6('mp')} FROM _top"""))
def a21_best_group(spark, sf_dir):
    f = features(spark, sf_dir)
    g = f.groupBy("category").agg(F.avg("success_binary").alias("rate"))
    best = g.agg(F.min_by("category", F.struct((-F.col("rate")).alias("r"), F.col("category").alias("c"))).alias("key"),
                 r6(F.max("rate")).alias("value")).select(F.lit("best_category").alias("kind"), "key", "value")
    top = (f.groupBy("country").agg(F.avg("pledged_amount").alias("mp"))
           .orderBy(F.col("mp").desc(), "country").limit(10)
           .select(F.lit("top_country_pledged").alias("kind"), F.col("country").alias("key"), r6("mp").alias("value")))
    return best.unionByName(top)


@query("a22_overview", _fsql(f"""
SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM features
UNION ALL SELECT 'success_rate', {s6('avg(success_binary)')} FROM features
UNION ALL SELECT 'median_goal', {s6('median(funding_goal)')} FROM features
UNION ALL SELECT 'concurrent_mean', {s6('avg(concurrent_campaigns)')} FROM features
UNION ALL SELECT 'concurrent_sd', {s6('stddev_samp(concurrent_campaigns)')} FROM features
UNION ALL SELECT 'concurrent_max', max(concurrent_campaigns)::DOUBLE FROM features
UNION ALL SELECT 'avg_price_mean', {s6('avg(avg_reward_price)')} FROM features
UNION ALL SELECT 'avg_price_sd', {s6('stddev_samp(avg_reward_price)')} FROM features
UNION ALL SELECT 'avg_price_max', {s6('max(avg_reward_price)')} FROM features
UNION ALL SELECT 'holiday_mean', {s6('avg(is_holiday_week)')} FROM features
UNION ALL SELECT 'with_tiers', count_if(num_reward_tiers > 0)::DOUBLE FROM features"""))
def a22_overview(spark, sf_dir):
    f = features(spark, sf_dir)
    med = exact_percentiles(f, "funding_goal", [0.5], names=["m"]).select("m").scalar()
    row = f.agg(F.count(F.lit(1)).cast("double").alias("rows"), r6(F.avg("success_binary")).alias("success_rate"),
                r6(med).alias("median_goal"), r6(F.avg("concurrent_campaigns")).alias("concurrent_mean"),
                r6(F.stddev_samp("concurrent_campaigns")).alias("concurrent_sd"),
                F.max("concurrent_campaigns").cast("double").alias("concurrent_max"),
                r6(F.avg("avg_reward_price")).alias("avg_price_mean"),
                r6(F.stddev_samp("avg_reward_price")).alias("avg_price_sd"),
                r6(F.max("avg_reward_price")).alias("avg_price_max"),
                r6(F.avg("is_holiday_week")).alias("holiday_mean"),
                F.count_if(F.col("num_reward_tiers") > 0).cast("double").alias("with_tiers"))
    names = row.columns
    stack = "stack({}, {}) as (metric, value)".format(len(names), ", ".join(f"'{n}', {n}" for n in names))
    return row.select(F.expr(stack))


@query("a23_mode", _fsql(f"""
SELECT 'category' AS column_name, coalesce((SELECT category FROM features WHERE category IS NOT NULL GROUP BY category
                                       ORDER BY count(*) DESC, category LIMIT 1), '{DEFAULT_MODE}') AS mode
UNION ALL
SELECT 'subcategory', coalesce((SELECT subcategory FROM features WHERE subcategory IS NOT NULL GROUP BY subcategory
                                ORDER BY count(*) DESC, subcategory LIMIT 1), '{DEFAULT_MODE}')"""))
def a23_mode(spark, sf_dir):
    f = features(spark, sf_dir)
    return (ag.mode_with_default(f, "category", DEFAULT_MODE).select(F.lit("category").alias("column_name"), "mode")
            .unionByName(ag.mode_with_default(f, "subcategory", DEFAULT_MODE)
                         .select(F.lit("subcategory").alias("column_name"), "mode")))


@query("a24_schema")
def a24_schema(spark, sf_dir):
    """Schema report with non-null counts (rows-only: type names differ between engines)."""
    f = features(spark, sf_dir)
    types = dict(f.dtypes)
    row = f.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(f.columns)])
    stack = "stack({}, {}) as (column_name, type, non_null)".format(
        len(f.columns), ", ".join(f"'{c}', '{types[c]}', c{i}" for i, c in enumerate(f.columns)))
    return row.select(F.expr(stack))
