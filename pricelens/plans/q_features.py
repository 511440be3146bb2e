"""Feature queries: P7-P28, J1, J5-J7 and W1-W4 over the campaign view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.exprs import clip, flag, r6, round_to, safe_div, try_div, year_holiday_flag
from pricelens.operators import features as fe
from pricelens.operators.joins import join_small
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import campaigns, enriched, features, staged
from pricelens.plans.registry import query
from pricelens.plans.sql import nz, with_views
from pricelens.plans.sql import r6 as s6

NOTEBOOK_CTE = f"""
_nbm AS (
  SELECT category, median(avg_reward_price) AS mp, median(funding_goal) AS mg, median(trend_index) AS mt
  FROM enriched WHERE category IS NOT NULL GROUP BY category
),
_nbs AS (
  SELECT avg(description_length) AS md, stddev_samp(description_length) AS sd,
         avg(update_frequency) AS mu, stddev_samp(update_frequency) AS su, avg(concurrent_campaigns) AS mc,
         median(backers_count / {nz('campaign_duration_days')}) AS bpd_med
  FROM enriched
),
_cy AS (SELECT category, year(launch_date) AS year, count(*) AS cy FROM enriched GROUP BY ALL),
_yt AS (SELECT year(launch_date) AS year, count(*) AS yt FROM enriched GROUP BY ALL),
notebook AS (
  SELECT e.*,
    least(greatest(e.pledged_amount / {nz('e.funding_goal')}, 0.0::DOUBLE), 20.0::DOUBLE) AS funding_ratio,
    e.backers_count / {nz('e.campaign_duration_days')} AS backers_per_day,
    e.avg_reward_price / {nz('m.mp')} AS price_positioning,
    e.funding_goal / {nz('m.mg')} AS goal_ambition,
    CASE WHEN e.trend_index > m.mt * 1.2::DOUBLE THEN 1 ELSE 0 END AS trend_spike,
    CASE WHEN s.mc <> 0 THEN e.concurrent_campaigns / s.mc END AS competition_intensity,
    ((CASE WHEN s.sd <> 0 THEN (e.description_length - s.md) / s.sd END)
      + (CASE WHEN s.su <> 0 THEN (e.update_frequency - s.mu) / s.su END)) / 2 AS creator_experience_proxy,
    s.bpd_med,
    CAST(year(e.launch_date) AS INTEGER) AS year,
    cy.cy / yt.yt AS category_saturation
  FROM enriched e LEFT JOIN _nbm m ON e.category = m.category CROSS JOIN _nbs s
  LEFT JOIN _cy cy ON e.category = cy.category AND year(e.launch_date) = cy.year
  LEFT JOIN _yt yt ON year(e.launch_date) = yt.year
)"""


def _nb(spark, sf_dir):
    """The notebook-variant feature table, staged (P20, W2, W4 read it)."""
    return staged(spark, sf_dir, "notebook", lambda: fe.notebook_features(enriched(spark, sf_dir)))


# --- P7 / P8: imputation ---------------------------------------------------------------------------

@query("p7_median_impute", with_views("""
, _d AS (SELECT project_id, CASE WHEN project_id % 9 = 0 THEN NULL ELSE description_length END AS dl FROM campaign)
SELECT project_id, dl AS description_length_raw,
       coalesce(CAST(dl AS DOUBLE), (SELECT median(dl) FROM _d)) AS description_length
FROM _d"""))
def p7_median_impute(spark, sf_dir):
    camp = campaigns(spark, sf_dir)
    d = camp.select("project_id", F.when(F.pmod("project_id", F.lit(9)) == 0, F.lit(None))
                    .otherwise(F.col("description_length")).cast("int").alias("description_length_raw"))
    med = exact_percentiles(d, "description_length_raw", [0.5], names=["m"]).select("m").scalar()
    return d.withColumn("description_length", F.coalesce(F.col("description_length_raw").cast("double"), med))


@query("p8_group_median_impute", with_views("""
, _t AS (SELECT project_id, category, CASE WHEN project_id % 7 = 0 THEN NULL ELSE trend_index END AS tr FROM campaign),
_m AS (SELECT category, median(tr) AS m FROM _t WHERE category IS NOT NULL GROUP BY category)
SELECT t.project_id, t.category, t.tr AS trend_index_raw, coalesce(CAST(t.tr AS DOUBLE), m.m) AS trend_index
FROM _t t LEFT JOIN _m m ON t.category = m.category"""))
def p8_group_median_impute(spark, sf_dir):
    camp = campaigns(spark, sf_dir)
    t = camp.select("project_id", "category", F.when(F.pmod("project_id", F.lit(7)) == 0, F.lit(None))
                    .otherwise(F.col("trend_index")).cast("int").alias("trend_index_raw"))
    m = exact_percentiles(t, "trend_index_raw", [0.5], ["category"], names=["m"]).drop("n")
    return (join_small(t, m, "category", "left")
            .select("project_id", "category", "trend_index_raw",
                    F.coalesce(F.col("trend_index_raw").cast("double"), F.col("m")).alias("trend_index")))


# --- P10-P16, P18-P21: row expressions --------------------------------------------------------------

@query("p10_funding_ratio", with_views(f"""
SELECT project_id,
  {s6('CASE WHEN funding_goal <> 0 THEN pledged_amount / funding_goal END')} AS ratio_raw,
  {s6('pledged_amount / ' + nz('funding_goal'))} AS ratio_safe,
  {s6('least(greatest(pledged_amount / ' + nz('funding_goal') + ', 0.0::DOUBLE), 20.0::DOUBLE)')} AS ratio_clipped,
  {s6('CASE WHEN funding_goal <= 0 THEN 0.0::DOUBLE ELSE pledged_amount / funding_goal END')} AS ratio_nonpositive_zero,
  CASE WHEN funding_goal > 0 THEN round(pledged_amount / funding_goal * 10000.0::DOUBLE) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio_rounded
FROM campaign"""))
def p10_funding_ratio(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    p, g = F.col("pledged_amount"), F.col("funding_goal")
    return c.select(
        "project_id",
        r6(try_div(p, g)).alias("ratio_raw"),
        r6(safe_div(p, g)).alias("ratio_safe"),
        r6(clip(safe_div(p, g), 0.0, 20.0)).alias("ratio_clipped"),
        r6(F.when(g <= 0, F.lit(0.0)).otherwise(p / g)).alias("ratio_nonpositive_zero"),
        F.when(g > 0, round_to(p / g, 4)).otherwise(F.lit(0.0)).alias("ratio_rounded"))


@query("p11_success_flags", with_views("""
SELECT project_id, CASE WHEN status = 'successful' THEN 1 ELSE 0 END AS success_by_status,
       CASE WHEN pledged_amount >= funding_goal THEN 1 ELSE 0 END AS success_by_amount,
       CASE WHEN pledged_amount / (CASE WHEN funding_goal = 0 THEN 1 ELSE funding_goal END) >= 1.0 THEN 1 ELSE 0 END AS success_by_ratio
FROM campaign"""))
def p11_success_flags(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    return c.select("project_id", flag(F.col("status") == "successful").alias("success_by_status"),
                    flag(F.col("pledged_amount") >= F.col("funding_goal")).alias("success_by_amount"),
                    flag(safe_div("pledged_amount", "funding_goal") >= 1.0).alias("success_by_ratio"))


@query("p12_p15_ratios", with_views(f"""
SELECT project_id,
  {s6('backers_count / ' + nz('campaign_duration_days'))} AS backers_per_day,
  {s6('pledged_amount / ' + nz('backers_count'))} AS pledged_per_backer,
  {s6('avg_reward_price / ' + nz('(funding_goal / 100)'))} AS price_ambition,
  {s6('num_updates / ' + nz('campaign_duration_days'))} AS update_frequency,
  {s6('num_comments / ' + nz('backers_count'))} AS engagement_ratio,
  {s6('price_spread / ' + nz('avg_reward_price'))} AS price_variation
FROM enriched""", level="enriched"))
def p12_p15_ratios(spark, sf_dir):
    e = fe.tier_stats(fe.characteristics(campaigns(spark, sf_dir)))
    return e.select(
        "project_id",
        r6(safe_div("backers_count", "campaign_duration_days")).alias("backers_per_day"),
        r6(safe_div("pledged_amount", "backers_count")).alias("pledged_per_backer"),
        r6(safe_div("avg_reward_price", F.col("funding_goal") / 100)).alias("price_ambition"),
        r6("update_frequency").alias("update_frequency"),
        r6("engagement_ratio").alias("engagement_ratio"),
        r6(safe_div("price_spread", "avg_reward_price")).alias("price_variation"))


@query("p16_p21_labels", with_views(f"""
, _r AS (SELECT *, least(greatest(pledged_amount / {nz('funding_goal')}, 0.0::DOUBLE), 20.0::DOUBLE) AS fr FROM enriched)
SELECT project_id,
  {s6('CASE WHEN fr IS NOT NULL THEN greatest(fr - 1.0::DOUBLE, 0.0::DOUBLE) END')} AS overfunding_ratio,
  {s6('ln(1 + avg_reward_price)')} AS log_avg_price,
  CASE WHEN campaign_duration_days IS NULL THEN 'medium' WHEN campaign_duration_days < 30 THEN 'short'
       WHEN campaign_duration_days <= 45 THEN 'medium' ELSE 'long' END AS campaign_length_category,
  CASE WHEN fr >= 3.0 THEN 'viral' WHEN fr >= 1.5 THEN 'strong_success' WHEN fr >= 1.0 THEN 'success'
       WHEN fr >= 0.5 THEN 'partial' ELSE 'failed' END AS success_tier,
  CASE WHEN fr > 3.0 THEN 1 ELSE 0 END AS demand_censored
FROM _r""", level="enriched"))
def p16_p21_labels(spark, sf_dir):
    e = fe.tier_stats(campaigns(spark, sf_dir))
    fr = clip(safe_div("pledged_amount", "funding_goal"), 0.0, 20.0)
    from pricelens.functions.exprs import guard_greatest
    return e.select("project_id",
                    r6(guard_greatest(fr - 1.0, 0.0)).alias("overfunding_ratio"),
                    r6(F.log1p("avg_reward_price")).alias("log_avg_price"),
                    fe.length_bucket("campaign_duration_days").alias("campaign_length_category"),
                    fe.success_tier(fr).alias("success_tier"),
                    flag(fr > 3.0).alias("demand_censored"))


@query("p19_outliers", with_views(f"""
, _r AS (SELECT *, pledged_amount / {nz('funding_goal')} AS fr FROM enriched)
SELECT project_id,
  CASE WHEN fr > 10 OR avg_reward_price > 1000 OR backers_count > 10000 THEN 1 ELSE 0 END AS is_outlier,
  CASE WHEN fr > 10 THEN 1 ELSE 0 END AS is_outlier_funding,
  CASE WHEN avg_reward_price > 1000 THEN 1 ELSE 0 END AS is_outlier_price
FROM _r""", level="enriched"))
def p19_outliers(spark, sf_dir):
    e = fe.tier_stats(campaigns(spark, sf_dir))
    fr = safe_div("pledged_amount", "funding_goal")
    return e.select("project_id",
                    flag((fr > 10) | (F.col("avg_reward_price") > 1000) | (F.col("backers_count") > 10000))
                    .alias("is_outlier"),
                    flag(fr > 10).alias("is_outlier_funding"),
                    flag(F.col("avg_reward_price") > 1000).alias("is_outlier_price"))


@query("p20_early_success", with_views("""
SELECT project_id, CASE WHEN funding_ratio >= 1.0 AND backers_per_day > bpd_med * 1.5::DOUBLE THEN 1 ELSE 0 END AS early_success
FROM notebook""", NOTEBOOK_CTE, level="enriched"))
def p20_early_success(spark, sf_dir):
    return _nb(spark, sf_dir).select("project_id", "early_success")


@query("p27_seasonality", with_views("""
SELECT project_id, month, day_of_week, quarter, is_holiday_week, CAST(year(launch_date) AS INTEGER) AS year,
       CASE WHEN month IN (1, 11, 12) THEN 1 ELSE 0 END AS is_winter_holiday_month
FROM enriched""", level="enriched"))
def p27_seasonality(spark, sf_dir):
    s = fe.seasonality(campaigns(spark, sf_dir))
    return s.select("project_id", "month", "day_of_week", "quarter", "is_holiday_week",
                    F.year("launch_date").alias("year"),
                    flag(F.col("month").isin(1, 11, 12)).alias("is_winter_holiday_month"))


@query("p28_tier_stats", with_views(f"""
SELECT project_id, num_reward_tiers, {s6('min_reward_price')} AS min_reward_price,
       {s6('max_reward_price')} AS max_reward_price, {s6('avg_reward_price')} AS avg_reward_price,
       {s6('price_spread')} AS price_spread
FROM enriched""", level="enriched"))
def p28_tier_stats(spark, sf_dir):
    t = fe.tier_stats(campaigns(spark, sf_dir))
    return t.select("project_id", "num_reward_tiers", *[r6(x).alias(x) for x in (
        "min_reward_price", "max_reward_price", "avg_reward_price", "price_spread")])


# --- J1 / J5 / J6 / J7 -----------------------------------------------------------------------------

@query("j1_concurrent_14d", with_views("""
SELECT project_id, category, concurrent_campaigns FROM enriched""", level="enriched"))
def j1_concurrent_14d(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    return fe.range_neighbour_count(c, "category", "launch_date", 14, "concurrent_campaigns").select(
        "project_id", "category", "concurrent_campaigns")


@query("j1_concurrent_7d", with_views("""
SELECT project_id, category,
  CASE WHEN launch_date IS NULL THEN 10 WHEN category IS NULL THEN -1
       ELSE CAST(count(*) OVER (PARTITION BY category ORDER BY launch_date
            RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING) - 1 AS INTEGER) END AS concurrent_campaigns
FROM campaign"""))
def j1_concurrent_7d(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    return fe.range_neighbour_count(c, "category", "launch_date", 7, "concurrent_campaigns",
                                    null_key_value=-1, null_ts_value=10).select(
        "project_id", "category", "concurrent_campaigns")


@query("j5_holiday_calendar", with_views("""
SELECT project_id, launch_date, is_holiday_week FROM enriched""", level="enriched"))
def j5_holiday_calendar(spark, sf_dir):
    return fe.seasonality(campaigns(spark, sf_dir)).select("project_id", "launch_date", "is_holiday_week")


@query("j6_holiday_year", with_views("""
SELECT project_id,
  CASE WHEN launch_date IS NULL THEN 0
       WHEN EXISTS (SELECT 1 FROM (VALUES (1, 1), (7, 4), (11, 24), (12, 25), (2, 14), (5, 10), (6, 15), (11, 27)) h(m, d)
                    WHERE abs(CAST(launch_date AS DATE) - make_date(year(launch_date), h.m, h.d)) <= 7) THEN 1
       ELSE 0 END AS holiday_proximity_year
FROM campaign"""))
def j6_holiday_year(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    return c.select("project_id", year_holiday_flag("launch_date").alias("holiday_proximity_year"))


@query("j7_saturation", with_views(f"""
SELECT project_id, category, year, {s6('category_saturation')} AS category_saturation FROM notebook""",
    NOTEBOOK_CTE, level="enriched"))
def j7_saturation(spark, sf_dir):
    s = fe.category_saturation(campaigns(spark, sf_dir))
    return s.select("project_id", "category", "year", r6("category_saturation").alias("category_saturation"))


# --- W1-W4 -----------------------------------------------------------------------------------------------

@query("w1_goal_ambition", with_views(f"""
SELECT project_id, category, {s6('goal_ambition')} AS goal_ambition, {s6('price_positioning')} AS price_positioning
FROM features""", level="features"))
def w1_goal_ambition(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("project_id", "category", r6("goal_ambition").alias("goal_ambition"),
                    r6("price_positioning").alias("price_positioning"))


@query("w2_trend_spike", with_views("""
SELECT f.project_id, f.trend_spike AS trend_spike_global, n.trend_spike AS trend_spike_category
FROM features f JOIN notebook n ON f.project_id = n.project_id""", NOTEBOOK_CTE, level="features"))
def w2_trend_spike(spark, sf_dir):
    f = features(spark, sf_dir).select("project_id", F.col("trend_spike").alias("trend_spike_global"))
    n = _nb(spark, sf_dir).select("project_id", F.col("trend_spike").alias("trend_spike_category"))
    return f.join(n, "project_id")


@query("w3_competition", with_views(f"""
SELECT project_id, concurrent_campaigns, {s6('competition_intensity')} AS competition_intensity FROM features""",
    level="features"))
def w3_competition(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("project_id", "concurrent_campaigns", r6("competition_intensity").alias("competition_intensity"))


@query("w4_experience", with_views(f"""
SELECT project_id, {s6('creator_experience_proxy')} AS experience_z, description_length AS experience_simple
FROM notebook""", NOTEBOOK_CTE, level="enriched"))
def w4_experience(spark, sf_dir):
    n = _nb(spark, sf_dir)
    return n.select("project_id", r6("creator_experience_proxy").alias("experience_z"),
                    F.col("description_length").alias("experience_simple"))


@query("causal_feature_table", with_views(f"""
SELECT project_id, {s6('funding_ratio')} AS funding_ratio, success_binary, {s6('backers_per_day')} AS backers_per_day,
       {s6('price_positioning')} AS price_positioning, {s6('price_ambition')} AS price_ambition,
       {s6('goal_ambition')} AS goal_ambition, is_weekend_launch, holiday_proximity, trend_spike,
       {s6('competition_intensity')} AS competition_intensity, creator_experience_proxy, demand_censored, is_outlier
FROM features""", level="features"))
def causal_feature_table(spark, sf_dir):
    f = features(spark, sf_dir)
    dbl = ["funding_ratio", "backers_per_day", "price_positioning", "price_ambition", "goal_ambition",
           "competition_intensity"]
    return f.select("project_id", *[r6(x).alias(x) if x in dbl else F.col(x) for x in [
        "funding_ratio", "success_binary", "backers_per_day", "price_positioning", "price_ambition",
        "goal_ambition", "is_weekend_launch", "holiday_proximity", "trend_spike", "competition_intensity",
        "creator_experience_proxy", "demand_censored", "is_outlier"]])


# --- P3 / P6 / P9 / P23: completeness filters and feature selection ---------------------------------

_CATEGORY_LIST = ["BUILDING", "MACHINERY", "FURNITURE"]


@query("p3_p9_filters", with_views(f"""
, _p AS (SELECT *, CASE WHEN project_id % 9 = 0 THEN NULL ELSE avg_reward_price END AS price_or_null FROM features)
SELECT 'all' AS step, count(*) AS n FROM _p
UNION ALL SELECT 'complete_required', count(*) FROM _p WHERE price_or_null IS NOT NULL AND funding_ratio IS NOT NULL
UNION ALL SELECT 'year_2021_2024', count(*) FROM _p WHERE year(launch_date) BETWEEN 2021 AND 2024
UNION ALL SELECT 'category_list', count(*) FROM _p WHERE category IN ({", ".join(f"'{c}'" for c in _CATEGORY_LIST)})
UNION ALL SELECT 'null_price_as_int_zero', count_if(coalesce(CAST(trunc(price_or_null) AS INTEGER), 0) = 0) FROM _p""",
    level="features"))
def p3_p9_filters(spark, sf_dir):
    """P3 complete-case drop, P9 year-range and category-list filters, P6 null → 0 as int."""
    f = features(spark, sf_dir).withColumn(
        "price_or_null", F.when(F.pmod("project_id", F.lit(9)) == 0, F.lit(None)).otherwise(F.col("avg_reward_price")))
    steps = [
        ("all", f),
        ("complete_required", f.na.drop(subset=["price_or_null", "funding_ratio"])),
        ("year_2021_2024", f.where(F.year("launch_date").between(2021, 2024))),
        ("category_list", f.where(F.col("category").isin(_CATEGORY_LIST))),
    ]
    out = None
    for name, d in steps:
        part = d.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    p6 = f.agg(F.lit("null_price_as_int_zero").alias("step"),
               F.count_if(F.coalesce(F.col("price_or_null").cast("int"), F.lit(0)) == 0).alias("n"))
    return out.unionByName(p6)


def select_features(df, wanted, target, text_prefix="nlp_dim_"):
    """The configured features that exist, plus every text dimension by prefix, then the
    complete-case rows (plan-time column check + ``na.drop``)."""
    cols = [c for c in wanted if c in df.columns] + sorted(c for c in df.columns if c.startswith(text_prefix))
    return df.select(*cols, target).na.drop(), cols


@query("p23_feature_selection")
def p23_feature_selection(spark, sf_dir):
    """Selected feature list (with text dims when present) and the complete-case row count."""
    from pricelens.plans.q_model import FEATURES, TARGET
    f = features(spark, sf_dir)
    sel, cols = select_features(f.withColumn("missing_feature_example", F.lit(None)), FEATURES + ["not_a_column"],
                                TARGET)
    return sel.agg(F.count(F.lit(1)).alias("complete_rows")).withColumn("features", F.lit(",".join(cols)))


# --- F2 / F8: formatting and labels -------------------------------------------------------------------

# Weekday names, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("f2_f8_format", with_views("""
SELECT project_id,
       '$' || format('{:,.2f}', round(funding_goal * 100.0::DOUBLE) / 100.0::DOUBLE) AS goal_text,
       format('{:.1f}', round(success_binary * 100.0::DOUBLE * 10.0::DOUBLE) / 10.0::DOUBLE) || '%' AS success_text,
       CASE day_of_week """ + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(WEEKDAYS)) + """ END AS weekday_name
FROM features""", level="features"))
def f2_f8_format(spark, sf_dir):
    """F2 currency `$x,xxx.xx` and percent text (values rounded to the shown digits first, so
    the half-even formatting never meets a tie), F8 weekday names."""
    f = features(spark, sf_dir)
    goal = F.round(F.col("funding_goal") * 100.0) / 100.0
    pct = F.round(F.col("success_binary") * 100.0 * 10.0) / 10.0
    name = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (F.col("day_of_week") + 1).cast("int"))
    return f.select("project_id", F.concat(F.lit("$"), F.format_number(goal, 2)).alias("goal_text"),
                    F.concat(F.format_number(pct, 1), F.lit("%")).alias("success_text"), name.alias("weekday_name"))
