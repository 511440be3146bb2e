"""Window, top-k, sampling and split queries: W5, W8, W9, K2-K6."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.exprs import r6, safe_div
from pricelens.operators import ranking as rk
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import campaigns, features, staged
from pricelens.plans.registry import query
from pricelens.plans.sql import nz, with_views
from pricelens.plans.sql import r6 as s6

PAIRS_SQL = f"""
_nx AS (
  SELECT project_id, category, funding_goal, avg_reward_price, funding_ratio,
         lead(project_id) OVER w AS id2, lead(funding_goal) OVER w AS g2, lead(avg_reward_price) OVER w AS p2,
         lead(funding_ratio) OVER w AS o2
  FROM features WHERE category IS NOT NULL
  WINDOW w AS (PARTITION BY category ORDER BY funding_goal, project_id)
),
pairs AS (
  SELECT project_id AS campaign_1_id, id2 AS campaign_2_id, category, funding_goal AS goal_1, g2 AS goal_2,
         avg_reward_price AS price_1, p2 AS price_2, funding_ratio AS outcome_1, o2 AS outcome_2,
         CASE WHEN avg_reward_price <> 0 THEN (p2 - avg_reward_price) / avg_reward_price END * 100 AS price_change_pct,
         o2 - funding_ratio AS outcome_change
  FROM _nx
  WHERE id2 IS NOT NULL
    AND (CASE WHEN funding_goal > 0 THEN g2 / funding_goal ELSE 0.0::DOUBLE END) BETWEEN 0.8 AND 1.2
    AND ((CASE WHEN avg_reward_price > 0 THEN p2 / avg_reward_price ELSE 0.0::DOUBLE END) < 0.9
      OR (CASE WHEN avg_reward_price > 0 THEN p2 / avg_reward_price ELSE 0.0::DOUBLE END) > 1.1)
)"""

_PAIR_DBL = ["goal_1", "goal_2", "price_1", "price_2", "outcome_1", "outcome_2", "price_change_pct", "outcome_change"]


def pairs_df(spark, sf_dir):
    """Matched pairs as a stage table (the sort behind them is the expensive part; V1 reuses it)."""
    return staged(spark, sf_dir, "pairs", lambda: rk.matched_pairs(features(spark, sf_dir)))


@query("w5_matched_pairs", with_views(
    "SELECT campaign_1_id, campaign_2_id, category, " + ", ".join(f"{s6(c)} AS {c}" for c in _PAIR_DBL) + " FROM pairs",
    PAIRS_SQL, level="features"))
def w5_matched_pairs(spark, sf_dir):
    p = pairs_df(spark, sf_dir)
    return p.select("campaign_1_id", "campaign_2_id", "category", *[r6(c).alias(c) for c in _PAIR_DBL])


@query("w8_kfold", with_views("""
SELECT project_id, CAST(ntile(5) OVER (ORDER BY project_id) AS INTEGER) AS fold FROM campaign"""))
def w8_kfold(spark, sf_dir):
    return rk.contiguous_folds(campaigns(spark, sf_dir).select("project_id"), ["project_id"], 5)


@query("w9_quartiles", with_views("""
, _e AS (SELECT quantile_cont(goal_ambition, 0.0) AS e0, quantile_cont(goal_ambition, 0.25) AS e1,
                quantile_cont(goal_ambition, 0.5) AS e2, quantile_cont(goal_ambition, 0.75) AS e3,
                quantile_cont(goal_ambition, 1.0) AS e4 FROM features)
SELECT project_id,
  CASE WHEN goal_ambition >= e0 AND goal_ambition <= e1 THEN 'Low'
       WHEN goal_ambition > e1 AND goal_ambition <= e2 THEN 'Medium-Low'
       WHEN goal_ambition > e2 AND goal_ambition <= e3 THEN 'Medium-High'
       WHEN goal_ambition > e3 AND goal_ambition <= e4 THEN 'High' END AS goal_quartile
FROM features, _e""", level="features"))
def w9_quartiles(spark, sf_dir):
    f = features(spark, sf_dir)
    q = exact_percentiles(f, "goal_ambition", [0.0, 0.25, 0.5, 0.75, 1.0], names=["e0", "e1", "e2", "e3", "e4"])
    s = q.select(F.struct("e0", "e1", "e2", "e3", "e4")).scalar()
    edges = [s[f"e{i}"] for i in range(5)]
    return rk.quantile_bins(f, "goal_ambition", edges).select("project_id", "goal_quartile")


@query("k2_top_n", with_views(f"""
SELECT * FROM (SELECT 'top_price_variation' AS kind, project_id, {s6('price_spread / ' + nz('avg_reward_price'))} AS value
               FROM features ORDER BY price_spread / {nz('avg_reward_price')} DESC, project_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'bottom_price_spread', project_id, {s6('price_spread')} FROM features
               ORDER BY price_spread ASC, project_id LIMIT 50)""", level="features"))
def k2_top_n(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("price_variation", safe_div("price_spread", "avg_reward_price"))
    top = rk.top_n(f, "price_variation", 10).select(F.lit("top_price_variation").alias("kind"), "project_id",
                                                     r6("price_variation").alias("value"))
    bot = rk.top_n(f, "price_spread", 50, largest=False).select(F.lit("bottom_price_spread").alias("kind"),
                                                                 "project_id", r6("price_spread").alias("value"))
    return top.unionByName(bot)


@query("k3_hash_sample", with_views("""
SELECT project_id, category FROM campaign ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 50"""))
def k3_hash_sample(spark, sf_dir):
    return rk.hash_sample(campaigns(spark, sf_dir), 50).select("project_id", "category")


@query("k4_split", with_views("""
SELECT project_id, CASE WHEN (((project_id + 42) % 2147483648) * 2654435761) % 4294967296 % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM campaign"""))
def k4_split(spark, sf_dir):
    return rk.hash_split(campaigns(spark, sf_dir)).select("project_id", "split")


@query("k5_time_split", with_views("""
SELECT project_id, CASE WHEN year(launch_date) <= 2022 THEN 'train' WHEN year(launch_date) >= 2023 THEN 'test' END AS split
FROM campaign"""))
def k5_time_split(spark, sf_dir):
    return rk.time_split(campaigns(spark, sf_dir)).select("project_id", "split")


@query("k6_quota", with_views("""
, _r AS (SELECT project_id, status, row_number() OVER (PARTITION BY status ORDER BY project_id) - 1 AS rk
         FROM campaign WHERE status IN ('successful', 'failed'))
SELECT project_id, status FROM _r WHERE rk < 501
ORDER BY CASE WHEN status = 'successful' THEN 0 ELSE 1 END, rk LIMIT 1000"""))
def k6_quota(spark, sf_dir):
    return rk.balanced_quota(campaigns(spark, sf_dir), 1000).select("project_id", "status")
