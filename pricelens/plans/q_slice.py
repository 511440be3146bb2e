"""Minimum slice: naive price slope and the weekend-launch Wald IV per category."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.exprs import array_mean, flag, positive_tiers, r6, safe_div, weekday
from pricelens.plans.common import campaigns
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views


def price_iv_by_category(camp):
    df = camp.select(
        "category",
        safe_div("pledged_amount", "funding_goal").alias("ratio"),
        array_mean(positive_tiers("reward_tiers")).alias("price"),
        flag(weekday("launch_date") >= 5).alias("weekend"))
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.regr_slope("ratio", "price")).alias("naive_slope"),
        r6(F.covar_samp("weekend", "ratio") / F.nullif(F.covar_samp("weekend", "price"), F.lit(0.0)))
        .alias("wald_iv"))


SLICE_SQL = with_views(f"""
, _s AS (
  SELECT category, pledged_amount / (CASE WHEN funding_goal = 0 THEN 1 ELSE funding_goal END) AS ratio,
         CASE WHEN len(list_filter(coalesce(reward_tiers, []::DOUBLE[]), lambda x: x > 0)) > 0
              THEN list_sum(list_filter(reward_tiers, lambda x: x > 0)) / len(list_filter(reward_tiers, lambda x: x > 0))
              ELSE 0.0::DOUBLE END AS price,
         CASE WHEN isodow(launch_date) - 1 >= 5 THEN 1 ELSE 0 END AS weekend
  FROM campaign)
SELECT category, count(*) AS n, {s6('regr_slope(ratio, price)')} AS naive_slope,
       {s6('covar_samp(weekend, ratio) / nullif(covar_samp(weekend, price), 0)')} AS wald_iv
FROM _s GROUP BY category""")


@query("slice_price_iv", SLICE_SQL)
def slice_price_iv(spark, sf_dir):
    return price_iv_by_category(campaigns(spark, sf_dir))
