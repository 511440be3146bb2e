"""DuckDB text of the campaign view and its derived views, used by every oracle query.

These are written independently of the Spark operators (window frames and EXISTS instead of the
bucketed count and the date-set lookup), so an oracle match checks the Spark plan, not a copy.
"""

from __future__ import annotations

from pricelens.functions.exprs import US_HOLIDAYS
from pricelens.sources.tables import CAMPAIGN_SQL

_HOLIDAY_VALUES = ", ".join(f"(TIMESTAMP '{y:04d}-{m:02d}-{d:02d}')" for y, m, d in US_HOLIDAYS)


def nz(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 1 ELSE {x} END)"


def r6(x: str) -> str:
    # + 0.0 turns -0.0 into 0.0, as Spark's rounding does
    return f"(round(({x}) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE + 0.0::DOUBLE)"


ENRICHED_CTE = f"""
_tiered AS (
  SELECT *, list_filter(coalesce(reward_tiers, []::DOUBLE[]), lambda x: x > 0) AS _pt FROM campaign
),
enriched AS (
  SELECT * EXCLUDE (_pt),
    CASE WHEN launch_date IS NULL THEN 0 WHEN category IS NULL THEN 0
         ELSE CAST(count(*) OVER (PARTITION BY category ORDER BY launch_date
              RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 14 DAY FOLLOWING) - 1 AS INTEGER)
    END AS concurrent_campaigns,
    CAST(month(launch_date) AS INTEGER) AS month,
    CAST(isodow(launch_date) - 1 AS INTEGER) AS day_of_week,
    'Q' || CAST(quarter(launch_date) AS VARCHAR) AS quarter,
    CASE WHEN EXISTS (SELECT 1 FROM (VALUES {_HOLIDAY_VALUES}) h(d)
                      WHERE abs(floor((epoch_us(_tiered.launch_date) - epoch_us(h.d)) / 86400000000.0::DOUBLE)) <= 7)
         THEN 1 ELSE 0 END AS is_holiday_week,
    CAST(len(_pt) AS INTEGER) AS num_reward_tiers,
    coalesce(list_min(_pt), 0.0::DOUBLE) AS min_reward_price,
    coalesce(list_max(_pt), 0.0::DOUBLE) AS max_reward_price,
    CASE WHEN len(_pt) > 0 THEN list_sum(_pt) / len(_pt) ELSE 0.0::DOUBLE END AS avg_reward_price,
    coalesce(list_max(_pt), 0.0::DOUBLE) - coalesce(list_min(_pt), 0.0::DOUBLE) AS price_spread,
    num_updates / {nz('campaign_duration_days')} AS update_frequency,
    num_comments / {nz('backers_count')} AS engagement_ratio
  FROM _tiered
)"""

FEATURES_CTE = f"""
_catmed AS (
  SELECT category, median(avg_reward_price) AS _med_price, median(funding_goal) AS _med_goal
  FROM enriched WHERE category IS NOT NULL GROUP BY category
),
_glob AS (
  SELECT median(trend_index) AS _med_trend, avg(concurrent_campaigns) AS _mean_comp FROM enriched
),
features AS (
  SELECT e.*,
    e.pledged_amount / {nz('e.funding_goal')} AS funding_ratio,
    CASE WHEN e.status = 'successful' THEN 1 ELSE 0 END AS success_binary,
    e.backers_count / {nz('e.campaign_duration_days')} AS backers_per_day,
    e.avg_reward_price / {nz('m._med_price')} AS price_positioning,
    e.avg_reward_price / {nz('(e.funding_goal / 100)')} AS price_ambition,
    e.funding_goal / {nz('m._med_goal')} AS goal_ambition,
    e.day_of_week AS launch_day_of_week,
    CASE WHEN e.day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend_launch,
    e.is_holiday_week AS holiday_proximity,
    CASE WHEN e.trend_index > g._med_trend * 1.2::DOUBLE THEN 1 ELSE 0 END AS trend_spike,
    CASE WHEN g._mean_comp > 0 THEN e.concurrent_campaigns / g._mean_comp ELSE 1.0::DOUBLE END AS competition_intensity,
    e.description_length AS creator_experience_proxy,
    CASE WHEN e.pledged_amount / {nz('e.funding_goal')} > 3.0::DOUBLE THEN 1 ELSE 0 END AS demand_censored,
    CASE WHEN e.pledged_amount / {nz('e.funding_goal')} > 10 OR e.avg_reward_price > 1000
              OR e.backers_count > 10000 THEN 1 ELSE 0 END AS is_outlier
  FROM enriched e LEFT JOIN _catmed m ON e.category = m.category CROSS JOIN _glob g
)"""


def with_views(body: str, *ctes: str, level: str = "campaign") -> str:
    """Prefix ``body`` with the campaign view and, by ``level``, the enriched/features views."""
    parts = []
    if level in ("enriched", "features"):
        parts.append(ENRICHED_CTE)
    if level == "features":
        parts.append(FEATURES_CTE)
    parts.extend(ctes)
    extra = "".join("," + p for p in parts)
    return CAMPAIGN_SQL + extra + "\n" + body
