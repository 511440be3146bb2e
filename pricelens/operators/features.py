"""Enrichment (E1 step 2) and causal features (E1 step 3) as DataFrame → DataFrame functions.

Covers P5-P28, J1, J5-J7 and W1-W4 of SURVEY §2. Every expression is a built-in; the only
shuffles are the neighbour count (J1) and the small per-group statistic tables joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.exprs import (array_mean, flag, holiday_flag, positive_tiers, safe_div,
                                       weekday)
from pricelens.operators.joins import join_small
from pricelens.operators.quantiles import exact_percentiles

DAY_SECONDS = 86400


def range_neighbour_count(df: DataFrame, key: str, ts: str, days: int, out: str,
                          null_key_value: int = 0, null_ts_value: int = 0,
                          exclude_self: bool = True) -> DataFrame:
    """Rows of the same ``key`` whose ``ts`` lies within ±``days`` (inclusive), minus self.

    Not an O(n²) self-join. Rows are first collapsed to (key, timestamp) counts, then split into
    (key, ``days``-wide bucket) partitions; each bucket also receives its two neighbours' rows as
    context, so the ±days range frame of every own row is complete inside one partition. A hot
    key is thereby spread over as many partitions as it has buckets, never one task.
    """
    width = days * DAY_SECONDS
    points = (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
              .groupBy(F.col(key).alias("_k"), F.col(ts).alias("_ts"))
              .agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_us", F.unix_micros(F.col("_ts").cast("timestamp")))
              .withColumn("_b", F.floor(F.col("_us") / F.lit(width * 1_000_000))))
    spread = points.withColumn("_shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    spread = spread.withColumn("_part", F.col("_b") + F.col("_shift"))
    w = (Window.partitionBy("_k", "_part").orderBy("_us")
         .rangeBetween(-width * 1_000_000, width * 1_000_000))
    counted = (spread.withColumn("_cnt", F.sum("_n").over(w))
               .where(F.col("_shift") == 0)
               .select(F.col("_k").alias(key), F.col("_ts").alias(ts), (F.col("_cnt") - (1 if exclude_self else 0)).alias("_cnt")))
    # A row a (key, timestamp): broadcast behind its measured size, so that the wide rows are not shuffled for it.
    joined = join_small(df, counted, [key, ts], "left")
    value = (F.when(F.col(ts).isNull(), F.lit(null_ts_value))
             .when(F.col(key).isNull(), F.lit(null_key_value))
             .otherwise(F.col("_cnt")).cast("int"))
    return joined.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


def tier_stats(df: DataFrame, tiers: str = "reward_tiers") -> DataFrame:
    """Count, min, max, mean and spread of the positive tier prices; empty → 0."""
    t = positive_tiers(tiers)
    return (df.withColumn("_tiers", t)
            .withColumn("num_reward_tiers", F.size("_tiers"))
            .withColumn("min_reward_price", F.coalesce(F.array_min("_tiers"), F.lit(0.0)))
            .withColumn("max_reward_price", F.coalesce(F.array_max("_tiers"), F.lit(0.0)))
            .withColumn("avg_reward_price", array_mean("_tiers"))
            .withColumn("price_spread", F.col("max_reward_price") - F.col("min_reward_price"))
            .drop("_tiers"))


def seasonality(df: DataFrame, ts: str = "launch_date") -> DataFrame:
    """Month, weekday (Mon=0), quarter label and the holiday-week flag."""
    return (df.withColumn("month", F.month(ts))
            .withColumn("day_of_week", weekday(ts))
            .withColumn("quarter", F.concat(F.lit("Q"), F.quarter(ts).cast("string")))
            .withColumn("is_holiday_week", holiday_flag(ts)))


def characteristics(df: DataFrame) -> DataFrame:
    """Updates per day and comments per backer (zero denominators → 1)."""
    return (df.withColumn("update_frequency", safe_div("num_updates", "campaign_duration_days"))
            .withColumn("engagement_ratio", safe_div("num_comments", "backers_count")))


def enrich(camp: DataFrame, window_days: int = 14) -> DataFrame:
    """``campaign_enriched``: competition, seasonality, tiers and characteristics (T27: existing
    trend/competition columns are kept)."""
    df = camp
    if "concurrent_campaigns" not in df.columns:
        df = range_neighbour_count(df, "category", "launch_date", window_days, "concurrent_campaigns")
    return characteristics(tier_stats(seasonality(df)))


def group_medians(df: DataFrame, cols: dict, group_cols=()) -> DataFrame:
    """Exact medians of several columns per group in one pass: (group…, name…)."""
    stacked = df.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(name).alias("v"), F.col(src).cast("double").alias("x"))
        for name, src in cols.items()])).alias("_s")).select(*group_cols, "_s.v", "_s.x")
    q = exact_percentiles(stacked, "x", [0.5], list(group_cols) + ["v"], names=["m"])
    return q.groupBy(*group_cols).agg(*[F.max(F.when(F.col("v") == name, F.col("m"))).alias(name)
                                        for name in cols])


def launch_weekday(df: DataFrame) -> Column:
    """Weekday of the launch date (null for a null date); a table without any launch date takes the stored
    ``day_of_week``, or 0 where there is none."""
    stored = F.col("day_of_week") if "day_of_week" in df.columns else F.lit(0)
    if "launch_date" not in df.columns:
        return stored
    dated = df.select(F.coalesce(F.max(F.col("launch_date").isNotNull()), F.lit(False))).scalar()
    return F.when(dated, weekday("launch_date")).otherwise(stored)


def causal_features(enriched: DataFrame, spike_threshold: float = 1.2) -> DataFrame:
    """``campaign_features``: outcomes, treatments, instruments, confounders and flags."""
    df = enriched
    cat_med = group_medians(df, {"_med_price": "avg_reward_price", "_med_goal": "funding_goal"},
                            ["category"])
    df = join_small(df, cat_med, "category", "left")
    glob = exact_percentiles(df, "trend_index", [0.5], names=["m"])
    med_trend = glob.select("m").scalar()
    mean_comp = df.select(F.avg("concurrent_campaigns")).scalar()
    df = (df
          .withColumn("funding_ratio", safe_div("pledged_amount", "funding_goal"))
          .withColumn("success_binary", flag(F.col("status") == "successful"))
          .withColumn("backers_per_day", safe_div("backers_count", "campaign_duration_days"))
          .withColumn("price_positioning", safe_div("avg_reward_price", "_med_price"))
          .withColumn("price_ambition", safe_div("avg_reward_price", F.col("funding_goal") / 100))
          .withColumn("goal_ambition", safe_div("funding_goal", "_med_goal"))
          .withColumn("launch_day_of_week", launch_weekday(df))
          .withColumn("is_weekend_launch", flag(F.col("launch_day_of_week") >= 5))
          .withColumn("holiday_proximity", F.col("is_holiday_week"))
          .withColumn("trend_spike", flag(F.col("trend_index") > med_trend * spike_threshold))
          .withColumn("competition_intensity",
                      F.when(mean_comp > 0, F.col("concurrent_campaigns") / mean_comp).otherwise(F.lit(1.0)))
          .withColumn("creator_experience_proxy", F.col("description_length"))
          .withColumn("demand_censored", flag(F.col("funding_ratio") > 3.0))
          .withColumn("is_outlier", flag((F.col("funding_ratio") > 10) | (F.col("avg_reward_price") > 1000)
                                         | (F.col("backers_count") > 10000))))
    return df.drop("_med_price", "_med_goal")


def success_tier(ratio) -> "F.Column":
    """Viral ≥ 3, strong_success ≥ 1.5, success ≥ 1, partial ≥ 0.5, else failed."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    return (F.when(r >= 3.0, F.lit("viral")).when(r >= 1.5, F.lit("strong_success"))
            .when(r >= 1.0, F.lit("success")).when(r >= 0.5, F.lit("partial")).otherwise(F.lit("failed")))


def length_bucket(days) -> "F.Column":
    """Null → medium, < 30 short, ≤ 45 medium, else long."""
    d = F.col(days) if isinstance(days, str) else days
    return (F.when(d.isNull(), F.lit("medium")).when(d < 30, F.lit("short"))
            .when(d <= 45, F.lit("medium")).otherwise(F.lit("long")))


def category_saturation(df: DataFrame, key: str = "category", ts: str = "launch_date") -> DataFrame:
    """Share of the year's campaigns that fall in this row's category.

    Two small count tables (category×year, year) joined back; null keys get null (T4)."""
    with_year = df.withColumn("year", F.year(ts))
    cy = with_year.groupBy(key, "year").agg(F.count(F.lit(1)).alias("_cy"))
    yt = with_year.groupBy("year").agg(F.count(F.lit(1)).alias("_yt"))
    share = cy.join(yt, "year").select(key, "year", (F.col("_cy") / F.col("_yt")).alias("category_saturation"))
    return join_small(with_year, share, [key, "year"], "left")


def notebook_features(enriched: DataFrame) -> DataFrame:
    """The research-notebook variant of the causal features (clipped ratio, category trend
    spike, z-score experience composite, saturation, early success, separate outlier flags)."""
    from pricelens.functions.exprs import clip, guard_greatest, scalars, try_div

    df = enriched
    ratio = clip(safe_div("pledged_amount", "funding_goal"), 0.0, 20.0)
    df = (df.withColumn("funding_ratio", ratio)
          .withColumn("success_binary", flag(F.col("status") == "successful"))
          .withColumn("backers_per_day", safe_div("backers_count", "campaign_duration_days"))
          .withColumn("overfunding_ratio", guard_greatest(F.col("funding_ratio") - 1.0, 0.0))
          .withColumn("log_avg_price", F.log1p("avg_reward_price"))
          .withColumn("campaign_length_category", length_bucket("campaign_duration_days"))
          .withColumn("is_weekend_launch", flag(F.col("day_of_week") >= 5)))
    meds = group_medians(df, {"_med_price": "avg_reward_price", "_med_goal": "funding_goal",
                              "_med_trend": "trend_index"}, ["category"])
    df = join_small(df, meds, "category", "left")
    st = scalars(df, md=F.avg("description_length"), sd=F.stddev_samp("description_length"),
                 mu=F.avg("update_frequency"), su=F.stddev_samp("update_frequency"),
                 mc=F.avg("concurrent_campaigns"))
    md, sd, mu, su, mc = (st[x] for x in ("md", "sd", "mu", "su", "mc"))
    bpd_med = exact_percentiles(df, "backers_per_day", [0.5], names=["m"]).select("m").scalar()
    df = (df.withColumn("price_positioning", safe_div("avg_reward_price", "_med_price"))
          .withColumn("price_ambition", safe_div("avg_reward_price", F.col("funding_goal") / 100))
          .withColumn("goal_ambition", safe_div("funding_goal", "_med_goal"))
          .withColumn("holiday_proximity", F.col("is_holiday_week"))
          .withColumn("trend_spike", flag(F.col("trend_index") > F.col("_med_trend") * 1.2))
          .withColumn("competition_intensity", try_div("concurrent_campaigns", mc))
          .withColumn("creator_experience_proxy",
                      (try_div(F.col("description_length") - md, sd) + try_div(F.col("update_frequency") - mu, su)) / 2)
          .withColumn("demand_censored", flag(F.col("funding_ratio") > 3.0))
          .withColumn("early_success", flag((F.col("funding_ratio") >= 1.0)
                                            & (F.col("backers_per_day") > bpd_med * 1.5)))
          .withColumn("is_outlier_funding", flag(F.col("funding_ratio") > 10))
          .withColumn("is_outlier_price", flag(F.col("avg_reward_price") > 1000)))
    df = category_saturation(df)
    return df.drop("_med_price", "_med_goal", "_med_trend")
