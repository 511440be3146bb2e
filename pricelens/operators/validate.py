"""Model validation operators (V1-V15): matched-pair errors, changers, placebo, bounds, invariants.

Each check is a projection plus one aggregation over the whole table (or a top-n / hash sample
where the sample *is* the check), returning tidy (test, metric, value, status) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.exprs import r6
from pricelens.operators.quantiles import exact_percentiles
from pricelens.operators.scenario import ScoringModel


def model_values(cols: Sequence[str], scale: float | None = None, overrides: dict | None = None) -> dict:
    """Feature expressions as the validators feed them: nulls → 0, optional uniform scaling."""
    vals = {}
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        vals[c] = x * F.lit(scale) if scale is not None else x
    vals.update(overrides or {})
    return vals


def pair_errors(pairs: DataFrame, feats: DataFrame, model: ScoringModel, key: str = "project_id") -> DataFrame:
    """V1: predict campaign 1 at campaign 2's price change and compare with campaign 2's outcome.
    J8: the left campaign's row is found by an equi-join on its id."""
    left = feats.select(F.col(key).alias("campaign_1_id"), *model.features)
    j = pairs.join(left, "campaign_1_id")
    new_price = F.col("avg_reward_price") * (F.lit(1.0) + F.col("price_change_pct") / 100)
    pred = model.predict(model_values(model.features, overrides={"avg_reward_price": new_price}))
    return j.select("campaign_1_id", "campaign_2_id", pred.alias("predicted"), F.col("outcome_2").alias("actual"),
                    F.abs(pred - F.col("outcome_2")).alias("error"), "price_change_pct").where(F.col("error").isNotNull())


def error_summary(errors: DataFrame, col: str = "error") -> DataFrame:
    """n, MAE, RMSE, median and the 25/50/75/90th percentiles of absolute errors."""
    q = exact_percentiles(errors, col, [0.25, 0.5, 0.75, 0.9], names=["p25", "p50", "p75", "p90"])
    qs = q.select(F.struct("p25", "p50", "p75", "p90")).scalar()
    return errors.agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.avg(col)).alias("mae"),
                      r6(F.sqrt(F.avg(F.col(col) * F.col(col)))).alias("rmse"), r6(qs["p50"]).alias("median_error"),
                      *[r6(qs[n]).alias(n) for n in ("p25", "p50", "p75", "p90")])


def invariant_violations(df: DataFrame) -> DataFrame:
    """Counts of rows breaking each data-contract rule, in one aggregation."""
    rules = {
        "missing_required": F.col("project_id").isNull() | F.col("funding_goal").isNull()
        | F.col("pledged_amount").isNull() | F.col("status").isNull(),
        "negative_money": (F.col("funding_goal") < 0) | (F.col("pledged_amount") < 0),
        "duration_out_of_range": (F.col("campaign_duration_days") <= 0) | (F.col("campaign_duration_days") > 90),
        "bad_status": ~F.col("status").isin("successful", "failed"),
        "non_binary_flag": ~F.col("is_weekend_launch").isin(0, 1) | ~F.col("is_holiday_week").isin(0, 1),
        "trend_out_of_range": (F.col("trend_index") < 0) | (F.col("trend_index") > 100),
    }
    row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    stack = "stack({}, {}) as (rule, violations)".format(len(rules), ", ".join(f"'{n}', {n}" for n in rules))
    return row.select("n_rows", F.expr(stack)).select(
        "rule", "violations", "n_rows", F.when(F.col("violations") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))
        .alias("status"))


def status(cond: Column, ok: str = "PASSED", bad: str = "WARNING") -> Column:
    return F.when(cond, F.lit(ok)).otherwise(F.lit(bad))
