"""Counterfactual scoring and advice for every campaign at once.

A scoring model is a small fitted coefficient table (raw-unit linear predictor) inlined into expressions
as literals — the broadcast of a model by value. Price/goal grids are evaluated per row with array
higher-order functions (``transform``/``array_max``/``array_position``): no explode, no shuffle,
one pass over the campaign table whatever the grid size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.exprs import clip, round_to

MODEL_FEATURES = ["avg_reward_price", "goal_ambition", "campaign_duration_days", "trend_index",
                  "concurrent_campaigns"]


@dataclass
class ScoringModel:
    intercept: float
    coefs: dict
    tsls_coef: float = 0.0
    features: list = field(default_factory=lambda: list(MODEL_FEATURES))

    @classmethod
    def from_fit(cls, fit, tsls_coef: float = 0.0) -> "ScoringModel":
        """From a Gram OLS fit (M2) and a 2SLS effect (M3)."""
        return cls(float(fit.intercept), {n: float(b) for n, b in zip(fit.names, fit.coef)}, float(tsls_coef),
                   list(fit.names))

    def predict(self, values: dict) -> Column:
        """Linear predictor over feature expressions (missing features count as 0)."""
        expr = F.lit(float(self.intercept))
        for name in self.features:
            x = values.get(name, F.lit(0.0))
            expr = expr + F.lit(float(self.coefs.get(name, 0.0))) * x.cast("double")
        return expr

    def rounded(self, digits: int) -> "ScoringModel":
        """Coefficients at ``digits`` significant digits: the same bits whatever order the fit's sums ran in."""
        def sig(x):
            return float(f"{x:.{digits - 1}e}")
        return ScoringModel(sig(self.intercept), {n: sig(b) for n, b in self.coefs.items()}, sig(self.tsls_coef),
                            list(self.features))


# Grid multipliers (np.linspace(0.3, 2.5, 20) and np.linspace(0.5, 2.0, 20)).
PRICE_MULTIPLIERS = [float(x) for x in np.linspace(0.3, 2.5, 20)]
GOAL_MULTIPLIERS = [float(x) for x in np.linspace(0.5, 2.0, 20)]
# Fallback quantile multipliers of the dashboard when no quantile model is loaded.
FALLBACK_QUANTILES = {0.1: 0.6, 0.25: 0.8, 0.5: 1.0, 0.75: 1.2, 0.9: 1.5}
# Fixed price list of the quantile-by-price table.
FIXED_PRICES = [25.0, 50.0, 75.0, 100.0, 150.0, 200.0]


# The label texts of the recommendation bands and price effects below.
def recommendation(ratio: Column) -> Column:
    """C1 band: ≥1.5 strong, ≥1.0 likely, ≥0.7 at risk, else needs work."""
    return (F.when(ratio >= 1.5, F.lit("Strong Success - Consider higher goal"))
            .when(ratio >= 1.0, F.lit("Likely Success - On track"))
            .when(ratio >= 0.7, F.lit("At Risk - Consider adjustments"))
            .otherwise(F.lit("Needs Work - Review pricing and goal")))


def price_effect_label(tsls_coef: float) -> str:
    if tsls_coef > 0.01:
        return "Higher prices slightly increase funding"
    if tsls_coef < -0.01:
        return "Higher prices decrease funding"
    return "Price has minimal causal effect on funding"


def api_values(goal_ambition_global: Column) -> dict:
    """C1 feature vector: ambition by the GLOBAL median goal, competition fixed at 0.5."""
    return {"avg_reward_price": F.col("avg_reward_price"), "goal_ambition": goal_ambition_global,
            "campaign_duration_days": F.col("campaign_duration_days"), "trend_index": F.col("trend_index"),
            "concurrent_campaigns": F.lit(0.5)}


def score_api(model: ScoringModel, values: dict, goal: Column, low: Column | None = None, high: Column | None = None) -> dict:
    """Funding ratio, expected funding, clamped probability, 10/90 band, recommendation.

    ``low`` and ``high`` are the funding ratio's 10 % and 90 % quantiles; without a quantile model fixed multiples of
    the prediction stand in for them."""
    ratio = model.predict(values)
    low = ratio * 0.5 if low is None else low
    high = ratio * 1.5 if high is None else high
    return {
        "expected_funding": round_to(goal * ratio, 2),
        "funding_ratio": round_to(ratio, 3),
        "success_probability": round_to(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), 3),
        "confidence_low": round_to(goal * low, 2),
        "confidence_high": round_to(goal * high, 2),
        "recommendation": recommendation(ratio),
    }


def demand_curve(model: ScoringModel, values: dict, price: Column, multipliers=PRICE_MULTIPLIERS) -> dict:
    """Ratios (rounded to 3) on the price grid; strict-greater argmax from 0, first wins;
    all ≤ 0 keeps the current price."""
    mults = F.array(*[F.lit(m) for m in multipliers])

    def at(m):
        v = dict(values)
        v["avg_reward_price"] = price * m
        return round_to(model.predict(v), 3)

    ratios = F.transform(mults, at)
    best = F.array_max(ratios)
    idx = F.array_position(ratios, best)
    opt = F.when(best > 0, price * F.element_at(mults, idx.cast("int"))).otherwise(price)
    return {"curve_ratios": ratios, "max_ratio": best, "optimal_price": round_to(opt, 2)}


def integer_price_grid(model: ScoringModel, values: dict, price: Column, goal: Column) -> dict:
    """C4: integer prices max(10, int(0.3p)) … int(2.5p) (exclusive), step max(1, span // 30);
    argmax of expected funding (ratio floored at 0 × goal), first wins.

    The predictor is linear in price. With a price coefficient ≤ 0 and goal ≥ 0 the expected
    funding is non-increasing along the grid (IEEE × and + are monotone), so the first grid point
    is exactly the first maximum: O(1) per row. Otherwise every grid point is evaluated."""
    lo = F.greatest(F.lit(10), (price * 0.3).cast("int"))
    hi = (price * 2.5).cast("int")
    step = F.greatest(F.lit(1), F.floor((hi - lo) / 30).cast("int"))
    size = F.when(hi > lo, F.floor((hi - 1 - lo) / step).cast("int") + 1).otherwise(F.lit(0))
    grid = F.when(hi > lo, F.sequence(lo, hi - 1, step)).otherwise(F.array().cast("array<int>"))

    def funding(p):
        v = dict(values)
        v["avg_reward_price"] = p.cast("double")
        return F.greatest(F.lit(0.0), model.predict(v)) * goal

    # One walk over the grid: the largest (funding, -price) is the greatest funding at its lowest price.
    best_pair = F.array_max(F.transform(grid, lambda p: F.struct(funding(p).alias("funding"), (-p).alias("minus_price"))))
    opt_scan, best_scan = -best_pair["minus_price"], best_pair["funding"]
    if float(model.coefs.get("avg_reward_price", 0.0)) <= 0.0:
        monotone = goal >= 0
        opt = F.when(size == 0, F.lit(None).cast("int")).when(monotone, lo).otherwise(opt_scan)
        best = F.when(size == 0, F.lit(None).cast("double")).when(monotone, funding(lo)).otherwise(best_scan)
    else:
        opt, best = opt_scan, best_scan
    return {"grid_size": size, "optimal_int_price": opt, "optimal_expected_funding": best}


def goal_curve(model: ScoringModel, values: dict, goal: Column, cat_median_goal: Column,
               multipliers=GOAL_MULTIPLIERS) -> dict:
    """Probability × 100 for goals 0.5…2.0 × goal (ambition recomputed by category median)."""
    mults = F.array(*[F.lit(m) for m in multipliers])

    def prob(m):
        v = dict(values)
        v["goal_ambition"] = F.when(cat_median_goal > 0, goal * m / cat_median_goal).otherwise(F.lit(1.0))
        r = F.greatest(F.lit(0.0), model.predict(v))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), r / 1.0 * 0.7)) * 100
    return {"goals": F.transform(mults, lambda m: goal * m), "probabilities": F.transform(mults, prob)}


def advice(ratio: Column, optimal_price: Column, price: Column, duration: Column, conf_low: Column,
           conf_high: Column, ambition: Column) -> dict:
    """Tone, price advice, triggered strategies and risk score (rule text as codes)."""
    tone = (F.when(ratio >= 1.2, F.lit("enthusiastic")).when(ratio >= 1.0, F.lit("positive"))
            .when(ratio >= 0.7, F.lit("cautious")).otherwise(F.lit("critical")))
    diff = optimal_price - price
    price_adv = (F.when(F.abs(diff) < 5, F.lit("keep")).when(diff > 0, F.lit("raise")).otherwise(F.lit("lower")))
    strategies = F.array_compact(F.array(
        F.when(duration > 45, F.lit("shorten_campaign")),
        F.when(conf_high - conf_low > 20000, F.lit("anchor_social_proof")),
        F.when(ambition > 1.5, F.lit("split_goal_phases"))))
    strategies = F.when(F.size(strategies) == 0, F.array(F.lit("build_community"))).otherwise(strategies)
    risk = F.greatest(F.lit(1), F.lit(10) - (ratio * 10).cast("int"))
    return {"tone": tone, "price_advice": price_adv, "strategies": strategies, "risk_score": risk}


def clamp01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)
