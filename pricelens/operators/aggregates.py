"""Aggregation operators A1-A24: profiles, shares, histograms, correlations, tests, metrics.

All are single-pass ``groupBy``/``agg`` plans (partial aggregation map-side, one small shuffle) or
unions of them; wide results are stacked to long form with ``stack`` rather than collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.exprs import c, r6
from pricelens.operators.joins import join_small
from pricelens.operators.quantiles import exact_percentiles


def group_means(df: DataFrame, dims: Sequence[str], measures: dict) -> DataFrame:
    """A1/A2: means per dimension for several dimensions in ONE scan (grouping sets).

    Output (dim, key, n, <measure>...), key cast to string."""
    gid = F.grouping_id(*dims)
    aggs = [F.count(F.lit(1)).alias("n")] + [r6(F.avg(src)).alias(name) for name, src in measures.items()]
    g = df.groupingSets([[d] for d in dims], *dims).agg(gid.alias("_gid"), *aggs)
    n = len(dims)
    dim_name = F.lit(None).cast("string")
    key = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        bit = 1 << (n - 1 - i)
        only_d = (F.col("_gid") == (2 ** n - 1 - bit))
        dim_name = F.when(only_d, F.lit(d)).otherwise(dim_name)
        key = F.when(only_d, F.col(d).cast("string")).otherwise(key)
    return g.select(dim_name.alias("dim"), key.alias("key"), "n", *measures.keys())


def value_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: value counts with share of the total, for several columns in one grouping-sets pass."""
    gid = F.grouping_id(*cols)
    g = df.groupingSets([[x] for x in cols], *cols).agg(gid.alias("_gid"), F.count(F.lit(1)).alias("n"))
    n = len(cols)
    col_name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, x in enumerate(cols):
        only = F.col("_gid") == (2 ** n - 1 - (1 << (n - 1 - i)))
        col_name = F.when(only, F.lit(x)).otherwise(col_name)
        value = F.when(only, F.col(x).cast("string")).otherwise(value)
    out = g.select(col_name.alias("column_name"), value.alias("value"), "n")
    total = F.sum("n").over(Window.partitionBy("column_name"))  # partitions = #columns, rows = #distinct values
    return out.withColumn("share", r6(F.col("n") / total))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample sd, min, exact quartiles, max per column (long form)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("column_name"), F.col(x).cast("double").alias("x")) for x in cols])).alias("_s")
    ).select("_s.column_name", "_s.x")
    moments = stacked.groupBy("column_name").agg(
        F.count("x").alias("count"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"),
        r6(F.min("x")).alias("min"), r6(F.max("x")).alias("max"))
    q = exact_percentiles(stacked, "x", [0.25, 0.5, 0.75], ["column_name"], names=["p25", "p50", "p75"]).drop("n")
    q = q.select("column_name", *[r6(x).alias(x) for x in ("p25", "p50", "p75")])
    return moments.join(q, "column_name", "left")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count and percent (2 dp), non-zero only; order by count descending."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(x).isNull().cast("long")).alias(f"m_{i}") for i, x in enumerate(cols)])
    stack = "stack({}, {}) as (column_name, n_missing)".format(
        len(cols), ", ".join(f"'{x}', m_{i}" for i, x in enumerate(cols)))
    out = row.select("_n", F.expr(stack)).where(F.col("n_missing") > 0)
    pct = F.round(F.col("n_missing") * 100.0 / F.col("_n") * 100.0) / 100.0
    return out.select("column_name", "n_missing", pct.alias("pct_missing"))


def histogram(df: DataFrame, x: str, bins: int, name: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Numpy-style equal-width histogram (last bin closed), every bin reported.

    Range = [lo, hi] if given (values outside are dropped) else [min, max] from one agg."""
    v = F.col(x).cast("double")
    base = df.select(v.alias("_x")).where(F.col("_x").isNotNull())
    if lo is not None and hi is not None:
        base = base.where((F.col("_x") >= lo) & (F.col("_x") <= hi))
        rng = base.agg(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    else:
        rng = base.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    sub = rng.select(F.struct("_lo", "_hi").alias("s")).scalar()
    lo_c, hi_c = sub["_lo"], sub["_hi"]
    width = (hi_c - lo_c) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo_c) / width), F.lit(bins - 1))).cast("int")
    counts = base.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    out = spine.join(counts, "bin", "left")
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(F.lit(name).alias("hist"), "bin", r6(F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                      r6(F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def box_stats(df: DataFrame, x: str, group: str) -> DataFrame:
    """Quartiles, IQR, 1.5·IQR whiskers (most extreme data inside the fences), outlier count."""
    q = exact_percentiles(df, x, [0.25, 0.5, 0.75], [group], names=["q1", "median", "q3"])
    j = join_small(df.select(group, F.col(x).cast("double").alias("_x")), q, group, "inner")
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    out = j.groupBy(group, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_high"),
        F.sum(((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).cast("long")).alias("n_outliers"))
    return out.select(group, "n", *[r6(c).alias(c) for c in ("q1", "median", "q3")],
                      r6(F.col("q3") - F.col("q1")).alias("iqr"), r6("whisker_low").alias("whisker_low"),
                      r6("whisker_high").alias("whisker_high"), "n_outliers")


def pearson(x, y):
    """Pearson r over the rows with both values: NaN when a side is constant (as in the SQL), null without rows.

    Spark's ``corr`` divides by zero there, which is an error in ANSI mode."""
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread).when(spread == 0, F.lit(float("nan")))


def corr_matrix(df: DataFrame, cols: Sequence[str], upper_only: bool = False) -> DataFrame:
    """Pairwise-complete Pearson r in ONE aggregation over the unique pairs (i ≤ j), stacked
    to long form; the full matrix mirrors them (r is symmetric) unless ``upper_only``."""
    uniq = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    row = df.agg(*[pearson(a, b).alias(f"c{k}")
                   for k, (a, b) in enumerate(uniq)])
    out = []
    for k, (a, b) in enumerate(uniq):
        if a == b and upper_only:
            continue
        out.append((a, b, k))
        if a != b and not upper_only:
            out.append((b, a, k))
    stack = "stack({}, {}) as (var_a, var_b, r)".format(
        len(out), ", ".join(f"'{a}', '{b}', c{k}" for a, b, k in out))
    return row.select(F.expr(stack)).select("var_a", "var_b", r6("r").alias("r"))


def instrument_correlations(df: DataFrame, instruments: Sequence[str], treatment: str, outcome: str,
                            threshold: float = 0.2) -> DataFrame:
    """corr(IV, treatment), corr(IV, outcome) and the validity label (|r_T| < 0.2)."""
    aggs = []
    for i, iv in enumerate(instruments):
        aggs += [pearson(iv, treatment).alias(f"t{i}"), pearson(iv, outcome).alias(f"o{i}")]
    row = df.agg(*aggs)
    stack = "stack({}, {}) as (instrument, corr_treatment, corr_outcome)".format(
        len(instruments), ", ".join(f"'{iv}', t{i}, o{i}" for i, iv in enumerate(instruments)))
    out = row.select(F.expr(stack))
    return out.select("instrument", r6("corr_treatment").alias("corr_treatment"),
                      r6("corr_outcome").alias("corr_outcome"),
                      F.when(F.abs("corr_treatment") < threshold, F.lit("valid")).otherwise(F.lit("weak"))
                      .alias("validity"))


def pooled_ttest(df: DataFrame, x: str, flag_col: str) -> DataFrame:
    """Two-sample pooled-variance t statistic (group 1 vs group 0) from one aggregation."""
    g = df.groupBy().agg(
        F.count(F.when(F.col(flag_col) == 1, F.col(x))).alias("n1"),
        F.count(F.when(F.col(flag_col) == 0, F.col(x))).alias("n0"),
        F.avg(F.when(F.col(flag_col) == 1, F.col(x))).alias("m1"),
        F.avg(F.when(F.col(flag_col) == 0, F.col(x))).alias("m0"),
        F.var_samp(F.when(F.col(flag_col) == 1, F.col(x))).alias("v1"),
        F.var_samp(F.when(F.col(flag_col) == 0, F.col(x))).alias("v0"))
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    t = (F.col("m1") - F.col("m0")) / F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n0")))
    return g.select("n1", "n0", r6("m1").alias("mean_1"), r6("m0").alias("mean_0"),
                    r6(F.col("m1") - F.col("m0")).alias("difference"), r6(t).alias("t_stat"),
                    (F.col("n1") + F.col("n0") - 2).alias("dof"))


def error_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """N, R², MAE, RMSE and median absolute error of predictions (one pass + exact median)."""
    e = F.col(y) - F.col(yhat)
    base = df.select(F.col(y).alias("_y"), e.alias("_e")).where(F.col("_e").isNotNull())
    base = base.persist(StorageLevel.MEMORY_AND_DISK)  # the median scans it several times: predict once
    m = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("_e")).alias("mae"),
                 F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
                 F.sum(F.col("_e") * F.col("_e")).alias("sse"), F.var_pop("_y").alias("vy"))
    med = exact_percentiles(base.select(F.abs("_e").alias("ae")), "ae", [0.5], names=["medae"]).select("medae")
    return m.select("n", r6(F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"),
                    r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                    r6(med.scalar()).alias("median_ae"))


def monthly_spine(df: DataFrame, ts: str, flag_col: str) -> DataFrame:
    """Per calendar month count and mean success, including months with no rows."""
    m = df.select(F.date_trunc("month", F.col(ts)).cast("date").alias("month"), F.col(flag_col).alias("_f"))
    counts = m.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("_f").alias("success_rate"))
    rng = m.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = rng.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    out = spine.join(counts, "month", "left")
    return out.select("month", F.coalesce("n", F.lit(0)).alias("n"), r6("success_rate").alias("success_rate"))


def mode_with_default(df: DataFrame, col: str, default: str = "Technology") -> DataFrame:
    """Most frequent value, ties → alphabetically first, default when there are no values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min_by(F.col(col), F.struct((-F.col("n")).alias("nn"), F.col(col).alias("v"))).alias("m"))
    return best.select(F.coalesce("m", F.lit(default)).alias("mode"))


# --- Student-t / F tails without SciPy (p-values are driver-side scalars) ------------------------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c_, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        for aa in (m * (b - m) * x / ((qam + m2) * (a + m2)),
                   -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))):
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c_ = 1.0 + aa / c_
            c_ = c_ if abs(c_) > tiny else tiny
            de = d * c_
            h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or dof <= 0 or np.isnan(t):
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper_p(f: float, d1: float, d2: float) -> float:
    if f is None or f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
