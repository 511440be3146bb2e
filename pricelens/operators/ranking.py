"""Row positions, adjacent pairs, folds, quantile bins, top-k and samples.

``row_index`` is the scalable replacement for ``row_number()`` over a huge (or global) window:
a range-partitioned sort spreads every group, even one holding a third of the rows, over many
tasks; per-(partition, group) counts — a table of partitions × groups rows — give each slice its
offset. The sorted data is checkpointed once so the ids cannot shift between the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.exprs import hash_unit, try_div


def row_index(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str], out: str = "row_idx",
              num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row within ``partition_cols`` ordered by ``order_cols``
    (equal to ``row_number() - 1`` over that window; order_cols should end with a unique key)."""
    keys = list(partition_cols) + list(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    srt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    srt = srt.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    srt = srt.checkpoint(eager=True)
    slices = srt.groupBy("_pid", *partition_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*partition_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # null-safe match on the group keys: a null group is one group, as in the window form
    sl = slices.select(F.col("_pid").alias("_pid2"), *[F.col(c).alias(f"_g_{c}") for c in partition_cols],
                       "_off", "_m0")
    cond = [srt["_pid"] == sl["_pid2"]] + [srt[c].eqNullSafe(sl[f"_g_{c}"]) for c in partition_cols]
    joined = srt.join(sl, cond)
    out_df = joined.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0"))
    return out_df.drop("_pid", "_pid2", "_mid", "_off", "_m0", *[f"_g_{c}" for c in partition_cols])


def adjacent_pairs(df: DataFrame, group: str, order: str, key: str, cols: Sequence[str]) -> DataFrame:
    """Each row joined to its successor within ``group`` by (order, key): the ``lead`` window
    expressed as an equi-join on (group, position + 1)."""
    ranked = row_index(df.where(F.col(group).isNotNull()).select(group, order, key, *cols), [group], [order, key], "_r")
    left = ranked.select(group, "_r", *[F.col(c).alias(f"{c}_1") for c in [key, order, *cols]])
    right = ranked.select(group, (F.col("_r") - 1).alias("_r"), *[F.col(c).alias(f"{c}_2") for c in [key, order, *cols]])
    return left.join(right, [group, "_r"]).drop("_r")


def matched_pairs(df: DataFrame, price: str = "avg_reward_price", goal: str = "funding_goal",
                  outcome: str = "funding_ratio", key: str = "project_id", group: str = "category") -> DataFrame:
    """Neighbours by goal within category with goal ratio in [0.8, 1.2] and price ratio
    outside [0.9, 1.1]; a non-positive left goal/price gives ratio 0."""
    p = adjacent_pairs(df, group, goal, key, [price, outcome])
    g1, g2, p1, p2 = F.col(f"{goal}_1"), F.col(f"{goal}_2"), F.col(f"{price}_1"), F.col(f"{price}_2")
    goal_ratio = F.when(g1 > 0, g2 / g1).otherwise(F.lit(0.0))
    price_ratio = F.when(p1 > 0, p2 / p1).otherwise(F.lit(0.0))
    keep = goal_ratio.between(0.8, 1.2) & ((price_ratio < 0.9) | (price_ratio > 1.1))
    return p.where(keep).select(
        F.col(f"{key}_1").alias("campaign_1_id"), F.col(f"{key}_2").alias("campaign_2_id"), group,
        g1.alias("goal_1"), g2.alias("goal_2"), p1.alias("price_1"), p2.alias("price_2"),
        F.col(f"{outcome}_1").alias("outcome_1"), F.col(f"{outcome}_2").alias("outcome_2"),
        (try_div(p2 - p1, p1) * 100).alias("price_change_pct"),
        (F.col(f"{outcome}_2") - F.col(f"{outcome}_1")).alias("outcome_change"))


def contiguous_folds(df: DataFrame, order_cols: Sequence[str], k: int = 5, out: str = "fold") -> DataFrame:
    """Unshuffled k-fold = ``ntile(k)`` over the row order (first n mod k folds one row
    larger), computed from the scalable row index and the total count."""
    ranked = row_index(df, [], order_cols, "_r")
    n = df.select(F.count(F.lit(1))).scalar()
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(
        rem + F.floor((F.col("_r") - big) / q))
    return ranked.withColumn(out, (fold + 1).cast("int")).drop("_r")


# Labels of the goal-ambition quartiles.
QUARTILE_LABELS = ["Low", "Medium-Low", "Medium-High", "High"]


def quantile_bins(df: DataFrame, x: str, edges: list, labels: Sequence[str] = QUARTILE_LABELS,
                  out: str = "goal_quartile") -> DataFrame:
    """``qcut``-style bins from interpolated edges (Columns), right-closed, lowest included."""
    v = F.col(x)
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        lo, hi = edges[i], edges[i + 1]
        cond = (v >= lo) & (v <= hi) if i == 0 else (v > lo) & (v <= hi)
        expr = F.when(cond, F.lit(labels[i])).otherwise(expr)
    return df.withColumn(out, expr)


def top_n(df: DataFrame, col: str, n: int, key: str = "project_id", largest: bool = True) -> DataFrame:
    """K2: n largest/smallest rows, ties broken by the key (TakeOrderedAndProject)."""
    o = F.col(col).desc() if largest else F.col(col).asc()
    return df.orderBy(o, F.col(key).asc()).limit(n)


def hash_sample(df: DataFrame, n: int, key: str = "project_id", salt: int = 42) -> DataFrame:
    """K3: fixed-size repeatable sample without replacement: the n smallest id hashes."""
    return df.withColumn("_h", hash_unit(key, salt)).orderBy("_h", key).limit(n).drop("_h")


def hash_split(df: DataFrame, key: str = "project_id", train_pct: int = 80, salt: int = 42) -> DataFrame:
    """K4: repeatable train/test split by id hash bucket."""
    return df.withColumn("split", F.when(F.pmod(hash_unit(key, salt), F.lit(100)) < train_pct, F.lit("train"))
                         .otherwise(F.lit("test")))


def time_split(df: DataFrame, ts: str = "launch_date", last_train_year: int = 2022) -> DataFrame:
    """K5: launch year ≤ 2022 → train, ≥ 2023 → test (others null)."""
    y = F.year(ts)
    return df.withColumn("split", F.when(y <= last_train_year, F.lit("train"))
                         .when(y >= last_train_year + 1, F.lit("test")))


def balanced_quota(df: DataFrame, target: int, status: str = "status", key: str = "project_id",
                   states: Sequence[str] = ("successful", "failed")) -> DataFrame:
    """K6: per state (in order) at most target//2 + 1 rows by key order, then the first ``target``
    rows overall (states in the listed order)."""
    quota = target // len(states) + 1
    s = df.where(F.col(status).isin(*states))
    # row_number() <= quota: every task forwards at most `quota` rows per state, no full sort of the table.
    ranked = s.withColumn("_r", F.row_number().over(Window.partitionBy(status).orderBy(key))).where(F.col("_r") <= quota)
    order = F.lit(None).cast("int")
    for i, st in reversed(list(enumerate(states))):
        order = F.when(F.col(status) == st, F.lit(i)).otherwise(order)
    return ranked.withColumn("_o", order).orderBy("_o", "_r").limit(target).drop("_o", "_r")
