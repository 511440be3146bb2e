"""Readers for the driver tables and the campaign view built on top of them.

The campaign view is the canonical ``campaign_raw`` contract (SURVEY §1) expressed over the
TPC-H-style tables: one row per order (FIXTURES §B). It is written twice — once as a Spark plan,
once as the DuckDB text every oracle query starts with — and the two are kept side by side here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.functions.exprs import round_to
from pricelens.operators.joins import join_small

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Campaign dates are shifted by this many months so the 1995-2001 order dates land on 2020-2026.
LAUNCH_SHIFT_MONTHS = 300


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregate (pledged, backers, tier prices).

    Partial aggregation happens map-side; the shuffle is keyed on l_orderkey, which is also the
    join key below, so the join reuses this partitioning on the line side. The tier list per
    order is bounded by the number of lines of one order.
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .where(F.col("l_quantity") > 0)
          .select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"))
    unit = round_to(F.col("l_extendedprice") / F.col("l_quantity") / F.lit(100), 2)
    return (li.groupBy("l_orderkey")
            .agg(F.sum(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("pledged"),
                 F.sum("l_quantity").alias("qty"),
                 F.sort_array(F.collect_list(unit)).alias("reward_tiers")))


def campaign_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``campaign_raw``: project_id, name, category, …, reward_tiers, trend_index."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it has a proven size bound.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    lines = order_lines(spark, sf_dir)

    # The customer comes before the lines: only the narrow orders are shuffled twice, not their sums and tier lists.
    base = (orders
            .join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))

    launch = F.add_months(F.to_date("o_orderdate"), LAUNCH_SHIFT_MONTHS).cast("timestamp_ntz")
    duration = (F.lit(15) + F.pmod(F.col("o_orderkey"), F.lit(46))).cast("int")
    backers = F.coalesce(F.col("qty"), F.lit(0.0)).cast("int")
    camp = base.select(
        F.col("o_orderkey").alias("project_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("subcategory"),
        F.col("n_name").alias("country"),
        F.col("o_totalprice").alias("funding_goal"),
        F.coalesce(F.col("pledged"), F.lit(0.0)).alias("pledged_amount"),
        backers.alias("backers_count"),
        launch.alias("launch_date"),
        duration.alias("campaign_duration_days"),
        F.col("reward_tiers"),
        F.pmod(F.col("o_orderkey"), F.lit(15)).cast("int").alias("num_updates"),
        F.floor(backers * (F.lit(2) + F.pmod(F.col("o_orderkey"), F.lit(7))) / F.lit(100))
        .cast("int").alias("num_comments"),
        (F.length("c_name") * (F.lit(10) + F.pmod(F.col("o_orderkey"), F.lit(40))))
        .cast("int").alias("description_length"),
    )
    camp = (camp
            .withColumn("status", F.when(F.col("pledged_amount") >= F.col("funding_goal"),
                                         F.lit("successful")).otherwise(F.lit("failed")))
            .withColumn("end_date", F.date_add(F.to_date("launch_date"), F.col("campaign_duration_days"))
                        .cast("timestamp_ntz"))
            .withColumn("launch_month", F.date_trunc("month", F.col("launch_date")).cast("date")))

    # Trend index: orders per (segment, month) scaled by the busiest (segment, month). The count
    # table has segments × months rows; it is counted and broadcast back (no shuffle of the
    # campaign rows onto a few hundred keys), with a shuffle join beyond the size limit.
    per_month = camp.groupBy("category", "launch_month").agg(F.count(F.lit(1)).alias("_n"))
    per_month = per_month.withColumn("_mx", F.max("_n").over(Window.partitionBy()))
    per_month = per_month.select(
        "category", "launch_month",
        F.floor(F.lit(100) * F.col("_n") / F.col("_mx")).cast("int").alias("trend_index"))
    camp = join_small(camp, per_month, ["category", "launch_month"], "left").drop("launch_month")
    return camp.select(*CAMPAIGN_COLUMNS)


CAMPAIGN_COLUMNS = [
    "project_id", "name", "category", "subcategory", "country", "status", "funding_goal",
    "pledged_amount", "backers_count", "launch_date", "end_date", "campaign_duration_days",
    "num_updates", "num_comments", "description_length", "reward_tiers", "trend_index",
]


# DuckDB twin of campaign_view(); every oracle query starts with this WITH clause.
CAMPAIGN_SQL = """
WITH _lines AS (
  SELECT l_orderkey,
         sum(l_extendedprice * (1 - l_discount)) AS pledged,
         sum(l_quantity) AS qty,
         list_sort(list(round(l_extendedprice / l_quantity / 100 * 100.0::DOUBLE) / 100.0::DOUBLE)) AS reward_tiers
  FROM lineitem WHERE l_quantity > 0 GROUP BY l_orderkey
),
_base AS (
  SELECT o.o_orderkey AS project_id, cu.c_name AS name, cu.c_mktsegment AS category,
         o.o_orderpriority AS subcategory, na.n_name AS country, o.o_totalprice AS funding_goal,
         coalesce(li.pledged, 0.0::DOUBLE) AS pledged_amount,
         CAST(trunc(coalesce(li.qty, 0.0::DOUBLE)) AS INTEGER) AS backers_count,
         CAST(o.o_orderdate + INTERVAL 300 MONTH AS TIMESTAMP) AS launch_date,
         CAST(15 + o.o_orderkey % 46 AS INTEGER) AS campaign_duration_days,
         li.reward_tiers,
         CAST(o.o_orderkey % 15 AS INTEGER) AS num_updates,
         CAST(floor(CAST(trunc(coalesce(li.qty, 0.0::DOUBLE)) AS INTEGER) * (2 + o.o_orderkey % 7) / 100) AS INTEGER) AS num_comments,
         CAST(length(cu.c_name) * (10 + o.o_orderkey % 40) AS INTEGER) AS description_length
  FROM orders o
  LEFT JOIN _lines li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey
  LEFT JOIN nation na ON cu.c_nationkey = na.n_nationkey
),
_month AS (
  SELECT category, date_trunc('month', launch_date) AS m, count(*) AS n FROM _base GROUP BY ALL
),
_trend AS (
  SELECT category, m, CAST(floor(100 * n / max(n) OVER ()) AS INTEGER) AS trend_index FROM _month
),
campaign AS (
  SELECT b.project_id, b.name, b.category, b.subcategory, b.country,
         CASE WHEN b.pledged_amount >= b.funding_goal THEN 'successful' ELSE 'failed' END AS status,
         b.funding_goal, b.pledged_amount, b.backers_count, b.launch_date,
         CAST(CAST(b.launch_date AS DATE) + b.campaign_duration_days AS TIMESTAMP) AS end_date,
         b.campaign_duration_days, b.num_updates, b.num_comments, b.description_length,
         b.reward_tiers, t.trend_index
  FROM _base b LEFT JOIN _trend t ON b.category = t.category AND date_trunc('month', b.launch_date) = t.m
)"""
