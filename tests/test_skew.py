"""Hot-key fixtures: one category holds most rows; results stay exact and the work is split."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.operators import features as fe
from pricelens.operators import ranking as rk
from pricelens.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    cat = np.where(rng.random(n) < 0.9, "HOT", rng.choice(["a", "b", "c"], n))
    days = rng.integers(0, 400, n)
    pdf = pd.DataFrame({"id": np.arange(n), "category": cat, "x": rng.normal(size=n).round(3),
                        "launch_date": [dt.datetime(2022, 1, 1) + dt.timedelta(days=int(d), hours=int(h))
                                        for d, h in zip(days, rng.integers(0, 24, n))]})
    return spark.createDataFrame(pdf).repartition(8)


def test_hot_group_row_index_is_spread_and_exact(spark, skewed):
    ranked = rk.row_index(skewed, ["category"], ["x", "id"], "r", num_partitions=8)
    ref = skewed.withColumn("r2", F.row_number().over(Window.partitionBy("category").orderBy("x", "id")) - 1)
    assert ranked.join(ref, "id").where(F.col("r") != F.col("r2")).count() == 0
    # the hot category's rows are sorted by several tasks, not one
    spread = (skewed.repartitionByRange(8, "category", "x", "id").where(F.col("category") == "HOT")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread > 1


def test_hot_group_exact_quantiles(spark, skewed):
    got = {r["category"]: (r["q1"], r["q2"]) for r in
           exact_percentiles(skewed, "x", [0.37, 0.5], ["category"], names=["q1", "q2"], accuracy=100).collect()}
    pdf = skewed.toPandas()
    for c, sub in pdf.groupby("category"):
        np.testing.assert_allclose(got[c], np.percentile(sub["x"], [37, 50]), rtol=1e-12)


def test_hot_group_range_count_with_time_of_day(spark, skewed):
    mine = fe.range_neighbour_count(skewed, "category", "launch_date", 14, "n").select("id", "n")
    a, b = skewed.alias("a"), skewed.alias("b")
    brute = (a.join(b, (F.col("a.category") == F.col("b.category"))
                    & (F.abs(F.unix_seconds(F.col("a.launch_date").cast("timestamp"))
                             - F.unix_seconds(F.col("b.launch_date").cast("timestamp"))) <= 14 * 86400)
                    & (F.col("a.id") != F.col("b.id")), "left")
             .groupBy(F.col("a.id").alias("id")).agg(F.count("b.id").alias("m")))
    assert mine.join(brute, "id").where(F.col("n") != F.col("m")).count() == 0
    # the hot category is processed in (category, 14-day bucket) partitions: many of them
    buckets = skewed.where(F.col("category") == "HOT").select(
        F.floor(F.unix_seconds(F.col("launch_date").cast("timestamp")) / (14 * 86400))).distinct().count()
    assert buckets > 20
