"""Distributed operators equal their single-partition / brute-force definitions."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricelens.operators import features as fe
from pricelens.operators import lookups as lk
from pricelens.operators import ranking as rk
from pricelens.operators.quantiles import exact_percentiles
from pricelens.plans.common import campaigns


def test_exact_percentiles_match_percentile_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": rng.integers(0, 40, 3000).astype(float)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_percentiles(df, "x", probs, ["g"], names=[f"q{i}" for i in range(len(probs))], accuracy=50).collect()}
    for g, sub in pdf.dropna().groupby("g"):
        np.testing.assert_allclose(got[g], np.percentile(sub["x"].values, [p * 100 for p in probs]), rtol=1e-12)


def test_row_index_equals_row_number(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 500), "v": rng.normal(size=500), "id": np.arange(500)})
    df = spark.createDataFrame(pdf)
    mine = rk.row_index(df, ["k"], ["v", "id"], "r", num_partitions=7)
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    j = mine.join(ref, "id")
    assert j.where(F.col("r") != F.col("r2")).count() == 0 and j.count() == 500


def test_range_count_equals_brute_force(spark, sf_dir):
    c = campaigns(spark, sf_dir).select("project_id", "category", "launch_date")
    mine = fe.range_neighbour_count(c, "category", "launch_date", 14, "n")
    a, b = c.alias("a"), c.alias("b")
    brute = (a.join(b, (F.col("a.category") == F.col("b.category"))
                    & (F.abs(F.unix_seconds(F.col("a.launch_date").cast("timestamp"))
                             - F.unix_seconds(F.col("b.launch_date").cast("timestamp"))) <= 14 * 86400)
                    & (F.col("a.project_id") != F.col("b.project_id")), "left")
             .groupBy(F.col("a.project_id").alias("project_id")).agg(F.count("b.project_id").alias("m")))
    j = mine.join(brute, "project_id")
    assert j.where(F.col("n") != F.col("m")).count() == 0 and j.count() == c.count()


def test_matched_pairs_equal_lead_window(spark, sf_dir):
    from pricelens.plans.common import features
    f = features(spark, sf_dir)
    mine = rk.adjacent_pairs(f, "category", "funding_goal", "project_id", [])
    w = Window.partitionBy("category").orderBy("funding_goal", "project_id")
    ref = f.where(F.col("category").isNotNull()).select(
        F.col("project_id").alias("project_id_1"), F.lead("project_id").over(w).alias("project_id_2")).where(
        F.col("project_id_2").isNotNull())
    a = sorted((r[0], r[1]) for r in mine.select("project_id_1", "project_id_2").collect())
    b = sorted((r[0], r[1]) for r in ref.collect())
    assert a == b


def test_partition_count_does_not_change_features(spark, sf_dir):
    from pricelens.operators.features import causal_features, enrich
    c = campaigns(spark, sf_dir)
    one = causal_features(enrich(c.repartition(1))).select("project_id", "goal_ambition", "concurrent_campaigns")
    many = causal_features(enrich(c.repartition(9))).select("project_id", "goal_ambition", "concurrent_campaigns")
    assert one.exceptAll(many).count() == 0


def test_knn_of_a_query_table_equals_brute_force(spark, monkeypatch):
    """Several blocks and chunks; integer coordinates give many ties, which go by id."""
    monkeypatch.setattr(lk, "KNN_QUERIES", 7)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"project_id": rng.permutation(1500), "a": rng.integers(0, 12, 1500).astype(float),
                        "b": rng.integers(0, 12, 1500)})
    pdf.loc[::9, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).repartition(3)
    got = {}
    for r in lk.knn(df, df.where("project_id % 50 = 0"), ["a", "b"], 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["project_id"], r["distance"])
    assert sorted(got) == list(range(0, 1500, 50))
    ids, x = pdf["project_id"].to_numpy(), pdf[["a", "b"]].fillna(0).to_numpy(float)
    for q, near in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [near[i + 1] for i in range(10)] == [(ids[i], d[i]) for i in best]


def test_due_query_campaigns_are_all_searched(spark, sf_dir):
    from pricelens.plans.q_lookup import j10_similar_due
    due = {r[0] for r in campaigns(spark, sf_dir).where("project_id % 50 = 0").select("project_id").collect()}
    assert len(due) > 20 and {r[0] for r in j10_similar_due(spark, sf_dir).select("query_id").collect()} == due


def test_quantile_boosting_leaves_are_exact_quantiles(spark):
    """One round at full step: a leaf's prediction is the ceil(q·n)-th target of its rows, not a sketch's."""
    from pricelens.operators import forest as fo
    rng = np.random.default_rng(4)
    n = 30_000
    pdf = pd.DataFrame({"project_id": np.arange(n), "x": np.repeat([0.0, 1.0], n // 2), "y": rng.normal(size=n)})
    pdf.loc[n // 2:, "y"] += 100
    out = fo.quantile_boosting(spark.createDataFrame(pdf), ["x"], "y", [0.1, 0.9], rounds=1, max_depth=1,
                               learning_rate=1.0).toPandas().sort_values("project_id")
    for half in (slice(0, n // 2), slice(n // 2, n)):
        y = np.sort(pdf["y"].to_numpy()[half])
        for name, q in (("q_10", 0.1), ("q_90", 0.9)):
            np.testing.assert_allclose(out[name].to_numpy()[half], y[int(np.ceil(q * len(y))) - 1], rtol=0, atol=1e-9)


def test_registered_quantile_boosting_runs_100_rounds_of_depth_6(spark, sf_dir, monkeypatch):
    from pricelens.operators import forest as fo
    from pricelens.plans import q_ml
    seen = {}
    monkeypatch.setattr(q_ml, "_FITTED", {})
    monkeypatch.setattr(fo, "quantile_boosting", lambda *a, **how: seen.update(how))
    q_ml.quantile_predictions(spark, sf_dir)
    assert (seen["rounds"], seen["max_depth"]) == (100, 6)


def test_effect_sink_and_effect_tables(spark, sf_dir, monkeypatch):
    """The effects sink has a row for each campaign; M16 has the effect rows and the whole ranking (small forests here)."""
    from pricelens.operators import forest as fo
    from pricelens.plans import q_lookup, q_ml, q_validate
    from pricelens.plans.common import features
    forest, boost = fo.random_forest, fo.boosted_trees
    monkeypatch.setattr(q_ml, "_FITTED", {})
    monkeypatch.setattr(fo, "random_forest", lambda t, y, *a, **how: forest(t, y, 2, 3))
    monkeypatch.setattr(fo, "boosted_trees", lambda t, y: boost(t, y, max_iter=2, max_depth=2))
    monkeypatch.setattr(q_validate, "v15_summary", lambda spark, sf_dir: spark.range(3))
    got = {r["sink"]: r["rows"] for r in q_lookup.s21_result_sinks(spark, sf_dir).collect()}
    n = features(spark, sf_dir).na.drop(subset=[c for c in q_ml.FEATURES if c != q_ml.TREATMENT]).count()
    assert got == {"validation_results": 3, "effects": n} and n > 1000
    rows = q_ml.m16_model_compare(spark, sf_dir).collect()
    assert {r["model"] for r in rows if r["kind"] == "effect" and r["value"] is not None} == {"ols", "2sls", "causal_forest"}
    assert {r["model"] for r in rows if r["kind"] == "fit"} == {"ols", "random_forest", "gradient_boosting"}
    ranked = sorted((r for r in rows if r["kind"] == "coefficient"), key=lambda r: r["importance_rank"])
    assert sorted(r["term"] for r in ranked) == sorted(q_ml.FEATURES)
    assert [abs(r["value"]) for r in ranked] == sorted((abs(r["value"]) for r in ranked), reverse=True)
