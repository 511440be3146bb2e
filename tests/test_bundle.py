"""The saved predictor: same bits after loading, nulls, versions and a writer that died."""

import pytest
from pyspark.sql import functions as F

from pricelens.operators import bundle as bu
from pricelens.operators import forest as fo
from pricelens.operators import linear as L
from pricelens.operators.quantile_trees import fit_quantiles
from pricelens.operators.scenario import ScoringModel

XS = ["a", "b"]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(400).select("id", F.sin("id").alias("a"), F.pmod("id", F.lit(7)).cast("double").alias("b"), F.lit("x").alias("q_10"))
    df = df.withColumn("y", 3 * F.col("a") - F.col("b") / 3 + F.cos("id") / 10)
    gr = L.fit_gram(df, [*XS, "y"])
    line = ScoringModel.from_fit(L.ols(gr, "y", XS), 0.1 + 0.2)
    forest = fo.random_forest(fo.assemble(df, ["b"], keep=["y"]), "y", 5, 3)
    trees = fit_quantiles(df, XS, "y", [0.1, 0.9], 3, 2)
    return df, bu.Bundle(XS, "a", "y", {"a": (0.1, 1 / 3), "b": (3.0, 1.0)}, line, line, ["b"], forest, trees)


def test_round_trip_keeps_every_bit_and_nulls_stay_null(spark, fitted, tmp_path):
    df, b = fitted
    path = str(tmp_path / "bundle")
    assert bu.save(spark, path, b) == 1
    rows = df.withColumn("a", F.when(F.col("id") != 3, F.col("a"))).withColumn("b", F.when(F.col("id") != 4, F.col("b")))
    want = {r["id"]: r for r in b.score(rows).collect()}
    got = {r["id"]: r for r in bu.load(spark, path).score(rows).collect()}
    assert want == got and len(got) == 400
    assert got[0]["ols_prediction"] is not None and isinstance(got[0]["q_10"], float)
    three, four = got[3], got[4]
    assert three["z_a"] is three["ols_prediction"] is three["q_10"] is None and three["treatment_effect"] is not None
    assert four["treatment_effect"] is four["q_90"] is four["z_b"] is None and four["z_a"] is not None
    assert bu.load(spark, path).score(rows.limit(0)).count() == 0


def test_versions_and_a_writer_that_died(spark, fitted, tmp_path):
    _, b = fitted
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        bu.load(spark, path)
    bu.save(spark, path, b)
    b.quantiles.table(spark).write.parquet(f"{path}/version=2/quantiles")  # died before `parts`
    assert bu.versions(spark, path) == [1] and bu.load(spark, path).outcome == "y"
    assert bu.save(spark, path, b) == 2 and bu.versions(spark, path) == [1, 2]
    with pytest.raises(FileNotFoundError):
        bu.load(spark, path, 3)
