"""Orthogonal forest: planted effects, honesty, nulls and empty tables."""

import numpy as np
import pandas as pd
import pytest

from pricelens.operators import orthoforest as of


@pytest.fixture(scope="module")
def planted():
    """Effect 1 below x0 = 0.5 and 3 above; x1 drives both outcome and treatment."""
    rng = np.random.default_rng(11)
    n = 6000
    x = rng.random((n, 3))
    tres, noise = rng.normal(size=n), rng.normal(size=n)
    effect = np.where(x[:, 0] < 0.5, 1.0, 3.0)
    t = x[:, 1] + tres
    return pd.DataFrame({"id": np.arange(n), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "t": t, "y": 2 * x[:, 1] + effect * t + noise,
                         "_tres": tres, "_yres": effect * tres + noise, "effect": effect})


def _holds(got, planted):
    got = got.set_index("id").join(planted.set_index("id"))
    far = got[(got.x0 - 0.5).abs() > 0.1]
    inside = (far.effect_lower <= far.effect) & (far.effect <= far.effect_upper)
    return inside.mean(), (far.treatment_effect - far.effect).abs().mean(), far


def test_a_planted_step_lies_within_its_interval(spark, planted):
    df = spark.createDataFrame(planted).repartition(3)
    forest = of.grow(df, ["x0", "x1", "x2"], "id", n_trees=20)
    assert (forest.feature[:, 0] == 0).mean() > 0.5  # most roots split on the feature that the effect hangs on
    inside, off, far = _holds(of.score(df, forest, "id").toPandas(), planted)
    assert inside > 0.95 and off < 0.15
    assert (far.effect_se > 0).all() and far.effect_se.mean() < 0.3
    again = of.grow(df.repartition(5), ["x0", "x1", "x2"], "id", n_trees=20)
    assert np.allclose(again.theta, forest.theta) and (again.feature == forest.feature).all()


def test_leaf_estimates_come_from_the_other_half(spark, planted):
    forest = of.grow(spark.createDataFrame(planted), ["x0", "x1", "x2"], "id", n_trees=2, max_depth=2)
    bins = forest.bins(planted[["x0", "x1", "x2"]].to_numpy())
    for tree in range(2):
        part, leaf = of._part(planted.id.to_numpy(), tree, 42), forest.node(tree, bins)
        assert abs((part == 1).mean() - 0.25) < 0.03
        for node in set(leaf.tolist()):
            mine = planted[(leaf == node) & (part == 1)]
            t, y = mine._tres, mine._yres
            theta = (t * y).sum() / (t * t).sum()
            se = np.sqrt((t ** 2 * (y - theta * t) ** 2).sum() * len(t) / (len(t) - 1)) / (t * t).sum()
            assert np.isclose(forest.theta[tree, node], theta) and np.isclose(forest.se[tree, node], se)


def test_whole_operator_with_nuisance_forests(spark, planted):
    df = spark.createDataFrame(planted[["id", "x0", "x1", "x2", "t", "y"]].head(3000)).selectExpr("*", "1 as treatment_effect")
    gaps = spark.createDataFrame([(-1, None, 0.1, 0.1, 1.0, 1.0)], "id long, x0 double, x1 double, x2 double, t double, y double").selectExpr("*", "1 as treatment_effect")
    got = of.orthogonal_effects(df.unionByName(gaps), ["x0", "x1", "x2"], "y", "t", "id", n_trees=15, nuisance_trees=10).toPandas()
    assert len(got) == 3000
    inside, off, _ = _holds(got, planted)
    assert inside > 0.9 and off < 0.25


def test_without_rows_or_spread(spark, planted):
    df = spark.createDataFrame(planted)
    empty = of.grow(df.limit(0), ["x0", "x1"], "id", n_trees=2, max_depth=2)
    assert of.score(df, empty, "id").where("treatment_effect is not null").count() == 0
    flat = of.grow(df.selectExpr("id", "1.0 as x0", "cast(_tres as double) as _tres", "2 * _tres as _yres"), ["x0"], "id", n_trees=3, max_depth=2)
    got = of.score(df.selectExpr("id", "1.0 as x0"), flat, "id").toPandas()
    assert np.allclose(got.treatment_effect, 2.0) and np.allclose(got.effect_se, 0.0, atol=1e-6)
