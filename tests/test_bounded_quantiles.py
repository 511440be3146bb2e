"""Exact percentiles whose bands are narrowed by further scans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators import quantiles as qu

PROBS = [0.013, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(6)
    parts = {"hot": rng.normal(0, 1, 30_000), "ties": np.concatenate([np.full(9000, 5.0), rng.uniform(0, 10, 3000)]), "steps": rng.integers(0, 40, 8000).astype(float),
             "few": np.array([3.0, 1.0]), "one": np.full(6000, 2.0)}
    pdf = pd.DataFrame([(g, x) for g, v in parts.items() for x in v], columns=["g", "x"])
    return parts, spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("hot", None), ("none", None)], "g string, x double")).repartition(3).cache()


@pytest.mark.parametrize("discrete", [False, True])
def test_narrowed_bands_stay_exact(spark, values, monkeypatch, discrete):
    parts, df = values
    monkeypatch.setattr(qu, "GRID", 16)
    names = [f"q{i}" for i in range(len(PROBS))]
    got = {r["g"]: r for r in qu.exact_percentiles(df, "x", PROBS, ["g"], names=names, accuracy=400, discrete=discrete, band_rows=60).collect()}
    assert set(got) == set(parts)
    for g, v in parts.items():
        s = np.sort(v)
        want = [s[max(0, int(np.ceil(len(s) * p)) - 1)] for p in PROBS] if discrete else np.quantile(v, PROBS)
        np.testing.assert_allclose([got[g][n] for n in names], want, rtol=0, atol=1e-12)
        assert got[g]["n"] == len(v)


def test_global_bands_are_narrowed(spark, values):
    _, df = values
    x = np.array([r.x for r in df.where("x is not null").collect()])
    row = qu.exact_percentiles(df, "x", [0.1, 0.5], names=["a", "b"], accuracy=400, band_rows=20).first()
    np.testing.assert_allclose([row["a"], row["b"]], np.quantile(x, [0.1, 0.5]), rtol=0, atol=1e-12)
    none = qu.exact_percentiles(df.limit(0), "x", [0.5], names=["a"]).collect()
    assert not none or none[0]["a"] is None


def test_the_band_does_not_grow_with_the_table(spark, monkeypatch):
    """Rows inside the brackets after narrowing, at two sizes: both under the bound, where the first bracket grows."""
    seen = []
    narrowed = qu._narrowed

    def spy(base, table, most, keys, *how):
        out = narrowed(base, table, most, keys, *how)
        for t in (table, out):
            r = t.first()
            seen.append(base.where((F.col("_x") >= r["_lo"][0]) & (F.col("_x") <= r["_hi"][0])).count())
        return out
    monkeypatch.setattr(qu, "_narrowed", spy)
    for n in (40_000, 400_000):
        df = spark.range(n).select((F.xxhash64("id") / 1e18).alias("x"))
        exact = df.agg(F.percentile("x", 0.37)).first()[0]
        assert abs(qu.exact_percentiles(df, "x", [0.37], names=["p"], accuracy=500, band_rows=200).first()["p"] - exact) < 1e-12
    first_small, last_small, first_large, last_large = seen
    assert first_large > 5 * first_small and max(last_small, last_large) <= 200
