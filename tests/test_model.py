"""The fitted scoring model: known truth, empty tables, SQL twin, and the price grid when a higher price pays."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators import scenario as sc
from pricelens.plans import model as pm


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    f = pd.DataFrame({c: rng.normal(5.0, 2.0, n) for c in pm.FEATURES})
    f["funding_goal"] = rng.uniform(1e3, 1e6, n)
    for i, c in enumerate(pm.INSTRUMENTS):
        f[c] = rng.integers(0, 2, n) if i else 0  # the first instrument never varies
    f["avg_reward_price"] = 1000 * f["avg_reward_price"] + 900 * f["trend_spike"]  # a large unit
    f["funding_ratio"] = 2.0 + 0.001 * f["avg_reward_price"] - 0.3 * f["goal_ambition"] + rng.normal(0, 0.1, n)
    return f


def test_fit_recovers_the_truth_and_equals_lstsq(spark, frame):
    m = pm.fit_model(spark.createDataFrame(frame))
    X = np.column_stack([np.ones(len(frame)), frame[pm.FEATURES]])
    b = np.linalg.lstsq(X, frame[pm.TARGET], rcond=None)[0]
    np.testing.assert_allclose([m.intercept, *m.coefs.values()], b, rtol=1e-7)
    assert abs(m.coefs["avg_reward_price"] - 0.001) < 1e-5 and abs(m.tsls_coef - 0.001) < 1e-4


def test_sql_twin_gives_the_same_bits(spark, frame):
    m = pm.fit_model(spark.createDataFrame(frame))
    con = duckdb.connect()
    con.register("features", frame)
    row = con.execute(f"WITH {pm.MODEL_SQL} SELECT * FROM _model").fetchone()
    assert row == (m.intercept, *m.coefs.values(), m.tsls_coef)


def test_rows_with_nulls_are_left_out(spark, frame):
    df = spark.createDataFrame(frame)
    holes = df.unionByName(df.limit(50).withColumn("goal_ambition", F.lit(None).cast("double")))
    assert pm.fit_model(holes).coefs == pm.fit_model(df).coefs


def test_an_empty_table_gives_zero_slopes(spark, frame):
    m = pm.fit_model(spark.createDataFrame(frame).limit(0))
    assert set(m.coefs.values()) == {0.0} and m.tsls_coef == 0.0


@pytest.mark.parametrize("coef", [0.002, -0.002])
def test_price_grid_equals_a_plain_scan(spark, coef):
    m = sc.ScoringModel(0.5, {"avg_reward_price": coef})
    rows = [(1, 40.0, 1000.0), (2, 400.0, 5000.0), (3, 3.0, 100.0), (4, 90.0, 0.0)]
    df = spark.createDataFrame(rows, "project_id int, avg_reward_price double, funding_goal double")
    g = sc.integer_price_grid(m, {"avg_reward_price": F.col("avg_reward_price")}, F.col("avg_reward_price"), F.col("funding_goal"))
    got = {r[0]: (r[1], r[2]) for r in df.select("project_id", g["optimal_int_price"], g["optimal_expected_funding"]).collect()}
    for pid, price, goal in rows:
        lo, hi = max(10, int(0.3 * price)), int(2.5 * price)
        grid = list(range(lo, hi, max(1, (hi - lo) // 30))) if hi > lo else []
        fund = [max(0.0, 0.5 + coef * p) * goal for p in grid]
        want = (grid[int(np.argmax(fund))], max(fund)) if grid else (None, None)
        assert got[pid][0] == want[0]
        assert want[1] is None and got[pid][1] is None or abs(got[pid][1] - want[1]) < 1e-9
