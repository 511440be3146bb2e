"""The quantile model: exact selection, trees against a plain implementation, SQL walk, reload, edge rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelens.operators import quantile_trees as qt

@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 2000
    f = pd.DataFrame({"a": rng.normal(0, 1, n), "b": rng.integers(0, 7, n).astype(float), "c": rng.uniform(0, 1, n), "project_id": np.arange(n)})
    f["y"] = np.round(np.where(f.a > 0.3, 2.0, 0.0) + f.b * f.c + rng.exponential(0.2 + f.c, n), 3)
    return f


def plain_trees(x, y, edges, quantiles, rounds, depth, rate, min_leaf):
    """The same boosting, written row by row: predictions of the training rows per quantile."""
    n, rank = len(y), lambda v, q: np.sort(v)[max(1, math.ceil(q * len(v) - 1e-9)) - 1]
    out = []
    for q in quantiles:
        pred = np.full(n, rank(y, q))
        for _ in range(rounds):
            g = q - (y < pred)
            groups = [np.arange(n)]
            for _ in range(depth):
                after = []
                for rows in groups:
                    splits = []
                    for j, cuts in enumerate(edges):
                        for e in cuts:
                            left = x[rows, j] <= e
                            nl = int(left.sum())
                            if min(nl, len(rows) - nl) >= min_leaf:
                                sl, s = g[rows][left].sum(), g[rows].sum()
                                splits.append((sl ** 2 / nl + (s - sl) ** 2 / (len(rows) - nl) - s ** 2 / len(rows), left))
                    top = max((gain for gain, _ in splits), default=0.0)
                    if top > 1e-9:
                        left = next(left for gain, left in splits if gain >= top * (1 - 1e-6))
                        after += [rows[left], rows[~left]]
                    else:
                        after.append(rows)
                groups = after
            step = np.zeros(n)
            for rows in groups:
                step[rows] = rate * rank(y[rows] - pred[rows], q)
            pred = pred + step
        out.append(pred)
    return np.column_stack(out)


def test_trees_equal_a_plain_implementation(spark, frame):
    df, xs = spark.createDataFrame(frame).repartition(3), ["a", "b", "c"]
    edges, levels, counted = qt.summarise(df, xs, "y", 8, 30)
    borders = sorted({v for v in df.agg(F.percentile_approx("y", [i / 30 for i in range(1, 30)], 10_000)).first()[0]})
    assert counted.agg(F.sum("n")).first()[0] == len(frame)
    y = np.array(levels)[np.searchsorted(borders, frame.y, "left")]
    assert np.mean(np.abs(y - frame.y)) < 0.1
    m = qt.fit_quantiles(df, xs, "y", [0.1, 0.5, 0.9], rounds=6, depth=3, n_bins=8, n_levels=30)
    x = frame[xs].to_numpy()
    np.testing.assert_allclose(m.predict(x), plain_trees(x, y, edges, [0.1, 0.5, 0.9], 6, 3, 0.1, 10), rtol=0, atol=1e-9)


def test_weighted_ranks_equal_repeating():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, w, g = rng.integers(0, 9, 40).astype(float), rng.integers(1, 6, 40), rng.integers(0, 4, 40)
        got = qt.weighted_ranks(v, w, g, 6, 0.3)
        for i in range(6):
            whole = np.sort(np.repeat(v[g == i], w[g == i]))
            assert got[i] == (whole[math.ceil(0.3 * len(whole) - 1e-9) - 1] if len(whole) else 0.0)


def test_too_many_cells_are_refused(spark, frame):
    with pytest.raises(ValueError):
        qt.summarise(spark.createDataFrame(frame), ["a", "b", "c", "a", "b", "c", "a", "b"], "y")


def test_bands_cover_what_they_say(spark, frame):
    train, test = frame[frame.project_id % 2 == 0], frame[frame.project_id % 2 == 1]
    m = qt.fit_quantiles(spark.createDataFrame(train), ["a", "b", "c"], "y", [0.1, 0.5, 0.9], rounds=40, depth=3)
    p = m.predict(test[["a", "b", "c"]].to_numpy())
    assert 0.72 < np.mean((test.y >= p[:, 0]) & (test.y <= p[:, 2])) < 0.88
    narrow, wide = test.c < 0.2, test.c > 0.8
    assert np.mean(p[wide, 2] - p[wide, 0]) > 1.5 * np.mean(p[narrow, 2] - p[narrow, 0])  # no constant multiple


def test_score_reload_and_sql_walk_agree(spark, frame, tmp_path):
    m = qt.fit_quantiles(spark.createDataFrame(frame), ["a", "b", "c"], "y", [0.1, 0.9], rounds=6, depth=4)
    m.table(spark).coalesce(1).write.parquet(str(tmp_path / "trees"))
    again = qt.QuantileModel.from_table(spark.read.parquet(str(tmp_path / "trees")), m.features, m.quantiles, 6, 4, 0.1)
    holes = pd.concat([frame.head(300), pd.DataFrame({"project_id": [9001, 9002], "a": [None, math.nan], "b": [1.0, 1.0], "c": [0.5, 0.5], "y": [1.0, 1.0]})])
    df = spark.createDataFrame(holes[["project_id", "a", "b", "c"]]).withColumn("row", F.lit("x")).withColumn("value", F.lit(3))
    values = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c") * 1.0}
    rows = {r.project_id: (r.low, r.high) for r in again.score(df, values, {0.1: "low", 0.9: "high"}).collect()}
    want = m.predict(frame[["a", "b", "c"]].to_numpy()[:300])
    assert rows[9001] == rows[9002] == (None, None)
    assert [rows[i] for i in range(300)] == [tuple(w) for w in want]
    con = duckdb.connect()
    con.register("x", frame.head(300))
    con.execute(f"CREATE TABLE t AS SELECT * FROM '{tmp_path}/trees/*.parquet'")
    walked = con.execute("""
        WITH RECURSIVE w AS (
            SELECT x.project_id, x.a, x.b, x.c, t.quantile, t.round, t.feature, t.threshold, t.value, t.node FROM x, t WHERE t.round >= 0 AND t.node = 0
            UNION ALL
            SELECT w.project_id, w.a, w.b, w.c, t.quantile, t.round, t.feature, t.threshold, t.value, t.node FROM w JOIN t ON t.quantile = w.quantile AND t.round = w.round
              AND t.node = 2 * w.node + 1 + CAST((CASE w.feature WHEN 0 THEN w.a WHEN 1 THEN w.b ELSE w.c END) > w.threshold AS INT) WHERE w.feature >= 0)
        SELECT project_id, w.quantile, any_value(i.value) + 0.1 * sum(w.value) AS p FROM w JOIN (SELECT * FROM t WHERE round < 0) i ON i.quantile = w.quantile
        WHERE w.feature < 0 GROUP BY ALL ORDER BY w.quantile, project_id""").fetchall()
    np.testing.assert_allclose([r[2] for r in walked], want.T.ravel(), rtol=0, atol=1e-9)


def test_empty_and_constant_tables(spark, frame):
    df = spark.createDataFrame(frame)
    none = qt.fit_quantiles(df.limit(0), ["a", "b"], "y", [0.5], rounds=2, depth=2)
    assert none.score(df.limit(3), {"a": F.col("a"), "b": F.col("b")}, {0.5: "p"}).select("p").distinct().collect()[0].p is None
    same = qt.fit_quantiles(df.withColumn("a", F.lit(1.0)).withColumn("y", F.lit(2.5)), ["a"], "y", [0.1, 0.9], rounds=3, depth=3)
    assert same.predict(np.array([[1.0], [5.0]])).tolist() == [[2.5, 2.5], [2.5, 2.5]]
    few = qt.fit_quantiles(df.limit(5), ["a", "b"], "y", [0.5], rounds=2, depth=2)
    assert (few.feature < 0).all() and len(few.init) == 1


def test_registered_bands_use_the_trees(spark, sf_dir, monkeypatch):
    import __spark_entry__ as E
    from pricelens.plans import model as pm, q_scenario as qs
    small = pm.quantile_model(spark, sf_dir, 4, 3)
    monkeypatch.setattr(qs, "quantile_model", lambda *a: small)
    plain = {r.project_id: r for r in E.queries()["c1_score"](spark, sf_dir).collect()}
    rows = E.queries()["c1_interval"](spark, sf_dir).collect()
    s = qs.scored(spark, sf_dir).toPandas().set_index("project_id")
    x = np.column_stack([s.avg_reward_price, s.amb_global, s.campaign_duration_days, s.trend_index, np.full(len(s), 0.5)]).astype(float)
    want = dict(zip(s.index, small.predict(x, [0.1, 0.9])))
    assert len(rows) == len(plain) == len(s)
    for r in rows:
        low, high = want[r.project_id]
        if math.isnan(low):
            assert r.confidence_low is None
            continue
        assert abs(r.confidence_low - s.funding_goal[r.project_id] * low) < 0.011 and abs(r.confidence_high - s.funding_goal[r.project_id] * high) < 0.011
        assert r.funding_ratio == plain[r.project_id].funding_ratio
    for key in ("c2_band", "c7_interval"):
        assert E.queries()[key](spark, sf_dir).count() == len(s)
    curves = E.queries()["c8_quantile_curves"](spark, sf_dir).collect()
    assert len(curves) == 6 * s.category.nunique() and all(r.q10 is not None for r in curves)
