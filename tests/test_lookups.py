"""Day lookups against brute force: ties, gaps over many buckets, far dates, nulls and empty series."""

import datetime as dt
import math
import random

import pytest

from pricelens.operators import lookups as lk


def _day(n):
    return dt.date(1970, 1, 1) + dt.timedelta(days=n)


def _frames(spark, asked, points):
    df = spark.createDataFrame([(i, None if d is None else _day(d)) for i, d in enumerate(asked)], "id long, at date")
    return df, spark.createDataFrame([(_day(d), v) for d, v in points.items()], "day date, v int")


CASES = {
    "dense": (list(range(19000, 19060)), {d: d % 97 for d in range(19000, 19060, 3)}),
    "ties": ([100, 101, 102, 103, 104], {100: 1, 104: 2}),
    "gaps": ([0, 255, 256, 5000, 9000, None], {-3000: 5, 256: 6, 257: None, 8000: 7}),
    "far": ([10, 2932000], {11: 1, 12: 2}),
    "no points": ([10, None], {}),
    "no values": ([10], {10: None}),
    "nothing asked": ([None], {10: 3}),
    "random": ([random.Random(5).randrange(-2000, 2000) for _ in range(200)],
               {d: d % 31 for d in random.Random(6).sample(range(-2500, 2500), 60)}),
}


@pytest.mark.parametrize("case", CASES)
def test_nearest(spark, case):
    asked, points = CASES[case]
    df, series = _frames(spark, asked, points)
    known = {d: v for d, v in points.items() if v is not None}
    want = {i: 50 if a is None or not known else known[min(known, key=lambda d: (abs(d - a), d))] for i, a in enumerate(asked)}
    got = {r["id"]: r["out"] for r in lk.nearest_lookup(df, "at", series, "v", "out").collect()}
    assert got == want


@pytest.mark.parametrize("case", CASES)
def test_window_mean(spark, case):
    asked, points = CASES[case]
    df, series = _frames(spark, asked, points)
    want = {}
    for i, a in enumerate(asked):
        near = [] if a is None else [v for d, v in points.items() if v is not None and abs(d - a) <= 14]
        want[i] = int(sum(near) / len(near)) if near else 50
    got = {r["id"]: r["out"] for r in lk.window_mean_lookup(df, "at", series, "v", "out").collect()}
    assert got == want


def test_broadcast_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pricelens.operators import joins
    wide = spark.range(2000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).persist()
    assert wide.count() == 2000 and 2000 * 256 < joins.cached_bytes(wide) < 2000 * 1024
    big = spark.range(10)
    plan = lambda: joins.join_small(big, wide, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(joins, "BROADCAST_BYTE_LIMIT", 1000)
    assert "broadcast" not in plan()


def test_weekday_is_the_stored_one_only_without_any_launch_date(spark):
    from pricelens.operators.features import launch_weekday
    some = spark.createDataFrame([(1, dt.datetime(2024, 1, 6), 2), (2, None, 3)], "id int, launch_date timestamp, day_of_week int")
    got = lambda df: [r[0] for r in df.orderBy("id").select(launch_weekday(df)).collect()]
    assert got(some) == [5, None]
    none = some.selectExpr("id", "cast(null as timestamp) as launch_date", "day_of_week")
    assert got(none) == got(none.drop("launch_date")) == [2, 3]
    assert got(none.drop("day_of_week")) == got(none.select("id")) == [0, 0]


def _points(n, seed):
    """Ids with three coordinates: repeated points, a hot point that holds a third of the rows, nulls and far outliers."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = [float(rng.choice([100, 500, 500, 1000, rng.randrange(5000)])), round(rng.expovariate(0.02), 1), float(rng.choice([30, 30, 60, rng.randrange(90)]))]
        if i % 3 == 0:
            p = [250.0, 20.0, 30.0]
        if i % 41 == 0:
            p[rng.randrange(3)] = None
        if i % 97 == 0:
            p[0] = 1e9 + i
        out.append((i * 7 % 1009 * 10 + i // 1009, *p))
    return out


def _brute(rows, asked, k):
    zero = lambda p: [0.0 if v is None or v != v else v for v in p]
    want = {}

    def distance(a, b):
        (x, y, z), (u, v, w) = zero(a), zero(b)
        return math.sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w))

    for q, *at in asked:
        near = sorted({(distance(p, at), i) for i, *p in rows if i is not None and i != q})[:k]
        want[q] = [(i, round(d, 6)) for d, i in near]
    return want


@pytest.mark.parametrize("cell_rows", [8, 50, 4096])
@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_nearest_neighbours(spark, monkeypatch, n, cell_rows):
    monkeypatch.setattr(lk, "KNN_ROWS", cell_rows)
    rows = _points(n, n + cell_rows)
    rows += rows[:3] + ([(None, 1.0, 2.0, 3.0), (99_999, float("nan"), 20.0, 30.0)] if n > 1 else [])
    schema = "project_id long, a double, b double, c double"
    history = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as rank", "1 as distance", "2 as _id")
    due = [r for r in rows if r[0] is not None and r[0] % 3 == 0] + ([(-5, 250.0, 20.0, 30.0), (-6, 1e12, -5.0, None)] if n else [])
    due = list({r[0]: r for r in due}.values())
    got = {}
    for r in lk.knn(history, spark.createDataFrame(due, schema), ["a", "b", "c"], 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["project_id"], round(r["distance"], 6)))
    assert got == {q: v for q, v in _brute(rows, due, 4).items() if v}


def test_cells_cover_space_and_bounds_hide_nothing():
    import numpy as np
    rng = np.random.default_rng(3)
    at = np.column_stack([rng.choice([1.0, 2.0, 2.0, 9.0], 3000), rng.normal(size=3000), rng.exponential(100, 3000).round(1)])
    cells = lk.Cells(at[:500], 40)
    mine = cells.of(at)
    assert 20 <= len(set(mine.tolist())) <= 40 and np.bincount(mine).max() < 600
    for p in at[:50]:
        d = np.sqrt(((at - p) ** 2).sum(axis=1))
        bound = np.sort(d)[10]
        assert set(mine[d <= bound].tolist()) <= set(cells.within(p, bound).tolist())
