"""Edge fixtures for the pandas/Spark traps, with hand-computed answers."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.functions import exprs as X
from pricelens.operators import features as fe
from pricelens.operators import ranking as rk
from pricelens.sources import ingest


def test_zero_denominators_map_to_one(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (10.0, None)], "p double, g double")
    got = [r[0] for r in df.select(X.safe_div("p", "g")).collect()]
    assert got == [10.0, 2.5, None]


def test_coercion_to_null(spark):
    df = spark.createDataFrame([("abc",), ("",), ("12.5",), (None,)], "s string")
    got = [r[0] for r in df.select(ingest.coerce_number("s")).collect()]
    assert got == [None, None, 12.5, None]
    ts = spark.createDataFrame([("2024-01-02 03:04:05",), ("bad date",)], "s string")
    got = [r[0] for r in ts.select(ingest.coerce_timestamp("s")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_null_comparison_flag_is_zero(spark):
    df = spark.createDataFrame([(None,), (4.0,)], "r double")
    assert [r[0] for r in df.select(X.flag(F.col("r") > 3)).collect()] == [0, 1]


def test_guarded_greatest_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(X.guard_greatest("x", 0.0)).collect()] == [None, 0.0, 2.0]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6),), (dt.datetime(2024, 1, 8),)], "d timestamp_ntz")
    assert [r[0] for r in df.select(X.weekday("d")).collect()] == [5, 0]


def test_holiday_edges_floor_semantics(spark):
    # Christmas 2023: in from exactly 7 days before, up to (not including) 8 days after
    rows = [(dt.datetime(2023, 12, 18, 0, 0, 0),), (dt.datetime(2023, 12, 17, 23, 59, 59),),
            (dt.datetime(2024, 1, 1, 23, 0, 0),), (dt.datetime(2023, 12, 28),), (None,)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    got = [r[0] for r in df.select(X.holiday_flag("d")).collect()]
    # 12-17 23:59:59 is 7 days 1 s before → floor(-7.00001) = -8 → out
    assert got == [1, 0, 1, 1, 0]


def test_tier_parsing(spark):
    df = spark.createDataFrame([("[10, 25]",), ("[]",), ('[10,"x"]',), ("[0,-5,20]",), ("5",), ("bad",), (None,)],
                               "t string")
    parsed = df.select(X.positive_tiers(X.parse_tiers_json("t")).alias("a"))
    got = [r[0] for r in parsed.collect()]
    assert got == [[10.0, 25.0], [], [], [20.0], [], [], []]


def test_tier_stats_empty_is_zero(spark):
    df = spark.createDataFrame([([10.0, 20.0],), (None,)], "reward_tiers array<double>")
    r = fe.tier_stats(df).select("num_reward_tiers", "min_reward_price", "avg_reward_price", "price_spread").collect()
    assert tuple(r[0]) == (2, 10.0, 15.0, 10.0) and tuple(r[1]) == (0, 0.0, 0.0, 0.0)


def test_neighbour_count_null_rules(spark):
    rows = [(1, "A", dt.datetime(2024, 1, 1)), (2, "A", dt.datetime(2024, 1, 8)), (3, "A", dt.datetime(2024, 1, 20)),
            (4, None, dt.datetime(2024, 1, 1)), (5, "A", None)]
    df = spark.createDataFrame(rows, "id int, category string, launch_date timestamp_ntz")
    got14 = dict(fe.range_neighbour_count(df, "category", "launch_date", 14, "c").select("id", "c").collect())
    assert got14 == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0}
    got7 = dict(fe.range_neighbour_count(df, "category", "launch_date", 7, "c", null_key_value=-1,
                                         null_ts_value=10).select("id", "c").collect())
    assert got7 == {1: 1, 2: 1, 3: 0, 4: -1, 5: 10}


def test_dedup_keep_first_and_null_ids(spark):
    rows = [(1, 2, 0, "b"), (1, 1, 5, "a"), (1, 3, 0, "c"), (None, 1, 1, "n1"), (None, 1, 0, "n0")]
    df = spark.createDataFrame(rows, "id int, rank int, row int, v string")
    first = {r["id"]: r["v"] for r in ingest.dedup_keep(df, "id", ["rank", "row"], "first").collect()}
    last = {r["id"]: r["v"] for r in ingest.dedup_keep(df, "id", ["rank", "row"], "last").collect()}
    assert first == {1: "a", None: "n0"} and last == {1: "c", None: "n1"}


def test_kfold_sizes(spark):
    df = spark.range(12).withColumnRenamed("id", "project_id")
    sizes = sorted(tuple(r) for r in rk.contiguous_folds(df, ["project_id"], 5).groupBy("fold").count().collect())
    assert [s[1] for s in sizes] == [3, 3, 2, 2, 2]


def test_swap_rename_no_collision(spark):
    df = spark.createDataFrame([("fine", "coarse")], "category string, subcategory string")
    r = ingest.swap_rename(df).first()
    assert r["category"] == "coarse" and r["subcategory"] == "fine"


def test_intersect_union_keeps_common_columns(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "id int, name string, goal double")
    b = spark.createDataFrame([(2, 2.0, "y")], "id int, goal double, name string")
    c = spark.createDataFrame([(3, "z", 3.0, 7)], "id int, name string, goal double, backers int")
    u = ingest.intersect_union([a, b, c], whitelist=["id", "name", "goal"])
    assert u.columns == ["id", "name", "goal"] and u.count() == 3


def test_money_text(spark):
    df = spark.createDataFrame([("$1,234 USD", "45% funded"), ("€50", "120%"), ("n/a", "nothing")], "a string, c string")
    f = ingest.money_fields("a", "c")
    got = [tuple(r) for r in df.select(f["pledged_amount"], f["percent_funded"], f["funding_goal"], f["status"]).collect()]
    assert got == [(1234.0, 45, 2742.0, "live"), (50.0, 120, 41.0, "successful"), (0.0, 0, 0.0, "live")]


def test_json_name_variants(spark):
    df = spark.createDataFrame([('{"name":"Art"}',), ('{"slug":"x"}',), ("123",), ("plain",), (None,)], "c string")
    got = [r[0] for r in df.select(ingest.json_name("c", "strict")).collect()]
    assert got == ["Art", "Unknown", "123", "plain", "Unknown"]
