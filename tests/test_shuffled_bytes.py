"""What j10_similar_due and the tables below it shuffle and write (finding F18): the rows stay, the copies on the way go."""

import datetime as dt
import glob

import pytest

from pricelens.operators import lookups as lk
from pricelens.plans import common
from pricelens.sources.tables import campaign_view


@pytest.fixture
def plain_plans(spark):
    """Plans that can be walked as they will run: no adaptive wrapper, no broadcast by size."""
    want = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _exchanges(df):
    return [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]


def _columns(node):
    return [node.output().apply(i).name() for i in range(node.output().size())]


def _tables(spark, base):
    """Orders with a repeated key, unknown and null customers, no lines; lines without an order."""
    day = dt.date(1996, 3, 1)
    orders = [(1, 10, "O", 100.0, day, "1-URGENT"), (2, 11, "O", 200.0, day, "2-HIGH"), (2, 11, "O", 200.0, day, "2-HIGH"),
              (3, None, "O", 300.0, None, None), (4, 99, "O", 0.0, day, "5-LOW"), (None, 10, "O", 5.0, day, "5-LOW")]
    lines = [(1, 2.0, 500.0, 0.1), (1, 1.0, 900.0, 0.0), (2, 4.0, 800.0, 0.5), (3, 0.0, 70.0, 0.0), (7, 1.0, 70.0, 0.0), (None, 1.0, 10.0, 0.0)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double"),
            ("customer", [(10, "ann", 0, "TOOLS"), (11, "bob", None, None), (None, "nobody", 0, "TOOLS")],
             "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
            ("nation", [(0, "PERU")], "n_nationkey int, n_name string")):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    return str(base)


def test_only_narrow_orders_are_shuffled_by_customer(spark, tmp_path, plain_plans):
    view = campaign_view(spark, _tables(spark, tmp_path))
    by = [_columns(n) for n in _exchanges(view) if "(o_custkey#" in n.simpleString(99)]
    assert by and not any({"reward_tiers", "pledged", "qty"} & set(c) for c in by)
    rows = view.select("project_id", "name", "category", "country", "pledged_amount", "backers_count", "reward_tiers").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (1, "ann", "TOOLS", "PERU", 1350.0, 3, [2.5, 9.0]), (2, "bob", None, None, 400.0, 4, [2.0]), (2, "bob", None, None, 400.0, 4, [2.0]),
        (3, None, None, None, 0.0, 0, None), (4, None, None, None, 0.0, 0, None), (None, "ann", "TOOLS", "PERU", 0.0, 0, None)], key=str)


def test_the_history_is_shuffled_by_point_and_by_cell_only(spark, plain_plans):
    """A repeated id and both zeros at one point, in different partitions: one neighbour, without a shuffle by id and point."""
    rows = [(i % 40, float(i % 7), -0.0 if i % 2 else 0.0) for i in range(200)] + [(50, 1.0, 0.0), (50, 1.0, -0.0), (50, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "project_id long, a double, b double").repartition(5)
    near = lk.knn(df, df.where("project_id = 50").distinct(), ["a", "b"], 10)
    assert [n for n in _exchanges(near) if "_id" in _columns(n)]
    assert not [n for n in _exchanges(near) if "(_id#" in n.simpleString(99)]
    got = {(r["rank"], r["project_id"], r["distance"]) for r in near.collect()}
    want = sorted({(abs(a - 1.0), i) for i, a, _ in rows if i != 50})[:10]
    assert got == {(p + 1, i, d) for p, (d, i) in enumerate(want)}


def test_stage_tables_are_compressed(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq
    monkeypatch.setattr(common, "_STAGED", {})
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: str(tmp_path / "stage" / name))
    base = _tables(spark, tmp_path / "in")
    assert common.campaigns(spark, base).count() == 6 == common.features(spark, base).count()
    for level in ("campaign", "enriched", "features"):
        files = glob.glob(str(tmp_path / "stage" / f"{level}-*" / "*.parquet"))
        assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files)
