"""Lookups into an interest series and nearest neighbours.

The interest series is a daily activity index derived from the ``events`` table (R3). Day lookups (J2, J4) merge
the distinct days of both sides in buckets of days: no calendar is filled in, so a date far off costs one row, and
the days are joined back through ``join_small``, which broadcasts them only after counting.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.operators.joins import join_small
from pricelens.session import ship_package

DEFAULT_TREND = 50


def daily_interest(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Interest per calendar day scaled 0-100 by the busiest day (day, interest)."""
    d = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    mx = d.agg(F.max("n").alias("m")).select(F.struct("m")).scalar()
    return d.select("day", F.floor(F.lit(100) * F.col("n") / mx["m"]).cast("int").alias("interest"))


#: Days in one bucket of the day merges.
BUCKET_DAYS = 256


def _days(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.to_date(ts).alias("day")).where("day is not null").distinct()


def _map_days(df: DataFrame, ts: str, table: DataFrame, out: str, default: int) -> DataFrame:
    """``table`` (day, out) joined back to the rows on their day; rows without one get the default."""
    j = join_small(df.withColumn("_day", F.to_date(ts)), table.withColumnRenamed("day", "_day"), "_day").drop("_day")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def nearest_lookup(df: DataFrame, ts: str, series: DataFrame, value: str, out: str,
                   default: int = DEFAULT_TREND) -> DataFrame:
    """Value of the series point nearest in days to the row's date (tie → earlier), else default.

    An as-of merge of two sorted sets of days: both are cut into buckets of days, each bucket is merged by itself, and
    its first and last points are carried over the edges through a table of one row a bucket. Series points without a
    value are no points; a null date and an empty series give the default. ``series`` has one row a day."""
    points = series.where(F.col(value).isNotNull()).select("day", F.struct("day", F.col(value).alias("v")).alias("_p"))
    merged = _days(df, ts).join(points, "day", "full").withColumn("_b", F.floor(F.unix_date("day") / F.lit(BUCKET_DAYS)))
    edges = merged.groupBy("_b").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    over = Window.orderBy("_b")  # one row a bucket: dates of 10,000 years make 14,300 of them
    edges = edges.select("_b", F.max("_last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                         F.min("_first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy("_b").orderBy("day")
    near = merged.join(edges, "_b").select(
        "day", F.coalesce(F.last("_p", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_before").alias("_l"),
        F.coalesce(F.first("_p", True).over(inside.rowsBetween(0, Window.unboundedFollowing)), "_after").alias("_r"))
    left, right = F.datediff("day", F.col("_l.day")), F.datediff(F.col("_r.day"), "day")
    pick = F.when(F.col("_r").isNull() | (left <= right), F.col("_l.v")).otherwise(F.col("_r.v"))
    return _map_days(df, ts, near.select("day", pick.alias(out)), out, default)


def month_lookup(df: DataFrame, key: str, ts: str, monthly: DataFrame, out: str,
                 default: int = DEFAULT_TREND) -> DataFrame:
    """Unique (key, month) pairs first, look each up once, map back (default 50)."""
    m = F.date_trunc("month", F.col(ts)).cast("date")
    combos = df.select(F.col(key).alias("_k"), m.alias("_m")).distinct()
    looked = combos.join(monthly.select(F.col("month").alias("_m"), F.col("interest").alias(out)), "_m", "left")
    looked = looked.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return df.join(looked, (F.col(key).eqNullSafe(F.col("_k"))) & (m == F.col("_m")), "left").drop("_k", "_m")


def window_mean_lookup(df: DataFrame, ts: str, series: DataFrame, value: str, out: str, days: int = 14,
                       default: int = DEFAULT_TREND) -> DataFrame:
    """int(mean series value over [date − days, date + days]); default when no points.

    Each series point is copied to the buckets of days its window reaches into; a range frame over the days of one
    bucket then sees every point it needs. Null dates get the default."""
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(BUCKET_DAYS))
    asked = _days(df, ts).select("day", F.lit(None).cast("double").alias("_v"), bucket("day").alias("_b"), F.lit(True).alias("_asked"))
    points = series.select("day", F.col(value).cast("double").alias("_v"), F.explode(F.sequence(
        bucket(F.date_sub("day", days)), bucket(F.date_add("day", days)))).alias("_b"), F.lit(False).alias("_asked"))
    w = Window.partitionBy("_b").orderBy(F.unix_date("day")).rangeBetween(-days, days)
    means = asked.unionByName(points).withColumn("_m", F.avg("_v").over(w)).where("_asked")
    return _map_days(df, ts, means.select("day", F.col("_m").cast("int").alias(out)), out, default)


#: kNN index: points a cell aims at, the most cells, and the size of the sample of points that places the cuts.
KNN_ROWS, KNN_CELLS, KNN_SAMPLE = 4096, 1 << 14, 1 << 17
#: Query points whose distances to the rows of a cell are held at once.
KNN_QUERIES = 16


class Cells:
    """A partition of space into boxes by median cuts of a sample, each along the side in which the points lie widest."""

    def __init__(self, sample, n_cells: int):
        import numpy as np
        width = sample.shape[1]
        self.dim, self.cut, self.child, self.cell, lows, highs = [], [], [], [], [], []
        todo = [(sample, n_cells, np.full(width, -np.inf), np.full(width, np.inf), None)]
        while todo:
            part, want, low, high, parent = todo.pop()
            if parent is not None:
                self.child[parent[0]][parent[1]] = len(self.dim)
            spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(width)
            axis = int(spread.argmax())
            leaf = want < 2 or len(part) < 2 or not spread[axis] > 0
            at = 0.0
            if not leaf:
                values = np.sort(part[:, axis])
                at = values[(len(values) - 1) // 2]
                if at == values[-1]:  # the upper half is one value: cut below it
                    at = values[values < at][-1]
                left = part[:, axis] <= at
                node = len(self.dim)
                for side, mine in ((1, ~left), (0, left)):
                    lo, hi = low.copy(), high.copy()
                    (hi if side == 0 else lo)[axis] = at
                    todo.append((part[mine], want // 2 if side else want - want // 2, lo, hi, (node, side)))
            else:
                lows.append(low)
                highs.append(high)
            self.dim.append(axis)
            self.cut.append(at)
            self.child.append([-1, -1])
            self.cell.append(len(lows) - 1 if leaf else -1)
        self.dim, self.cut, self.child, self.cell = (np.array(x) for x in (self.dim, self.cut, self.child, self.cell))
        self.low, self.high = np.array(lows), np.array(highs)

    def of(self, at):
        """Cell of each point (rows of ``at``)."""
        import numpy as np
        node, rows = np.zeros(len(at), np.int64), np.arange(len(at))
        while (inner := self.cell[node] < 0).any():
            right = (at[rows, self.dim[node]] > self.cut[node]).astype(np.int64)
            node = np.where(inner, self.child[node, right], node)
        return self.cell[node]

    def within(self, point, bound):
        """Cells whose box comes as near to a point as ``bound``. The sum runs in the order of the distances' sum and each step
        is monotonic, so rounding never hides a cell."""
        import numpy as np
        d = np.zeros(len(self.low))
        for i, x in enumerate(point):
            d += np.maximum(np.maximum(self.low[:, i] - x, x - self.high[:, i]), 0.0) ** 2
        return np.flatnonzero(np.sqrt(d) <= bound)


def _nearest_in_cell(xs: list[str], k: int, at_once: int):
    """Cogroup body: for each query point of a cell its k nearest rows there, by distance, then id."""

    def run(rows, queries):
        import numpy as np
        import pandas as pd
        rows = rows.sort_values("_id", kind="stable")
        ids, at = rows["_id"].to_numpy(), rows[xs].to_numpy(float)
        out, points = [], queries[xs].to_numpy(float)
        for block in (points[i:i + at_once] for i in range(0, len(points), at_once)):
            distances = np.zeros((len(block), len(ids)))
            for i in range(len(xs)):
                distances += (at[:, i] - block[:, i, None]) ** 2
            for point, d in zip(block, np.sqrt(distances)):
                near = np.arange(len(ids))
                if len(near) > k:
                    near = np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))  # with the ties of the k-th
                near = near[np.argsort(d[near], kind="stable")][:k]
                out.append((*point, ids[near], d[near]))
        return pd.DataFrame(out, columns=[*xs, "ids", "ds"])

    return run


def knn(history: DataFrame, queries: DataFrame, cols: Sequence[str], k: int = 10, key: str = "project_id") -> DataFrame:
    """K nearest history rows (Euclidean, unscaled) for every row of a query table; ties by id.

    Null and NaN coordinates count as 0. Rows without a key are neither history nor queries, a row is never its own
    neighbour, and an id repeated at one point counts once; fewer than k other rows give fewer neighbours.

    An exact index: points that many rows share keep their k + 1 smallest ids, space is cut into boxes of about
    KNN_ROWS points (cuts from a hash sample of about KNN_SAMPLE points, all that the driver sees; every row is indexed), and
    each query point first searches its own cell. The k + 1st distance found there bounds which other cells can hold a
    nearer row, and only those are visited. The history is shuffled by point and by cell, never copied."""
    point = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)]
    xs = [f"_x{i}" for i in range(len(cols))]
    slim = lambda df: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), *point)
    ship_package(history.sparkSession)
    rows, asked = slim(history), slim(queries)
    smallest = Window.partitionBy(*xs).orderBy("_id")
    points = rows.withColumn("_r", F.dense_rank().over(smallest)).where(F.col("_r") <= k + 1)
    # An id repeated at a point follows itself there: dropped in the same order, where distinct() would shuffle the history again.
    points = points.withColumn("_r", F.lag("_id").over(smallest)).where(~F.col("_r").eqNullSafe(F.col("_id"))).drop("_r")

    n = rows.agg(F.approx_count_distinct(F.struct(*xs))).first()[0]
    rare = F.pmod(F.xxhash64(*xs), F.lit(1 << 30)) < int(min(1.0, KNN_SAMPLE / max(n, 1)) * (1 << 30))
    cells = Cells(rows.where(rare).select(*xs).distinct().toPandas().to_numpy(float), min(KNN_CELLS, -(-n // KNN_ROWS)))

    @F.pandas_udf("int")
    def cell_of(at: pd.DataFrame) -> pd.Series:
        return pd.Series(cells.of(at.to_numpy(float)))

    @F.pandas_udf("array<int>")
    def others(at: pd.DataFrame, bound: pd.Series) -> pd.Series:
        at = at.to_numpy(float)
        return pd.Series([[c for c in cells.within(p, b).tolist() if c != own] for p, b, own in zip(at, bound, cells.of(at).tolist())])

    search = lambda q: indexed.groupBy("_cell").cogroup(q.groupBy("_cell")).applyInPandas(
        _nearest_in_cell(xs, k + 1, KNN_QUERIES), ", ".join(f"{x} double" for x in xs) + ", ids array<long>, ds array<double>")
    at = F.struct(*xs)
    indexed = points.withColumn("_cell", cell_of(at))
    own = search(asked.select(*xs).distinct().withColumn("_cell", cell_of(at)))
    bound = F.when(F.size("ds") > k, F.element_at("ds", -1)).otherwise(F.lit(float("inf")))
    found = own.unionByName(search(own.select(*xs, F.explode(others(at, bound)).alias("_cell"))))
    found = found.select(*xs, F.explode(F.arrays_zip("ds", "ids")).alias("_n"))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*xs).orderBy("_n"))).where(F.col("_r") <= k + 1)
    best = found.groupBy(*xs).agg(F.sort_array(F.collect_list("_n")).alias("_near"))  # k + 1 a point
    mine = F.slice(F.filter("_near", lambda x: x["ids"] != F.col("_id")), 1, k)
    near = asked.join(best, xs).select(F.col("_id").alias("query_id"), F.posexplode(mine).alias("_p", "_n"))
    return near.select("query_id", F.col("_n.ids").alias(key), F.col("_n.ds").alias("distance"), (F.col("_p") + 1).alias("rank"))
