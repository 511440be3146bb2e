"""Quantile boosting over a bounded contingency table, and the model that scores any feature expression.

Boosting needs hundreds of dependent passes over the same rows. Instead of one Spark job a pass, two native
aggregations over all rows reduce the table to what histogram trees can see of it:

1. one ``percentile_approx`` pass gives each feature's bin edges and the outcome's levels;
2. rows are counted per (cell of feature bins, outcome level), with map-side combine.

The result has at most n_bins ** features * n_levels rows whatever the size of the table (10 million for five features in
10 bins and 100 levels, about 120 MB), so one task can grow a quantile's trees over it. Every row of the table is
counted; what is given up is the resolution of thresholds (tenths of the rows) and outcomes (hundredths).
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.session import ship_package

#: Bins of a feature and levels of the outcome. The counted table has n_bins ** features * n_levels rows at most.
BINS, LEVELS = 10, 100
#: A larger bound than this is refused.
MOST_CELLS = 20_000_000

TREE_SCHEMA = "quantile double, round int, node int, feature int, threshold double, value double"


@dataclass
class QuantileModel:
    """Boosted trees per quantile. Node i of a tree has the children 2 i + 1 (feature <= threshold) and 2 i + 2; feature
    -1 marks a leaf. ``init`` is empty for a model fitted on no rows, whose predictions are null."""

    features: list[str]
    quantiles: list[float]
    init: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    rate: float

    def predict(self, x: np.ndarray, quantiles: Sequence[float] | None = None) -> np.ndarray:
        """One column per quantile for feature rows; a row with a missing feature gives NaN."""
        wanted = list(self.quantiles if quantiles is None else quantiles)
        out = np.full((len(x), len(wanted)), np.nan)
        whole = ~np.isnan(x).any(axis=1)
        if not len(self.init) or not whole.any():
            return out
        x = np.ascontiguousarray(x[whole])
        rows = np.arange(len(x))
        for column, quantile in enumerate(wanted):
            c = self.quantiles.index(quantile)
            total = np.full(len(x), self.init[c])
            for feature, threshold, value in zip(self.feature[c], self.threshold[c], self.value[c]):
                node = np.zeros(len(x), np.int64)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node]), node)
                total += self.rate * value[node]
            out[whole, column] = total
        return out

    def score(self, df: DataFrame, values: dict[str, Column], names: dict[float, str]) -> DataFrame:
        """``df`` with one column per wanted quantile (quantile -> name), for the given feature expressions. A null or NaN
        feature, or a model fitted on no rows, gives null. Columns of ``df`` may have any names but the new ones."""
        ship_package(df.sparkSession)
        x = F.array(*[F.coalesce(values[f].cast("double"), F.lit(float("nan"))) for f in self.features])
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), x.alias("x"))
        out = T.StructType([packed.schema["row"], *[T.StructField(n, T.DoubleType()) for n in names.values()]])
        wanted, k = list(names), len(self.features)

        def run(batches):
            import pyarrow as pa
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                p = self.predict(x, wanted)
                cols = [pa.array(p[:, i], pa.float64(), mask=np.isnan(p[:, i])) for i in range(len(wanted))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *names.values()])

        return packed.mapInArrow(run, out).select("row.*", *names.values())

    def table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows; round -1 holds each quantile's first prediction. quantiles x rounds x nodes rows."""
        import pandas as pd
        q, r, n = np.indices(self.feature.shape)
        used = ((self.feature >= 0) | (self.value != 0) | (n == 0)).ravel()
        parts = {"quantile": np.array(self.quantiles)[q.ravel()], "round": r.ravel(), "node": n.ravel(), "feature": self.feature.ravel(),
                 "threshold": self.threshold.ravel(), "value": self.value.ravel()}
        first = pd.DataFrame({"quantile": self.quantiles[:len(self.init)], "round": -1, "node": 0, "feature": -1, "threshold": 0.0, "value": self.init})
        return spark.createDataFrame(pd.concat([first, pd.DataFrame(parts)[used]], ignore_index=True), TREE_SCHEMA)

    @classmethod
    def from_table(cls, trees: DataFrame, features: Sequence[str], quantiles: Sequence[float], rounds: int, depth: int, rate: float) -> "QuantileModel":
        """Read back what ``table`` wrote; the scores are the same to the last bit."""
        shape = (len(quantiles), rounds, (2 << depth) - 1)
        feature, threshold, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
        init = {}
        rows = trees.toPandas()
        for r in rows[rows["round"] < 0].itertuples():
            init[r.quantile] = r.value
        rows = rows[rows["round"] >= 0]
        at = (rows["quantile"].map({q: i for i, q in enumerate(quantiles)}).to_numpy(int), rows["round"].to_numpy(), rows["node"].to_numpy())
        feature[at], threshold[at], value[at] = rows["feature"], rows["threshold"], rows["value"]
        return cls(list(features), list(quantiles), np.array([init[q] for q in quantiles if q in init]), feature, threshold, value, rate)


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin: how many edges lie below x."""
    return sum(((x > F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def summarise(df: DataFrame, xs: Sequence[str], y: str, n_bins: int = BINS, n_levels: int = LEVELS) -> tuple[list[list[float]], list[float], DataFrame]:
    """(bin edges per feature, values of the outcome levels, counted table cell / level / n) of all complete rows."""
    if n_bins ** len(xs) * n_levels > MOST_CELLS:
        raise ValueError(f"{n_bins} bins of {len(xs)} features and {n_levels} levels make more than {MOST_CELLS} cells")
    cols = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*xs, y])]
    rows = df.select(*cols)
    rows = rows.where(" and ".join(f"c{i} is not null and not isnan(c{i})" for i in range(len(cols))))
    cuts = [i / n_bins for i in range(1, n_bins)]
    # Odd multiples of 1 / (2 n_levels) are the levels' values, even ones the borders between them.
    halves = [i / (2 * n_levels) for i in range(1, 2 * n_levels)]
    found = rows.agg(*[F.percentile_approx(f"c{i}", cuts if i < len(xs) else halves, 10_000).alias(f"p{i}") for i in range(len(cols))]).first()
    edges = [sorted(set(found[f"p{i}"] or ())) for i in range(len(xs))]
    borders = sorted(set((found[f"p{len(xs)}"] or ())[1::2]))
    values = (found[f"p{len(xs)}"] or [])[::2]
    # With ties some levels fall together: a level's value is the middle one of the values dealt to it.
    dealt: dict[int, list[float]] = {}
    for v in values:
        dealt.setdefault(sum(v > b for b in borders), []).append(v)
    cell, scale = F.lit(0), 1
    for i, e in enumerate(edges):
        cell = cell + bin_of(F.col(f"c{i}"), e) * F.lit(scale)
        scale *= n_bins
    level = F.size(F.filter(F.array(*[F.lit(b) for b in borders]).cast("array<double>"), lambda b: b < F.col(f"c{len(xs)}")))
    counted = rows.select(cell.cast("int").alias("cell"), level.alias("level")).groupBy("cell", "level").agg(F.count("*").alias("n"))
    levels, last = [], 0.0
    for i in range(len(borders) + 1):  # a level no value was dealt to lies at its border
        mine = dealt.get(i) or [borders[min(i, len(borders) - 1)] if borders else last]
        levels.append(mine[len(mine) // 2])
    return edges, levels, counted


def weighted_ranks(values: np.ndarray, weights: np.ndarray, group: np.ndarray, n_groups: int, q: float) -> np.ndarray:
    """Per group the ceil(q * n)-th smallest of its values, each value counting as often as its weight; 0 if empty."""
    order = np.lexsort((values, group))
    values, weights, group = values[order], weights[order], group[order]
    run = np.cumsum(weights)
    total = np.bincount(group, weights, n_groups)
    before = np.concatenate([[0], np.cumsum(total)[:-1]])
    at = np.searchsorted(run, before + np.maximum(1, np.ceil(q * total - 1e-9)) - 0.5)
    return np.where(total > 0, values[np.minimum(at, len(values) - 1)], 0.0)


def cell_ranks(y: np.ndarray, f: np.ndarray, upto: np.ndarray, group: np.ndarray, n_groups: int, q: float) -> np.ndarray:
    """Per group of cells the ceil(q * n)-th smallest y[level] - f[cell], counted by rows; 0 if empty.

    ``y`` ascends, so a cell's values ascend too and ``upto`` (rows of a cell below each level) counts them: the rank is found
    by bisecting the bits of the doubles, at most 64 steps over the cells, without sorting cells x levels values."""
    total = np.bincount(group, upto[:, -1], n_groups)
    rank = np.maximum(1, np.ceil(q * total - 1e-9)) - 0.5
    cells, top = np.arange(len(f)), len(y) - 1

    def value(key):  # doubles in the order of their keys
        return np.where(key < 0, np.int64(-1) ^ key | np.int64(-1 << 63), key).view(np.float64)

    def key(v):
        bits = (v + 0.0).view(np.int64)
        return np.where(bits < 0, np.int64(-1) ^ bits | np.int64(-1 << 63), bits)

    low = np.full(n_groups, key(np.array([y[0] - f.max()]))[0]) - 1  # below every value
    high = np.full(n_groups, key(np.array([y[-1] - f.min()]))[0])
    while (low + 1 < high).any():
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        t = value(middle)[group]
        at = np.searchsorted(y, f + t, "right")
        # The sum rounds otherwise than the difference that is ranked: step to the level where the latter crosses t.
        while (back := (at > 0) & (y[np.maximum(at - 1, 0)] - f > t)).any():
            at -= back
        while (on := (at <= top) & (y[np.minimum(at, top)] - f <= t)).any():
            at += on
        enough = np.bincount(group, upto[cells, at], n_groups) > rank
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return np.where(total > 0, value(high), 0.0)


def boost(cell: np.ndarray, level: np.ndarray, n: np.ndarray, edges: list[list[float]], levels: Sequence[float], quantiles: Sequence[float], rounds: int,
          depth: int, rate: float, min_leaf: int, n_bins: int):
    """(init, feature, threshold, value) of all quantiles from the counted table; arrays by quantile, round and node.

    Each round fits a tree of least squares to q - 1[y < f] and sets every leaf to the q-quantile of y - f in it. Ties
    of a split go to the first feature, then the lowest threshold.
    """
    k, y = len(edges), np.asarray(levels, float)
    cells, row = np.unique(cell, return_inverse=True)
    bins = np.array([cells // n_bins ** j % n_bins for j in range(k)])
    size = np.bincount(row, n, len(cells))
    upto = np.zeros((len(cells), len(y) + 1))  # rows of a cell below each level
    np.add.at(upto, (row, level + 1), n)
    upto = np.cumsum(upto, axis=1)
    n_q, nodes = len(quantiles), (2 << depth) - 1
    feature, threshold, value = np.full((n_q, rounds, nodes), -1, np.int32), np.zeros((n_q, rounds, nodes)), np.zeros((n_q, rounds, nodes))
    init = np.zeros(n_q)
    for c, q in enumerate(quantiles):
        init[c] = weighted_ranks(y[level], n, np.zeros(len(n), np.int64), 1, q)[0]
        f = np.full(len(cells), init[c])
        for r in range(rounds):
            slope = q * size - upto[np.arange(len(cells)), np.searchsorted(y, f, "left")]
            node = np.zeros(len(cells), np.int64)
            for d in range(depth):
                first, width = (1 << d) - 1, 1 << d
                here = np.flatnonzero(node >= first)
                at = (node[here] - first) * n_bins + bins[:, here]
                count = np.stack([np.bincount(a, size[here], width * n_bins).reshape(width, n_bins) for a in at], 1)
                total = np.stack([np.bincount(a, slope[here], width * n_bins).reshape(width, n_bins) for a in at], 1)
                n_all, s_all = count.sum(-1, keepdims=True), total.sum(-1, keepdims=True)
                n_left, s_left = np.cumsum(count, -1)[..., :-1], np.cumsum(total, -1)[..., :-1]
                n_right, s_right = n_all - n_left, s_all - s_left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s_left ** 2 / n_left + s_right ** 2 / n_right - s_all ** 2 / n_all
                gain = np.where((n_left >= min_leaf) & (n_right >= min_leaf), gain, 0.0).reshape(width, -1)
                # Equal gains differ by rounding: anything within a millionth of the best counts as best.
                best = (gain >= gain.max(-1, keepdims=True) * (1 - 1e-6)).argmax(-1)
                moves = np.full(nodes, -1), np.zeros(nodes, np.int64)
                for w in np.flatnonzero(gain.max(-1) > 1e-9):
                    j, cut = divmod(int(best[w]), n_bins - 1)
                    feature[c, r, first + w], threshold[c, r, first + w] = j, edges[j][cut]
                    moves[0][first + w], moves[1][first + w] = j, cut
                j = moves[0][node]
                split = np.flatnonzero(j >= 0)
                node[split] = 2 * node[split] + 1 + (bins[j[split], split] > moves[1][node[split]])
            found = cell_ranks(y, f, upto, node, nodes, q)
            leaf = feature[c, r] < 0
            value[c, r, leaf] = found[leaf]
            f = f + rate * value[c, r, node]
    return init, feature, threshold, value


def fit_quantiles(df: DataFrame, xs: Sequence[str], y: str, quantiles: Sequence[float], rounds: int = 100, depth: int = 6, rate: float = 0.1,
                  min_leaf: int = 10, n_bins: int = BINS, n_levels: int = LEVELS) -> QuantileModel:
    """Fit on all complete rows of ``df`` (nulls and NaN in a feature or the target leave a row out). Extra columns
    are ignored; an empty table gives a model whose predictions are null."""
    ship_package(df.sparkSession)
    xs, quantiles = list(xs), [float(q) for q in quantiles]
    edges, levels, counted = summarise(df, xs, y, n_bins, n_levels)

    def run(table):
        import pyarrow as pa
        i = table.column("i")[0].as_py()
        parts = [table.column(c).to_numpy().astype(np.int64) for c in ("cell", "level", "n")]
        found = boost(*parts, edges, levels, quantiles[i:i + 1], rounds, depth, rate, min_leaf, n_bins)
        return pa.table({"i": pa.array([i], pa.int32()), "model": pa.array([pickle.dumps(found, 5)], pa.binary())})

    # A task a quantile, each with the bounded table; a row of rounds x 2^(depth + 1) nodes comes back, whatever the table.
    every = F.explode(F.array(*[F.lit(i) for i in range(len(quantiles))])).alias("i")
    counted = counted.select(every, "cell", "level", "n").repartition(max(len(quantiles), 1), "i")
    got = {r["i"]: pickle.loads(r["model"]) for r in counted.groupBy("i").applyInArrow(run, "i int, model binary").collect()}
    shape = (len(quantiles), rounds, (2 << depth) - 1)
    empty = (np.zeros(0), np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape))
    init, feature, threshold, value = (np.concatenate([got[i][j] for i in range(len(quantiles))]) for j in range(4)) if got else empty
    return QuantileModel(xs, quantiles, init, feature, threshold, value, rate)
