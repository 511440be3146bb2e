"""Orthogonal forest (M10): honest trees that split where the local effect of a treatment differs.

Works on residuals of outcome and treatment (cross-fitted nuisance forests). Every tree draws its own half of the
rows by a hash of the key and splits it once more: one part places the splits, the other estimates the leaves. A split
maximises the spread of the gradient pseudo-outcomes ``T (Y - theta T) / mean(T^2)`` between its sides, which needs only
the count and the sums of T^2 and TY by (tree, node, feature, bin). Each level is one aggregation over the
rows: a task adds up its rows in NumPy, Spark adds up the tasks. The driver holds trees and sums, whose size does not grow
with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.forest import cross_fit
from pricelens.session import ship_package

#: Bins of a feature (cuts at sketched quantiles) and the accuracy of those sketches.
BINS, ACCURACY = 32, 10_000
#: Normal quantile of the 95 % interval: a fixed value.
Z95 = 1.959963984540054


@dataclass
class EffectForest:
    """Trees as heaps (children of node i: 2i + 1, 2i + 2); feature -1 marks a leaf."""

    xs: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    theta: np.ndarray | None = None
    slope: np.ndarray | None = None
    se: np.ndarray | None = None

    def bins(self, at: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, at[:, j], side="left") for j, c in enumerate(self.cuts)]) if len(at) else np.zeros(at.shape, np.int64)

    def node(self, tree: int, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[tree, node]
            if not (f >= 0).any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.bin[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)

    def effect(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect, standard error): leaves weighted by their mean T^2. A mean's deviation is at most the mean deviation, so
        the error is an upper bound whatever the trees share."""
        top, weight, error = np.zeros(len(bins)), np.zeros(len(bins)), np.zeros(len(bins))
        for t in range(len(self.feature)):
            leaf = self.node(t, bins)
            a = self.slope[t, leaf]
            top += a * self.theta[t, leaf]
            weight += a
            error += a * self.se[t, leaf]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(weight > 0, top / weight, np.nan), np.where(weight > 0, error / weight, np.nan)


def _part(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """0: places the splits of a tree, 1: estimates its leaves, 2 and 3: not drawn."""
    h = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) & np.uint64(3)


def _sums(rows: DataFrame, body, n: int) -> pd.DataFrame:
    """Sums by ``slot`` of what ``body`` adds up in a task (arrays of ``n`` columns by slot)."""
    names = [f"s{i}" for i in range(n)]

    def run(batches):
        total = None
        for batch in batches:
            got = body(batch)
            total = got if total is None else total + got
        if total is not None:
            slot = np.flatnonzero(total[0])
            yield pd.DataFrame({"slot": slot, **{c: total[i, slot] for i, c in enumerate(names)}})

    out = rows.mapInPandas(run, "slot long, " + ", ".join(f"{c} double" for c in names))
    return out.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toPandas()


def grow(res: DataFrame, xs: Sequence[str], key: str, n_trees: int = 50, max_depth: int = 5, min_leaf: int = 20,
         min_share: float = 0.05, seed: int = 42) -> EffectForest:
    """Forest over rows with ``xs``, an integer ``key``, ``_yres`` and ``_tres``. A side of a split keeps at least ``min_leaf``
    rows and ``min_share`` of the node's T^2; a leaf with fewer than two estimating rows takes its nearest ancestor's
    estimate. Rows with a null in any of these columns are left out; without rows there is no effect (null)."""
    xs, size = list(xs), 2 ** (max_depth + 1) - 1
    ship_package(res.sparkSession)
    rows = res.select(F.col(key).cast("long").alias("_key"), *[F.col(x).cast("double").alias(x) for x in xs], "_yres", "_tres").na.drop()
    rows = rows.checkpoint()  # read once a level: nuisance fits must not run again
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(x, F.array(*map(F.lit, shares)), ACCURACY).alias(x) for x in xs]).first()
    forest = EffectForest(xs, [np.unique(np.array(cuts[x] or [], float)) for x in xs],
                          np.full((n_trees, size), -1, np.int64), np.zeros((n_trees, size), np.int64))
    p = len(xs)

    def columns(batch):
        t, y = batch["_tres"].to_numpy(float), batch["_yres"].to_numpy(float)
        return batch["_key"].to_numpy(np.int64), forest.bins(batch[xs].to_numpy(float)), t, y

    for level in range(max_depth):
        first, width = 2 ** level - 1, 2 ** level

        def histograms(batch, first=first, width=width):
            keys, bins, t, y = columns(batch)
            out = np.zeros((3, n_trees * width * p * BINS))
            for tree in range(n_trees):
                mine = _part(keys, tree, seed) == 0
                node = forest.node(tree, bins[mine]) - first
                live = node >= 0
                b, tt, yy = bins[mine][live], t[mine][live], y[mine][live]
                at = ((tree * width + node[live])[:, None] * p + np.arange(p)) * BINS + b
                for i, v in enumerate((np.ones(len(tt)), tt * tt, tt * yy)):
                    out[i] += np.bincount(at.ravel(), np.repeat(v, p), out.shape[1])
            return out

        got = _sums(rows, histograms, 3)
        h = np.zeros((3, n_trees * width * p * BINS))
        h[:, got["slot"].to_numpy(int)] = got[["s0", "s1", "s2"]].to_numpy().T
        n, a, b = h.reshape(3, n_trees, width, p, BINS)
        left = np.cumsum(np.stack([n, a, b]), axis=-1)
        whole = left[..., -1:]
        right = whole - left
        with np.errstate(invalid="ignore", divide="ignore"):
            theta = whole[2] / whole[1]
            gain = sum((s[2] - theta * s[1]) ** 2 / s[0] for s in (left, right)) / (whole[1] / whole[0]) ** 2
            fits = (np.minimum(left[0], right[0]) >= min_leaf) & (np.minimum(left[1], right[1]) >= min_share * whole[1])
        gain = np.where(fits & np.isfinite(gain), gain, 0.0)
        # Two thirds of the features may split a node, drawn anew for each.
        drawn = np.random.default_rng([seed, level]).random((n_trees, width, p)).argsort(axis=-1) < max(1, -(-2 * p // 3))
        gain = np.where(drawn[..., None], gain, 0.0).reshape(n_trees, width, p * BINS)
        best = gain.argmax(axis=-1)
        split = gain.max(axis=-1) > 0
        part = slice(first, first + width)
        forest.feature[:, part] = np.where(split, best // BINS, -1)
        forest.bin[:, part] = np.where(split, best % BINS, 0)
        if not split.any():
            break

    def leaves(batch):
        keys, bins, t, y = columns(batch)
        out = np.zeros((6, n_trees * size))
        for tree in range(n_trees):
            mine = _part(keys, tree, seed) == 1
            at, tt, yy = tree * size + forest.node(tree, bins[mine]), t[mine], y[mine]
            for i, v in enumerate((np.ones(len(tt)), tt ** 2, tt * yy, (tt * yy) ** 2, tt ** 3 * yy, tt ** 4)):
                out[i] += np.bincount(at, v, out.shape[1])
        return out

    got = _sums(rows, leaves, 6)
    s = np.zeros((6, n_trees * size))
    s[:, got["slot"].to_numpy(int)] = got[[f"s{i}" for i in range(6)]].to_numpy().T
    s = s.reshape(6, n_trees, size)
    for node in range(size - 1, 0, -1):  # an inner node estimates from all rows below it
        s[:, :, (node - 1) // 2] += s[:, :, node]
    for node in range(1, size):
        poor = (s[0, :, node] < 2) | (s[1, :, node] <= 0)
        s[:, poor, node] = s[:, poor, (node - 1) // 2]
    n, a, b, b2, ab, a2 = s
    with np.errstate(invalid="ignore", divide="ignore"):
        forest.theta = np.where(a > 0, b / a, 0.0)
        spread = np.maximum(b2 - 2 * forest.theta * ab + forest.theta ** 2 * a2, 0.0) * np.where(n > 1, n / (n - 1), 1.0)
        forest.se = np.where(a > 0, np.sqrt(spread) / a, 0.0)
        forest.slope = np.where(n > 0, a / n, 0.0)
    return forest


def score(df: DataFrame, forest: EffectForest, key: str) -> DataFrame:
    """key, treatment_effect, effect_se, effect_lower, effect_upper (95 %); rows with a null feature are left out."""
    ship_package(df.sparkSession)
    rows = df.select(key, *[F.col(x).cast("double").alias(f"_f{i}") for i, x in enumerate(forest.xs)]).na.drop(
        subset=[f"_f{i}" for i in range(len(forest.xs))])

    def run(batches):
        for batch in batches:
            effect, se = forest.effect(forest.bins(batch.iloc[:, 1:].to_numpy(float)))
            yield pd.DataFrame({key: batch.iloc[:, 0], "treatment_effect": effect, "effect_se": se,
                                "effect_lower": effect - Z95 * se, "effect_upper": effect + Z95 * se})

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, treatment_effect double, effect_se double, effect_lower double, effect_upper double")


def orthogonal_effects(df: DataFrame, xs: Sequence[str], y: str, t: str, key: str = "project_id", n_trees: int = 50, nuisance_trees: int = 100,
                       max_depth: int = 5, seed: int = 42) -> DataFrame:
    """Effect of ``t`` on ``y`` for every complete row, with its standard error and 95 % interval."""
    res = cross_fit(df, xs, y, t, key, n_trees=nuisance_trees, seed=seed)
    return score(df.na.drop(subset=[*xs, y, t]), grow(res, xs, key, n_trees, max_depth, seed=seed), key)
