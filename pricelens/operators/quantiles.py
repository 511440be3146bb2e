"""Exact, interpolated percentiles that scale to hot groups.

Spark's exact ``percentile``/``median`` keeps every distinct value of a group in one task's hash
map, which does not survive a category holding a third of 100 TB. This operator is exact (same
linear interpolation as ``percentile``, SURVEY T9) but never materialises a whole group:

1. one aggregation per group: ``count`` and ``percentile_approx`` at p ± margin/accuracy. The
   sketch's rank error is at most n/accuracy, so [lo, hi] brackets the target ranks;
2. while a bracket may still hold more than BAND_ROWS rows, another scan counts the rows below and inside every
   bracket exactly and sketches the inside on a grid: the bracket shrinks to the grid cells around the rank,
   by about a factor of 20 a scan;
3. a last scan tags each value as *below* the bracket or *inside* it and counts (group, prob, value) — rows below
   collapse map-side into one counter per group;
4. inside the band cumulative counts give the exact order statistics, and the two neighbours are interpolated.

A group's band is summed up in one task; it has at most BAND_ROWS distinct values, whatever the group's row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.operators.joins import join_small

DEFAULT_ACCURACY = 20000
DEFAULT_MARGIN = 4
#: Rows that the band around one rank may hold before it is narrowed by another scan.
BAND_ROWS = 100_000
#: Cells of the sketch that narrows a bracket, and most scans spent on it (20 ** 12 rows; more only if values tie).
GRID, MOST_SCANS = 64, 12


def exact_percentiles(df: DataFrame, value, probs: Sequence[float], group_cols: Sequence[str] = (),
                      names: Sequence[str] | None = None, accuracy: int = DEFAULT_ACCURACY,
                      margin: int = DEFAULT_MARGIN, discrete: bool = False, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per group: group_cols…, ``n`` (non-null count) and one column per probability.

    ``discrete`` takes the ceil(p·n)-th value itself (``percentile_disc``) instead of interpolating."""
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"p{int(round(p * 1000)):04d}" for p in probs]
    group_cols = list(group_cols)
    keys = group_cols if group_cols else ["_g"]
    x = F.col(value) if isinstance(value, str) else value

    base = df.select(*[F.col(g) for g in group_cols], x.cast("double").alias("_x"))
    if not group_cols:
        base = base.withColumn("_g", F.lit(0))
    base = base.where(F.col("_x").isNotNull())

    eps = margin / float(accuracy)
    lo_p = [max(0.0, p - eps) for p in probs]
    hi_p = [min(1.0, p + eps) for p in probs]
    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", lo_p + hi_p, accuracy).alias("_apx"))
    k = len(probs)
    # Groups of at most `accuracy` rows take the whole group as the band (bounded by accuracy);
    # above that the ±margin/accuracy bracket exceeds the sketch error plus the one-rank gap between
    # the sketch's ceil(p·n) rank and the interpolation ranks floor/ceil((n-1)·p).
    small = F.col("_n") <= accuracy
    sketch = sketch.select(
        *keys, "_n",
        F.array(*[(F.col("_min") if lo_p[i] <= 0.0 else F.when(small, F.col("_min")).otherwise(F.col("_apx")[i]))
                  for i in range(k)]).alias("_lo"),
        F.array(*[(F.col("_max") if hi_p[i] >= 1.0 else F.when(small, F.col("_max")).otherwise(F.col("_apx")[k + i]))
                  for i in range(k)]).alias("_hi"))

    sketch, most = _held(sketch)
    if most > accuracy:
        sketch = _narrowed(base, sketch, most, keys, probs, discrete, accuracy, band_rows, (2 * margin + 2) / accuracy)

    if group_cols:
        # one sketch row per group: broadcast after a size check, so a hot group is never shuffled
        tagged = join_small(base, sketch.select(*keys, "_lo", "_hi"), keys, "inner")
    else:
        # global: the one-row bracket travels as a scalar subquery (no join, nothing to fold into
        # a cross product)
        sk = sketch.select(F.struct("_lo", "_hi", "_n").alias("s")).scalar()
        tagged = base.withColumn("_lo", sk["_lo"]).withColumn("_hi", sk["_hi"])
    tags = F.array(*[
        F.when(F.col("_x") < F.col("_lo")[i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
         .when(F.col("_x") <= F.col("_hi")[i], F.struct(F.lit(i).alias("i"), F.col("_x").alias("v")))
        for i in range(k)])
    counts = (tagged.select(*keys, F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("_t"))
              .select(*keys, F.col("_t.i").alias("_i"), F.col("_t.v").alias("_v"))
              .groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c")))

    w = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    prob_arr = F.array(*[F.lit(p) for p in probs])
    ranked = counts.withColumn("_cum", F.sum("_c").over(w))
    ranked = (ranked.join(sketch.select(*keys, "_n"), keys) if group_cols else ranked.withColumn("_n", sk["_n"]))
    p_i = prob_arr[F.col("_i")]
    pos = (F.greatest(F.ceil(F.col("_n") * p_i) - 1, F.lit(0)).cast("double") if discrete
           else (F.col("_n") - 1).cast("double") * p_i)
    ranked = (ranked
              .withColumn("_pos", pos)
              .withColumn("_rlo", F.floor("_pos"))
              .withColumn("_rhi", F.ceil("_pos"))
              .withColumn("_first", F.col("_cum") - F.col("_c"))
              .withColumn("_last", F.col("_cum") - 1))
    inside = lambda r: F.col("_v").isNotNull() & (F.col("_first") <= F.col(r)) & (F.col(r) <= F.col("_last"))
    picked = ranked.groupBy(*keys, "_i").agg(
        F.first("_pos").alias("_pos"), F.first("_rlo").alias("_rlo"), F.first("_rhi").alias("_rhi"),
        F.max(F.when(inside("_rlo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(inside("_rhi"), F.col("_v"))).alias("_vhi"))
    # lo + (hi - lo)·frac: exact when the two neighbours are equal (edges reused as bin bounds)
    q = F.when(F.col("_rlo") == F.col("_rhi"), F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.col("_rlo")))
    picked = picked.select(*keys, "_i", q.alias("_q"))
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(names[i])
                                      for i in range(k)])
    if group_cols:
        out = out.join(sketch.select(*keys, F.col("_n").alias("n")), keys)
    else:
        out = out.withColumn("n", sk["_n"]).drop("_g")
    return out.select(*group_cols, "n", *names)


def _held(table: DataFrame) -> tuple[DataFrame, int]:
    """The per-group table, persisted, and the rows of its largest group."""
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    return table, table.agg(F.max("_n")).first()[0] or 0


def _narrowed(base: DataFrame, table: DataFrame, most: int, keys: list[str], probs: Sequence[float], discrete: bool, accuracy: int, band_rows: int, share: float) -> DataFrame:
    """`table` (keys, _n, _lo, _hi) with brackets that hold at most `band_rows` rows each, or a single value.

    `share` bounds the part of a group's rows that its first brackets hold, so small tables take no extra scan.
    """
    if most * share <= band_rows:
        return table
    grid = [i / GRID for i in range(1, GRID)]
    for _ in range(MOST_SCANS):
        rows = join_small(base, table.select(*keys, "_lo", "_hi"), keys, "inner")
        aggs = []
        for i in range(len(probs)):
            inside = (F.col("_x") >= F.col("_lo")[i]) & (F.col("_x") <= F.col("_hi")[i])
            aggs += [F.count(F.when(F.col("_x") < F.col("_lo")[i], 1)).alias(f"_b{i}"), F.count(F.when(inside, 1)).alias(f"_w{i}"),
                     F.percentile_approx(F.when(inside, F.col("_x")), grid, accuracy).alias(f"_s{i}")]
        found = table.join(rows.groupBy(*keys).agg(*aggs), keys)
        low, high, wide = [], [], []
        for i, p in enumerate(probs):
            ends = [F.col("_lo")[i], F.col("_hi")[i]]
            rank = F.greatest(F.ceil(F.col("_n") * p) - 1, F.lit(0)) if discrete else F.floor((F.col("_n") - 1) * F.lit(p))
            # The rank's cell of the grid, with a cell on either side for the sketch's error and the next rank.
            cell = F.floor((rank - F.col(f"_b{i}")) * GRID / F.greatest(F.col(f"_w{i}"), F.lit(1))).cast("int")
            shrinks = F.col(f"_w{i}") > band_rows
            low.append(F.when(shrinks & (cell >= 2), F.element_at(f"_s{i}", F.greatest(cell - 1, F.lit(1)))).otherwise(ends[0]))
            high.append(F.when(shrinks & (cell <= GRID - 3), F.element_at(f"_s{i}", F.greatest(F.least(cell + 2, F.lit(GRID - 1)), F.lit(1)))).otherwise(ends[1]))
            # Ties may keep a bracket from shrinking any further: its distinct values are few then.
            moved = (low[-1] > ends[0]) | (high[-1] < ends[1])
            wide.append(F.when((low[-1] < high[-1]) & moved, F.col(f"_w{i}")).otherwise(0))
        narrow = found.select(*keys, "_n", F.array(*low).alias("_lo"), F.array(*high).alias("_hi"), F.array_max(F.array(*wide)).alias("_wide"))
        narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
        widest = narrow.agg(F.max("_wide")).first()[0] or 0
        table = narrow.drop("_wide")
        if widest <= band_rows:
            break
    return table


def with_group_quantile(df: DataFrame, value: str, prob: float, group_cols: Sequence[str], name: str,
                        **kw) -> DataFrame:
    """Attach a per-group (or global) exact percentile to every row.

    Rows with a null group key get null, like pandas ``groupby.transform`` (T4). The quantile table
    has one row per group; AQE broadcasts it when small and shuffles otherwise.
    """
    qt = exact_percentiles(df, value, [prob], group_cols, names=[name], **kw).drop("n")
    if group_cols:
        return join_small(df, qt, list(group_cols), "left")
    return df.withColumn(name, qt.select(name).scalar())
