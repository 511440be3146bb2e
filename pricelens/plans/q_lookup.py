"""Lookup, grid and neighbour queries (J2-J4, J9, J10) and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricelens.functions.exprs import r6
from pricelens.operators import lookups as lk
from pricelens.operators import ranking as rk
from pricelens.operators.scenario import PRICE_MULTIPLIERS
from pricelens.plans.common import campaigns, features
from pricelens.plans.model import FEATURES, INSTRUMENTS, TARGET
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views
from pricelens.session import scratch_path
from pricelens.sources.tables import read_table

SERIES_SQL = """
_sd AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
_si AS (SELECT day, CAST(floor(100 * n / max(n) OVER ()) AS INTEGER) AS interest FROM _sd)"""


def _series(spark, sf_dir):
    return lk.daily_interest(read_table(spark, sf_dir, "events"))


@query("j2_nearest_trend", with_views("""
, _c AS (SELECT project_id, CAST(launch_date AS DATE) AS day FROM campaign),
_p AS (SELECT c.project_id, c.day, s.day AS pd, s.interest AS pv FROM _c c ASOF LEFT JOIN _si s ON c.day >= s.day),
_n AS (SELECT c.project_id, s.day AS nd, s.interest AS nv FROM _c c ASOF LEFT JOIN _si s ON c.day <= s.day)
SELECT p.project_id, CASE WHEN pv IS NULL AND nv IS NULL THEN 50 WHEN nv IS NULL THEN pv WHEN pv IS NULL THEN nv
                          WHEN (p.day - pd) <= (nd - p.day) THEN pv ELSE nv END AS trend_nearest
FROM _p p JOIN _n n ON p.project_id = n.project_id""", SERIES_SQL))
def j2_nearest_trend(spark, sf_dir):
    c = campaigns(spark, sf_dir).select("project_id", "launch_date")
    return lk.nearest_lookup(c, "launch_date", _series(spark, sf_dir), "interest", "trend_nearest").select(
        "project_id", "trend_nearest")


@query("j3_month_lookup", with_views("""
, _m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1),
_mi AS (SELECT month, CAST(floor(100 * n / max(n) OVER ()) AS INTEGER) AS interest FROM _m)
SELECT c.project_id, c.category, coalesce(mi.interest, 50) AS trend_month
FROM campaign c LEFT JOIN _mi mi ON CAST(date_trunc('month', c.launch_date) AS DATE) = mi.month"""))
def j3_month_lookup(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    m = ev.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    mx = m.agg(F.max("n").alias("x")).select(F.struct("x")).scalar()
    monthly = m.select("month", F.floor(F.lit(100) * F.col("n") / mx["x"]).cast("int").alias("interest"))
    c = campaigns(spark, sf_dir).select("project_id", "category", "launch_date")
    return lk.month_lookup(c, "category", "launch_date", monthly, "trend_month").select(
        "project_id", "category", "trend_month")


@query("j4_trend_window", with_views("""
, _c AS (SELECT project_id, CAST(launch_date AS DATE) AS day FROM campaign)
SELECT c.project_id, coalesce(CAST(trunc(avg(s.interest)) AS INTEGER), 50) AS trend_window
FROM _c c LEFT JOIN _si s ON abs(s.day - c.day) <= 14 GROUP BY c.project_id""", SERIES_SQL))
def j4_trend_window(spark, sf_dir):
    c = campaigns(spark, sf_dir).select("project_id", "launch_date")
    return lk.window_mean_lookup(c, "launch_date", _series(spark, sf_dir), "interest", "trend_window").select(
        "project_id", "trend_window")


_GRID_VALUES = ", ".join(f"({i}, {m!r}::DOUBLE)" for i, m in enumerate(PRICE_MULTIPLIERS))


@query("j9_price_grid", with_views(f"""
SELECT f.project_id, g.i AS grid_idx, {s6('f.avg_reward_price * g.m')} AS price
FROM features f, (VALUES {_GRID_VALUES}) g(i, m)""", level="features"))
def j9_price_grid(spark, sf_dir):
    """Campaign × price-multiplier grid as a generator (explode), not a cartesian join."""
    f = features(spark, sf_dir)
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(PRICE_MULTIPLIERS)])
    g = f.select("project_id", "avg_reward_price", F.explode(grid).alias("g"))
    return g.select("project_id", F.col("g.i").alias("grid_idx"), r6(F.col("avg_reward_price") * F.col("g.m")).alias("price"))


_KNN_COLS = ["funding_goal", "avg_reward_price", "campaign_duration_days"]


def _similar(f, queries):
    nn = lk.knn(f, queries.select("project_id", *_KNN_COLS), _KNN_COLS, 10)
    return nn.select("query_id", nn["rank"].cast("int").alias("rank"), "project_id", r6("distance").alias("distance"))


@query("j10_similar", with_views(f"""
, _q AS (SELECT project_id AS query_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS q_{c}' for c in _KNN_COLS)}
         FROM features ORDER BY (((project_id + 42) % 2147483648) * 2654435761) % 4294967296, project_id LIMIT 20),
_d AS (SELECT q.query_id, f.project_id,
              sqrt({' + '.join(f'(coalesce(CAST(f.{c} AS DOUBLE), 0.0::DOUBLE) - q.q_{c}) ^ 2' for c in _KNN_COLS)}) AS distance
       FROM _q q, features f WHERE f.project_id <> q.query_id),
_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, project_id) AS rank FROM _d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, project_id, {s6('distance')} AS distance FROM _r WHERE rank <= 10""",
    level="features"))
def j10_similar(spark, sf_dir):
    """10 nearest historical campaigns for each of 20 hash-sampled query campaigns (the sample its SQL asks for)."""
    f = features(spark, sf_dir)
    return _similar(f, rk.hash_sample(f, 20))


@query("j10_similar_due", with_views(f"""
, _q AS (SELECT project_id AS query_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS q_{c}' for c in _KNN_COLS)}
         FROM features WHERE project_id % 50 = 0),
_d AS (SELECT q.query_id, f.project_id,
              sqrt({' + '.join(f'(coalesce(CAST(f.{c} AS DOUBLE), 0.0::DOUBLE) - q.q_{c}) ^ 2' for c in _KNN_COLS)}) AS distance
       FROM _q q, features f WHERE f.project_id <> q.query_id),
_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, project_id) AS rank FROM _d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, project_id, {s6('distance')} AS distance FROM _r WHERE rank <= 10""",
    level="features"))
def j10_similar_due(spark, sf_dir):
    """10 nearest historical campaigns for every due query campaign (id divisible by 50) against all rows."""
    f = features(spark, sf_dir)
    return _similar(f, f.where(F.col("project_id") % 50 == 0))


@query("s20_sinks", with_views("""
, _t AS (SELECT count(*) AS n, count(reward_tiers) AS with_tiers, CAST(coalesce(sum(len(reward_tiers)), 0) AS BIGINT) AS tiers FROM features)
SELECT unnest(['parquet', 'csv']) AS format, n AS rows, with_tiers, tiers FROM _t""", level="features"))
def s20_sinks(spark, sf_dir):
    """Stage sinks: the feature table, reward tiers as JSON text, written as Parquet and CSV to the shared folder,
    read back with the tiers parsed again."""
    f = features(spark, sf_dir).withColumn("reward_tiers", F.to_json("reward_tiers"))
    base = scratch_path(spark, f"sink-{spark.sparkContext.applicationId}")
    f.write.mode("overwrite").parquet(f"{base}/features_parquet")
    f.write.mode("overwrite").option("header", True).csv(f"{base}/features_csv")
    pq = spark.read.parquet(f"{base}/features_parquet")
    cs = spark.read.option("header", True).schema(f.schema).csv(f"{base}/features_csv")
    tiers = F.from_json("reward_tiers", "array<double>")
    counts = [F.count(F.lit(1)).alias("rows"), F.count(tiers).alias("with_tiers"),
              F.coalesce(F.sum(F.when(tiers.isNotNull(), F.size(tiers))), F.lit(0)).cast("long").alias("tiers")]
    return (pq.agg(F.lit("parquet").alias("format"), *counts)
            .unionByName(cs.agg(F.lit("csv").alias("format"), *counts)))


_BUNDLE_COLUMNS = [f"z_{c}" for c in FEATURES] + ["ols_prediction", "tsls_prediction", "treatment_effect", "q_10", "q_25", "q_50", "q_75", "q_90"]


@query("s22_model_persist", with_views(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS part, count(*) AS n, 0::BIGINT AS differing, count(*) AS n_scored FROM features WHERE "
                          + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES) for c in _BUNDLE_COLUMNS), level="features"))
def s22_model_persist(spark, sf_dir):
    """The whole fitted predictor saved, loaded and applied to every complete row beside the original: per part, rows
    scored and rows whose score differs in any bit."""
    from pricelens.operators import bundle as bu
    from pricelens.plans.model import fit_bundle, quantile_model
    from pricelens.plans.q_ml import campaign_effects
    f = features(spark, sf_dir).select("project_id", *FEATURES, TARGET, *INSTRUMENTS)
    fitted = fit_bundle(f, campaign_effects(spark, sf_dir)[2], quantile_model(spark, sf_dir))
    path = scratch_path(spark, f"bundle-{uuid.uuid4().hex[:8]}")
    loaded = bu.load(spark, path, bu.save(spark, path, fitted))
    rows = f.select("project_id", *FEATURES).na.drop()
    both = loaded.score(fitted.score(rows).withColumnsRenamed({c: f"_{c}" for c in _BUNDLE_COLUMNS}))
    got = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"d{i}") for i, c in enumerate(_BUNDLE_COLUMNS)],
                   *[F.count(c).alias(f"k{i}") for i, c in enumerate(_BUNDLE_COLUMNS)])
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col("n").alias("n"), F.col(f"d{i}").alias("differing"), F.col(f"k{i}").alias("n_scored"))
                      for i, c in enumerate(_BUNDLE_COLUMNS)])
    return got.select(F.inline(parts))


@query("s21_result_sinks", with_views("""
SELECT 'effects' AS sink, count(*) AS rows, count(DISTINCT project_id) AS keys FROM features WHERE """
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES if c != "avg_reward_price")
    + """
UNION ALL SELECT 'validation_results', 6, 6""", level="features"))
def s21_result_sinks(spark, sf_dir):
    """Per-campaign effects and the validation summary written as CSV to the shared folder and
    read back (test, metric, value, status / project_id, category, treatment_effect: one row a campaign)."""
    from pricelens.plans.q_ml import campaign_effects
    from pricelens.plans.q_validate import v15_summary
    base = scratch_path(spark, f"results-{spark.sparkContext.applicationId}")
    v15_summary(spark, sf_dir).write.mode("overwrite").option("header", True).csv(f"{base}/validation_results")
    effects = features(spark, sf_dir).select("project_id", "category").join(campaign_effects(spark, sf_dir)[0], "project_id")
    effects.write.mode("overwrite").option("header", True).csv(f"{base}/effects")
    v = spark.read.option("header", True).csv(f"{base}/validation_results")
    e = spark.read.option("header", True).csv(f"{base}/effects")
    return (v.agg(F.lit("validation_results").alias("sink"), F.count(F.lit(1)).alias("rows"), F.countDistinct(v.columns[0]).alias("keys"))
            .unionByName(e.agg(F.lit("effects").alias("sink"), F.count(F.lit(1)).alias("rows"), F.countDistinct("project_id").alias("keys"))))
