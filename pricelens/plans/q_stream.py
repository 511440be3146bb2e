"""Streaming queries R1-R3, the batch twin of R3, and the resumable ingestion S19."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricelens.plans.common import campaigns
from pricelens.plans.registry import query
from pricelens.plans.sql import with_views
from pricelens.sources import derived
from pricelens.sources.tables import read_table
from pricelens.streaming import incremental as inc


@query("r1_ingest", with_views("""
, _n AS (SELECT count(*) FILTER (WHERE project_id % 2 = 0) AS half, count(*) AS n,
                CAST(coalesce(sum(len(reward_tiers)) FILTER (WHERE project_id % 2 = 0), 0) AS BIGINT) AS half_tiers,
                CAST(coalesce(sum(len(reward_tiers)), 0) AS BIGINT) AS tiers FROM campaign)
SELECT 1 AS run, half AS rows_in_sink, half_tiers AS tiers_in_sink FROM _n
UNION ALL SELECT 2, half, half_tiers FROM _n
UNION ALL SELECT 3, n, tiers FROM _n"""))
def r1_ingest(spark, sf_dir):
    """Incremental ingestion: the files of the even campaigns, the same files again (nothing more), then with the
    files of the odd ones added (exactly those)."""
    p = inc.stream_paths(spark, f"r1-{uuid.uuid4().hex[:8]}")
    camp = campaigns(spark, sf_dir)
    rows = []
    for run, rest in ((1, 0), (2, None), (3, 1)):
        if rest is not None:
            camp.where(F.pmod("project_id", F.lit(2)) == rest).write.mode("append").parquet(p["source"])
        inc.ingest_files(spark, p["source"], p["sink"], p["checkpoint"], camp.schema)
        rows.append(spark.read.schema(camp.schema).parquet(p["sink"]).agg(
            F.lit(run).alias("run"), F.count(F.lit(1)).alias("rows_in_sink"),
            F.coalesce(F.sum(F.size(F.coalesce("reward_tiers", F.array().cast("array<double>")))), F.lit(0)).cast("long").alias("tiers_in_sink")).first())
    return spark.createDataFrame(rows, "run int, rows_in_sink long, tiers_in_sink long")


@query("r2_dedup", with_views("""
SELECT count(*) AS rows_kept, count(DISTINCT coalesce(id, -1)) AS distinct_ids, count(*) AS from_first_file
FROM (SELECT DISTINCT id FROM _copies)""", derived.COPIES_SQL))
def r2_dedup(spark, sf_dir):
    """Keep-first across micro-batches: three copies per campaign (null ids are one group) arrive in three files, one
    after another; the copy of the first file stays."""
    p = inc.stream_paths(spark, f"r2-{uuid.uuid4().hex[:8]}")
    cp = derived.copies(campaigns(spark, sf_dir))
    for rank in (1, 2, 3):
        cp.where(F.col("file_rank") == rank).write.mode("append").parquet(p["source"])
        out = inc.dedup_stream(spark, p["source"], cp.schema, "id", "row_in_file", p["sink"], p["checkpoint"], max_files_per_trigger=None)
    return out.agg(F.count(F.lit(1)).alias("rows_kept"), F.countDistinct(F.coalesce("id", F.lit(-1))).alias("distinct_ids"),
                   F.count(F.when(F.col("file_rank") == 1, 1)).alias("from_first_file"))


_ACTIVITY_SQL = with_views("""
, _c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT window_start, event_type, n,
       CAST(floor(100 * n / max(n) OVER (PARTITION BY event_type)) AS INTEGER) AS activity_index FROM _c""")


@query("r3_activity", _ACTIVITY_SQL)
def r3_activity(spark, sf_dir):
    """Windowed activity index from a file stream of events in update mode. The events arrive in four parts by time;
    every other event of a part's last 12 hours comes with the next part, inside the watermark of a day."""
    p = inc.stream_paths(spark, f"r3-{uuid.uuid4().hex[:8]}")
    ev = read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    span = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(F.struct("lo", "hi")).scalar()
    step = (F.unix_micros(span["hi"]) - F.unix_micros(span["lo"])) / F.lit(4) + F.lit(1)
    at = (F.unix_micros("ts") - F.unix_micros(span["lo"])) / step
    held = (F.pmod("event_id", F.lit(2)) == 0) & (F.floor(at + F.lit(12 * 3600 * 1_000_000) / step) > F.floor(at))
    part = F.coalesce(F.least(F.floor(at) + held.cast("int"), F.lit(3)), F.lit(0))
    schema = ev.schema
    for i in range(4):
        ev.where(part == i).write.mode("append").parquet(p["source"])
        out = inc.activity_stream(spark, p["source"], schema, p["sink"], p["checkpoint"])
    return out


@query("r3_activity_batch", _ACTIVITY_SQL)
def r3_activity_batch(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return inc.scale_activity(inc.activity_counts(ev))


@query("s19_resumable_ingest", with_views("""
, _n AS (SELECT count(*) AS n FROM campaign)
SELECT 1 AS run, n // 2 AS rows_in_sink, n // 2 AS distinct_ids, n // 2 AS target FROM _n
UNION ALL SELECT 2, n // 2, n // 2, n // 2 FROM _n
UNION ALL SELECT 3, n, n, n FROM _n"""))
def s19_resumable_ingest(spark, sf_dir):
    """Resumable ingestion up to half the campaigns, again with the same target (nothing more), then with
    all campaigns as the target (exactly the rest, no row lost or doubled)."""
    p = inc.stream_paths(spark, f"s19-{uuid.uuid4().hex[:8]}")
    camp = campaigns(spark, sf_dir)
    camp.repartition(6).write.mode("overwrite").parquet(p["source"])
    n = camp.count()
    rows = []
    for run, target in enumerate((n // 2, n // 2, n), start=1):
        got = inc.ingest_until(spark, p["source"], p["sink"], p["checkpoint"], camp.schema, "project_id", target)
        ids = spark.read.schema(camp.schema).parquet(f"{p['sink']}/*").select("project_id").distinct().count()
        rows.append((run, got, ids, target))
    return spark.createDataFrame(rows, "run int, rows_in_sink long, distinct_ids long, target long")
