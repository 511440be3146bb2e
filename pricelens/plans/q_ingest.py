"""Ingestion queries (S6-S17, P1, P2, P4, P5, P24, P25) over rule-derived raw inputs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from pricelens.functions.exprs import r6
from pricelens.plans.common import campaigns
from pricelens.plans.registry import query
from pricelens.plans.sql import r6 as s6
from pricelens.plans.sql import with_views
from pricelens.sources import catalogue, derived, ingest
from pricelens.sources.tables import read_table


def _raw(spark, sf_dir):
    return ingest.normalise_columns(derived.raw_dump(campaigns(spark, sf_dir)))


# --- P1 ------------------------------------------------------------------------------------------

@query("p1_state_filter", with_views("""
SELECT 'exact' AS mode, lower(state) AS status, count(*) AS n FROM _raw WHERE state IN ('Failed', 'Successful') GROUP BY ALL
UNION ALL
SELECT 'four', lower(state), count(*) FROM _raw WHERE state IN ('successful', 'failed', 'Successful', 'Failed') GROUP BY ALL
UNION ALL
SELECT 'lower', lower(state), count(*) FROM _raw WHERE lower(state) IN ('successful', 'failed') GROUP BY ALL
""", derived.RAW_SQL))
def p1_state_filter(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    parts = [ingest.completed_state_filter(raw, "state", m).groupBy(F.lit(m).alias("mode"), "status")
             .agg(F.count(F.lit(1)).alias("n")) for m in ("exact", "four", "lower")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- S7 / S8 -------------------------------------------------------------------------------------

@query("s7_alias_pick", with_views("""
SELECT id AS project_id, goal AS goal_local_wins, usd_goal_real AS goal_usd_preferred,
       usd_goal_real AS goal_when_local_absent, subcategory AS category_kept, main_category AS category_from_alias
FROM _raw""", derived.RAW_SQL))
def s7_alias_pick(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    v1 = ingest.alias_if_absent(raw).select("id", F.col("goal").alias("goal_local_wins"))
    v2 = ingest.alias_prefer(raw).select("id", F.col("goal").alias("goal_usd_preferred"))
    v3 = ingest.alias_if_absent(raw.drop("goal")).select("id", F.col("goal").alias("goal_when_local_absent"))
    no_cat = raw.drop("category", "subcategory")
    v4 = ingest.alias_if_absent(no_cat).select("id", F.col("category").alias("category_from_alias"))
    kept = ingest.alias_if_absent(ingest.swap_rename(raw)).select("id", F.col("category").alias("category_kept"))
    out = v1.join(v2, "id").join(v3, "id").join(v4, "id").join(kept, "id")
    return out.withColumnRenamed("id", "project_id")


@query("s8_swap_rename", with_views("""
SELECT id AS project_id, subcategory AS category, category AS subcategory FROM _raw""", derived.RAW_SQL))
def s8_swap_rename(spark, sf_dir):
    return ingest.swap_rename(_raw(spark, sf_dir)).select(
        F.col("id").alias("project_id"), "category", "subcategory")


# --- P4 / P5 / P2 / P24 / P25 ----------------------------------------------------------------------

@query("p4_coerce", with_views("""
SELECT id AS project_id, TRY_CAST(launched AS TIMESTAMP) AS launch_date,
       TRY_CAST(deadline AS TIMESTAMP) AS end_date, TRY_CAST(goal_text AS DOUBLE) AS goal_num
FROM _raw""", derived.RAW_SQL))
def p4_coerce(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("id").alias("project_id"),
                      ingest.coerce_timestamp("launched").alias("launch_date"),
                      ingest.coerce_timestamp("deadline").alias("end_date"),
                      ingest.coerce_number("goal_text").alias("goal_num"))


@query("p5_duration", with_views("""
SELECT id AS project_id,
       CAST(floor((epoch_us(TRY_CAST(deadline AS TIMESTAMP)) - epoch_us(TRY_CAST(launched AS TIMESTAMP)))
                  / 86400000000.0::DOUBLE) AS INTEGER) AS campaign_duration_days
FROM _raw""", derived.RAW_SQL))
def p5_duration(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("id").alias("project_id"), ingest.duration_days(
        ingest.coerce_timestamp("deadline"), ingest.coerce_timestamp("launched")).alias("campaign_duration_days"))


_HARMONISED_SQL = """
_harm AS (
  SELECT id AS project_id, name, subcategory AS category, category AS subcategory, lower(state) AS status,
         goal AS funding_goal, pledged AS pledged_amount, backers AS backers_count,
         CAST(floor((epoch_us(TRY_CAST(deadline AS TIMESTAMP)) - epoch_us(TRY_CAST(launched AS TIMESTAMP)))
                    / 86400000000.0::DOUBLE) AS INTEGER) AS campaign_duration_days
  FROM _raw WHERE state IN ('Failed', 'Successful')
),
_valid AS (
  SELECT * FROM _harm
  WHERE funding_goal > 0 AND pledged_amount >= 0 AND campaign_duration_days > 0 AND campaign_duration_days <= 90
)"""


@query("p2_validity", with_views(f"""
SELECT project_id, category, subcategory, status, {s6('funding_goal')} AS funding_goal,
       {s6('pledged_amount')} AS pledged_amount, campaign_duration_days,
       CASE WHEN status = 'successful' THEN 1 ELSE 0 END AS is_successful,
       {s6('pledged_amount / (CASE WHEN funding_goal = 0 THEN 1 ELSE funding_goal END)')} AS funding_ratio
FROM _valid""", derived.RAW_SQL, _HARMONISED_SQL))
def p2_validity(spark, sf_dir):
    h = ingest.harmonise(derived.raw_dump(campaigns(spark, sf_dir)))
    return h.select("project_id", "category", "subcategory", "status", r6("funding_goal").alias("funding_goal"),
                    r6("pledged_amount").alias("pledged_amount"), "campaign_duration_days", "is_successful",
                    r6("funding_ratio").alias("funding_ratio"))


@query("p24_hash_impute", with_views("""
SELECT project_id,
       CAST(length(coalesce(name, 'Unknown Project')) * (10 + (((project_id + 1) % 2147483648) * 2654435761) % 4294967296 % 40) AS INTEGER) AS description_length,
       CAST((((project_id + 2) % 2147483648) * 2654435761) % 4294967296 % 15 AS INTEGER) AS num_updates,
       CAST(trunc(coalesce(CAST(backers_count AS DOUBLE), 0.0::DOUBLE)
            * (0.02::DOUBLE + 0.06::DOUBLE * ((((project_id + 3) % 2147483648) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE)) AS INTEGER) AS num_comments,
       CAST(20 + (((project_id + 4) % 2147483648) * 2654435761) % 4294967296 % 60 AS INTEGER) AS trend_index_fill
FROM _valid""", derived.RAW_SQL, _HARMONISED_SQL))
def p24_hash_impute(spark, sf_dir):
    h = ingest.harmonise(derived.raw_dump(campaigns(spark, sf_dir)))
    return h.select("project_id", "description_length", "num_updates", "num_comments", "trend_index_fill")


@query("p25_tiers", with_views("""
, _b AS (SELECT id, goal, greatest(10, CAST(trunc(goal / 500) AS BIGINT)) AS b FROM _raw)
SELECT id AS project_id,
       [greatest(10, b), greatest(25, b * 2), greatest(50, b * 4), greatest(100, b * 8)]::DOUBLE[] AS tiers_plain,
       CASE WHEN goal IS NULL OR goal <= 0 THEN [25.0, 50.0, 100.0]::DOUBLE[]
            ELSE [greatest(10, b), greatest(25, b * 2), greatest(50, b * 4), greatest(100, b * 8)]::DOUBLE[] END AS tiers_defaulted
FROM _b""", derived.RAW_SQL))
def p25_tiers(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(F.col("id").alias("project_id"),
                      ingest.tiers_from_goal("goal", bad_default=False).alias("tiers_plain"),
                      ingest.tiers_from_goal("goal", bad_default=True).alias("tiers_defaulted"))


def _hash_sql(salt):
    return f"((id + {salt}) % 2147483648 * 2654435761 % 4294967296)"


_JITTER_SQL = ", ".join(f"greatest({low}, greatest(10, CAST(trunc(goal / 1000) AS BIGINT)) * {m} + {lo} + {_hash_sql(11 + i)} % {hi - lo})"
                        for i, (low, m, lo, hi) in enumerate(ingest.JITTERED_TIERS))


@query("p25_tier_variants", with_views(f"""
, _b AS (SELECT id, goal, greatest(10, CAST(trunc(goal / 500) AS BIGINT)) AS b FROM _raw)
SELECT id AS project_id,
       CASE WHEN goal IS NULL OR goal <= 0 THEN [25.0, 50.0, 100.0]::DOUBLE[]
            ELSE list_sort(list_distinct([greatest(10, b), greatest(20, b * 2), greatest(50, b * 4), greatest(100, b * 8)]))[:5]::DOUBLE[] END AS tiers_snapshot,
       CASE WHEN goal IS NULL OR goal <= 0 THEN [25.0, 50.0, 100.0]::DOUBLE[]
            ELSE list_sort(list_distinct([{_JITTER_SQL}]))[:3 + {_hash_sql(10)} % 5]::DOUBLE[] END AS tiers_jittered
FROM _b""", derived.RAW_SQL))
def p25_tier_variants(spark, sf_dir):
    """The snapshot loader's and the jittered loader's tiers of every campaign."""
    return _raw(spark, sf_dir).select(F.col("id").alias("project_id"), ingest.tiers_snapshot("goal").alias("tiers_snapshot"),
                                      ingest.tiers_jittered("goal", "id").alias("tiers_jittered"))


# --- S9 / S10 --------------------------------------------------------------------------------------

_FRAMES_SQL = """
_frames AS (
  SELECT project_id AS id, name, funding_goal AS goal, status AS state FROM campaign
  UNION ALL SELECT project_id, name, funding_goal * 2, status FROM campaign
  UNION ALL SELECT project_id, name, usd_goal, status FROM (SELECT *, funding_goal * 1.25::DOUBLE AS usd_goal FROM campaign)
)"""


def _three_frames(camp):
    a = camp.select(F.col("project_id").alias("id"), "name", F.col("funding_goal").alias("goal"),
                    F.col("status").alias("state"), "country")
    b = camp.select(F.col("project_id").alias("id"), "name", (F.col("funding_goal") * 2).alias("goal"),
                    F.col("pledged_amount").alias("pledged"), F.col("status").alias("state"))
    c = camp.select(F.col("project_id").alias("id"), "name", F.col("status").alias("state"),
                    F.col("backers_count").alias("backers"), (F.col("funding_goal") * 1.25).alias("usd_goal_real"))
    c = ingest.alias_if_absent(c)  # usd_goal_real → goal, since goal is absent here
    return [a, b, c]


@query("s9_intersect_union", with_views(f"""
SELECT id, name, {s6('goal')} AS goal, state FROM _frames""", _FRAMES_SQL))
def s9_intersect_union(spark, sf_dir):
    u = ingest.intersect_union(_three_frames(campaigns(spark, sf_dir)),
                               whitelist=["id", "name", "category", "goal", "pledged", "state"])
    return u.select("id", "name", r6("goal").alias("goal"), "state")


def _money_feed(camp):
    pid = F.col("project_id")
    whole = F.col("pledged_amount").cast("long")
    amount_text = (F.when(F.pmod(pid, F.lit(23)) == 0, F.lit("n/a"))
                   .when(F.pmod(pid, F.lit(5)) == 0, F.concat(F.lit("€"), whole.cast("string")))
                   .otherwise(F.concat(F.lit("$"), F.format_number(whole, 0), F.lit(" USD"))))
    pct = (F.lit(100) * F.col("pledged_amount") / F.col("funding_goal")).cast("long")
    card_text = F.when(F.pmod(pid, F.lit(4)) == 0, F.lit("no percent here")).otherwise(
        F.concat(F.col("name"), F.lit(" "), pct.cast("string"), F.lit("% funded")))
    return camp.select(pid.alias("project_id"), "name", "category", amount_text.alias("amount_text"),
                       card_text.alias("card_text"))


_MONEY_SQL = """
_money AS (
  SELECT project_id, name, category,
         CASE WHEN project_id % 23 = 0 THEN 'n/a'
              WHEN project_id % 5 = 0 THEN '€' || CAST(CAST(trunc(pledged_amount) AS BIGINT) AS VARCHAR)
              ELSE '$' || format('{:,}', CAST(trunc(pledged_amount) AS BIGINT)) || ' USD' END AS amount_text,
         CASE WHEN project_id % 4 = 0 THEN 'no percent here'
              ELSE name || ' ' || CAST(CAST(trunc(100 * pledged_amount / funding_goal) AS BIGINT) AS VARCHAR) || '% funded' END AS card_text
  FROM campaign
),
_money_parsed AS (
  SELECT project_id, name, category, amount_text, card_text,
         coalesce(TRY_CAST(regexp_replace(split_part(amount_text, ' ', 1), '[^\\d.]', '', 'g') AS DOUBLE), 0.0::DOUBLE) AS pledged_amount,
         coalesce(TRY_CAST(regexp_extract(card_text, '(\\d+)%', 1) AS INTEGER), 0) AS percent_funded
  FROM _money
),
_money_out AS (
  SELECT *, CASE WHEN percent_funded > 0 THEN CAST(CAST(trunc(pledged_amount / (percent_funded / 100.0::DOUBLE)) AS BIGINT) AS DOUBLE)
                 ELSE pledged_amount END AS funding_goal,
         CASE WHEN percent_funded >= 100 THEN 'successful' ELSE 'live' END AS status
  FROM _money_parsed
)"""


def _money_parsed(camp):
    feed = _money_feed(camp)
    fields = ingest.money_fields("amount_text", "card_text")
    return feed.select("project_id", "name", "category", "amount_text", "card_text",
                       *[v.alias(k) for k, v in fields.items()])


@query("s17_money_percent", with_views(f"""
SELECT project_id, amount_text, card_text, {s6('pledged_amount')} AS pledged_amount, percent_funded,
       {s6('funding_goal')} AS funding_goal, status
FROM _money_out""", _MONEY_SQL))
def s17_money_percent(spark, sf_dir):
    m = _money_parsed(campaigns(spark, sf_dir))
    return m.select("project_id", "amount_text", "card_text", r6("pledged_amount").alias("pledged_amount"),
                    "percent_funded", r6("funding_goal").alias("funding_goal"), "status")


_PAGES_SQL = """
_pg AS (
  SELECT page_id,
         trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h1,
         trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')) AS title,
         trim(regexp_replace(regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1), '<[^>]+>', '', 'g')) AS para
  FROM pages
),
_cards AS (
  SELECT page_id, CASE WHEN h1 <> '' THEN h1 WHEN title <> '' THEN title END AS name, para AS "desc",
         0.0::DOUBLE AS goal, 0.0::DOUBLE AS pledged, 'live' AS state, 'Unknown' AS category, 'US' AS country,
         'live_scrape_fallback' AS source
  FROM _pg
)"""


@query("s16_page_fields", with_views("""
SELECT * FROM _cards WHERE name IS NOT NULL""", _PAGES_SQL))
def s16_page_fields(spark, sf_dir):
    return ingest.page_fields(read_table(spark, sf_dir, "pages"))


@query("s10_live_union", with_views("""
, _u AS (
  SELECT 'kaggle' AS source, status FROM _valid
  UNION ALL SELECT 'live_scrape', lower(state) FROM _cards WHERE name IS NOT NULL
  UNION ALL SELECT 'indiegogo', lower(status) FROM _money_out
)
SELECT source, status, count(*) AS n FROM _u GROUP BY ALL""",
    derived.RAW_SQL, _HARMONISED_SQL, _PAGES_SQL, _MONEY_SQL))
def s10_live_union(spark, sf_dir):
    camp = campaigns(spark, sf_dir)
    hist = ingest.harmonise(derived.raw_dump(camp))
    cards = ingest.page_fields(read_table(spark, sf_dir, "pages")).withColumnRenamed("state", "status")
    money = _money_parsed(camp)
    req = ["name", "category", "status"]
    u = ingest.union_with_source(hist, [("live_scrape", cards), ("indiegogo", money)], req)
    return u.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


# --- S11 / S12 ---------------------------------------------------------------------------------------

@query("s11_dedup_first", with_views(f"""
SELECT id, file_rank, {s6('goal')} AS goal, status FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_rank, row_in_file) AS rn FROM _copies) WHERE rn = 1
""", derived.COPIES_SQL))
def s11_dedup_first(spark, sf_dir):
    d = ingest.dedup_keep(derived.copies(campaigns(spark, sf_dir)), "id", ["file_rank", "row_in_file"], "first")
    return d.select("id", "file_rank", r6("goal").alias("goal"), "status")


@query("s12_dedup_last", with_views(f"""
SELECT id, file_rank, {s6('goal')} AS goal, status FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_rank DESC, row_in_file DESC) AS rn FROM _copies) WHERE rn = 1
""", derived.COPIES_SQL))
def s12_dedup_last(spark, sf_dir):
    d = ingest.dedup_keep(derived.copies(campaigns(spark, sf_dir)), "id", ["file_rank", "row_in_file"], "last")
    return d.select("id", "file_rank", r6("goal").alias("goal"), "status")


# --- S13 / S14 / S15 -----------------------------------------------------------------------------------

@query("s13_project_json", with_views("""
, _j AS (
  SELECT *, CAST(trunc(pledged_amount) AS BIGINT) AS pl,
         CASE WHEN project_id % 7 = 0 THEN CAST(trunc(CAST(trunc(pledged_amount) AS BIGINT) * 11 / 10) AS BIGINT) END AS usd
  FROM campaign
  WHERE project_id % 101 <> 0 AND project_id % 11 <> 0 AND year(launch_date) BETWEEN 2009 AND 2025
    AND status IN ('successful', 'failed')
)
SELECT project_id, name, country AS creator, subcategory AS category, category AS subcategory,
       CAST(trunc(funding_goal) AS BIGINT)::DOUBLE AS funding_goal,
       CASE WHEN usd IS NOT NULL AND usd <> 0 THEN usd ELSE pl END::DOUBLE AS pledged_amount,
       backers_count, campaign_duration_days, 0 AS num_updates, 0 AS num_comments,
       CAST(project_id % 50 AS INTEGER) AS description_length,
       CAST(launch_date AS DATE) AS launch_date, CAST(end_date AS DATE) AS end_date, status,
       list_filter(coalesce(reward_tiers, []::DOUBLE[]), lambda x: x <> 0) AS reward_tiers, country,
       CASE WHEN trunc(funding_goal) > 0 THEN round((CASE WHEN usd IS NOT NULL AND usd <> 0 THEN usd ELSE pl END)::DOUBLE
            / CAST(trunc(funding_goal) AS BIGINT)::DOUBLE * 10000.0::DOUBLE) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS funding_ratio
FROM _j"""))
def s13_project_json(spark, sf_dir):
    js = derived.project_json(campaigns(spark, sf_dir))
    return ingest.normalise_project_json(js, "json", year_range=(2009, 2025))


_JSON_NAME_SQL = """
_jn AS (
  SELECT project_id,
         CASE WHEN project_id % 17 = 0 THEN NULL
              WHEN project_id % 3 = 0 THEN '{"name":"' || category || '"}'
              WHEN project_id % 3 = 1 THEN category
              WHEN project_id % 2 = 0 THEN '{"slug":"' || lower(category) || '"}'
              ELSE '123' END AS category_raw
  FROM campaign
)"""


def _json_name_input(camp):
    pid = F.col("project_id")
    raw = (F.when(F.pmod(pid, F.lit(17)) == 0, F.lit(None).cast("string"))
           .when(F.pmod(pid, F.lit(3)) == 0, F.concat(F.lit('{"name":"'), F.col("category"), F.lit('"}')))
           .when(F.pmod(pid, F.lit(3)) == 1, F.col("category"))
           .when(F.pmod(pid, F.lit(2)) == 0, F.concat(F.lit('{"slug":"'), F.lower("category"), F.lit('"}')))
           .otherwise(F.lit("123")))
    return camp.select("project_id", raw.alias("category_raw"))


@query("s14_json_name", with_views("""
, _f AS (
  SELECT max(CASE WHEN starts_with(category_raw, '{')
                   AND (json_extract_string(category_raw, '$.name') IS NULL) THEN 1 ELSE 0 END) AS any_fail FROM _jn
)
SELECT project_id, category_raw,
       CASE WHEN (SELECT any_fail FROM _f) = 1 THEN category_raw
            WHEN starts_with(category_raw, '{') THEN json_extract_string(category_raw, '$.name')
            ELSE category_raw END AS name_brace,
       CASE WHEN category_raw IS NULL THEN 'Unknown'
            WHEN starts_with(ltrim(category_raw), '{') AND json_valid(category_raw)
                 THEN coalesce(json_extract_string(category_raw, '$.name'), 'Unknown')
            ELSE category_raw END AS name_strict
FROM _jn""", _JSON_NAME_SQL))
def s14_json_name(spark, sf_dir):
    df = _json_name_input(campaigns(spark, sf_dir))
    x = F.col("category_raw")
    # v1 fails as a whole column when any brace-text lacks a name: then every row keeps the raw text
    fails = F.when(x.startswith("{") & F.get_json_object(x, "$.name").isNull(), 1).otherwise(0)
    any_fail = df.select(F.max(fails)).scalar()
    brace = F.when(any_fail == 1, x).otherwise(ingest.json_name(x, "brace"))
    return df.select("project_id", "category_raw", brace.alias("name_brace"),
                     ingest.json_name(x, "strict").alias("name_strict"))


@query("s15_epoch", with_views("""
SELECT project_id, CASE WHEN project_id % 19 = 0 THEN 'bad' ELSE CAST(epoch(launch_date)::BIGINT AS VARCHAR) END AS launched_at,
       CASE WHEN project_id % 19 = 0 THEN NULL ELSE make_timestamp(CAST(epoch(launch_date) AS BIGINT) * 1000000) END AS launch_ts
FROM campaign"""))
def s15_epoch(spark, sf_dir):
    camp = campaigns(spark, sf_dir)
    txt = F.when(F.pmod(F.col("project_id"), F.lit(19)) == 0, F.lit("bad")).otherwise(
        F.unix_seconds(F.col("launch_date").cast("timestamp")).cast("string"))
    df = camp.select("project_id", txt.alias("launched_at"))
    return df.withColumn("launch_ts", ingest.epoch_to_timestamp("launched_at"))


# --- S1 / S2 / S3 / S5: file scans ---------------------------------------------------------------

@query("s1_s5_csv_scan", with_views("""
SELECT count(*) AS rows, count(DISTINCT id) AS distinct_ids, count(*) FILTER (WHERE id % 5 = 0) AS accented_names,
       CAST(sum(length(name) + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS name_chars,
       0::BIGINT AS replacement_chars FROM _raw""", derived.RAW_SQL))
def s1_s5_csv_scan(spark, sf_dir):
    """The raw dump written as header CSV files — UTF-8 in one folder, Latin-1 snapshots in a
    sub-folder — then read back recursively in one scan with the encoding fallback: accented names
    must come back intact (no U+FFFD) and every row exactly once."""
    from pricelens.session import scratch_path
    camp = campaigns(spark, sf_dir)
    raw = derived.raw_dump(camp).withColumn(
        "Name ", F.when(F.pmod(F.col("ID"), F.lit(5)) == 0, F.concat(F.col("Name "), F.lit("é")))
        .otherwise(F.col("Name ")))
    base = scratch_path(spark, f"csv-{spark.sparkContext.applicationId}")
    utf = raw.where(F.pmod(F.col("ID"), F.lit(2)) == 0)
    lat = raw.where(F.pmod(F.col("ID"), F.lit(2)) == 1)
    utf.repartition(3).write.mode("overwrite").option("header", True).csv(f"{base}/dump")
    lat.repartition(2).write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(
        f"{base}/dump/snapshots")
    back = ingest.normalise_columns(ingest.read_csv_with_fallback(spark, f"{base}/dump", recursive=True,
                                                                  glob="*.csv"))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("distinct_ids"),
                    F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("name_chars"),
                    F.count_if(F.col("name").endswith("é")).alias("accented_names"),
                    F.count_if(F.col("name").contains("�")).alias("replacement_chars"))


# --- S3 / S4 / S5 / K6: file catalogue ---------------------------------------------------------------

def _dumps(spark, sf_dir, name):
    from pricelens.session import scratch_path
    camp = campaigns(spark, sf_dir).select("project_id", "status", "funding_goal")
    return camp, scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def _write_csv(df, path):
    df.write.option("header", True).csv(path)


@query("s3_s4_source_pick", with_views("""
SELECT 'largest_first' AS step, CAST(r AS INTEGER) AS source_rank, count(*) AS n, CAST(sum(project_id) AS BIGINT) AS id_sum
FROM (SELECT project_id, unnest(CASE WHEN project_id % 4 = 0 THEN [1, 3] ELSE [1, 2] END) AS r FROM campaign) GROUP BY ALL
UNION ALL SELECT 'main_dump', 1, count(*), CAST(sum(project_id) AS BIGINT) FROM campaign WHERE project_id % 4 <> 0
UNION ALL SELECT 'first_existing', 1, count(*), CAST(sum(project_id) AS BIGINT) FROM campaign WHERE project_id % 4 = 0"""))
def s3_s4_source_pick(spark, sf_dir):
    """Three dumps under two roots (a third root does not exist): all of them largest first with the rows of each, the
    main dump by root, pattern and size, and the first path that exists."""
    camp, base = _dumps(spark, sf_dir, "dumps")
    fourth = F.pmod("project_id", F.lit(4)) == 0
    _write_csv(camp.where(~fourth), f"{base}/raw/kickstarter-2021.csv")
    _write_csv(camp.where(fourth), f"{base}/raw/kickstarter-small.csv")
    _write_csv(camp, f"{base}/ks-projects-all.csv")
    src = catalogue.sources(catalogue.file_catalogue(spark, [f"{base}/raw/kaggle", f"{base}/raw", base]))
    schema = camp.schema

    def tally(rows, step):
        return rows.groupBy(F.lit(step).alias("step"), "source_rank").agg(
            F.count(F.lit(1)).alias("n"), F.sum("project_id").alias("id_sum"))

    ranked = catalogue.read_ranked(spark, catalogue.largest_first(src), "source_rank", schema)
    main = ingest.read_csv_dump(spark, catalogue.pick_dump(src), schema)
    first = ingest.read_csv_dump(spark, catalogue.first_existing(
        spark, [f"{base}/raw/kickstarter_raw.csv", f"{base}/raw/kickstarter-small.csv", f"{base}/ks-projects-all.csv"]), schema)
    one = F.lit(1).alias("source_rank")
    return tally(ranked, "largest_first").unionByName(tally(main.select("project_id", one), "main_dump")).unionByName(
        tally(first.select("project_id", one), "first_existing"))


# Months of the derived snapshots: two a year, so that "the first of each year" leaves some out.
_SNAPSHOTS = ["2021-03", "2021-11", "2022-02", "2022-07", "2023-01"]


@query("s5_k6_snapshots", with_views(f"""
, _s AS (SELECT project_id, funding_goal * (1.0::DOUBLE + k / 10.0::DOUBLE) AS goal, k + 1 AS ordinal, s
         FROM campaign, (SELECT unnest({_SNAPSHOTS}) AS s, unnest(range({len(_SNAPSHOTS)})) AS k) WHERE (project_id + k) % 3 <> 0),
_u AS (SELECT 'all' AS scope, * FROM _s UNION ALL SELECT 'first_of_year', * FROM _s WHERE s IN ('2021-03', '2022-02', '2023-01'))
SELECT scope, project_id, CAST(max(ordinal) AS INTEGER) AS ordinal, {s6('arg_max(goal, ordinal)')} AS goal FROM _u GROUP BY scope, project_id"""))
def s5_k6_snapshots(spark, sf_dir):
    """Five monthly snapshots, each with two thirds of the campaigns at other goals, found by the catalogue: the newest
    copy of every campaign over all of them, and over the first snapshot of each year alone."""
    camp, base = _dumps(spark, sf_dir, "snapshots")
    for k, month in enumerate(_SNAPSHOTS):
        _write_csv(camp.where(F.pmod(F.col("project_id") + k, F.lit(3)) != 0).select(
            "project_id", (F.col("funding_goal") * (F.lit(1.0) + F.lit(k) / F.lit(10.0))).alias("goal")), f"{base}/Kickstarter_{month}.csv")
    src = catalogue.sources(catalogue.file_catalogue(spark, [base]))
    out = []
    for scope, chosen in (("all", catalogue.snapshot_order(src)), ("first_of_year", catalogue.first_snapshots(src, 1))):
        rows = catalogue.read_ranked(spark, chosen, "ordinal", "project_id long, goal double")
        last = ingest.dedup_keep(rows, "project_id", ["ordinal"], "last")
        out.append(last.select(F.lit(scope).alias("scope"), "project_id", "ordinal", r6("goal").alias("goal")))
    return out[0].unionByName(out[1])
