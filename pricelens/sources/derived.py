"""Raw-format inputs derived by rule from the campaign view, for the ingestion operators.

The reference ingests CSV dumps, JSON project records, scraped cards and money text. The driver
ships none of those, so each is re-created here from the campaign view with a fixed rule (in Spark
and, next to it, in DuckDB). Every derived table has a row per campaign (or per copy), so its size
grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _state(pid, status):
    cap = F.when(status == "successful", F.lit("Successful")).otherwise(F.lit("Failed"))
    return (F.when(F.pmod(pid, F.lit(11)) == 0, F.lit("live"))
            .when(F.pmod(pid, F.lit(13)) == 0, F.lit("canceled"))
            .when(F.pmod(pid, F.lit(2)) == 0, cap)
            .otherwise(status))


def raw_dump(camp: DataFrame) -> DataFrame:
    """A historical dump with raw header names, mixed-case states, text dates (some bad) and
    local/USD money columns; some goals are 0 and some durations exceed 90 days."""
    pid = F.col("project_id")
    deadline = F.when(F.pmod(pid, F.lit(89)) == 0, F.date_add(F.to_date("launch_date"), 120)
                      .cast("timestamp_ntz")).otherwise(F.col("end_date"))
    return camp.select(
        pid.alias("ID"),
        F.col("name").alias("Name "),
        F.col("subcategory").alias("Category"),
        F.col("category").alias("Subcategory"),
        F.col("category").alias("Main Category"),
        F.when(F.pmod(pid, F.lit(83)) == 0, F.lit(0.0)).otherwise(F.col("funding_goal")).alias("Goal"),
        F.col("pledged_amount").alias("Pledged"),
        F.col("backers_count").alias("Backers"),
        _state(pid, F.col("status")).alias("State"),
        F.col("country").alias("Country"),
        F.when(F.pmod(pid, F.lit(97)) == 0, F.lit("n/a"))
        .otherwise(F.date_format("launch_date", _TS_FMT)).alias("Launched"),
        F.date_format(deadline, _TS_FMT).alias("Deadline"),
        (F.col("funding_goal") * F.lit(1.25)).alias("USD Goal Real"),
        F.when(F.pmod(pid, F.lit(71)) == 0, F.lit("abc")).otherwise(
            F.col("funding_goal").cast("long").cast("string")).alias("Goal Text"),
    )


RAW_SQL = """
_raw AS (
  SELECT project_id AS id, name, subcategory AS category, category AS subcategory, category AS main_category,
         CASE WHEN project_id % 83 = 0 THEN 0.0::DOUBLE ELSE funding_goal END AS goal,
         pledged_amount AS pledged, backers_count AS backers,
         CASE WHEN project_id % 11 = 0 THEN 'live' WHEN project_id % 13 = 0 THEN 'canceled'
              WHEN project_id % 2 = 0 THEN (CASE WHEN status = 'successful' THEN 'Successful' ELSE 'Failed' END)
              ELSE status END AS state,
         country,
         CASE WHEN project_id % 97 = 0 THEN 'n/a' ELSE strftime(launch_date, '%Y-%m-%d %H:%M:%S') END AS launched,
         strftime(CASE WHEN project_id % 89 = 0 THEN CAST(CAST(launch_date AS DATE) + 120 AS TIMESTAMP)
                       ELSE end_date END, '%Y-%m-%d %H:%M:%S') AS deadline,
         funding_goal * 1.25::DOUBLE AS usd_goal_real,
         CASE WHEN project_id % 71 = 0 THEN 'abc' ELSE CAST(CAST(trunc(funding_goal) AS BIGINT) AS VARCHAR) END AS goal_text
  FROM campaign
)"""


def copies(camp: DataFrame, n: int = 3) -> DataFrame:
    """n copies of every campaign as if read from n files; copy k has file rank ((id+k) mod n)+1
    and a value that differs by copy, so keep-first/keep-last pick different copies per id."""
    base = camp.select("project_id", "funding_goal", "status")
    out = base.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select(
        F.when(F.pmod(F.col("project_id"), F.lit(53)) == 0, F.lit(None).cast("long"))
        .otherwise(F.col("project_id")).alias("id"),
        (F.pmod(F.col("project_id") + F.col("_k"), F.lit(n)) + 1).cast("int").alias("file_rank"),
        F.col("project_id").alias("row_in_file"),
        (F.col("funding_goal") * (F.lit(1.0) + F.col("_k") / F.lit(10.0))).alias("goal"),
        F.col("status"))


COPIES_SQL = """
_copies AS (
  SELECT CASE WHEN project_id % 53 = 0 THEN NULL ELSE project_id END AS id,
         CAST((project_id + k) % 3 + 1 AS INTEGER) AS file_rank, project_id AS row_in_file,
         funding_goal * (1.0::DOUBLE + k / 10.0::DOUBLE) AS goal, status
  FROM campaign, (SELECT unnest([0, 1, 2]) AS k) ks
)"""


def project_json(camp: DataFrame) -> DataFrame:
    """One nested project record (JSON text) per campaign, in the snapshot API's shape."""
    pid = F.col("project_id")
    rewards = F.concat(F.lit("["), F.array_join(F.transform(
        F.coalesce(F.col("reward_tiers"), F.array().cast("array<double>")),
        lambda x: F.concat(F.lit('{"minimum":'), x.cast("string"), F.lit("}"))), ","), F.lit("]"))
    launched = F.unix_seconds(F.col("launch_date").cast("timestamp"))
    deadline = F.unix_seconds(F.col("end_date").cast("timestamp"))
    state = F.when(F.pmod(pid, F.lit(11)) == 0, F.lit("live")).otherwise(F.col("status"))
    cur = F.when(F.pmod(pid, F.lit(7)) == 0, F.lit("EUR")).otherwise(F.lit("USD"))
    goal = F.col("funding_goal").cast("long").cast("string")
    pledged = F.col("pledged_amount").cast("long")
    usd = (pledged * F.lit(11) / F.lit(10)).cast("long").cast("string")
    js = F.concat(
        F.when(F.pmod(pid, F.lit(101)) == 0, F.lit("{")).otherwise(
            F.concat(F.lit('{"id":'), pid.cast("string"), F.lit(","))),
        F.lit('"name":"'), F.col("name"), F.lit('","blurb":"'),
        F.repeat(F.lit("x"), F.pmod(pid, F.lit(50)).cast("int")), F.lit('","goal":'), goal,
        F.lit(',"pledged":'), pledged.cast("string"), F.lit(',"usd_pledged":'), usd,
        F.lit(',"currency":"'), cur, F.lit('","state":"'), state,
        F.lit('","launched_at":'), launched.cast("string"), F.lit(',"deadline":'), deadline.cast("string"),
        F.lit(',"backers_count":'), F.col("backers_count").cast("string"),
        F.lit(',"creator":{"name":"'), F.col("country"), F.lit('"}'),
        F.lit(',"category":{"name":"'), F.col("subcategory"), F.lit('","parent_name":"'), F.col("category"),
        F.lit('"},"location":{"country":"'), F.col("country"), F.lit('"},"rewards":'), rewards, F.lit("}"))
    return camp.select(pid.alias("src_id"), js.alias("json"))
