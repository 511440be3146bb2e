"""Ingestion operators S1-S17 and P1-P5, P24, P25: raw campaign dumps → the campaign contract.

Each function maps DataFrame(s) to a DataFrame; nothing is collected. Alias and schema decisions
(S7, S9) are made at plan time from ``df.columns``; row-level parsing uses built-in JSON, regex and
``try_*`` functions (T2), so bad values become null instead of failing the job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.joins import join_small
from pricelens.functions.exprs import c, flag, floor_days_between, hash_unit, round_to, safe_div

# --- S1 / S2 / S3 / S5: file scans -----------------------------------------------------------


def read_csv_dump(spark, path: str | Sequence[str], schema=None, recursive: bool = False, glob: str | None = None,
                  encoding: str = "UTF-8") -> DataFrame:
    """Header CSV scan (many files or a folder tree at once), with the source file
    path and size kept so callers can rank sources (largest first) and snapshots (by name)."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.withColumn("_source_file", F.col("_metadata.file_path")).withColumn(
        "_source_size", F.col("_metadata.file_size"))


def read_csv_with_fallback(spark, path: str | Sequence[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """UTF-8, and Latin-1 for the files that hold bytes which are no UTF-8.

    The files are scanned as Latin-1, which maps every byte to one character and back, so a text's bytes are at hand:
    one pass finds, per file, whether all its texts are valid UTF-8; the files' verdicts are joined to the rows on the
    path (a table of one row a file) and the texts of good files are decoded. One schema serves all files, a dump that
    is Latin-1 throughout works, and no list of paths is built. Latin-1 never fails, so the reference's third encoding
    is unreachable and omitted. Null texts stay null; a file without rows gives none.
    """
    raw = read_csv_dump(spark, path, recursive=recursive, glob=glob, encoding="ISO-8859-1")
    names = []
    for n in raw.columns:  # the header line: a byte order mark goes
        try:
            names.append(n.encode("latin-1").decode("utf-8-sig"))
        except UnicodeError:
            names.append(n)
    raw = raw.toDF(*names)
    texts = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string" and not f.name.startswith("_source")]
    bytes_of = {n: F.encode(c(n), "ISO-8859-1").cast("string") for n in texts}
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.is_valid_utf8(x), F.lit(True)) for x in bytes_of.values()], F.lit(True))
    files = raw.groupBy("_source_file").agg(F.bool_and(valid).alias("_utf8"))
    out = join_small(raw, files, "_source_file")
    return out.select(*[F.when(F.col("_utf8"), bytes_of[n]).otherwise(c(n)).alias(n) if n in bytes_of else c(n) for n in names])


# --- S6-S10: schema harmonisation --------------------------------------------------------------


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case, strip, spaces → underscores."""
    return df.toDF(*[re.sub(r"\s", "_", n.strip().lower()) for n in df.columns])


# Alias tables of the harmonisers (target ← source), in the reference's order.
ALIASES_IF_ABSENT = {"goal": "usd_goal_real", "pledged": "usd_pledged_real", "category": "main_category",
                     "backers": "backers_count"}
USD_PREFERENCE = {"goal": ["usd_goal_real", "goal"], "pledged": ["usd_pledged_real", "usd_pledged", "pledged"]}
RUNTIME_ALIASES = {"funding_goal": ["funding_goal", "goal"],
                   "campaign_duration_days": ["campaign_duration_days", "duration_days"]}


def alias_if_absent(df: DataFrame, aliases: dict = ALIASES_IF_ABSENT) -> DataFrame:
    """S7 variant 1: rename source → target only when target is missing (local ``goal`` wins)."""
    for target, source in aliases.items():
        if target not in df.columns and source in df.columns:
            df = df.withColumnRenamed(source, target)
    return df


def alias_prefer(df: DataFrame, preference: dict = USD_PREFERENCE) -> DataFrame:
    """S7 variant 2/3: the first present candidate becomes the target column (plan-time pick)."""
    for target, candidates in preference.items():
        found = next((x for x in candidates if x in df.columns), None)
        if found is not None and found != target:
            df = df.withColumn(target, F.col(found))
    return df


def swap_rename(df: DataFrame, a: str = "category", b: str = "subcategory") -> DataFrame:
    """Exchange two column names in one projection (sequential renames would collide)."""
    return df.select(*[F.col(n).alias(b if n == a else a if n == b else n) for n in df.columns])


def intersect_union(frames: Sequence[DataFrame], whitelist: Sequence[str] | None = None) -> DataFrame:
    """Keep only the columns common to every input (whitelist order first), then union."""
    common = set(frames[0].columns)
    for f in frames[1:]:
        common &= set(f.columns)
    order = [x for x in (whitelist or []) if x in common]
    order += sorted(common - set(order))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*order) for f in frames])


def union_with_source(historical: DataFrame, live: Sequence[tuple[str, DataFrame]],
                      required: Sequence[str]) -> DataFrame:
    """Tag sources, add missing required columns as null, lower-case status, union."""
    def shape(df, source):
        for col in required:
            if col not in df.columns:
                df = df.withColumn(col, F.lit(None).cast("string"))
        df = df.withColumn("source", F.lit(source))
        if "status" in df.columns:
            df = df.withColumn("status", F.lower("status"))
        return df.select(*required, "source")
    frames = [shape(historical, "kaggle")] + [shape(df, name) for name, df in live]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), frames)


# --- S11 / S12: deduplication --------------------------------------------------------------------


def dedup_keep(df: DataFrame, key: str, order_cols: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first (or last) by ``order_cols``.

    Written as ``min_by``/``max_by`` aggregation, not a per-key window: partial aggregation
    collapses copies map-side, so a key holding a third of all rows never lands whole in one task.
    Null keys form one group, as in pandas ``drop_duplicates``.
    """
    rest = [x for x in df.columns if x != key]
    order = F.struct(*[F.col(o) for o in order_cols])
    pick = F.min_by if keep == "first" else F.max_by
    out = df.groupBy(key).agg(pick(F.struct(*[F.col(x) for x in rest]), order).alias("_r"))
    return out.select(key, *[F.col("_r")[x].alias(x) for x in rest])


# --- P1-P5: state filter, validity, coercion, duration --------------------------------------------

# The accepted completed states per harmoniser variant.
STATES_EXACT = ["Failed", "Successful"]
STATES_FOUR = ["successful", "failed", "Successful", "Failed"]
STATES_LOWER = ["successful", "failed"]


def completed_state_filter(df: DataFrame, state: str = "state", mode: str = "exact") -> DataFrame:
    """Keep completed campaigns and derive lower-case ``status``."""
    s = F.col(state)
    cond = {"exact": s.isin(STATES_EXACT), "four": s.isin(STATES_FOUR),
            "lower": F.lower(s).isin(STATES_LOWER)}[mode]
    return df.where(cond).withColumn("status", F.lower(s))


def validity_filter(df: DataFrame, max_days: int = 90) -> DataFrame:
    """Goal > 0, pledged ≥ 0, 0 < duration ≤ max_days."""
    return df.where((F.col("funding_goal") > 0) & (F.col("pledged_amount") >= 0)
                    & (F.col("campaign_duration_days") > 0)
                    & (F.col("campaign_duration_days") <= max_days))


def coerce_number(col) -> "F.Column":
    """Text → double, bad text → null (``errors='coerce'``, T2)."""
    return F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")


def coerce_timestamp(col) -> "F.Column":
    """Text → timestamp_ntz, unparseable → null."""
    return F.try_to_timestamp(c(col)).cast("timestamp_ntz")


def duration_days(end, start) -> "F.Column":
    """P5: floored whole days between end and start."""
    return floor_days_between(end, start).cast("int")


# --- P24 / P25: deterministic fills ----------------------------------------------------------------


def hash_impute(df: DataFrame, id_col: str = "project_id") -> DataFrame:
    """Fields missing from a dump, drawn from id hashes instead of an RNG.

    description_length = len(name)·U{10..49}; num_updates = U{0..14};
    num_comments = int(backers·U[0.02, 0.08)); trend_index = U{20..79}.
    """
    h1, h2, h3, h4 = (hash_unit(id_col, s) for s in (1, 2, 3, 4))
    name_len = F.length(F.coalesce(F.col("name"), F.lit("Unknown Project")))
    return (df
            .withColumn("description_length", (name_len * (F.lit(10) + F.pmod(h1, F.lit(40)))).cast("int"))
            .withColumn("num_updates", F.pmod(h2, F.lit(15)).cast("int"))
            .withColumn("num_comments", (F.coalesce(F.col("backers_count").cast("double"), F.lit(0.0))
                                         * (F.lit(0.02) + F.lit(0.06) * h3 / F.lit(4294967296.0))).cast("int"))
            .withColumn("trend_index_fill", (F.lit(20) + F.pmod(h4, F.lit(60))).cast("int")))


def tiers_from_goal(goal, bad_default: bool = True) -> "F.Column":
    """P25: base = max(10, int(goal/500)); tiers max(10,b), max(25,2b), max(50,4b), max(100,8b).
    A null or non-positive goal gives [25, 50, 100] in the defaulting variant."""
    g = c(goal)
    base = F.greatest(F.lit(10), (g / F.lit(500)).cast("long"))
    tiers = F.array(F.greatest(F.lit(10), base), F.greatest(F.lit(25), base * 2),
                    F.greatest(F.lit(50), base * 4), F.greatest(F.lit(100), base * 8)).cast("array<double>")
    if not bad_default:
        return tiers
    return F.when(g.isNull() | (g <= 0), F.array(F.lit(25.0), F.lit(50.0), F.lit(100.0))).otherwise(tiers)


def _sorted_tiers(tiers, most: "F.Column | int") -> "F.Column":
    return F.slice(F.array_sort(F.array_distinct(tiers)), F.lit(1), most if not isinstance(most, int) else F.lit(most)).cast("array<double>")


def tiers_snapshot(goal) -> "F.Column":
    """P25, snapshot variant: the second floor is 20 instead of 25; sorted, without repeats, at most five. A null or
    non-positive goal gives [25, 50, 100]."""
    g = c(goal)
    base = F.greatest(F.lit(10), (g / F.lit(500)).cast("long"))
    tiers = F.array(*[F.greatest(F.lit(low), base * m) for low, m in ((10, 1), (20, 2), (50, 4), (100, 8))])
    return F.when(g.isNull() | (g <= 0), F.array(F.lit(25.0), F.lit(50.0), F.lit(100.0))).otherwise(_sorted_tiers(tiers, 5))


# Floor, multiple of the base and jitter range [from, to) of each tier of the jittered variant.
JITTERED_TIERS = [(10, 1, -5, 10), (25, 2, -10, 20), (50, 4, -15, 30), (100, 8, -20, 50), (200, 15, -30, 100)]


def tiers_jittered(goal, key) -> "F.Column":
    """P25, jittered variant: base max(10, int(goal / 1000)), five tiers moved by whole numbers from the row's id hash,
    sorted, without repeats, the first 3 to 7 of them. A null or non-positive goal gives [25, 50, 100]."""
    g = c(goal)
    base = F.greatest(F.lit(10), (g / F.lit(1000)).cast("long"))
    moved = [F.greatest(F.lit(low), base * m + F.lit(lo) + F.pmod(hash_unit(key, 11 + i), F.lit(hi - lo)))
             for i, (low, m, lo, hi) in enumerate(JITTERED_TIERS)]
    count = (F.lit(3) + F.pmod(hash_unit(key, 10), F.lit(5))).cast("int")
    return F.when(g.isNull() | (g <= 0), F.array(F.lit(25.0), F.lit(50.0), F.lit(100.0))).otherwise(_sorted_tiers(F.array(*moved), count))


def harmonise(raw: DataFrame) -> DataFrame:
    """E1 step 1 over a raw dump: S6 → P1 → S8 → rename → P4 → P5 → P2 → P10/P11 → P24/P25."""
    df = normalise_columns(raw)
    df = completed_state_filter(df, "state", "exact")
    df = swap_rename(df)
    df = (df.withColumnRenamed("id", "project_id").withColumnRenamed("goal", "funding_goal")
          .withColumnRenamed("pledged", "pledged_amount").withColumnRenamed("backers", "backers_count"))
    df = (df.withColumn("launch_date", coerce_timestamp("launched"))
          .withColumn("end_date", coerce_timestamp("deadline")))
    df = df.withColumn("campaign_duration_days", duration_days("end_date", "launch_date"))
    df = validity_filter(df)
    df = (df.withColumn("is_successful", flag(F.col("status") == "successful"))
          .withColumn("funding_ratio", safe_div("pledged_amount", "funding_goal")))
    df = hash_impute(df).withColumn("reward_tiers", tiers_from_goal("funding_goal", bad_default=False))
    return df


# --- S13-S17: record parsers -------------------------------------------------------------------------

PROJECT_SCHEMA = (
    "id BIGINT, name STRING, blurb STRING, goal DOUBLE, pledged DOUBLE, usd_pledged DOUBLE, "
    "currency STRING, state STRING, launched_at BIGINT, deadline BIGINT, backers_count INT, "
    "updates_count INT, comments_count INT, country STRING, "
    "creator STRUCT<name: STRING>, category STRUCT<name: STRING, parent_name: STRING, slug: STRING>, "
    "location STRUCT<country: STRING>, rewards ARRAY<STRUCT<minimum: DOUBLE>>")


def normalise_project_json(df: DataFrame, col: str = "json", year_range=(2009, 2030)) -> DataFrame:
    """Nested project record → flat campaign row.

    Drops records without id, outside the year range, or whose state is not successful/failed.
    Non-USD pledges take ``usd_pledged`` when present; tiers are the positive reward minimums;
    duration is floor-divided seconds. Timestamps are read as UTC (SURVEY §1).
    """
    p = F.from_json(F.col(col), PROJECT_SCHEMA)
    df = df.select(p.alias("p")).select("p.*")
    goal = F.coalesce(F.col("goal"), F.lit(0.0))
    pledged0 = F.coalesce(F.col("pledged"), F.lit(0.0))
    pledged = F.when(F.coalesce(F.col("currency"), F.lit("USD")) != "USD",
                     F.when(F.coalesce(F.col("usd_pledged"), F.lit(0.0)) != 0, F.col("usd_pledged"))
                     .otherwise(pledged0)).otherwise(pledged0)
    launch = F.to_date(F.timestamp_seconds("launched_at"))
    tiers = F.filter(F.transform(F.coalesce(F.col("rewards"), F.array().cast("array<struct<minimum:double>>")),
                                 lambda r: r["minimum"]), lambda m: m.isNotNull() & (m != 0))
    out = df.select(
        F.col("id").alias("project_id"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("creator.name"), F.lit("Unknown")).alias("creator"),
        F.coalesce(F.col("category.name"), F.lit("")).alias("category"),
        F.coalesce(F.col("category.parent_name"), F.col("category.slug"), F.lit("")).alias("subcategory"),
        round_to(goal, 2).alias("funding_goal"),
        round_to(pledged, 2).alias("pledged_amount"),
        F.coalesce(F.col("backers_count"), F.lit(0)).alias("backers_count"),
        F.when(F.col("launched_at").isNotNull() & F.col("deadline").isNotNull(),
               F.floor((F.col("deadline") - F.col("launched_at")) / F.lit(86400))).cast("int")
        .alias("campaign_duration_days"),
        F.coalesce(F.col("updates_count"), F.lit(0)).alias("num_updates"),
        F.coalesce(F.col("comments_count"), F.lit(0)).alias("num_comments"),
        F.length(F.coalesce(F.col("blurb"), F.lit(""))).alias("description_length"),
        launch.alias("launch_date"),
        F.to_date(F.timestamp_seconds("deadline")).alias("end_date"),
        F.col("state").alias("status"),
        tiers.alias("reward_tiers"),
        F.coalesce(F.col("country"), F.col("location.country"), F.lit("")).alias("country"),
        F.when(goal > 0, round_to(pledged / goal, 4)).otherwise(F.lit(0.0)).alias("funding_ratio"),
    )
    year_ok = F.year("launch_date").between(year_range[0], year_range[1]) | F.col("launch_date").isNull()
    return out.where(F.col("project_id").isNotNull() & (F.col("project_id") != 0) & year_ok
                     & F.col("status").isin("successful", "failed"))


def json_name(col, mode: str = "brace") -> "F.Column":
    """Name out of a JSON-or-plain-text column.

    ``brace``: parse only text starting with '{', otherwise keep the raw text;
    ``strict``: null → 'Unknown'; JSON without a name → 'Unknown'; unparseable → raw text.
    """
    x = c(col)
    obj = F.from_json(x, "struct<name: string>")
    if mode == "brace":
        return F.when(x.startswith("{"), obj["name"]).otherwise(x)
    # A JSON object parses; valid non-object JSON (a number, a list) falls to the raw text.
    is_object = F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull()
    return (F.when(x.isNull(), F.lit("Unknown"))
            .when(is_object, F.coalesce(obj["name"], F.lit("Unknown")))
            .otherwise(x))


def epoch_to_timestamp(col) -> "F.Column":
    """Epoch seconds (text or number) → timestamp_ntz (UTC), bad values → null."""
    return F.timestamp_seconds(c(col).try_cast("bigint")).cast("timestamp_ntz")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Campaign card fields from raw pages.

    Embedded ``data-project`` JSON first; otherwise the text fallback: <h1> (or <title>) as name,
    the first <p> as description and the fixed defaults for the missing money and state fields.
    """
    h = F.col(html)
    embedded = F.regexp_extract(h, r"data-project='([^']*)'", 1)
    has_json = (embedded != "") & F.get_json_object(embedded, "$.name").isNotNull()
    strip_tags = lambda e: F.trim(F.regexp_replace(e, r"<[^>]+>", ""))
    h1 = strip_tags(F.regexp_extract(h, r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    title = strip_tags(F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)</title>", 1))
    para = strip_tags(F.regexp_extract(h, r"(?s)<p[^>]*>(.*?)</p>", 1))
    name = F.when(h1 != "", h1).when(title != "", title)
    return pages.select(
        "page_id",
        F.when(has_json, F.get_json_object(embedded, "$.name")).otherwise(name).alias("name"),
        F.when(has_json, F.get_json_object(embedded, "$.blurb")).otherwise(para).alias("desc"),
        F.when(has_json, F.get_json_object(embedded, "$.goal").try_cast("double"))
        .otherwise(F.lit(0.0)).alias("goal"),
        F.when(has_json, F.get_json_object(embedded, "$.pledged").try_cast("double"))
        .otherwise(F.lit(0.0)).alias("pledged"),
        F.when(has_json, F.get_json_object(embedded, "$.state")).otherwise(F.lit("live")).alias("state"),
        F.when(has_json, F.get_json_object(embedded, "$.category.name")).otherwise(F.lit("Unknown"))
        .alias("category"),
        F.when(has_json, F.get_json_object(embedded, "$.country")).otherwise(F.lit("US")).alias("country"),
        F.when(has_json, F.lit("live_scrape")).otherwise(F.lit("live_scrape_fallback")).alias("source"),
    ).where(F.col("name").isNotNull())


def money_fields(amount_text, card_text) -> dict:
    """S17: "$1,234 USD" → 1234.0 (first token, non-digits stripped, 0 if bad); "45%" → 45;
    goal back-computed as int(amount/(pct/100)) when pct > 0, else the amount; status by pct ≥ 100."""
    first = F.split(c(amount_text), " ").getItem(0)
    amount = F.coalesce(F.regexp_replace(first, r"[^\d.]", "").try_cast("double"), F.lit(0.0))
    pct = F.coalesce(F.regexp_extract(c(card_text), r"(\d+)%", 1).try_cast("int"), F.lit(0))
    goal = F.when(pct > 0, (amount / (pct / F.lit(100.0))).cast("long").cast("double")).otherwise(amount)
    status = F.when(pct >= 100, F.lit("successful")).otherwise(F.lit("live"))
    return {"pledged_amount": amount, "percent_funded": pct, "funding_goal": goal, "status": status}
