"""File catalogue S3-S5 and the snapshot quota of K6: which files a dump consists of and in what order.

The catalogue is a table of one row a file, read by Spark's binary file source without the content column. A *source*
is what one loader call reads: a file, or the folder of a table written in several files. Ranks are windows over the
sources, of which there are as many as dumps and snapshots, not as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.operators.joins import join_small
from pricelens.sources.ingest import read_csv_dump

# File patterns of the campaign dump, first match first.
DUMP_PATTERNS = ["ks-projects*.csv", "kickstarter*.csv", "Kickstarter*.csv", "*.csv"]

_SCHEMA = "path string, folder string, name string, size long, depth int, root_rank int"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of ``paths`` that exists, else None."""
    return next((p for p in paths if exists(spark, p)), None)


def file_catalogue(spark: SparkSession, roots: Sequence[str], glob: str = "*.csv") -> DataFrame:
    """S3: every file below the roots whose name fits ``glob``: path, folder, name, size, depth below its root and the
    root's rank. A root that does not exist adds nothing; a file below several roots counts for the first of them."""
    found = []
    for rank, root in enumerate(roots):
        if exists(spark, root):
            files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
                     .load(root).select("path", F.col("length").alias("size")))
            parts = F.split("path", "/")
            base = len([x for x in root.split("://")[-1].strip("/").split("/") if x])
            inside = F.size(F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "/"), lambda x: x != "")) - base - 1
            found.append(files.select("path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"),
                                      F.element_at(parts, -1).alias("name"), "size", inside.cast("int").alias("depth"),
                                      F.lit(rank).alias("root_rank")))
    if not found:
        return spark.createDataFrame([], _SCHEMA)
    every = reduce(lambda a, b: a.unionByName(b), found)
    rest = ["folder", "name", "size", "depth", "root_rank"]
    return every.groupBy("path").agg(F.min_by(F.struct(*rest), "root_rank").alias("_r")).select(
        "path", *[F.col("_r")[x].alias(x) for x in rest])


def sources(files: DataFrame) -> DataFrame:
    """Files put together to sources: a part file (``part-...``) belongs to its folder, any other file is a source.

    Columns: source (path), label (its last name), files, size (bytes), depth, root_rank, year and month of the snapshot
    (the first ``yyyy-mm`` or ``yyyy_mm`` in the label, else null)."""
    part = F.col("name").startswith("part-")
    own = files.withColumn("source", F.when(part, F.col("folder")).otherwise(F.col("path"))).withColumn(
        "depth", F.col("depth") - part.cast("int"))
    s = own.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.min("depth").alias("depth"),
                                  F.min("root_rank").alias("root_rank"))
    s = s.withColumn("label", F.element_at(F.split("source", "/"), -1))
    when = r"(?<!\d)(\d{4})[-_](0[1-9]|1[0-2])(?!\d{2})"
    return (s.withColumn("year", F.nullif(F.regexp_extract("label", when, 1), F.lit("")).cast("int"))
            .withColumn("month", F.nullif(F.regexp_extract("label", when, 2), F.lit("")).cast("int")))


def largest_first(src: DataFrame) -> DataFrame:
    """S3: rank 1 is the largest source (ties by path): the order in which copies of one id are kept."""
    return src.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("size").desc(), "source")))


def snapshot_order(src: DataFrame) -> DataFrame:
    """Ordinal of the dated sources by year and month (ties by path), overall and inside the year; undated ones go."""
    dated = src.where("year is not null")
    return dated.withColumn("ordinal", F.row_number().over(Window.orderBy("year", "month", "source"))).withColumn(
        "in_year", F.row_number().over(Window.partitionBy("year").orderBy("month", "source")))


def first_snapshots(src: DataFrame, per_year: int, years: Sequence[int] | None = None) -> DataFrame:
    """K6: the first ``per_year`` snapshots of every (given) year."""
    kept = snapshot_order(src).where(F.col("in_year") <= per_year)
    return kept if years is None else kept.where(F.col("year").isin(*years))


def pick_dump(src: DataFrame, patterns: Sequence[str] = DUMP_PATTERNS) -> str | None:
    """S3: the single main dump: sources lying directly in the first root that has any, there the first pattern that any
    fits, of those the largest (ties by path). One row reaches the driver; None if there is no source."""
    like = ["^" + p.replace(".", r"\.").replace("*", ".*") + "$" for p in patterns]
    rank = F.coalesce(*[F.when(F.col("label").rlike(x), F.lit(i)) for i, x in enumerate(like)])
    best = src.where("depth = 0").withColumn("_fit", rank).where("_fit is not null").orderBy(
        "root_rank", "_fit", F.col("size").desc(), "source").select("source").first()
    return best["source"] if best else None


def read_ranked(spark: SparkSession, src: DataFrame, rank: str, schema=None) -> DataFrame:
    """All rows of the sources with the column ``rank`` of their source: one scan, joined on the path.

    Only the sources' own paths go to the reader; their files are found by Spark. No source gives an error from an
    unknown schema, or with ``schema`` an empty table."""
    paths = [r["source"] for r in src.select("source").collect()]  # as many as dumps or monthly snapshots
    if not paths:
        if schema is None:
            raise ValueError("no source to read and no schema given")
        return spark.createDataFrame([], schema).withColumn(rank, F.lit(None).cast("int"))
    rows = read_csv_dump(spark, paths, schema=schema).drop("_source_size")
    path = F.col("_source_file")
    rows = rows.withColumn("_source", F.when(path.rlike("/part-[^/]*$"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path))
    # both sides drop the scheme: file listings and scans write it differently (file:/x and file:///x)
    bare = lambda x: F.regexp_replace(x, "^([a-z0-9]+:)/*", "$1/")
    ranks = src.select(bare(F.col("source")).alias("_source"), rank)
    return join_small(rows.withColumn("_source", bare(F.col("_source"))), ranks, "_source", "inner").drop("_source", "_source_file")
