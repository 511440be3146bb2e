"""SparkSession construction and cluster-safe defaults."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. Only applied where the session leaves them unset, so a cluster's
# own spark-defaults win.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of packed blocks are large: a batch is held by the JVM (off its heap) and by the Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def get_spark(master: str | None = None, app: str = "pricelens", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    extra = {"spark.driver.memory": "8g", **(extra or {})}
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    # Timestamps in the campaign tables are wall-clock; epoch arithmetic must not drift by zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a private one only on a local master.

    On a cluster a folder of one machine would lose rows silently, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pricelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for tables written to cut lineage."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's source, once per application, for operators that run in Python workers.

    Concurrent fits call this at the same time: the first one ships, the others wait until it has."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if ".zip" in root:
        return
    with _SHIPPING:
        if sc.applicationId in _SHIPPED:
            return
        # Spark takes a file name from one folder only, so each archive has a name of its own.
        handle, path = tempfile.mkstemp(prefix="pricelens-package-", suffix=".zip")
        with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.join("pricelens", os.path.relpath(os.path.join(folder, f), root)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
