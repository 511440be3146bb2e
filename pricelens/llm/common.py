"""Shared helpers: tables, shared scratch folders, files reached by URI, folds, Arrow batch size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import checkpoint_dir

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

#: Rows per Arrow batch handed to a Python worker: whole texts travel in them, so few rows keep a batch small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def arrow_batches(spark: SparkSession) -> None:
    """Make Python workers ready: they can import this package wherever they run, and Arrow batches of
    whole texts stay small unless the session already asks for small ones."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source as a Python file, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not root.endswith(".zip/pricelens"):
        path = os.path.join(tempfile.mkdtemp(prefix="pricelens-src-"), "pricelens-src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("pricelens", os.path.relpath(full, root)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; never reused, so a retry cannot mix runs."""
    return os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id has no fold (null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def row_struct(df: DataFrame) -> Column:
    """All columns as one struct: names of extra columns cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def filesystem(uri: str):
    """(file system, path) of a folder or file in the shared store."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def publish(store, temporary: str, final: str) -> None:
    """Give a finished file its name. A retried task writes the same content, so replacing is harmless."""
    store.move(temporary, final)


def text_bytes(column) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def attempt() -> tuple[int, str]:
    """(partition id, name unique to this task attempt)."""
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return (ctx.partitionId(), f"{ctx.partitionId()}-{ctx.taskAttemptId()}") if ctx else (0, uuid.uuid4().hex)


#: What separates words where a contract says `[^\x20\x09-\x0D]+`; bytes.split() separates by the same six bytes.
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of UTF-8 text, block by block: no word is cut, and no block of a long text is much over `size` bytes."""
    at = 0
    while at < len(data):
        stop = at + size
        if stop < len(data):
            cut = _BLANK.search(data, stop)
            stop = cut.start() if cut else len(data)
        yield data[at:stop].split()
        at = stop


class Numbers(dict):
    """Value -> number, in order of first use."""

    def __missing__(self, value) -> int:
        self[value] = n = len(self)
        return n


_KEPT: dict = {}


def kept(key: tuple, build):
    """The one large object (a vocabulary, a model with its memo) that this worker keeps between tasks: a chain of
    operators in one application never holds two of them."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]
