"""Exact deduplication by Grace hashing.

Three steps, all on Spark partitions:

1. `local_pass` - each input partition collapses its own copies in an open-addressing table of bounded
   memory, so a content that fills a third of the corpus leaves at most one full record per partition.
2. The surviving records are dealt by content hash (the first partitioning level; Spark's shuffle files
   are its spill files). A task whose distinct contents exceed the budget partitions them again by the next
   hash bits into spill files of the shared folder, level after level, until each bucket fits the table.
3. Contents are compared completely in the table; every record then learns its group's keeper.

Membership rows join the result on the id of the record that represented them in step 1: a key held by at
most the rows of one input partition, however large the group.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

#: Bytes of distinct content that one table may hold.
TABLE_BYTES = 96 << 20
#: Bytes that a copy adds to the list of its group, roughly.
MEMBER_BYTES = 200
#: Hash bits consumed by one partitioning level.
LEVEL_BITS = 4
#: After this level every bit of the hash is used up; what is left has equal hashes and stays in the table.
MAX_LEVEL = 64 // LEVEL_BITS - 1


class OpenTable:
    """Open-addressing table with linear probing; entries compare hash, then the complete content."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.mask = capacity - 1
        self.hashes: list[int] = []
        self.contents: list = []
        self.bytes = 0

    def find_or_add(self, h: int, content) -> tuple[int, bool]:
        """(entry number, whether it is new)."""
        slots, mask = self.slots, self.mask
        at = (h ^ (h >> 29)) & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        slots[at] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += sys.getsizeof(content) + 64
        if 3 * len(self.contents) > 2 * mask:
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for entry, h in enumerate(self.hashes):
            at = (h ^ (h >> 29)) & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def _better(a: tuple, b: tuple) -> bool:
    """Whether (id, uid) a outranks b; a null id ranks lowest, a tie of ids goes to the larger uid."""
    return (a[0] is not None, a[0] if a[0] is not None else 0, a[1]) > (b[0] is not None, b[0] if b[0] is not None else 0, b[1])


def _digest(content: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass"))


def _local(id_col: str, text_col: str, rows: bool, table_bytes: int):
    """mapInArrow body of step 1. `rows`: carry whole rows of representatives and drop the other rows."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        part, _ = common.attempt()
        seq = 0
        table, best, members = OpenTable(), [], []

        def flush(row_type, id_type):
            out: dict[str, list] = {k: [] for k in ("uid", "rep", "id", "h", "n", "sha", "row")}
            for e, (rank, row) in enumerate(best):
                rep = rank[1]
                sha = hashlib.sha256(table.contents[e].encode("utf-8", "surrogatepass")).digest()
                for one in members[e] if not rows else [rank]:
                    chosen = one[1] == rep
                    for k, v in zip(out, (one[1], rep, one[0], table.hashes[e] - (1 << 63), len(members[e]) if chosen else 0, sha, row if chosen else None)):
                        out[k].append(v)
                if len(out["uid"]) >= 2048:
                    yield emit(out, row_type, id_type)
                    out = {k: [] for k in out}
            if out["uid"]:
                yield emit(out, row_type, id_type)

        def emit(out, row_type, id_type):
            types = {"uid": pa.int64(), "rep": pa.int64(), "id": id_type, "h": pa.int64(), "n": pa.int64(), "sha": pa.binary(), "row": row_type}
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))

        kinds = None
        for batch in batches:
            col = batch.column(0)
            kinds = (col.type, col.type.field(id_col).type)
            for row in col.to_pylist():
                text = row[text_col] or ""
                rank = (row[id_col], (part << 40) + seq)
                seq += 1
                e, new = table.find_or_add(_digest(text), text)
                if new:
                    best.append((rank, row))
                    members.append([rank])
                else:
                    members[e].append(rank)
                    table.bytes += MEMBER_BYTES
                    if _better(rank, best[e][0]):
                        best[e] = (rank, row)
                if table.bytes > table_bytes:
                    yield from flush(*kinds)
                    table, best, members = OpenTable(), [], []
        if kinds:
            yield from flush(*kinds)

    return run


class _Grace:
    """Step 2 inside one task: table, and spill files by further hash bits when the table is too large."""

    def __init__(self, text_col: str, folder: str, table_bytes: int):
        self.text_col, self.folder, self.table_bytes = text_col, folder, table_bytes
        _, self.name = common.attempt()

    def groups(self, records, level: int):
        """Yields (best record, members) of every distinct content. A record is (h, uid, id, n, row, same_as);
        same_as names the uid of an earlier record of equal content when the row itself was left out."""
        table, best, members, at = OpenTable(), [], [], {}
        records = iter(records)
        for h, uid, key, n, row, same_as in records:
            if same_as is not None:
                e, new = at[same_as], False
            else:
                e, new = table.find_or_add(h, row[self.text_col] or "")
            if new:
                best.append(((key, uid), row))
                members.append([(uid, key, n)])
                at[uid] = e
            else:
                members[e].append((uid, key, n))
                if row is not None and _better((key, uid), best[e][0]):
                    best[e] = ((key, uid), row)
            if table.bytes > self.table_bytes and level < MAX_LEVEL:
                held = self._held(table, best, members)
                yield from self._partition(held, records, level)
                return
        for (rank, row), mine in zip(best, members):
            yield rank, row, mine

    @staticmethod
    def _held(table, best, members):
        for e, ((key, uid), row) in enumerate(best):
            h = table.hashes[e]
            yield h, uid, key, next(n for u, _, n in members[e] if u == uid), row, None
            for u, k, n in members[e]:
                if u != uid:
                    yield h, u, k, n, None, uid

    def _partition(self, held, records, level: int):
        import pyarrow as pa
        store, folder = common.filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        files, sinks, pending = {}, {}, {}
        shift = 64 - LEVEL_BITS * (level + 1)

        def put(b):
            rows = pending.pop(b, [])
            if not rows:
                return
            if b not in sinks:
                files[b] = f"{folder}/{self.name}-{level}-{uuid.uuid4().hex[:8]}-{b}.arrow"
                stream = store.open_output_stream(files[b], compression=None)
                sinks[b] = (pa.ipc.new_stream(stream, SPILL, options=pa.ipc.IpcWriteOptions(compression="zstd")), stream)
            cols = list(zip(*rows))
            sinks[b][0].write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, SPILL)], schema=SPILL))

        import pickle
        SPILL = pa.schema([("h", pa.uint64()), ("uid", pa.int64()), ("id", pa.binary()), ("n", pa.int64()), ("row", pa.binary()), ("same_as", pa.int64())])
        try:
            for part in (held, records):
                for h, uid, key, n, row, same_as in part:
                    b = (h >> shift) & ((1 << LEVEL_BITS) - 1)
                    pending.setdefault(b, []).append((h, uid, pickle.dumps(key), n, None if row is None else pickle.dumps(row), same_as))
                    if len(pending[b]) >= 64:
                        put(b)
            for b in list(pending):
                put(b)
            for sink, stream in sinks.values():
                sink.close()
                stream.close()

            def read(path):
                with store.open_input_stream(path, compression=None) as f, pa.ipc.open_stream(f) as r:
                    for batch in r:
                        for x in batch.to_pylist():
                            yield x["h"], x["uid"], pickle.loads(x["id"]), x["n"], x["row"] and pickle.loads(x["row"]), x["same_as"]

            for path in files.values():
                yield from self.groups(read(path), level + 1)
        finally:
            for path in files.values():
                store.delete_file(path)


def _merge(text_col: str, folder: str, rows: bool, table_bytes: int):
    """mapInArrow body of steps 2 and 3: decisions per representative, or the keepers' whole rows."""

    def run(batches):
        import pyarrow as pa
        kinds: list = []

        def records():
            for batch in batches:
                kinds[:] = [batch.schema.field("row").type, batch.schema.field("id").type]
                for x in batch.to_pylist():
                    yield x["h"] + (1 << 63), x["uid"], x["id"], x["n"], x["row"], None

        def emit(out):
            if rows:
                array = pa.array(out, kinds[0])
                return pa.RecordBatch.from_arrays([array], ["row"])
            cols = list(zip(*out))
            types = (pa.int64(), pa.int64(), kinds[1], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["rep", "keep_uid", "keep_id", "group_size"])

        out: list = []
        for rank, row, members in _Grace(text_col, folder, table_bytes).groups(records(), 1):
            if rows:
                out.append(row)
            else:
                size = sum(n for _, _, n in members)
                out += [(uid, rank[1], rank[0], size) for uid, _, _ in members]
            if len(out) >= 2048:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return run


def _local_schema(row_type: T.StructType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("uid", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("id", id_type),
                         T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sha", T.BinaryType()),
                         T.StructField("row", row_type)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and empty texts form one group. The row with the largest id stays; of
    rows that also share the id exactly one is kept. A null id ranks lowest. Repeated rows each get a row.
    Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    row_type, id_type = T.StructType(slim.schema.fields), slim.schema["id"].dataType
    local = common.staged(slim.select(common.row_struct(slim).alias("row")).mapInArrow(_local("id", "text", False, table_bytes), _local_schema(row_type, id_type)), "dedup")
    reps = local.where("n > 0").select("h", "uid", "id", "n", "row").repartition("h")
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("keep_uid", T.LongType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType())])
    merged = reps.mapInArrow(_merge("text", common.run_dir(spark, "dedup-spill"), False, table_bytes), out)
    return (local.select("uid", "rep", "id", "sha").join(merged, "rep")
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows `exact_dedup` keeps, with all their columns; contents cross the network once."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    row_type, id_type = T.StructType(docs.schema.fields), docs.schema[id_col].dataType
    reps = docs.select(common.row_struct(docs).alias("row")).mapInArrow(_local(id_col, text_col, True, table_bytes), _local_schema(row_type, id_type))
    reps = reps.select("h", "uid", "id", "n", "row").repartition("h")
    kept = reps.mapInArrow(_merge(text_col, common.run_dir(spark, "dedup-spill"), True, table_bytes), T.StructType([T.StructField("row", row_type)]))
    return kept.select("row.*")
