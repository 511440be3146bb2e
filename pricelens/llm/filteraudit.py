"""How filters interact: what each removes in every order, from sorted posting lists of failing ids.

1. One pass over the texts gives each row a number, its failures and a digest of its text (`failures`).
2. A posting list is the sorted row numbers of one part that fail one filter, cut into id ranges (`postings`).
   Two further lists hold the rows marked good and toxic. A part of any size is spread over its ranges.
3. Inside a range, unions are galloping k-way merges of the lists and removals are galloping differences. Only
   their sizes leave the task; the sizes of all ranges are summed (`set_sizes`).
4. What a step of an order does depends on its filter and the set of earlier ones alone, so the orders of a
   part are read off its k * 2^(k-1) summed sizes (`audit`).
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

FILTERS = "ABCDE"
#: Row numbers of one id range: 2 ** RANGE_BITS, the most that one posting list holds.
RANGE_BITS = 14
#: More filters than this would make too many orders (7! = 5040 a part).
MOST_FILTERS = 7

_UPPER = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = re.compile(rb"[#$%&*|]").search


def text_failures(data: bytes) -> int:
    """Bits of the filters A to D that one UTF-8 text fails: under 200 words; under half of the words distinct;
    over 3 % capitals A-Z; a sign of #$%&*|."""
    n, distinct = 0, set()
    for words in common.word_blocks(data):
        n += len(words)
        distinct.update(words)
    points = len(data.translate(None, _CONTINUED))
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (_SIGNS(data) is not None) << 3


def _facts(batches):
    import hashlib

    import pyarrow as pa
    part_no, _ = common.attempt()
    seq = 0
    for batch in batches:
        masks, digests = [], []
        for data in common.text_bytes(batch.column(1)):
            masks.append(text_failures(data))
            digests.append(hashlib.sha256(data).digest())
        n = batch.num_rows
        rows = pa.array(range((part_no << 40) + seq, (part_no << 40) + seq + n), pa.int64())
        seq += n
        yield pa.RecordBatch.from_arrays([rows, pa.array([part_no] * n, pa.int32()), batch.column(0), batch.column(2), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                         ["row", "source", "id", "part", "mask", "digest"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """row, id, part, mask of every document; bit i of mask: it fails filter i of FILTERS.

    Filter E fails a row whose whole text occurs under a smaller id anywhere in the table. A null id is never
    smaller and never fails it; rows of one id do not fail each other. Null text is empty, a null part the empty string.
    """
    common.arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("source", T.IntegerType()), slim.schema["id"], T.StructField("part", T.StringType()),
                        T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    facts = common.staged(slim.mapInArrow(_facts, out), "audit-facts")
    # Copies collapse within the input partition they came from, so a key of the join back has at most one partition's rows.
    local = facts.groupBy("source", "digest").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    local = common.staged(local, "audit-copies")
    first = local.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
    copied = local.join(first.select("digest", "first"), "digest").where("high > first").select("source", "digest", "first")
    rows = facts.join(copied, ["source", "digest"], "left")
    return rows.select("row", "id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"))


def postings(rows: DataFrame, n_filters: int, range_bits: int = RANGE_BITS) -> DataFrame:
    """part, range, n (its rows), lists: sorted row numbers per filter, then those of `good` and of `toxic` rows.

    `rows` has row (distinct long), part, mask, good, toxic. A list has at most 2 ** range_bits entries.
    """
    def listed(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("row"))))

    lists = [listed(F.col("mask").bitwiseAND(1 << i) != 0) for i in range(n_filters)] + [listed(F.col("good")), listed(F.col("toxic"))]
    return rows.groupBy("part", F.shiftright("row", range_bits).alias("range")).agg(F.count("*").alias("n"), F.array(*lists).alias("lists"))


def gallop(ids: list, x: int, at: int) -> int:
    """First position from `at` on whose id is not below x: doubling steps, then halving."""
    step, stop, n = 1, at, len(ids)
    while stop < n and ids[stop] < x:
        at, stop, step = stop + 1, stop + step, 2 * step
    return bisect_left(ids, x, at, min(stop, n))


def union(lists: list[list]) -> list:
    """Sorted union of sorted lists: the list with the smallest head gives all it has below the next head."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    out: list = []
    while heads:
        x, k, at = heapq.heappop(heads)
        ids = lists[k]
        if not heads:
            out += ids[at:]
            break
        after = heads[0][0]
        stop = gallop(ids, after, at)
        out += ids[at:stop]
        if stop == at:  # an equal id stands at the head of another list, which will give it
            stop += 1
        if stop < len(ids):
            heapq.heappush(heads, (ids[stop], k, stop))
    return out


def split_by(ids: list, others: list) -> tuple[list, list]:
    """(ids not in `others`, ids in `others`), both lists sorted."""
    apart, shared, a, b = [], [], 0, 0
    while a < len(ids) and b < len(others):
        stop = gallop(ids, others[b], a)
        apart += ids[a:stop]
        a = stop
        if a < len(ids) and ids[a] == others[b]:
            shared.append(ids[a])
            a, b = a + 1, b + 1
        elif a < len(ids):
            b = gallop(others, ids[a], b)
    return apart + ids[a:], shared


def range_sizes(lists: list[list], n_filters: int):
    """(filter, earlier filters as bits, removed, good lost, toxic lost, size of the union of all those) of one range."""
    good, toxic = lists[n_filters], lists[n_filters + 1]
    for before in range(1 << n_filters):
        gone = union([lists[i] for i in range(n_filters) if before >> i & 1])
        for f in range(n_filters):
            if not before >> f & 1:
                removed = split_by(lists[f], gone)[0]
                yield f, before, len(removed), len(split_by(removed, good)[1]), len(split_by(removed, toxic)[1]), len(gone) + len(removed)


def set_sizes(posted: DataFrame, n_filters: int) -> DataFrame:
    """Summed sizes per part, filter and set of earlier filters: removed, good_lost, toxic_lost, gone, n."""
    def run(batches):
        import pyarrow as pa
        names = ["part", "filter", "before", "removed", "good_lost", "toxic_lost", "gone", "n"]
        for batch in batches:
            for part, n, lists in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [(part, *sizes, n) for sizes in range_sizes(lists, n_filters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "part" else pa.int32() if k in ("filter", "before") else pa.int64()) for k, c in zip(names, zip(*rows))], names)

    sizes = posted.select("part", "n", "lists").mapInArrow(run, "part string, filter int, before int, removed long, good_lost long, toxic_lost long, gone long, n long")
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "gone", "n")])


def audit(rows: DataFrame, names: str = FILTERS, range_bits: int = RANGE_BITS) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `rows` has row (distinct long, numbered from 0 on within blocks), part, mask (bit i: fails names[i]), good, toxic. At most MOST_FILTERS one-letter
    names. A filter that nothing fails gives zeros; a part without rows does not occur; an empty table gives no row.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS or len(set(names)) < k:
        raise ValueError(f"one to {MOST_FILTERS} different one-letter filters")
    spark = rows.sparkSession
    common.arrow_batches(spark)
    sizes = set_sizes(postings(rows, k, range_bits), k)
    own = Window.partitionBy("part", "filter")  # 2 ** (k - 1) rows each
    others = F.lit((1 << k) - 1).bitwiseXOR(F.expr("shiftleft(1, filter)"))
    orders_with = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("before") + 1)
    sizes = sizes.select("*", F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own).alias("failing"),
                         F.max(F.when(F.col("before") == others, F.col("removed"))).over(own).alias("unique_fails"),
                         F.sum(F.col("removed") * orders_with).over(own).alias("shapley"))
    steps = [("".join(names[i] for i in order), at + 1, order[at], sum(1 << i for i in order[:at])) for order in permutations(range(k)) for at in range(k)]
    # k! * k rows, 600 for five filters: bounded by the number of filters.
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int"))
    return sizes.join(orders, ["filter", "before"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"))


def document_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                   good_col: str = "quality", toxic_col: str = "toxic", range_bits: int = RANGE_BITS) -> DataFrame:
    """`audit` of the filters A to E over whole documents, one row per part, order and step.

    Null text is empty, a null part the empty string; repeated rows each count. An id with several labels is good
    or toxic if one of them says 1; null labels and ids without a label count as neither. Extra columns are
    ignored; an empty table gives no row.
    """
    marks = (labels.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{good_col}`") == 1).alias("good"), (F.col(f"`{toxic_col}`") == 1).alias("toxic"))
             .groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).where("good or toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return audit(rows.select("row", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), FILTERS, range_bits)
