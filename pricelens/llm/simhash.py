"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Two 64-bit fingerprints link at `MAX_BITS` = 3 or fewer differing bits. Pigeonhole, twice: of the four 16-bit
segments at least one has no error, and of the two 24-bit halves of the other 48 bits at least one has at
most one error. The extended Golay code [24,12,8] turns "at most one error" into equality: a 24-bit word lies
within distance 3 of one codeword or at distance 4 of six. Words one bit apart have distances of different
parity, so one of them is at an odd distance (1 or 3) from a codeword that lies within 4 of the other; keying
a word by the indices of all codewords within distance 4 (one key or six, 3.2 on average) therefore gives two
such words a common key. A join key is (which segment, its 16 bits, which half, the 12-bit codeword index);
candidates that share a key are verified by their full 64-bit distance.

Equal fingerprints collapse before the join, so copies cost nothing there. Keys held by many different
fingerprints are split by further exact segments under other bit orders, which again lose no pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common
from pricelens.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: A key shared by more fingerprints than this is split again before pairs are looked at.
BUCKET = 2048
#: Rounds of splitting; what is still larger is compared in blocks inside its task.
SPLITS = 3
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code (fixed value).
GOLAY = 0b110001110101


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Majority vote of the XXH64 bits of all k-word shingles of an A-Z lower-cased text; no word: zero."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < k:
        hashes = [digest(b" ".join(words), seed)]
        return int.from_bytes(hashes[0], "big")
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    starts = starts.tolist()
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        raw = b"".join([digest(joined[a:b - 1], seed) for a, b in zip(starts[at:stop], starts[at + k:stop + k])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(id_col: str, text_col: str, k: int, seed: int, keep: bool):
    def run(batches):
        import pyarrow as pa
        part, _ = common.attempt()
        seq = part << 40
        for batch in batches:
            col = batch.column(0)
            texts = common.text_bytes(col.field(text_col))
            fps = np.array([fingerprint(t, k, seed) for t in texts], np.uint64).view(np.int64)
            uids = np.arange(seq, seq + len(fps))
            seq += len(fps)
            yield pa.RecordBatch.from_arrays([pa.array(uids), col.field(id_col), pa.array(fps)] + [col] * keep, ["uid", "id", "fp"] + ["row"] * keep)
    return run


def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 12-bit syndrome of the extended code: how many error patterns of least weight up to 4 it has
    (1 or 6) and those patterns; and the syndrome of each of the three bytes of a word."""
    code = np.zeros(4096, np.int64)
    for m in range(4096):
        word = m << 11
        for b in range(22, 10, -1):
            if word >> b & 1:
                word ^= GOLAY << (b - 11)
        word |= m << 11
        code[m] = word << 1 | (bin(word).count("1") & 1)
    # Systematic: the index is the top 12 bits, so a word's syndrome is its low half xor its index's low half.
    parity = code & 0xFFF
    count, patterns = np.zeros(4096, np.int64), np.zeros((4096, 6), np.int64)
    weight = np.full(4096, 99)
    single = [1 << b for b in range(24)]

    def syndrome(e):
        return int((e & 0xFFF) ^ parity[e >> 12])

    def grow(start, value, left, w):
        s = syndrome(value)
        if w < weight[s]:
            weight[s], count[s] = w, 0
        if w == weight[s]:
            patterns[s, count[s]] = value
            count[s] += 1
        if left:
            for b in range(start, 24):
                grow(b + 1, value | single[b], left - 1, w + 1)

    grow(0, 0, 4, 0)
    return count, patterns, parity


_TABLES: list = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, 12-bit codeword indices) of all codewords within distance 4 of 24-bit words."""
    if not _TABLES:
        _TABLES.append(_cosets())
    count, patterns, parity = _TABLES[0]
    words = words.astype(np.int64)
    s = (words & 0xFFF) ^ parity[words >> 12]
    n = count[s]
    rows = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] ^ patterns[s[rows], nth]) >> 12


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, join keys) of unsigned 64-bit fingerprints; equal keys of one row appear once."""
    rows, keys = [], []
    for seg in range(4):
        low = np.uint64(16 * seg)
        exact = (fps >> low) & np.uint64(0xFFFF)
        below = fps & np.uint64((1 << (16 * seg)) - 1)
        rest = ((fps >> low >> np.uint64(16)) << low) | below
        for half in range(2):
            at, index = golay_keys((rest >> np.uint64(24 * half)) & np.uint64(0xFFFFFF))
            rows.append(at)
            keys.append(((seg * 2 + half) << 28) + (exact[at].astype(np.int64) << 12) + index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    import pyarrow as pa
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        rows, keys = fingerprint_keys(fps)
        for at in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)]), pa.array(fps[rows[at:at + (1 << 16)]].view(np.int64))], ["key", "fp"])


def _links_of_run(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links inside one bucket: verified pairs, reduced to one edge per fingerprint."""
    label = np.arange(len(fps))
    step = max(1, (1 << 21) // len(fps))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at:at + step, None] ^ fps[None, :]) <= max_bits
        i, j = np.nonzero(near)
        i += at
        i, j = i[i < j], j[i < j]
        while True:
            low = np.minimum(label[i], label[j])
            if np.array_equal(label[i], low) and np.array_equal(label[j], low):
                break
            for end in (label[i], label[j], i, j):
                np.minimum.at(label, end, low)
            while not np.array_equal(label[label], label):
                label = label[label]
    own = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[own], fps[label[own]]


def _link(max_bits: int):
    """mapInArrow body over rows sorted by (key, fp): verified links of every bucket."""

    def pairs(keys, fps):
        out = []
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        sizes = np.diff(starts)
        small = np.repeat(sizes <= 16, sizes)
        d = 1
        while d < min(17, len(keys)):
            hit = np.nonzero((keys[d:] == keys[:-d]) & small[d:])[0]
            if not len(hit):
                break
            hit = hit[np.bitwise_count(fps[hit] ^ fps[hit + d]) <= max_bits]
            out.append((fps[hit], fps[hit + d]))
            d += 1
        for run in np.nonzero(sizes > 16)[0]:
            out.append(_links_of_run(np.unique(fps[starts[run]:starts[run + 1]]), max_bits))
        return out

    def run(batches):
        import pyarrow as pa

        def emit(found):
            a = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
            b = np.concatenate([y for _, y in found] or [np.zeros(0, np.uint64)])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(both[:, 1]).view(np.int64))], ["a", "b"])

        keys, fps = [], []
        held = 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            held += len(keys[-1])
            if held >= 1 << 17:
                k, f = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield emit(pairs(k[:cut], f[:cut]))
                keys, fps, held = [k[cut:]], [f[cut:]], 0
        if keys:
            yield emit(pairs(np.concatenate(keys), np.concatenate(fps)))

    return run


def _split(round_no: int):
    """Four refined keys per row: the old key with one exact 16-bit segment under another order of the bits."""
    order = np.random.default_rng(round_no).permutation(64)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, order]
            seg = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u2").astype(np.uint64)
            for j in range(4):
                mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seg[:, j] * np.uint64(4) + np.uint64(j)) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array((mixed ^ (mixed >> np.uint64(32))).view(np.int64)), pa.array(fps)], ["key", "fp"])
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp) -> links (a, b) that connect everything `max_bits` or fewer bits connect. Exact for max_bits <= 3."""
    if max_bits > 3:
        raise ValueError("the pigeonhole over four segments and two halves holds up to 3 differing bits")
    kf = "key long, fp long"
    keys = distinct.select("fp").mapInArrow(_keys, kf)
    links = None
    for round_no in range(SPLITS + 1):
        hot = keys.groupBy("key").count().where(F.col("count") > bucket).select("key")
        hot = common.staged(hot, "hot-keys") if round_no < SPLITS else None
        some = hot is not None and not hot.isEmpty()
        cold = keys.join(hot, "key", "left_anti") if some else keys
        found = cold.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link(max_bits), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not some:
            return links
        keys = common.staged(keys.join(hot, "key", "left_semi").mapInArrow(_split(round_no), kf).distinct(), "split-keys")
    return links


def _clusters(marked: DataFrame, max_bits: int) -> DataFrame:
    """marked(uid, id, fp) -> one row per fingerprint: fp, first = its component's least (id, uid)."""
    per = common.staged(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")), "fingerprints")
    roots = common.staged(components(fingerprint_links(per, max_bits)), "components")
    linked = per.join(roots.withColumnRenamed("v", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    joined = linked.select("fp", "root").join(least, "root").select("fp", "least")
    # A table of its own, so that the join with the documents is one that Spark can split at a hot fingerprint.
    return common.staged(per.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")), "clusters")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and link like any other. component_id is the smallest
    non-null id reachable (null only if all ids of the component are null). Repeated rows each get a row;
    extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = slim.schema["id"].dataType
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", id_type), T.StructField("fp", T.LongType())])
    marked = common.staged(slim.select(common.row_struct(slim).alias("row")).mapInArrow(_fingerprints("id", "text", k, seed, False), out), "simhash")
    return (marked.join(_clusters(marked, max_bits), "fp")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, one of each component: the one of smallest id (of equal ids, the first read)."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("row", T.StructType(docs.schema.fields))])
    marked = common.staged(docs.select(common.row_struct(docs).alias("row")).mapInArrow(_fingerprints(id_col, text_col, k, seed, True), out), "simhash-rows")
    thin = marked.select("uid", "id", "fp")
    later = thin.join(_clusters(thin, max_bits), "fp").where("uid <> first.uid").select("uid")
    return marked.join(later, "uid", "left_anti").select("row.*")
