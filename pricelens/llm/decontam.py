"""Benchmark decontamination by a prefix-filtered containment join.

A window is `WINDOW` consecutive item words (a shorter item is one window). A window is contained in a
document only if each of its shingles is, so for full containment the necessary prefix of its shingles, sorted by
rarity in the corpus, has length one: its rarest shingle. The join therefore probes documents for one shingle
per window. Position and length bounds then fix the only place where the window can lie (occurrence minus
the shingle's offset in the window, inside the document), and the words there are compared one by one.

A benchmark of at most `BLOCK_WORDS` words, counted first, is written to the shared folder as one block and each task
probes its index in memory. A larger one is never loaded: its windows become a table keyed by prefix shingle, the
documents' shingles that pass a bit filter of bounded size meet it in an equi-join, and the candidates are verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

WINDOW = 13
SHINGLE = 3
#: Most benchmark words that a task holds (about 200 bytes a word); beyond it the windows are joined as a table.
BLOCK_WORDS = 200_000
#: Bits of the join's shingle filter, at most (64 MB) and in one segment. A fuller filter lets more shingles through to the join.
FILTER_BITS, SEGMENT_BITS = 1 << 29, 1 << 20

#: A-Z to lower case; every byte but digits, letters and 0x80-0xFF to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def contaminated(n_hit: Column, n_words: Column, percent: int = 5) -> Column:
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


class Block:
    """Windows of some items over a vocabulary of their own; 0 stands for any other word."""

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[at:at + window]), set()).add(item)
        self.window = window
        self.base = len(self.vocab) + 1
        if self.base ** shingle >= 1 << 62:
            raise ValueError("block too large for its shingle codes")
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for row, w in enumerate(windows):
            self.words[row, :len(w)] = w
        self.items = [sorted(v) for v in windows.values()]
        #: Shingle size of each window: the given one, or the whole of a window that is shorter.
        self.sizes = np.minimum(self.lengths, shingle)
        self._all = None

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Code of the shingle that begins at each position; 0 where a word is not of this block."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = ids[k:k + n]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code * 4 + size, 0)

    def shingles(self) -> np.ndarray:
        """(windows, offsets) codes of the shingles of each window, 0 where there is none."""
        out = np.zeros((len(self.lengths), self.window), np.int64)
        for row, (n, size) in enumerate(zip(self.lengths, self.sizes)):
            got = self.codes(self.words[row, :n], int(size))
            out[row, :len(got)] = got
        return out

    def all_codes(self) -> np.ndarray:
        """Sorted codes of all shingles of all windows."""
        if self._all is None:
            grid = np.unique(self.shingles())
            self._all = grid[grid > 0]
        return self._all

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words], np.int64)


class Index:
    """A block with the prefix shingle of every window, ready to probe documents."""

    def __init__(self, block: Block, counts: dict[int, int]):
        self.block = block
        self.by_size = {}
        grid = block.shingles()
        for size in np.unique(block.sizes):
            rows = np.nonzero(block.sizes == size)[0]
            chosen = []
            for row in rows:
                # Rarest first; of equally rare shingles the smaller code, then the earlier place.
                chosen.append(min((counts.get(int(c), 0), int(c), at) for at, c in enumerate(grid[row]) if c)[1:])
            code = np.array([c for c, _ in chosen], np.int64)
            order = np.argsort(code, kind="stable")
            self.by_size[int(size)] = (code[order], np.array([at for _, at in chosen], np.int64)[order], rows[order])

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window rows, places) of all occurrences of windows in a document."""
        found = []
        for size, (codes, offsets, rows) in self.by_size.items():
            doc = self.block.codes(ids, size)
            place = np.nonzero(doc)[0]
            if not len(place):
                continue
            low = np.searchsorted(codes, doc[place], side="left")
            many = np.searchsorted(codes, doc[place], side="right") - low
            place, low, many = place[many > 0], low[many > 0], many[many > 0]
            if not len(place):
                continue
            which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start = np.repeat(place, many) - offsets[which]
            row = rows[which]
            length = self.block.lengths[row]
            fits = (start >= 0) & (start + length <= len(ids))
            start, row, length = start[fits], row[fits], length[fits]
            for lo in range(0, len(start), 1 << 16):
                s, r, n = start[lo:lo + (1 << 16)], row[lo:lo + (1 << 16)], length[lo:lo + (1 << 16)]
                span = np.arange(self.block.window)[None, :]
                inside = span < n[:, None]
                at = np.where(inside, s[:, None] + span, 0)
                same = ((ids[at] == self.block.words[r]) | ~inside).all(axis=1)
                found.append((r[same], s[same]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def _fits(items: DataFrame, block_words: int) -> bool:
    """Whether the items have at most `block_words` words."""

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words_of(t or b"")) for t in batch.column(0).to_pylist())], pa.int64())], ["n"])

    return (items.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) <= block_words


_LOADED: dict[tuple, object] = {}


def _load(folder: str, block: int, window: int, shingle: int, counts_folder: str | None):
    """Block or index `block`; the last one used stays in the worker."""
    import pyarrow.parquet as pq
    key = (folder, block, counts_folder)
    if key not in _LOADED:
        store, base = common.filesystem(folder)
        rows = pq.read_table(f"{base}/block={block}", filesystem=store, partitioning=None).to_pylist()
        made = Block(sorted(((r["item"], r["text"] or b"") for r in rows), key=lambda x: (str(x[0]), x[1])), window, shingle)
        if counts_folder:
            store, base = common.filesystem(counts_folder)
            from pyarrow import fs
            here = store.get_file_info(fs.FileSelector(base)) if store.get_file_info(base).type != fs.FileType.NotFound else []
            mine = any(i.base_name == f"block={block}" for i in here)
            got = pq.read_table(f"{base}/block={block}", filesystem=store, partitioning=None) if mine else None
            made = Index(made, dict(zip(got["code"].to_pylist(), got["n"].to_pylist())) if got else {})
        _LOADED.clear()
        _LOADED[key] = made
    return _LOADED[key]


def _prepare(docs: DataFrame, items: DataFrame, text_col: str, window: int, shingle: int):
    """Write the block and the corpus counts of its shingles; (blocks, folder, counts folder)."""
    spark = docs.sparkSession
    folder, counts_folder = common.run_dir(spark, "bench-blocks"), common.run_dir(spark, "bench-counts")
    items.withColumn("block", F.lit(0).cast("long")).repartition(1).write.partitionBy("block").parquet(folder)
    blocks = [0] if items.take(1) else []

    def run(batches):
        import pyarrow as pa
        total: dict[int, dict[int, int]] = {b: {} for b in blocks}
        for batch in batches:
            texts = [words_of(t) for t in common.text_bytes(batch.column(0))]
            for b in blocks:
                block = _load(folder, b, window, shingle, None)
                mine = block.all_codes()
                found = [c for t in texts for size in np.unique(block.sizes) for c in [block.codes(block.ids(t), int(size))]]
                found = np.concatenate([c[c > 0] for c in found] or [np.zeros(0, np.int64)])
                at = np.minimum(np.searchsorted(mine, found), max(0, len(mine) - 1))
                codes, n = np.unique(found[mine[at] == found] if len(mine) else found[:0], return_counts=True)
                sums = total[b]
                for c, k in zip(codes.tolist(), n.tolist()):
                    sums[c] = sums.get(c, 0) + k
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(sums), pa.int64()), pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], ["block", "code", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "block long, code long, n long")
    counted.groupBy("block", "code").agg(F.sum("n").alias("n")).repartition("block").write.partitionBy("block").parquet(counts_folder)
    return blocks, folder, counts_folder


def _judge(blocks, folder, counts_folder, window, shingle, texts: list[bytes]):
    """(n_words, n_hit, item ids) of each text."""
    words = [words_of(t) for t in texts]
    cover = [np.zeros(len(w) + 1, np.int32) for w in words]
    items: list[set] = [set() for _ in words]
    for b in blocks:
        index = _load(folder, b, window, shingle, counts_folder)
        for i, w in enumerate(words):
            rows, starts = index.hits(index.block.ids(w))
            if len(rows):
                np.add.at(cover[i], starts, 1)
                np.add.at(cover[i], starts + index.block.lengths[rows], -1)
                for r in np.unique(rows):
                    items[i].update(index.block.items[r])
    return [(len(w), int((np.cumsum(c[:-1]) > 0).sum()), x) for w, c, x in zip(words, cover, items)]


class _WordCodes(dict):
    """64-bit code of a word; short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        code = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 32:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = code
        return code


def _gram_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit code of the shingle that begins at each place. Two shingles with one code cost a comparison, nothing else."""
    n = max(0, len(codes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _word_codes(words: list[bytes], memo: _WordCodes) -> np.ndarray:
    return np.fromiter((memo[w] for w in words), np.uint64, len(words))


def _filter(codes: DataFrame, name: str) -> tuple[str, int]:
    """Bit filter of a column `code`, written to the shared folder segment by segment; (folder, bits)."""
    n = codes.agg(F.approx_count_distinct("code")).first()[0]
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    segment = min(bits, SEGMENT_BITS)
    slot = F.col("code").bitwiseAND(F.lit(bits - 1))
    slots = codes.select((slot / segment).cast("long").alias("segment"), (slot % segment).cast("int").alias("slot"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for slots in batch.column(1):
                marks = np.zeros(segment, bool)
                marks[slots.values.to_numpy()] = True
                rows.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["segment", "bits"])

    folder = common.run_dir(codes.sparkSession, name)
    slots.groupBy("segment").agg(F.collect_set("slot").alias("slots")).mapInArrow(run, "segment long, bits binary").write.parquet(folder)
    return folder, bits


def _passing(folder: str, bits: int, codes: np.ndarray) -> np.ndarray:
    """Places of the codes that the filter lets through; the last filter used stays in the worker."""
    if (folder, bits) not in _LOADED:
        import pyarrow.parquet as pq
        store, base = common.filesystem(folder)
        marks, size = np.zeros(bits // 8, np.uint8), min(bits, SEGMENT_BITS) // 8
        for row in pq.read_table(base, filesystem=store, partitioning=None).to_pylist():
            marks[row["segment"] * size:(row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
        _LOADED.clear()
        _LOADED[folder, bits] = marks
    slot = codes & np.uint64(bits - 1)
    return np.flatnonzero(_LOADED[folder, bits][(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


#: Rows of one Arrow batch that the join's steps hand back.
_ROWS = 4096


def _batches(rows, schema):
    """Tuples as Arrow batches of at most _ROWS rows."""
    import itertools

    import pyarrow as pa
    rows = iter(rows)
    while part := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], names=schema.names)


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, shingle: int) -> DataFrame:
    """digest, n_words, n_hit, items (sorted as strings) of each text in which a window occurs; copies share a row.

    Windows, shingles and candidates stay tables. A window's prefix shingle is the rarest of its shingles in the corpus; one
    that never occurs there drops the window. A frequent shingle on the documents' side of the join is split by AQE; it is
    a prefix only of windows all of whose shingles are at least as frequent."""
    spark = docs.sparkSession
    item_type = items.schema["item"].dataType

    def windows(batches):
        import pyarrow as pa
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or b"")
                yield from _batches(((item, b" ".join(words[at:at + window])) for at in range(max(1, len(words) - window + 1) if words else 0)),
                                    pa.schema([("item", batch.schema.field(0).type), ("win", pa.binary())]))

    key = F.unhex(F.sha2("win", 256)).alias("key")
    owned = items.mapInArrow(windows, T.StructType([T.StructField("item", item_type), T.StructField("win", T.BinaryType())]))
    owned = common.staged(owned.select("item", "win", key).distinct(), "bench-windows")

    def shingles(batches):
        import pyarrow as pa
        memo, schema = _WordCodes(), pa.schema([("key", pa.binary()), ("size", pa.int32()), ("at", pa.int32()), ("code", pa.int64())])

        def rows(batch):
            for k, win in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = win.split(b" ")
                size = min(len(words), shingle)
                for at, code in enumerate(_gram_codes(_word_codes(words, memo), size).view(np.int64).tolist()):
                    yield k, size, at, code

        for batch in batches:
            yield from _batches(rows(batch), schema)

    grams = owned.select("key", "win").distinct().mapInArrow(shingles, "key binary, size int, at int, code long")
    grams = common.staged(grams, "bench-shingles")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most `shingle` numbers
    every = _filter(grams.select("code"), "bench-filter")

    def count(batches):
        import pyarrow as pa
        memo = _WordCodes()
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for text in common.text_bytes(batch.column(0)):
                words = _word_codes(words_of(text), memo)
                for size in sizes:
                    codes = _gram_codes(words, size)
                    found.append(codes[_passing(*every, codes)].view(np.int64))
            codes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    text = F.col(f"`{text_col}`")
    counts = docs.select(text.alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rarest = grams.join(counts, "code", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "at")).alias("p"))
    prefix = rarest.where("p.n > 0").select("key", "p.code", F.col("p.at").alias("offset")).join(owned.select("key", "win").distinct(), "key")
    prefix = common.staged(prefix, "bench-prefix")
    chosen = _filter(prefix.select("code"), "bench-prefix-filter")

    def probe(batches):
        import pyarrow as pa
        memo = _WordCodes()
        schema = pa.schema([("digest", pa.string()), ("n_words", pa.int64()), ("code", pa.int64()), ("place", pa.int64()), ("lead", pa.int32()), ("near", pa.binary())])

        def rows(digest, text):
            words = words_of(text)
            known = _word_codes(words, memo)
            for size in sizes:
                codes = _gram_codes(known, size)
                for place in _passing(*chosen, codes).tolist():
                    low = max(0, place - window + size)
                    yield digest, len(words), int(codes[place].view(np.int64)), place, place - low, b" ".join(words[low:place + window])

        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1))):
                yield from _batches(rows(digest, text), schema)

    found = docs.select(_digest(text).alias("digest"), text.alias("text")).mapInArrow(
        probe, "digest string, n_words long, code long, place long, lead int, near binary").dropDuplicates(["digest", "code", "place"])

    def verify(batches):
        import pyarrow as pa
        schema = pa.schema([("digest", pa.string()), ("n_words", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])

        def rows(batch):
            for digest, n, place, lead, near, k, offset, win in zip(*(c.to_pylist() for c in batch.columns)):
                win, at = win.split(b" "), lead - offset
                if at >= 0 and near.split(b" ")[at:at + len(win)] == win:
                    yield digest, n, k, place - offset, place - offset + len(win)

        for batch in batches:
            yield from _batches(rows(batch), schema)

    hits = found.join(prefix, "code").select("digest", "n_words", "place", "lead", "near", "key", "offset", "win")
    hits = common.staged(hits.mapInArrow(verify, "digest string, n_words long, key binary, start long, stop long"), "bench-hits")
    before = F.max("stop").over(Window.partitionBy("digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy("digest", "n_words", "start").agg(F.max("stop").alias("stop")).withColumn("before", F.coalesce(before, F.lit(0)))
    cover = spans.groupBy("digest", "n_words").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    names = hits.select("digest", "key").distinct().join(owned.select("key", "item"), "key").select("digest", "item").distinct()
    names = names.groupBy("digest").agg(F.sort_array(F.collect_list(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items"))
    return cover.join(names, "digest")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256)


def _count_words(batches):
    import pyarrow as pa
    for batch in batches:
        n = [len(words_of(t)) for t in common.text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "digest", "n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    A document is contaminated if some word lies in an occurrence of a window and such words make up `percent`
    of its words or more. Null or wordless texts have no words, so they are clean; a null item has no window;
    a null item id counts as one item without a name (the empty string). Repeated documents each get a row,
    repeated items count once per id. Extra columns are ignored; an empty benchmark leaves all clean.
    """
    common.arrow_batches(docs.sparkSession)
    bench = _items(benchmark, item_col, item_text)
    if not _fits(bench, block_words):
        found = _joined(docs, bench, text_col, window, shingle).drop("n_words")
        slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _digest(F.col(f"`{text_col}`")).alias("digest"), F.col(f"`{text_col}`").alias("text"))
        counted = slim.mapInArrow(_count_words, T.StructType([slim.schema["doc_id"], T.StructField("digest", T.StringType()), T.StructField("n_words", T.LongType())]))
        names, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
        return counted.join(found, "digest", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"),
                                                            contaminated(n_hit, F.col("n_words"), percent).alias("contaminated"))
    plan = _prepare(docs, bench, text_col, window, shingle)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([slim.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = _judge(*plan, window, shingle, list(common.text_bytes(batch.column(1))))
            names = [sorted("" if x is None else str(x) for x in s) for _, _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in ([n for n, _, _ in got], [h for _, h, _ in got], [len(s) for s in names])), pa.array(names, pa.list_(pa.string()))],
                                             [f.name for f in out])

    return slim.mapInArrow(run, out).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words"), percent))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` that `decontaminate` finds clean, with all their columns; nulls, ties, repeats and empty tables as there."""
    common.arrow_batches(docs.sparkSession)
    bench = _items(benchmark, item_col, item_text)
    if not _fits(bench, block_words):
        bad = _joined(docs, bench, text_col, window, shingle).where(contaminated(F.col("n_hit"), F.col("n_words"), percent)).select("digest")
        judged = docs.select(common.row_struct(docs).alias("row"), _digest(F.col(f"`{text_col}`")).alias("digest"))
        return judged.join(bad, "digest", "left_anti").select("row.*")
    plan = _prepare(docs, bench, text_col, window, shingle)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            col = batch.column(0)
            got = _judge(*plan, window, shingle, list(common.text_bytes(col.field(text_col))))
            clean = pa.array([not (h > 0 and 100 * h >= percent * n) for n, h, _ in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([col.filter(clean)], ["row"])

    row = docs.select(common.row_struct(docs).alias("row"))
    return row.mapInArrow(run, row.schema).select("row.*")


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
