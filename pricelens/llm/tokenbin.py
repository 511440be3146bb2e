"""Token ids in directly addressable codes (DAC): any token by its number, without decoding a block.

An id is split into chunks of 8 bits, low chunk first. Level k holds chunk k of the ids that have one, and a
bitmap says which of them go on to level k + 1. A rank directory (ones before every 512th bit) turns the
position in level k into the position in level k + 1, so one token costs one chunk and one rank per level.

File layout, little-endian: magic, levels (u32), documents (u64), tokens (u64), then (offset, length) of each
section as u64 pairs, then the sections: document ids (i64), null flags of the ids (u8), document starts
(u64, one more than documents), and per level chunks (u8), bitmap, rank directory (u64).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm import common
from pricelens.llm.bpe import LONGEST, MEMO_BYTES, WordSplitter, byte_symbols

MAGIC = b"DAC8"
BLOCK = 512
#: Tokens after which a task starts a new file; a document is never split.
FILE_TOKENS = 8 << 20
#: Id appended to each document.
END_ID = 1


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, packed bitmap, rank directory) per level of an unsigned id array."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(more)])[::BLOCK].astype("<u8")
        out.append(((rest & np.uint64(0xFF)).astype(np.uint8), bits, ones))
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return out


def pack(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """One file of documents (id or null, tokens each) and their ids in order."""
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype("<u8")
    sections = [np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), starts.tobytes()]
    levels = levels_of(ids)
    for chunks, bits, ones in levels:
        sections += [chunks.tobytes(), bits.tobytes(), ones.tobytes()]
    head = struct.pack("<4sIQQ", MAGIC, len(levels), len(doc_ids), len(ids))
    at, table = len(head) + 16 * len(sections), b""
    for s in sections:
        table += struct.pack("<QQ", at, len(s))
        at += len(s)
    return b"".join([head, table, *sections])


class DacFile:
    """Random access to one file. `source` is a seekable file; only the directories are read on opening."""

    def __init__(self, source):
        self.source = source
        magic, n, self.docs, self.tokens = struct.unpack("<4sIQQ", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a DAC file")
        table = struct.unpack(f"<{2 * (3 + 3 * n)}Q", source.read(16 * (3 + 3 * n)))
        self.sections = list(zip(table[::2], table[1::2]))
        self.levels = n
        nulls = self._section(1)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(self._section(0), "<i8"), nulls)]
        self.starts = np.frombuffer(self._section(2), "<u8").astype(np.int64)
        self.ones = [np.frombuffer(self._section(5 + 3 * k), "<u8").astype(np.int64) for k in range(n)]

    def _section(self, k: int, start: int = 0, length: int | None = None) -> bytes:
        at, size = self.sections[k]
        self.source.seek(at + start)
        return self.source.read(size - start if length is None else length)

    def _bits(self, level: int, start: int, stop: int) -> np.ndarray:
        raw = np.frombuffer(self._section(4 + 3 * level, start // 8, (stop + 7) // 8 - start // 8), np.uint8)
        return np.unpackbits(raw, bitorder="little")[start % 8:start % 8 + stop - start]

    def _rank(self, level: int, i: int) -> int:
        block = i // BLOCK
        return int(self.ones[level][block]) + int(self._bits(level, block * BLOCK, i).sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of tokens start..stop-1 of the file: per level one read of chunks and one rank."""
        ids = np.zeros(stop - start, np.uint32)
        where, at = np.arange(stop - start), start
        for k in range(self.levels):
            if not len(where):
                break
            chunks = np.frombuffer(self._section(3 + 3 * k, at, len(where)), np.uint8)
            ids[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            more = self._bits(k, at, at + len(where)).astype(bool)
            at = self._rank(k, at) if k + 1 < self.levels else 0
            where = where[more]
        return ids

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, d: int) -> np.ndarray:
        return self.slice(int(self.starts[d]), int(self.starts[d + 1]))


class _Encoder:
    """Ids of whole texts, asked of the tokenizers library's model once per distinct word; the memo's generations are
    bounded by bytes."""

    def __init__(self, path: str):
        self.splitter = WordSplitter(path)
        self.model, self.symbols = self.splitter.library.model, byte_symbols()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in self.splitter.special.items()}
        self.known, self.older, self.held = dict(self.special), {}, 0

    def _ids(self, word: str) -> bytes:
        """Ids of one word, which is normalised already: it goes to the model alone."""
        mapped = word if word.isascii() and word.isalnum() else "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def raw(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out = []
        for block in self.splitter.blocks(text):
            words = self.splitter.words(block)
            if self.held >= MEMO_BYTES:
                self.older, self.known, self.held = self.known, dict(self.special), 0
            known = self.known
            long = {}
            for w in set(words).difference(known):
                if (raw := self.older.get(w)) is None:
                    raw = self._ids(w)
                if len(w) > LONGEST:
                    long[w] = raw
                else:
                    known[w] = raw
                    self.held += len(w) + len(raw) + 200
            out.append(b"".join([long[w] if w in long else known[w] for w in words]) if long else b"".join(map(known.__getitem__, words)))
        return b"".join(out)


def _writer(path: str, folder: str, end_id: int, file_tokens: int):
    def run(batches):
        import pyarrow as pa
        part, name = common.attempt()
        store, base = common.filesystem(folder)
        store.create_dir(base, recursive=True)
        enc = common.kept(("encoder", path), lambda: _Encoder(path))
        end = np.array([end_id], "<u4").tobytes()
        docs, counts, parts, held, seq, done = [], [], [], 0, 0, 0

        def close():
            data = pack(docs, counts, np.frombuffer(b"".join(parts), "<u4"))
            final, temporary = f"{base}/ids-{part:06d}-{seq:05d}.dac", f"{base}/.{name}-{seq:05d}"
            with store.open_output_stream(temporary, compression=None) as f:
                f.write(data)
            common.publish(store, temporary, final)
            cols = {"part": [part], "seq": [seq], "file": [f"ids-{part:06d}-{seq:05d}.dac"], "n_docs": [len(docs)], "n_tokens": [held], "before": [done]}
            return pa.RecordBatch.from_pydict(cols, schema=schema)

        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = enc.raw(text or "") + end
                docs.append(d)
                counts.append(len(raw) // 4)
                parts.append(raw)
                held += counts[-1]
                if held >= file_tokens:
                    yield close()
                    done, seq = done + held, seq + 1
                    docs, counts, parts, held = [], [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode whole texts and write them in ascending id order as DAC files; returns the manifest.

    One row per file: part, seq, file, n_docs, n_tokens, start (tokens of all files before it). Null texts
    are empty documents (the end id alone). Null ids come first; rows that share an id follow by text. An
    empty table writes no file. Retried tasks rewrite the same files under the same names.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    path = path or common.tokenizer_path()
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = common.staged(dealt.mapInArrow(_writer(path, folder, end_id, file_tokens), "part long, seq long, file string, n_docs long, n_tokens long, before long"), "token-manifest")
    # One row per writing task: the running total needs a single small partition.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    offset = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", offset.alias("offset"))
    return manifest.join(parts, "part").select("part", "seq", "file", "n_docs", "n_tokens", (F.col("before") + F.col("offset")).alias("start"))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        import pyarrow as pa
        store, base = common.filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    dac = DacFile(pa.BufferReader(f.read()))
                n = np.diff(dac.starts)
                crc = [zlib.crc32(dac.document(d).astype("<u4").tobytes()) for d in range(dac.docs)]
                yield pa.RecordBatch.from_arrays([pa.array(dac.doc_ids, pa.int64()), pa.array(dac.starts[:-1] + row["start"]), pa.array(n), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files to a new folder of the shared store and read every document back from them."""
    folder = common.run_dir(docs.sparkSession, "token-files")
    manifest = common.staged(write_tokens(docs, folder, path, id_col, text_col, end_id, file_tokens), "token-index")
    return read_documents(manifest, folder)
