"""WARC archives as a chunked record table.

Payloads travel as rows (record, chunk number, bytes) from the start: Spark cuts them, a writer task streams the
chunks of a record into the archive, and a reader streams archives back into chunk rows that carry the running
length and SHA-1. Neither side holds a whole record, however large its payload.

Records are gzip members of their own, so a reader can start at any record. A revisit record stores no payload;
its HTTP head keeps the payload's length, its WARC head the digest and the record it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm import common

CHUNK_BYTES = 64 << 10
FILE_BYTES = 256 << 20
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def _safe(url: str) -> str:
    """A URL fit for a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_head(page_id, url: str | None, size: int, digest: bytes, refers_to, date: str = DATE) -> bytes:
    """WARC head and HTTP head of a record; `refers_to` makes it a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
              f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _chunks(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, chunk_bytes: int) -> DataFrame:
    """Chunk rows of all records, each record's in order inside one partition."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    full = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    full = full.withColumn("size", F.octet_length("payload").cast("long")).withColumn("same", F.sha2("payload", 256)).withColumn("uid", F.monotonically_increasing_id())
    thin = full.select("page_id", "same").where(F.col("size") >= min_bytes)
    keep = thin.groupBy("same").agg(F.max("page_id").alias("refers_to"))
    revisits = thin.join(keep, "same").where("page_id < refers_to").distinct()
    # A record that is stored joins nothing; the hot payload's rows are spread over their page ids.
    marked = full.join(revisits, ["page_id", "same"], "left")
    stored = F.col("refers_to").isNull()
    pieces = F.when(stored, F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1))).otherwise(F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(
        i.alias("chunk"), F.when(stored, F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes))).alias("data")))
    rows = marked.select("page_id", "uid", "url", "size", F.unhex(F.sha1("payload")).alias("digest"), "refers_to", pieces.alias("chunks"), F.explode(cut).alias("c"))
    rows = rows.select("page_id", "uid", "url", "size", "digest", "refers_to", "chunks", "c.chunk", "c.data")
    return rows.sortWithinPartitions("page_id", "uid", "chunk")


def _writer(folder: str, date: str, file_bytes: int, level: int):
    def run(batches):
        import pyarrow as pa
        part, name = common.attempt()
        store, base = common.filesystem(folder)
        store.create_dir(base, recursive=True)
        seq, sink, written, records = 0, None, 0, 0
        member = sha = None
        schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

        def done():
            sink.close()
            final = f"records-{part:06d}-{seq:05d}.warc.gz"
            common.publish(store, f"{base}/.{name}-{seq:05d}", f"{base}/{final}")
            return pa.RecordBatch.from_pydict({"file": [final], "records": [records], "bytes": [written]}, schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    if sink is None:
                        sink = store.open_output_stream(f"{base}/.{name}-{seq:05d}", compression=None)
                    member, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out = member.compress(record_head(r["page_id"], r["url"], r["size"], r["digest"], r["refers_to"], date))
                else:
                    out = b""
                if r["data"]:
                    sha.update(r["data"])
                    out += member.compress(r["data"])
                if r["chunk"] == r["chunks"] - 1:
                    if r["refers_to"] is None and sha.digest() != r["digest"]:
                        raise ValueError(f"chunks of page {r['page_id']} do not add up to its payload")
                    out += member.compress(b"\r\n\r\n") + member.flush()
                    records += 1
                sink.write(out)
                written += len(out)
                if r["chunk"] == r["chunks"] - 1 and written >= file_bytes:
                    yield done()
                    seq, sink, written, records = seq + 1, None, 0, 0
        if sink is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = REVISIT_BYTES,
                   date: str = DATE, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, level: int = 1) -> DataFrame:
    """Write one record per row to gzipped archives in `folder`; returns the manifest (file, records, bytes).

    Of records with equal payloads of at least `min_bytes` bytes the one of largest id is the response and
    the others revisit it; rows that share that id are all responses. Null html is an empty payload. A null id
    never revisits. A null url leaves the target out. Extra columns are ignored; an empty table
    writes no file. Retried tasks write under a name of their own and rename at the end.
    """
    common.arrow_batches(pages.sparkSession)
    rows = _chunks(pages, id_col, url_col, html_col, min_bytes, chunk_bytes)
    return common.staged(rows.mapInArrow(_writer(folder, date, file_bytes, level), "file string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Bytes of an archive, gzip member by gzip member, in bounded pieces."""

    def __init__(self, source, size: int):
        self.source, self.size, self.buffer, self.rest = source, size, b"", b""
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.source.read(self.size)
            if not raw:
                return False
            out = self.member.decompress(raw, self.size)
            self.rest = self.member.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def line_block(self) -> list[str] | None:
        """Head lines up to the blank line, or None at the end."""
        while b"\r\n\r\n" not in self.buffer:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a head")
                return None
        head, self.buffer = self.buffer.split(b"\r\n\r\n", 1)
        return head.decode("utf-8", "replace").split("\r\n")

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(urn: str | None):
    value = (urn or "").strip("<>").removeprefix(_ID)
    return int(value) if value else None


def read_records(source, chunk_bytes: int = CHUNK_BYTES):
    """Chunk rows of one open archive: (page_id, record_type, refers_to, url, declared length, declared
    digest, chunk, data, whether last, bytes so far, SHA-1 so far)."""
    stream = _Stream(source, chunk_bytes)
    while (head := stream.line_block()) is not None:
        warc = _fields(head)
        left = int(warc["content-length"])
        http_head = stream.line_block()
        left -= len("\r\n".join(http_head).encode()) + 4
        size = int(_fields(http_head)["content-length"])
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        same = (_number(warc["warc-record-id"]), warc["warc-type"], _number(warc.get("warc-refers-to")), warc.get("warc-target-uri"), size, digest)
        sha, done, chunk = hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(left, chunk_bytes))
            left -= len(data)
            done += len(data)
            sha.update(data)
            yield (*same, chunk, data, left == 0, done, sha.copy().hexdigest())
            chunk += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


_ROWS = ("page_id long, record_type string, refers_to long, url string, declared_bytes long, declared_digest string, "
         "chunk long, data binary, last boolean, bytes_so_far long, sha1_so_far string")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in the manifest; `data=False` leaves the bytes out."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches):
        import pyarrow as pa
        store, base = common.filesystem(folder)
        types = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.string())))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for k, c in zip(names, zip(*rows))], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{file}", compression=None) as f:
                    rows = []
                    for r in read_records(f, chunk_bytes):
                        rows.append(r if data else (*r[:7], None, *r[8:]))
                        if len(rows) >= (64 if data else 4096):
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, _ROWS)


def archive_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """Write the archives to a new shared folder, read them back, one row per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Length and digest of a response are those of the bytes read;
    a revisit has those its record declares."""
    folder = common.run_dir(pages.sparkSession, "archives")
    rows = read_archives(write_archives(pages, folder, id_col, url_col, html_col, **how), folder, data=False).where("last")
    stored = F.col("record_type") == "response"
    return rows.select("page_id", F.when(stored, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
                       F.when(stored, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")
