"""URL rules by a Bloom filter cascade: exact membership over the corpus's keys, without a join per URL.

A rule is (host, path, verdict); it fits its host and all subdomains when the URL's path starts with its path, and
the longest fitting rule wins. The keys a URL may match are its host suffixes joined with its path prefixes
(of the lengths that occur in rules). For each verdict a cascade holds the listed keys: level 1 is a Bloom filter
of the listed keys, level 2 one of the keys of the whole corpus that pass level 1 without being listed, level 3
one of the listed keys that pass level 2, and so on until no key passes wrongly. A key is listed exactly if
the number of levels it passes in a row is odd. Only the filters travel to the tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm import common

#: False positive rates of the first and of the later levels.
FIRST_RATE, LATER_RATE = 0.001, 0.3
#: Bytes all filters together may have; they are sent to every task.
MAX_BYTES = 64 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host lower-cased in A-Z; both empty for null or a string without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[:end] if slash < 0 else rest[:slash]
    path = "" if slash < 0 else rest[slash:end]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys the URL may match, longest first; of equal length, the longer host first. An empty host has none."""
    if not host:
        return []
    suffixes = [host]
    while (dot := suffixes[-1].find(".")) >= 0:
        suffixes.append(suffixes[-1][dot + 1:])
    keys = [(len(s) + n, len(s), s + path[:n]) for s in suffixes if s for n in lengths if n <= len(path)]
    return [k for *_, k in sorted(keys, reverse=True)]


class Bloom:
    """A Bloom filter as plain bits; `seed` makes the levels of a cascade independent."""

    def __init__(self, bits: np.ndarray, size: int, hashes: int, seed: int):
        self.bits, self.size, self.hashes, self.seed = bits, size, hashes, seed

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        return size, max(1, round(size / max(1, n) * math.log(2))) if n else 1

    @staticmethod
    def places(key: str, size: int, hashes: int, seed: int) -> list[int]:
        import xxhash
        raw = key.encode("utf-8", "surrogatepass")
        a, b = xxhash.xxh64_intdigest(raw, 2 * seed), xxhash.xxh64_intdigest(raw, 2 * seed + 1) | 1
        return [(a + i * b) % (1 << 64) % size for i in range(min(hashes, 24))]

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, self.size, self.hashes, self.seed))


def _build(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """The filter of a key column: tasks OR their bits, Spark ORs the words, the driver gets one bit map."""
    size, hashes = Bloom.shape(n, rate)
    if size // 8 > MAX_BYTES:
        raise ValueError(f"{n} keys need {size // 8} bytes of filter, over MAX_BYTES: split the list")

    def run(batches):
        import pyarrow as pa
        words: dict[int, int] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in Bloom.places(key, size, hashes, seed):
                    words[p >> 5] = words.get(p >> 5, 0) | 1 << (p & 31)
        yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.int64()), pa.array(words.values(), pa.int64())], ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 32 + 1, "<u4")
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype("<u4")
    return Bloom(np.frombuffer(words.tobytes(), np.uint8), size, hashes, seed)


class Cascade:
    """Levels in order; exact for every key of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def passed(self, key: str) -> int:
        n = 0
        for level in self.levels:
            if key not in level:
                break
            n += 1
        return n

    def __contains__(self, key: str) -> bool:
        return self.passed(key) % 2 == 1


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches):
        for batch in batches:
            import pyarrow as pa
            yield batch.filter(pa.array([k in level for k in batch.column(0).to_pylist()], pa.bool_()))
    return keys.mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe, seed: int = 0) -> Cascade:
    """listed(key) against universe(level) -> DataFrame(key) of corpus keys passing the first level."""
    listed = common.staged(listed.select("key").distinct(), "listed")
    n = listed.count()
    if not n:
        return Cascade([])
    levels = [_build(listed, n, FIRST_RATE, seed)]
    wrong = common.staged(universe(levels[0]).distinct().join(listed, "key", "left_anti"), "false-positives")
    inside, outside = listed, wrong
    while (m := outside.count()) > 0:
        if len(levels) > 200:
            raise RuntimeError("the cascade does not end")
        levels.append(_build(outside, m, LATER_RATE, seed + len(levels)))
        inside, outside = outside, common.staged(_passing(inside, levels[-1]), "still-passing")
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    `rules` has host, path and verdict; rule is host and path written together, null if none fits, and then the
    verdict is `default`: a URL that no list names passes. A rule listed under two verdicts takes the
    first in alphabetical order. Null urls have empty host and path and match nothing. Rules with a null or empty
    host are ignored. Repeated rows each get a row; extra columns are ignored; empty tables work.
    """
    spark = pages.sparkSession
    common.arrow_batches(spark)
    rules = rules.where("host is not null and host <> ''").select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                                                                  F.coalesce("path", F.lit("")).alias("path"), "verdict")
    # Distinct lengths of rule paths and distinct verdicts: a few numbers and words, whatever the list's size.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    verdicts = sorted(r[0] for r in rules.select("verdict").where("verdict is not null").distinct().collect())
    urls = pages.select(F.col(f"`{url_col}`").alias("url"))

    def universe(level: Bloom) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                seen = {k for u in batch.column(0).to_pylist() for k in candidates(*split_url(u), lengths)}
                yield pa.RecordBatch.from_arrays([pa.array([k for k in sorted(seen) if k in level], pa.string())], ["key"])
        return urls.mapInArrow(run, "key string")

    lists = [(v, build_cascade(rules.where(F.col("verdict") == v).select(F.concat("host", "path").alias("key")), universe, seed=1000 * i)) for i, v in enumerate(verdicts)]
    total = sum(len(b.bits) for _, c in lists for b in c.levels)
    if total > MAX_BYTES:
        raise ValueError(f"the filters have {total} bytes, over MAX_BYTES: split the list")
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                found = next(((k, v) for k in candidates(host, path, lengths) for v, c in lists if k in c), (None, default))
                out.append((host, path, *found))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
