"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run of period q has at least max(6, 4 q) words, so each of its words occurs four times in it. A word that
occurs less often within a segment can be in no run there and splits the segment; counts are taken again
in the pieces, until no word is too rare. A run never crosses a split, since a word that extended it would be
part of a run itself.

Surviving segments are scanned lag by lag. At lag q a run shows as at least 3 q matches in a row, which hold three
multiples of q in a row: looking at every q-th word finds all of them in (words / q) steps, so all lags
together cost words * log(words). A place found so is extended by galloping in both directions.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

#: Periods that a run must hold, and words that it must have.
REPEATS, LEAST = 4, 6
#: Bytes of text split together; a longer text is split alone.
BLOCK_BYTES = 4 << 20


def word_numbers(data: bytes, numbers: common.Numbers) -> np.ndarray:
    parts = [np.array(list(map(numbers.__getitem__, words)), np.int32) for words in common.word_blocks(data)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)


def surviving(words: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the segments in which no word is too rare, from segments words[bounds[i]:bounds[i + 1]]."""
    starts, ends = np.asarray(bounds[:-1]), np.asarray(bounds[1:])
    done: list[tuple[int, int]] = []
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(starts):
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        sizes = ends - starts
        if not len(sizes):
            break
        segment = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(segment)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        key = segment.astype(np.int64) * kinds + words[place]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(first, len(ordered)))
        rare = np.empty(len(key), bool)
        rare[order] = np.repeat(count < repeats, count)
        whole = ~np.logical_or.reduceat(rare, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        done += zip(starts[whole].tolist(), ends[whole].tolist())
        # Pieces between rare words, within the segments that have some.
        on = ~rare & ~whole[segment]
        before = np.concatenate([[False], on[:-1]]) & np.concatenate([[False], segment[1:] == segment[:-1]])
        after = np.concatenate([on[1:], [False]]) & np.concatenate([segment[1:] == segment[:-1], [False]])
        starts, ends = place[on & ~before], place[on & ~after] + 1
    return sorted(done)


def _matches(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch [low, high) around `at` with words[i] == words[i + lag], by growing steps."""
    high, step, most = at + 1, 32, len(words) - lag
    while high < most:
        stop = min(high + step, most)
        same = words[high:stop] == words[high + lag:stop + lag]
        if not same.all():
            high += int(same.argmin())
            break
        high, step = stop, 2 * step
    low, step = at, 32
    while low > 0:
        stop = max(low - step, 0)
        same = (words[stop:low] == words[stop + lag:low + lag])[::-1]
        if not same.all():
            low -= int(same.argmin())
            break
        low, step = stop, 2 * step
    return low, high


def lag_scan(words: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment.

    A stretch of smaller period d at lag q lies in a run of period d that divides q (a string of four q words with both
    periods has their common divisor as a period) and ends with it; known runs are left out so.
    """
    n, found, known = len(words), [], []
    for q in range(1, n // repeats + 1):
        if n < least:
            break
        sample = words[::q]
        same = sample[1:] == sample[:-1]
        if q & (q - 1) == 0:  # runs too short to hide anything at this lag or beyond are forgotten
            known = [r for r in known if r[1] > (repeats - 1) * q]
        hit = np.flatnonzero(np.logical_and.reduce([same[i:len(same) - repeats + 2 + i] for i in range(repeats - 1)])) * q
        if not len(hit):
            continue
        for start, length, d in known:
            if q % d == 0 and length > (repeats - 1) * q:
                hit = hit[(hit < start) | (hit + (repeats - 1) * q >= start + length)]
        i = 0
        while i < len(hit):
            low, high = _matches(words, int(hit[i]), q)
            length = high - low + q
            if length >= max(least, repeats * q) and not any(q % d == 0 and s <= low and low + length <= s + m for s, m, d in known):
                found.append((low, length, q))
                known.append((low, length, q))
            i = int(np.searchsorted(hit, high))
    return found


def runs_of(words: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each segment, as (start in the segment, length, period) sorted by start, then period."""
    out: list[list] = [[] for _ in range(len(bounds) - 1)]
    for start, end in surviving(words, bounds, repeats, least):
        k = int(np.searchsorted(bounds, start, "right")) - 1
        base = start - int(bounds[k])
        out[k] += [(base + s, m, q) for s, m, q in lag_scan(words[start:end], repeats, least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # sorted by start, then period, so the first of equals stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def repeat_by_id(words: np.ndarray, doc_id) -> np.ndarray:
    """Test repetition by rule of the id: h = crc32(decimal id), g = h // 10; if h % 10 = 0, word i >= a becomes
    word a + (i - a) % p with a = g % n, p = 1 + (n - a) // (3 + g % 8). A null id and an empty text stay."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_runs, the strongest run (start, length, period, exponent_milli; null without a run),
    runs_sha256 and collapsed_sha256 (the text with every run cut to its first period).

    `change(word numbers, id)` may rearrange the words before the scan. Words are `[^\\x20\\x09-\\x0D]+`. Null and
    empty texts have no words and no run. Repeated rows each get a row; extra columns are ignored; an empty
    table gives an empty result. Each text is judged whole, one text at a time or short texts together.
    """
    common.arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    longs, texts = ("n_runs", "start", "length", "period", "exponent_milli"), ("runs_sha256", "collapsed_sha256")
    out = T.StructType([slim.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.StringType()) for c in texts]])

    def judged(block):
        numbers = common.Numbers()
        words = [word_numbers(data, numbers) for _, data in block]
        if change:
            words = [change(w, i) for w, (i, _) in zip(words, block)]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        names = list(numbers)
        for w, runs in zip(words, runs_of(np.concatenate(words), bounds)):
            start, length, q = strongest(runs) or (None, None, None)
            kept = w[kept_words(len(w), runs)] if runs else w
            collapsed = hashlib.sha256()
            for at in range(0, len(kept), 1 << 16):
                collapsed.update((b" " if at else b"") + b" ".join(map(names.__getitem__, kept[at:at + (1 << 16)].tolist())))
            listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
            yield len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), collapsed.hexdigest()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows, block, held = [], [], 0
            for key, data in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1))):
                block.append((key, data))
                held += len(data)
                if held >= block_bytes:
                    rows += judged(block)
                    block, held = [], 0
            if block:
                rows += judged(block)
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.string()) for c in cols[5:]]], ["doc_id", *longs, *texts])

    return slim.mapInArrow(run, out)
