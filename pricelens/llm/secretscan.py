"""Secret scans: fixed patterns, and a battery of randomness tests over every unbroken run of code characters.

1. The characters of the whole corpus are counted: how often ordinary text uses each symbol (`character_counts`).
2. A run of at least MIN_RUN characters is read in the smallest alphabet that holds it. Three tests ask whether it
   looks drawn at random: chi-squared uniformity over the alphabet, runs above and below its middle, and lag-one
   serial correlation. Fisher's method combines them into `p_random`, small if the run is not random.
3. `p_ordinary` is the chance that ordinary text of this length and alphabet comes out as even as the run does: the
   lower tail of the same chi-squared statistic under the corpus's symbol shares. Short runs cannot be told from
   ordinary text, so their p_ordinary stays large.
4. False discoveries are controlled by length: Benjamini-Hochberg over p_ordinary within each stratum of alphabet
   and length class, over all runs of the corpus. p is rounded up to a grid of ten steps a decade, so the
   table that is ranked has a bounded number of cells.

A run counts as a secret if its stratum's threshold admits it and the battery does not refuse it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

#: Fixed patterns (group 2 of `assign` is the value); letters of its names in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16}

#: Alphabets in which a run may be written, smallest first (fixed values).
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": _D, "hex": _D + "abcdef", "HEX": _D + "ABCDEF", "lower": _L, "upper": _U, "base32": _U + "234567", "lower36": _D + _L, "upper36": _D + _U,
    "letters": _U + _L, "base62": _U + _L + _D, "base64": _U + _L + _D + "+/", "base64url": _U + _L + _D + "-_", "mixed": _U + _L + _D + "+/-_",
}
MIN_RUN = 16
#: Share of false discoveries allowed in a stratum; the battery refuses a run whose combined p is below REFUSE.
FDR, REFUSE = 0.01, 0.001
#: Grid of p_ordinary: level = floor(-10 log10 p), at most this.
TOP_LEVEL = 300

_CODE = np.zeros(256, bool)
_CODE[list(ALPHABETS["mixed"].encode())] = True


class Alphabet:
    """Symbol numbers and, from the corpus's counts, the symbol shares of ordinary text in this alphabet."""

    def __init__(self, symbols: str, counts: np.ndarray):
        self.size = len(symbols)
        self.number = np.full(256, -1, np.int16)
        self.number[list(symbols.encode())] = np.arange(self.size)
        share = counts[list(symbols.encode())].astype(float) + 1
        share /= share.sum()
        self.second, self.third = float((share ** 2).sum()), float((share ** 3).sum())


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(x: np.ndarray, k: int) -> tuple[float, float, float, float]:
    """(chi-squared statistic, p of chi-squared, p of runs, p of serial correlation) of symbol numbers below k,
    under a uniform independent source. A constant run has p 0 in the last two."""
    n = len(x)
    chi = float((np.bincount(x, minlength=k).astype(float) ** 2).sum()) * k / n - n
    # Mean and variance of the statistic under the multinomial are exact for any n.
    p_chi = normal_below(-(chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = x >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        count = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * n1 * n2 / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))
        p_runs = min(1.0, 2 * normal_below(-max(abs(count - mean) - 0.5, 0) / spread))
    else:
        p_runs = 0.0
    y = x - x.mean()
    around = float(y @ y)
    p_serial = min(1.0, 2 * normal_below(-abs(float(y[1:] @ y[:-1]) / around + 1 / n) * math.sqrt(n))) if around else 0.0
    return chi, p_chi, p_runs, p_serial


def fisher(ps: tuple) -> float:
    """Combined p of independent tests: upper tail of chi-squared with two degrees of freedom a test."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half ** i / math.factorial(i) for i in range(len(ps)))


def p_ordinary(chi: float, n: int, alphabet: Alphabet) -> float:
    """Chance that ordinary text of n symbols is as even as this: normal lower tail of its number of equal pairs."""
    pairs = n * (n - 1) / 2
    equal = ((chi + n) * n / alphabet.size - n) / 2
    second, third = alphabet.second, alphabet.third
    spread = pairs * (second - second ** 2) + pairs * (n - 2) * 2 * max(third - second ** 2, 0.0)
    return normal_below((equal + 0.5 - pairs * second) / math.sqrt(spread)) if spread > 0 else 1.0


def level_of(p: float) -> int:
    """Grid level of a p-value; the level stands for a p not below the true one."""
    return min(TOP_LEVEL, int(math.floor(-10 * math.log10(max(p, 1e-300)))))


def stratum_of(alphabet: int, n: int) -> int:
    """Alphabet and length class (four classes per doubling) as one number."""
    return alphabet * 1000 + int(4 * math.log2(n))


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches that are long enough, sorted."""
    out = []
    low = data.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Scanner:
    def __init__(self, counts: np.ndarray, min_run: int = MIN_RUN, refuse: float = REFUSE):
        self.alphabets = [Alphabet(s, counts) for s in ALPHABETS.values()]
        self.min_run, self.refuse = min_run, refuse

    def runs(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, stratum, level) in bytes of every code run that the battery does not refuse; those it refuses
        have level -1. Up to two '=' after a run belong to its span."""
        codes = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], _CODE[codes], [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.min_run
        out = []
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            run = codes[start:end]
            for kind, alphabet in enumerate(self.alphabets):
                x = alphabet.number[run]
                if x.min() >= 0:
                    break
            chi, *ps = battery(x.astype(np.int64), alphabet.size)
            level = level_of(p_ordinary(chi, end - start, alphabet)) if fisher(tuple(ps)) >= self.refuse else -1
            tail = end
            while tail < len(codes) and tail < end + 2 and codes[tail] == 0x3D:
                tail += 1
            out.append((start, tail, stratum_of(kind, end - start), level))
        return out

    def scan(self, text: str) -> tuple[list, list]:
        """(base spans, candidate runs as (start, end, stratum, level)) of one text in code points. A run that touches
        a base span is part of it and no candidate."""
        data = text.encode("utf-8", "surrogatepass")
        base, found = base_spans(text, data), self.runs(data)
        if found and len(data) != len(text):
            points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(points[a]), int(points[b]), s, v) for a, b, s, v in found]
        if base:
            reach, ends = 0, []
            for _, _, end in base:
                reach = max(reach, end)
                ends.append(reach)
            starts = [s for s, _, _ in base]
            # Of the base spans that begin before the run's end, the furthest reaching one decides.
            found = [r for r in found if not (i := bisect_left(starts, r[1])) or ends[i - 1] <= r[0]]
        return base, found


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Occurrences of the 128 ASCII characters in all texts."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in common.text_bytes(batch.column(0)):
                for at in range(0, len(data), 1 << 22):
                    total += np.bincount(np.frombuffer(data, np.uint8, min(1 << 22, len(data) - at), at), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128)), pa.array(total[:128])], ["code", "n"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in rows:  # 128 rows, whatever the corpus
        out[r.code] = r.n
    return out


def thresholds(cells: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Lowest admitted level per stratum by Benjamini-Hochberg, from (stratum, level, runs) cells. Refused runs
    (level -1) count as tests. A stratum that admits nothing is left out."""
    out: dict[int, int] = {}
    by: dict[int, list] = {}
    for stratum, level, n in cells:
        by.setdefault(stratum, []).append((level, n))
    for stratum, rows in by.items():
        tests, admitted = sum(n for _, n in rows), 0
        for level, n in sorted(rows, reverse=True):
            admitted += n
            if level >= 0 and tests * 10 ** (-level / 10) <= fdr * admitted:
                out[stratum] = level
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR, min_run: int = MIN_RUN, refuse: float = REFUSE) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, kind, end) sorted by start, then kind: 0 assign, 1 access,
    2 hex, 3 random. Positions are code points, ends exclusive.

    Null and empty texts have no span. Repeated rows each get a row and count as tests each; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    scanner = Scanner(character_counts(docs, text_col), min_run, refuse)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    span, run_ = "array<struct<start:long,kind:int,end:long>>", "array<struct<start:long,end:long,stratum:int,level:int>>"
    out = T.StructType([slim.schema["doc_id"], T.StructField("base", T._parse_datatype_string(span)), T.StructField("runs", T._parse_datatype_string(run_))])

    def run(batches):
        import pyarrow as pa
        span_t = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        run_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("level", pa.int32())]))
        for batch in batches:
            base, runs = [], []
            for text in batch.column(1).to_pylist():
                b, r = scanner.scan(text or "")
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
                runs.append([{"start": s, "end": e, "stratum": t, "level": v} for s, e, t, v in r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span_t), pa.array(runs, run_t)], ["doc_id", "base", "runs"])

    scanned = common.staged(slim.mapInArrow(run, out), "secret-runs")
    # At most alphabets x length classes x levels cells: 13 x 160 x 302, whatever the corpus.
    cells = scanned.select(F.explode("runs").alias("r")).groupBy("r.stratum", "r.level").agg(F.count("*").alias("n")).collect()
    admit = thresholds([(c.stratum, c.level, c.n) for c in cells], fdr)
    if not admit:
        return scanned.select("doc_id", F.array_sort("base").alias("spans"))
    limit = F.create_map(*[F.lit(x) for pair in sorted(admit.items()) for x in pair])
    added = F.transform(F.filter("runs", lambda r: r["level"] >= F.element_at(limit, r["stratum"])),
                        lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def secret_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the fixed patterns' spans), spans (all, as text
    kind:start:end, comma-joined). Rules for nulls, repeats, extra columns and empty tables as in `find_secrets`."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    found = find_secrets(docs, id_col, text_col, **how)
    counts = [number(kind) for kind in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
