"""Filter audit, secret scans and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from pricelens.llm import filteraudit, periodic, secretscan

RND = random.Random(41)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ------------------------------------------------------------------------------------------

def brute_mask(text):
    words = WORD.findall(text)
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + 8 * any(c in "#$%&*|" for c in text))


def brute_audit(docs, labels):
    rows = []
    for doc, text, part in docs:
        mask = brute_mask(text or "")
        if doc is not None and any(d is not None and d < doc and (t or "") == (text or "") for d, t, _ in docs):
            mask += 16
        mine = [x for x in labels if doc is not None and x[0] == doc]
        rows.append((part or "", mask, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out = []
    for part in {r[0] for r in rows}:
        removed_by = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                now = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                removed_by[name] += len(now)
                lines.append((name, part, "".join(order), step, len(left), len(now), sum(1 for r in gone if r[1] & bit),
                              sum(1 for r in rows if r[0] == part and r[1] == bit), sum(r[2] for r in now), sum(r[3] for r in now)))
                gone += now
        out += [(*line[1:], removed_by[line[0]]) for line in lines]
    return sorted(out)


def audited_docs():
    texts = ["", None, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i % 60}" for i in range(250)), "É" * 96 + "ABC ", "É" * 97 + "ABCD",
             "plain words", "plain words", "a $ b", "\x1c\x85\xa0", " ".join(f"w{i}" for i in range(199)) + "\x0b100%"]
    docs = [(i, RND.choice(texts), RND.choice(["en", "fr", "", None])) for i in range(120)]
    return docs + [(5, "plain words", "en"), (5, "plain words", "en"), (None, "plain words", "fr"), (None, None, None)]


@pytest.mark.parametrize("range_bits", [2, 14])
def test_audit_equals_brute_force(spark, range_bits):
    docs = audited_docs()
    labels = [(RND.randrange(130), RND.choice([0, 1, None]), RND.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    df = spark.createDataFrame([(d, t, p, "x", 3, True) for d, t, p in docs], "doc_id long, text string, lang string, digest string, mask int, good boolean").repartition(3)
    marks = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = sorted(map(tuple, filteraudit.document_audit(df, marks, range_bits=range_bits).collect()))
    assert got == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.document_audit(df, marks).count() == 0
    one = spark.createDataFrame([(1, "x", None)], df.schema)
    rows = filteraudit.document_audit(one, marks).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


def test_galloping_merges():
    for _ in range(300):
        lists = [sorted(RND.sample(range(60), RND.randrange(0, 40))) for _ in range(RND.randrange(0, 5))]
        assert filteraudit.union(lists) == sorted(set().union(*lists))
        a, b = (sorted(RND.sample(range(60), RND.randrange(0, 50))) for _ in range(2))
        assert filteraudit.split_by(a, b) == (sorted(set(a) - set(b)), sorted(set(a) & set(b)))


def test_long_texts_are_counted_whole():
    text = " ".join(f"w{i % 400}" for i in range(700_000)).encode()  # several blocks
    assert filteraudit.text_failures(text) == 2
    assert filteraudit.text_failures(b"x" * 3_000_000) == 1


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError):
        filteraudit.audit(spark.createDataFrame([], "row long, part string, mask int, good boolean, toxic boolean"), "ABCDEFGH")


# --- secret scans ------------------------------------------------------------------------------------------

def brute_base(text):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(f"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def key(n, symbols="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(RND.choice(symbols) for _ in range(n))


FORMS = ["", None, "pässword=abc Password : 'abcdefgh' x", "api_key=\"" + key(30) + "\" é AKIA" + key(16, "ABCDEFGH12345") + ".", "token:secret:abcdefgh1", "toKen=abcdefghij, ſecret=abcdefghij",
         "AKIAAKIA AKIAx " + key(40, "0123456789abcdef"), "漢" + key(31, "0123456789abcdef") + " " + key(33, "0123456789abcdef") + "ghi", "SECRET=" + key(9) + "passwd:" + key(8)]


def test_base_spans_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(FORMS)] + [(2, FORMS[2]), (None, FORMS[3])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, spans string, runs int").repartition(3)
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secretscan.secret_table(df).collect()), key=str)
    want = []
    for d, t in docs:
        spans = brute_base(t or "")
        count = Counter(k for _, k, _ in spans)
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        want.append((d, count[0], count[1], count[2], hashlib.sha256(listed.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(n for _, n, *_ in got) and secretscan.secret_table(df.limit(0)).count() == 0


def test_battery_equals_textbook_sums():
    for n, k in ((16, 16), (40, 62), (500, 64)):
        x = np.array([RND.randrange(k) for _ in range(n)])
        chi, p_chi, p_runs, p_serial = secretscan.battery(x, k)
        count = Counter(x.tolist())
        assert math.isclose(chi, sum((count[s] - n / k) ** 2 / (n / k) for s in range(k)), rel_tol=1e-9)
        runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
        n1 = sum(int(a >= k / 2) for a in x)
        n2 = n - n1
        mean, var = 2 * n1 * n2 / n + 1, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
        assert math.isclose(p_runs, min(1, math.erfc(max(abs(runs - mean) - 0.5, 0) / math.sqrt(2 * var))), rel_tol=1e-6)
        m = sum(x) / n
        r = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / sum((a - m) ** 2 for a in x)
        assert math.isclose(p_serial, math.erfc(abs(r + 1 / n) * math.sqrt(n / 2)), rel_tol=1e-6)
    assert math.isclose(secretscan.fisher((0.05, 0.2, 0.9)), 0.1526, abs_tol=2e-3)  # chi2 = 9.42, 6 degrees
    assert secretscan.battery(np.zeros(20, int), 16)[2:] == (0.0, 0.0)


def test_battery_is_calibrated_on_random_runs():
    ps = [secretscan.fisher(secretscan.battery(np.array([RND.randrange(62) for _ in range(40)]), 62)[1:]) for _ in range(2000)]
    assert np.mean(np.array(ps) < 0.05) < 0.09 and np.mean(np.array(ps) < secretscan.REFUSE) < 0.01


def test_thresholds_are_benjamini_hochberg():
    for _ in range(200):
        ps = [RND.random() ** RND.choice([1, 6]) for _ in range(RND.randrange(1, 60))]
        levels = [secretscan.level_of(p) for p in ps]
        grid = sorted(10 ** (-v / 10) for v in levels)
        passed = [g for i, g in enumerate(grid, 1) if g <= 0.1 * i / len(grid)]
        got = secretscan.thresholds([(7, v, n) for v, n in Counter(levels).items()], 0.1)
        assert (7 in got) == bool(passed)
        if passed:
            assert {v for v in levels if v >= got[7]} == {v for v, in zip(levels) if 10 ** (-v / 10) <= max(passed)}


def test_planted_keys_are_found_and_words_left(spark):
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    natural = lambda n: "".join(letters[min(int(RND.expovariate(0.16)), 25)] for _ in range(n))
    docs, planted = [], {}
    for i in range(400):
        words = [natural(RND.randint(2, 9)) for _ in range(150)]
        words[5] = "/".join(natural(6).title() for _ in range(RND.randint(3, 9)))  # a path: long, but ordinary
        words[7] = natural(RND.randint(16, 40))
        if i % 4 == 0:
            words[50] = key(RND.choice([40, 48, 64]))
            planted[i] = words[50]
        docs.append((i, " ü ".join(words)))
    got = {r.doc_id: r.spans for r in secretscan.secret_table(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    texts = dict(docs)
    found = {i: [texts[i][int(s):int(e)] for k, s, e in (x.split(":") for x in spans.split(",") if x) if k == "random"] for i, spans in got.items()}
    hits = sum(planted[i] in found[i] for i in planted)
    false = sum(len(v) for v in found.values()) - hits
    assert hits >= 0.9 * len(planted) and false <= 0.03 * hits


def test_runs_in_base_spans_are_not_added_twice():
    counts = np.ones(256, np.int64)
    s = secretscan.Scanner(counts)
    text = "é token=" + key(30) + " " + key(30) + "=="
    base, runs = s.scan(text)
    assert base == [(2, 0, 38)] and [(a, b) for a, b, *_ in runs] == [(39, 71)]
    assert s.scan("") == ([], []) and len(s.scan("Ab9+" * 500_000)[1]) == 1


# --- periodic runs -----------------------------------------------------------------------------------------

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                run = words[i:i + length]
                if not any(all(run[x] == run[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text, changed=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if changed and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made_text(n):
    words = []
    while len(words) < n:
        unit = [RND.choice("abcdé") * RND.choice([1, 1, 2]) for _ in range(RND.randint(1, 7))]
        words += unit * RND.choice([1, 1, 3, 4, 5, 9])
        words += [f"r{RND.randrange(30)}" for _ in range(RND.choice([0, 0, 1, 12]))]
    return RND.choice([" ", "\n", " \t "]).join(words[:n])


@pytest.mark.parametrize("block_bytes", [1, 400, 1 << 22])
def test_runs_equal_brute_force(spark, block_bytes):
    docs = [(i, made_text(RND.randrange(1, 160))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "\x1c"), (903, "a " * 200), (904, "a b " * 90 + "a"), (None, "x y " * 9), (3, docs[3][1]), (3, docs[3][1]), (905, "a a a a a b " * 20), (906, "a a a b " * 3 + "c a a a b " * 3)]
    df = spark.createDataFrame([(d, t, 7, "z") for d, t in docs], "doc_id long, text string, start int, period string").repartition(3)
    got = sorted(map(tuple, periodic.periodic_runs(df, change=periodic.repeat_by_id, block_bytes=block_bytes).collect()), key=str)
    assert got == sorted((brute_row(d, t) for d, t in docs), key=str)
    plain = sorted(map(tuple, periodic.periodic_runs(df).collect()), key=str)
    assert plain == sorted((brute_row(d, t, False) for d, t in docs), key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_lag_scan_alone_finds_all_runs():
    for _ in range(400):
        words = made_text(RND.randrange(1, 120)).split()
        codes = np.array([sorted(set(words)).index(w) for w in words], np.int32)
        assert sorted(periodic.lag_scan(codes), key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_long_texts_with_few_words_stay_quick():
    import time
    rng = np.random.default_rng(5)
    t = time.perf_counter()
    words = rng.integers(0, 3, 300_000).astype(np.int32)
    words[100_000:180_000] = words[100_000 + np.arange(80_000) % 20_000]
    runs = periodic.runs_of(words, np.array([0, len(words)]))[0]
    assert any(q == 20_000 and m >= 80_000 for _, m, q in runs)
    assert periodic.runs_of(np.zeros(300_000, np.int32), np.array([0, 300_000]))[0] == [(0, 300_000, 1)]
    assert time.perf_counter() - t < 60
