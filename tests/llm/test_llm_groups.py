"""Deduplication and near-duplicate operators against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from pricelens.llm import exactdedup, graph, simhash

RND = random.Random(11)
SCHEMA = "doc_id long, text string, uid string, row string, fp int"


def rows(n=400):
    words = ["".join(RND.choice("abcde") for _ in range(4)) for _ in range(300)]
    base = [" ".join(RND.choice(words) for _ in range(40)) for _ in range(60)]
    out = []
    for i in range(n):
        w = RND.choice(base).split(" ")
        for _ in range(RND.choice([0, 0, 1, 2])):
            w[RND.randrange(len(w))] = RND.choice(words)
        out.append((i, " ".join(w)))
    out += [(n + i, "hot text " * 30) for i in range(n // 2)]  # a third of all rows
    out += [(n * 2, None), (n * 2 + 1, ""), (n * 2 + 2, " \t\n"), (3, "same id"), (3, "same id"), (None, "same id"), (None, None), (n * 3, "Two Words"), (n * 3 + 1, "two\u00a0words x " * 3000)]
    RND.shuffle(out)
    return [(i, t, "x", "y", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def rank(i):
    return (i is not None, i or 0)


@pytest.mark.parametrize("table_bytes", [1 << 26, 3000])
def test_exact_dedup(docs, table_bytes):
    """The small budget forces flushes of the local tables and several levels of spill files."""
    data = docs.collect()
    groups = {}
    for r in data:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    got = exactdedup.exact_dedup(docs, table_bytes=table_bytes).collect()
    assert len(got) == len(data)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    want = sorted((rank(i), rank(max(ids, key=rank)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((rank(r.doc_id), rank(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(not r.kept or r.doc_id == r.keep_id for r in got)


@pytest.mark.parametrize("table_bytes", [1 << 26, 3000])
def test_keep_distinct_returns_whole_rows(docs, table_bytes):
    got = exactdedup.keep_distinct(docs, table_bytes=table_bytes)
    assert got.schema == docs.schema
    best = {}
    for r in docs.collect():
        if r.text or "" not in best or rank(r.doc_id) > rank(best[r.text or ""]):
            best[r.text or ""] = max([r.doc_id] + ([best[r.text or ""]] if (r.text or "") in best else []), key=rank)
    assert sorted((r.text or "", rank(r.doc_id)) for r in got.collect()) == sorted((t, rank(i)) for t, i in best.items())


def test_open_table_compares_contents():
    t = exactdedup.OpenTable(4)
    assert [t.find_or_add(5, c) for c in ("a", "b", "a")] == [(0, True), (1, True), (0, False)]  # equal hashes, different contents
    assert all(t.find_or_add(i, str(i))[1] for i in range(100)) and not t.find_or_add(99, "99")[1]


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    parent = {k: k for k in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if bin(a ^ b).count("1") <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in items}


def test_simhash(docs):
    data = docs.collect()
    prints = [brute_fingerprint(r.text or "") for r in data]
    roots = brute_components(set(prints))
    least = {}
    for r, fp in zip(data, prints):
        if r.doc_id is not None:
            least[roots[fp]] = min(least.get(roots[fp], 1 << 60), r.doc_id)
    want = sorted((rank(r.doc_id), f"{fp:016x}", least[roots[fp]]) for r, fp in zip(data, prints))
    assert sorted((rank(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash(docs).collect()) == want
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


@pytest.mark.parametrize("bucket", [2048, 4])
def test_links_of_dense_and_chained_fingerprints(spark, bucket):
    """Fingerprints 0 to 3 bits apart in one ball and in chains; small buckets force the splitting rounds."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    fps = {center}
    for _ in range(250):
        fps.add(center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    at = int(rng.integers(1 << 62))
    for _ in range(40):
        at ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        fps.add(at)
    fps |= {int(x) for x in rng.integers(1 << 63, size=200, dtype=np.uint64)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(3)
    got = {r.v: r.root for r in graph.components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    want, classes = brute_components(fps), {}
    for f, root in want.items():
        classes.setdefault(root, set()).add(signed[f])
    for members in classes.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(s, s) for s in signed.values()}) == len(classes)


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(*(x.tolist() for x in simhash.fingerprint_keys(f)))) for f in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(3000))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (500, None)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (exactdedup.exact_dedup(none), exactdedup.keep_distinct(none), simhash.simhash(none), simhash.keep_first(none)):
        assert df.count() == 0
