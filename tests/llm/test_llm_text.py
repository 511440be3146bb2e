"""Encoding operators against the tokenizers library and plain recomputation."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from pricelens.llm import bpe, common, tokenbin, tokencounts

WORD = common.tokenizer_path()
BYTE = common.tokenizer_path(common.BYTE_BPE)
RND = random.Random(7)
LONG = "".join(RND.choice("thérainogß") for _ in range(30_000))
TEXTS = ["", None, "Hello wörld's !!'s naïve 123", "a <|endoftext|>b<|startoftext|> <|endoftext", LONG, "ab" * 4000 + "  x\n\n y " + "é" * 3000,
         "ΣΑΣ İx 漢字 ౜ \x1c a\x85b é e\u0301", "\n\n a  \n\n\nb ", "lines\n\nand\r\nmore \n", "Hello wörld's !!'s naïve 123", "!" * 500, "'LL 'll don't"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, a long word, repeated rows and ids, and columns named like the operators' own."""
    rows = [(i, t, "x", "part", 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None, None), (2, "other", "y", "z", 0), (None, "nobody", "", "", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, row string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD)


def test_lookahead_is_sufficient(library):
    c = bpe.codec(WORD)
    for word in ("".join(RND.choice("abcdeinorst") for _ in range(9000)), "ab" * 5000, "a" * 12_000):
        assert list(c.merges.stream([word.encode()[i:i + 700] for i in range(0, len(word), 700)])) == library.encode(word, add_special_tokens=False).ids


def test_improper_merge_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [["ab", "b"], ["a", "b"]], "")


def test_encode_and_decode_equal_the_library(docs, library):
    got = sorted(map(tuple, bpe.encode(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_digests(docs, library):
    got = sorted(map(tuple, bpe.encode_digests(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decoder_keeps_unfinished_sequences():
    d = bpe.Decoder({i: bytes([i]) for i in range(256)}, b"")
    text = "aé漢🎈z"
    assert "".join(d.feed([b]) for b in text.encode()) + d.close() == text
    assert d.feed([0xE6, 0xBC]) == "" and d.close() == "\ufffd"


def test_memo_stays_bounded():
    memo = bpe.Memo(len, limit=10)
    assert [memo["x" * (i % 25)] for i in range(200)] == [i % 25 for i in range(200)] and len(memo) <= 10


def test_random_access_codes():
    ids = np.random.default_rng(3).choice([0, 1, 255, 256, 300, 65_535, 65_536, 2 ** 31, 2 ** 32 - 1], 5000).astype(np.uint32)
    counts = [0, 1, 1999, 0, 3000]
    f = tokenbin.DacFile(io.BytesIO(tokenbin.pack([5, None, 7, 8, 9], counts, ids)))
    assert f.doc_ids == [5, None, 7, 8, 9] and f.levels == 4
    assert [f.token(i) for i in range(0, 5000, 37)] == ids[::37].tolist()
    assert np.array_equal(f.slice(511, 1600), ids[511:1600]) and np.array_equal(f.document(4), ids[2000:]) and len(f.document(0)) == 0
    empty = tokenbin.DacFile(io.BytesIO(tokenbin.pack([], [], np.zeros(0, np.uint32))))
    assert empty.tokens == 0 and empty.docs == 0


@pytest.mark.parametrize("file_tokens", [10, 1 << 20])
def test_token_table_reads_back_what_the_library_gives(docs, library, file_tokens):
    got = [tuple(r) for r in tokenbin.token_table(docs, file_tokens=file_tokens).orderBy("start").collect()]
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_spans_equal_whole_document_offsets():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    enc = tokencounts.SpanEncoder(BYTE)
    for text in [x or "" for x in TEXTS]:
        assert [tuple(s) for s in enc.spans(text).tolist()] == t.encode(text, add_special_tokens=False).offsets


def test_spans_of_very_long_runs():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    enc = tokencounts.SpanEncoder(BYTE)
    for text in (" " * 2_000_000, "x" * 100_000, " \n" * 50_000 + "é"):
        assert [tuple(s) for s in enc.spans(text).tolist()] == t.encode(text, add_special_tokens=False).offsets


def test_boundary_rules():
    spans = np.array([[0, 2], [2, 5], [5, 6], [6, 10], [12, 13]])
    sections = np.array([[0, 3], [3, 3], [3, 8], [8, 10]])
    assert tokencounts.attribute(spans, sections)[0].tolist() == [0, 2, 2, 2, -1]
    assert tokencounts.attribute(spans, sections, "start")[0].tolist() == [0, 0, 2, 2, -1]
    assert tokencounts.attribute(spans, sections)[1].tolist() == [False, True, False, True, False]


def test_counts_per_line_add_up(docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    want = {}
    for r in docs.collect():
        text = r.text or ""
        ends = [i + 1 for i, ch in enumerate(text) if ch == "\n"]
        ends += [len(text)] if not ends or ends[-1] < len(text) else []
        counts = [0] * len(ends)
        for a, b in t.encode(text, add_special_tokens=False).offsets:
            overlap = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends], ends)]
            counts[max(range(len(ends)), key=lambda i: (overlap[i], -i))] += 1
        for i, (s, e, n) in enumerate(zip([0, *ends], ends, counts)):
            want.setdefault(str(r.doc_id), []).append((i, s, e, n))
    got = {}
    for r in tokencounts.token_counts(docs).collect():
        got.setdefault(str(r.doc_id), []).append((r.section, r.char_start, r.char_end, r.n_tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_given_sections_and_gaps(spark):
    df = spark.createDataFrame([(1, "one two three", [(0, 3), (8, 13)]), (2, None, None)], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = {tuple(r) for r in token_rows(tokencounts.token_counts(df, sections_col="s", rule="start"))}
    assert got == {(1, 0, 0, 3, 1), (1, 1, 8, 13, 0), (1, None, None, None, 2)}


def token_rows(df):
    return [r[:5] for r in map(tuple, df.collect())]


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (bpe.encode(none), bpe.encode_digests(none), tokenbin.token_table(none), tokencounts.token_counts(none)):
        assert df.count() == 0


def test_letters_that_leave_the_latin_blocks(spark, library):
    rnd = random.Random(11)
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = ["aȺb", "việt", "hớ́i", "(Ⱥ", "-ẹ", "Ⱥ" * 300, "x̣̂ (ȾE) 'S"]
    for _ in range(1500):
        texts.append("".join(rnd.choice(marks) if rnd.random() < 0.25 else chr(rnd.choice([32, rnd.randrange(0x21, 0x7F), rnd.randrange(0x80, 0x250), rnd.randrange(0x370)]))
                             for _ in range(rnd.randrange(1, 25))))
    c, enc = bpe.codec(WORD), tokenbin._Encoder(WORD)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for part in c.encode(text) for i in part] == want
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == want


def test_word_memory_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenbin, "MEMO_BYTES", 5000)
    enc = tokenbin._Encoder(WORD)
    rnd = random.Random(2)
    for _ in range(60):
        text = " ".join(rnd.choice(["the", "(naïve)", "1,234", "don't", "x" * 400]) + str(rnd.randrange(40)) for _ in range(50))
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc.held < 30_000 and len(enc.older) < 200


def test_memo_is_bounded_in_bytes():
    memo = bpe.Memo(lambda w: tuple(w), limit_bytes=10_000)
    for i in range(500):
        assert memo[f"{i % 90}" * 40] == tuple(f"{i % 90}" * 40)
    assert len(memo) < 60 and memo["y" * 1000] and "y" * 1000 not in memo
