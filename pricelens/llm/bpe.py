"""BPE encoding as a bounded-lookahead streaming transducer, decoding as a byte-to-text state machine.

Merges apply in rank order, so what follows a text can change its tokens only through a chain of merges: a
merge (a, b) across the end of the known text takes back the piece a, and a later merge (a', b') can go on
only if b' begins with a piece that was taken back, i.e. has a on its left spine. The longest such chain over
the merge list, measured in symbols, is the sufficient lookahead: a token that ends at least that far
before the end of the buffer is stable and is emitted; the rest stays in the buffer. Buffer and word memo are
bounded, so memory does not depend on the length of a text or of a word.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common

#: Entries of one generation of the word memo; two generations live at a time.
MEMO = 300_000
#: Bytes of one generation, roughly; longer words than LONGEST are not kept.
MEMO_BYTES, LONGEST = 64 << 20, 256
#: Characters of a text handled at once.
BLOCK = 1 << 16
#: Symbols fed to a window beyond the lookahead.
WINDOW = 2048


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list with its ranks and sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in merges]
        self.vocab, self.suffix = vocab, suffix
        self.rank = {}
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(pairs):
            for x in (a, b):
                if made.get(x, -1) >= r:
                    raise ValueError(f"merge {r} uses {x!r} before it is made: stable prefixes need a proper list")
            joined = a + b if not suffix or not a.endswith(suffix) else a[: -len(suffix)] + b
            made.setdefault(joined, r)
            self.rank.setdefault((a, b), (r, joined))
        later = {b for _, b in pairs} | {a for a, _ in pairs}
        for r, (a, b) in enumerate(pairs):
            if any(x in later and x in made and made[x] > r for x in (a, b)):
                raise ValueError(f"merge {r} needs a piece that is made later")
        self.rank_of = {p: r for p, (r, _) in self.rank.items()}
        self.made = [self.rank[p][1] for p in pairs]
        self.none = len(pairs)
        self.lookahead = self._lookahead(pairs)
        self.symbols = byte_symbols()

    def _lookahead(self, pairs) -> int:
        taken: dict[str, int] = {}  # piece -> longest chain that has just taken it back
        left: dict[str, list[str]] = {}  # piece -> its possible first parts
        longest = 0
        for a, b in pairs:
            spine, todo = set(), [b]
            while todo:
                x = todo.pop()
                if x not in spine:
                    spine.add(x)
                    todo += left.get(x, ())
            size = len(a.removesuffix(self.suffix) if self.suffix else a)
            chain_size = size + max((taken.get(x, 0) for x in spine), default=0)
            taken[a] = max(taken.get(a, 0), chain_size)
            left.setdefault(self.rank[a, b][1], []).append(a)
            longest = max(longest, chain_size)
        return longest

    def merge(self, pieces: list[str]) -> list[str]:
        """All merges, lowest rank first and left to right within a rank."""
        if len(pieces) > 48:
            return self._merge_long(pieces)
        get, none = self.rank_of.get, self.none
        pieces = list(pieces)
        ranks = [get(p, none) for p in zip(pieces, pieces[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            pieces[i] = made = self.made[low]
            del pieces[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((pieces[i - 1], made), none)
            if i < len(ranks):
                ranks[i] = get((made, pieces[i + 1]), none)
        return pieces

    def _merge_long(self, pieces: list[str]) -> list[str]:
        rank, n = self.rank, len(pieces)
        at: list = list(pieces)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(pieces, pieces[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = right[i]
            if at[i] != a or j >= n or at[j] != b:
                continue
            at[i], at[j] = rank[a, b][1], None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (p := (at[x], at[y])) in rank:
                    heapq.heappush(heap, (rank[p][0], x, p))
        return [p for p in at if p is not None]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word given as byte blocks of any size; holds at most lookahead + 2 * WINDOW symbols."""
        symbols, buffer = self.symbols, []
        held = None  # the last symbol, which may turn out to be the word's end
        for block in data:
            for at in range(0, len(block), WINDOW):
                fresh = [symbols[b] for b in block[at:at + WINDOW]]
                buffer += fresh if held is None else [held, *fresh]
                held = buffer.pop() if buffer else None
                if len(buffer) >= self.lookahead + WINDOW:
                    used = 0
                    for piece in self.merge(buffer):
                        size = len(piece.removesuffix(self.suffix) if self.suffix else piece)
                        if used + size > len(buffer) - self.lookahead:
                            break
                        used += size
                        yield self.vocab[piece]
                    buffer = buffer[used:]
        if held is not None:
            for piece in self.merge([*buffer, held + self.suffix]):
                yield self.vocab[piece]


class WordSplitter:
    """Words of a text as a lower-casing word-BPE file splits it: NFC, lower case, letters / one number /
    other signs; special tokens come out as one word. Texts beyond the Latin blocks go through the file's own
    normaliser and splitter, whose Unicode tables may differ from Python's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a lower-casing word BPE file")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        latin = [chr(c) for c in range(0x370)]
        kind = {c: unicodedata.category(c)[0] for c in latin}
        letters = re.escape("".join(c for c in latin if kind[c] == "L"))
        numbers = re.escape("".join(c for c in latin if kind[c] == "N"))
        space = re.escape("".join(c for c in latin if re.fullmatch(r"\s", c) and c not in "\x1c\x1d\x1e\x1f"))
        #: Contractions and classes of the file's split pattern (fixed values).
        self.words_of = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.foreign = re.compile("[^\x00-ͯ‐-‧]").search
        self.break_at = re.compile("[ \n]").search
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}

    def blocks(self, text: str, size: int = BLOCK) -> Iterator[str]:
        """The text cut at blanks: no word, combining sequence or special token crosses a blank."""
        at = 0
        while at < len(text):
            stop = at + size
            if stop < len(text):
                cut = self.break_at(text, stop)
                stop = cut.end() if cut else len(text)
            yield text[at:stop]
            at = stop

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words_of(text.lower())
        # Composition and lower case may both lead out of the Latin blocks, whose classes alone are known here.
        if self.foreign(text) is None and self.foreign(normal := unicodedata.normalize("NFC", text).lower()) is None:
            return self.words_of(normal)
        normal = self.library.normalizer.normalize_str(text)
        mapped = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.bytes_of[c] for c in w).decode("utf-8") for w, _ in mapped]


class Memo(dict):
    """Word -> value, computed on first use; a full generation retires and is consulted once more. A generation is
    bounded by entries and by bytes."""

    def __init__(self, fill, limit: int = MEMO, keep: dict | None = None, limit_bytes: int = MEMO_BYTES):
        super().__init__(keep or {})
        self.fill, self.limit, self.limit_bytes, self.keep, self.old, self.held = fill, limit, limit_bytes, dict(keep or {}), {}, 0

    def __missing__(self, word: str):
        if len(word) > LONGEST:
            return self.fill(word)
        if len(self) >= self.limit or self.held >= self.limit_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
            self.update(self.keep)
        value = self.old.get(word)
        if value is None:
            value = self.fill(word)
        self[word] = value
        self.held += sys.getsizeof(word) + sys.getsizeof(value) + 100
        return value


class Decoder:
    """Incremental byte-to-text machine. Its state is the unfinished UTF-8 sequence (at most 3 bytes) and
    whether a token came before. form "joined": token strings with a blank between; "text": the bytes
    that the tokens stand for, a word end becoming a blank."""

    def __init__(self, tokens: dict[int, bytes], joiner: bytes):
        self.tokens, self.joiner = tokens, joiner
        self.pending, self.begun = b"", False

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that begin a sequence which is not complete yet."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.pending + (self.joiner if self.begun else b"") + self.joiner.join(map(self.tokens.__getitem__, ids))
        self.begun = True
        keep = self.unfinished(data)
        self.pending = data[len(data) - keep:] if keep else b""
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encoder and decoder of one word-BPE file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.splitter = WordSplitter(path)
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.memo = Memo(self._short, keep={w: (i,) for w, i in self.splitter.special.items()})
        self.vocab = {i: t for t, i in {**model["vocab"], **self.splitter.special}.items()}
        self.text_of = {i: str(i) for i in self.vocab}

    def _short(self, word: str) -> tuple:
        m = self.merges
        pieces = list(word) if word.isascii() and word.isalnum() else [m.symbols[b] for b in word.encode("utf-8")]
        pieces[-1] += m.suffix
        return tuple(map(m.vocab.__getitem__, m.merge(pieces)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, block by block, as soon as they are stable."""
        for block in self.splitter.blocks(text):
            words = self.splitter.words(block)
            long = [w for w in words if len(w) > 4096] if len(block) > 4096 else []
            if long:
                for w in words:
                    if len(w) <= 4096:
                        yield list(self.memo[w])
                    else:
                        ids = self.merges.stream([w.encode("utf-8")])
                        while part := [i for _, i in zip(range(WINDOW), ids)]:
                            yield part
                continue
            yield list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def decoder(self, form: str = "joined") -> Decoder:
        if form == "joined":
            return Decoder(self._table("joined"), b" ")
        return Decoder(self._table("text"), b"")

    def _table(self, form: str) -> dict[int, bytes]:
        name = f"_{form}"
        if not hasattr(self, name):
            back, suffix, special = self.splitter.bytes_of, self.merges.suffix, set(self.splitter.special.values())

            def raw(i, t):
                if i in special:
                    return t.encode()
                end = bool(suffix) and t.endswith(suffix)
                return bytes(back[c] for c in (t.removesuffix(suffix) if end else t)) + b" " * end
            setattr(self, name, {i: t.encode() if form == "joined" else raw(i, t) for i, t in self.vocab.items()})
        return getattr(self, name)


def codec(path: str) -> Codec:
    """One codec per worker process; its memo serves all tasks of the worker."""
    return common.kept(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (the decoded text) of whole texts, for use as data.

    Null and empty texts give an empty array and an empty string. Repeated rows each get a row; extra
    columns are ignored; an empty table gives an empty result.
    """
    path = path or common.tokenizer_path()

    def one(c: Codec, text: str):
        dec, ids, out = c.decoder(), [], []
        for part in c.encode(text):
            ids += part
            out.append(dec.feed(part))
        return ids, "".join(out) + dec.close()

    return _mapped(docs, path, id_col, text_col, one, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text are hashed as they are emitted and
    never held as a whole. Rules for nulls, repeats, extra columns and empty tables as in `encode`."""
    path = path or common.tokenizer_path()

    def one(c: Codec, text: str):
        import hashlib
        dec, n, ids, out = c.decoder(), 0, hashlib.sha256(), hashlib.sha256()
        name = c.text_of.__getitem__
        for part in c.encode(text):
            if part:
                ids.update(((" " if n else "") + " ".join(map(name, part))).encode())
                n += len(part)
                out.update(dec.feed(part).encode())
        out.update(dec.close().encode())
        return n, ids.hexdigest(), out.hexdigest()

    return _mapped(docs, path, id_col, text_col, one, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, one, fields: list) -> DataFrame:
    common.arrow_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([slim.schema["doc_id"], *fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(out)
        c = codec(path)
        for batch in batches:
            got = [one(c, t or "") for t in batch.column(1).to_pylist()]
            cols = list(zip(*got)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:]))], names=schema.names)

    return slim.mapInArrow(run, out)
