"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole. Every token keeps its character span, and the sorted spans are
merged with the sorted section spans (an interval join inside the document). A token that crosses a section
boundary goes, whole, by one explicit rule: "majority" - the section that holds most of its characters, the
earlier one on a tie - or "start" - the section of its first character.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common
from pricelens.llm.bpe import byte_symbols

RULES = ("majority", "start")


class SpanEncoder:
    """Character spans of the tokens of whole texts for a byte-level BPE file; special strings are ordinary text.

    The file's vocabulary goes to tiktoken, which gives a whole text's ids as one array. Its pattern engine gives
    up on very long runs of one kind of sign; those texts go, whole, through the tokenizers library. Spans are
    sums of the tokens' byte lengths; a token that holds part of a character's bytes spans that whole character.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("the file's merges are not in the order of their ids")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern engine's stack
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def spans(self, text: str) -> np.ndarray:
        """(tokens, 2) start and end characters, in order."""
        data = text.encode()
        if not data:
            return np.zeros((0, 2), np.int64)
        ends = np.cumsum(self.bytes_of[self._ids(text)])
        if int(ends[-1]) != len(data):
            raise ValueError("the file's tokens do not cover the text")
        starts = np.concatenate([[0], ends[:-1]])
        if len(data) != len(text):
            char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
            starts, ends = char[starts], char[ends - 1] + 1
        return np.stack([starts, ends], axis=1)


def line_sections(text: str) -> np.ndarray:
    """Sections of a text: its lines, each with its line feed; an empty text has one empty section."""
    ends = _ends(text)
    if not ends or ends[-1] < len(text) or not text:
        ends = [*ends, len(text)]
    return np.array([[0, *ends[:-1]], ends], np.int64).T


def _ends(text: str) -> list[int]:
    out, at = [], 0
    while (at := text.find("\n", at) + 1) > 0:
        out.append(at)
    return out


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(section number or -1, whether it crosses a section's edge) of each token.

    Sections are sorted and do not overlap; gaps are allowed, and a token wholly in a gap has no section.
    """
    starts, ends = sections[:, 0], sections[:, 1]
    full = ends > starts
    number, starts, ends = np.nonzero(full)[0], starts[full], ends[full]
    if not len(number) or not len(spans):
        return np.full(len(spans), -1), np.zeros(len(spans), bool)
    first = np.searchsorted(ends, spans[:, 0], side="right")  # first section that ends after the token's start
    last = np.searchsorted(starts, np.maximum(spans[:, 1], spans[:, 0] + 1), side="left") - 1
    inside = first <= last
    low = np.minimum(first, len(number) - 1)
    crosses = inside & ((first < last) | (spans[:, 0] < starts[low]) | (spans[:, 1] > ends[low]))
    chosen = np.where(inside, low, -1)
    if rule == "start":
        outside = crosses & (spans[:, 0] < starts[low])
        chosen[outside] = -1
    else:
        for t in np.nonzero(crosses & (first < last))[0]:
            s = np.arange(first[t], last[t] + 1)
            chosen[t] = s[np.argmax(np.minimum(ends[s], spans[t, 1]) - np.maximum(starts[s], spans[t, 0]))]
    return np.where(chosen >= 0, number[chosen], -1), crosses


_ENCODERS: dict[str, SpanEncoder] = {}


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 sections_col: str | None = None, rule: str = "majority") -> DataFrame:
    """One row per document and section: doc_id, section, char_start, char_end, n_tokens, n_crossing.

    Sections are the lines of the text, or the spans array<struct<start,end>> of `sections_col` (sorted, not
    overlapping; with it, tokens of gaps come in a row whose section, start and end are null, if there are any).
    n_crossing counts the section's tokens that cross one of its edges. Null texts count as empty: one
    empty section with no token. Repeated rows each give their rows; extra columns are ignored; an empty
    table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    common.arrow_batches(docs.sparkSession)
    path = path or common.tokenizer_path(common.BYTE_BPE)
    cols = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    slim = docs.select(*cols, *([F.col(f"`{sections_col}`").alias("sections")] if sections_col else []))
    out = T.StructType([slim.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("section", "char_start", "char_end", "n_tokens", "n_crossing"))])

    def run(batches):
        import pyarrow as pa
        if path not in _ENCODERS:
            _ENCODERS[path] = SpanEncoder(path)
        enc = _ENCODERS[path]
        for batch in batches:
            given = batch.column(2).to_pylist() if sections_col else None
            rows, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                if given is None:
                    sections = line_sections(text)
                else:
                    sections = np.array([(s["start"], s["end"]) for s in given[i] or ()], np.int64).reshape(-1, 2)
                spans = enc.spans(text)
                where, crosses = attribute(spans, sections, rule)
                n = len(sections)
                table = np.stack([np.arange(n), sections[:, 0], sections[:, 1], np.bincount(where[where >= 0], minlength=n)[:n], np.bincount(where[crosses & (where >= 0)], minlength=n)[:n]])
                gap = int((where < 0).sum())
                if gap:
                    table = np.concatenate([table, [[-1], [-1], [-1], [gap], [int(crosses[where < 0].sum())]]], axis=1)
                rows += [i] * table.shape[1]
                parts.append(table)
            table = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            none = table[0] < 0
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(table[k], pa.int64(), mask=none if k < 3 else None) for k in range(5))], names=[f.name for f in out])

    return slim.mapInArrow(run, out)
