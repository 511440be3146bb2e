"""Toxicity of restored text: a noisy channel is undone by Viterbi decoding before a classifier scores.

1. A character trigram model is counted over all documents (partial counts per partition, summed by Spark).
2. A token written in leetspeak, letter by letter or with repeated letters becomes a lattice of what each
   sign may stand for; the Viterbi path under the character model and the channel's costs is the restored word.
3. Restored words and their beginnings are the features of a logistic regression, fitted on a bounded sample of
   labelled training rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common
from pricelens.llm.bpe import Memo

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE_ROWS = 4000
#: Features kept by the classifier, at most.
FEATURES = 2500
FOLDS = 5

#: What a sign may stand for besides itself (fixed values).
CHANNEL = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs that may be strewn between the letters of a word.
STREWN = ".-_*~'·"
#: Costs in nats of reading a sign as a letter, of dropping a strewn sign, of shortening a run of one letter.
COST_LEET, COST_STREWN, COST_RUN, COST_KEPT_SIGN = 1.5, 0.5, 1.0, 6.0

#: Letters a-z are 1-26, any other letter 27, all else 0.
CLASSES = 28
_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_ODD = re.compile(r"[0-9@$!|+(€]")
_words = re.compile(r"[^\W\d_]+").findall


def classes(text: str) -> np.ndarray:
    """Class of each character of a lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(codes), np.int64)
    low = (codes >= 97) & (codes <= 122)
    out[low] = codes[low] - 96
    out[(codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00))] = 27
    return out


class CharModel:
    """Smoothed trigram model over character classes: cost[a, b, c] in nats."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 5 * p1[None, :]) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None, :, :]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def restore(self, token: str) -> str:
        """Most likely reading of a lower-cased token."""
        kind = lambda ch: ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0
        # A path is a chain (path before, piece). Where one state is left, or where all chains begin alike, that part is
        # settled and moves to `made`: time and memory grow with the token's length, not with its square.
        made: list[str] = []
        states: dict[tuple, tuple] = {(0, 0): (0.0, None)}
        for step, (ch, run) in enumerate(_runs(token)):
            if len(states) == 1:
                (a, b), (_, path) = next(iter(states.items()))
                made += _pieces(path)
                if run == 1 and ch.isalpha():
                    made.append(ch)
                    states = {(b, kind(ch)): (0.0, None)}
                    continue
                states = {(a, b): (0.0, None)}
            elif step % 4096 == 0:
                states = _settle(states, made)
            arcs = []
            if ch.isalpha():
                arcs += [(ch * n, 0.0 if n == run else COST_RUN) for n in sorted({min(run, 2), 1} | ({run} if run < 3 else set()))]
            else:
                arcs.append((ch * run, COST_KEPT_SIGN * run))
                arcs += [(c * n, COST_LEET * n + COST_RUN * (run - n > 0)) for c in CHANNEL.get(ch, "") for n in sorted({1, min(run, 2)})]
                if ch in STREWN:
                    arcs.append(("", COST_STREWN * run))
            after: dict[tuple, tuple] = {}
            for (a, b), (total, path) in states.items():
                for piece, price in arcs:
                    x, y, t = a, b, total + price
                    for c in piece[:3]:
                        z = kind(c)
                        t += self.cost[x][y][z]
                        x, y = y, z
                    best = after.get((x, y))
                    if best is None or t < best[0]:
                        after[x, y] = (t, (path, piece))
            states = after
        ends = [(t + self.cost[a][b][0], path) for (a, b), (t, path) in states.items()]
        low = min(t for t, _ in ends)
        return "".join(made) + min("".join(_pieces(path)) for t, path in ends if t == low)


def _pieces(path) -> list[str]:
    out = []
    while path is not None:
        path, piece = path
        out.append(piece)
    return out[::-1]


def _settle(states: dict, made: list) -> dict:
    """Move the beginning that all chains share to `made`; the states keep the rest."""
    chains = []
    for _, path in states.values():
        nodes = []
        while path is not None:
            nodes.append(path)
            path = path[0]
        chains.append(nodes[::-1])
    shared = 0
    while all(len(c) > shared and c[shared] is chains[0][shared] for c in chains):
        shared += 1
    made += [node[1] for node in chains[0][:shared]]
    out = {}
    for (state, (total, _)), nodes in zip(states.items(), chains):
        path = None
        for node in nodes[shared:]:
            path = (path, node[1])
        out[state] = (total, path)
    return out


def _runs(token: str):
    at = 0
    while at < len(token):
        end = at + 1
        while end < len(token) and token[end] == token[at]:
            end += 1
        yield token[at], end - at
        at = end


def tokens_of(text: str) -> list[str]:
    """Blank-separated lower-case tokens; three or more single signs in a row become one strewn token."""
    tokens = text.lower().split()
    if min(map(len, tokens), default=9) > 1:
        return tokens
    out, row = [], []
    for t in [*tokens, "  "]:
        if len(t) == 1 and (t.isalnum() or t in CHANNEL):
            row.append(t)
            continue
        out += ["-".join(row)] if len(row) > 2 else row
        row = []
        out.append(t)
    out.pop()
    return out


def restored(token: str, model: CharModel) -> list[str]:
    """Words of one token after deobfuscation; a plain word stands for itself.

    A word of letters only with doubled letters may be natural or disguised: it stands for itself and for its
    reading through the lattice. So does a token with a '(' or a trailing '$' or '|' at its edge, which may be
    punctuation or a letter. Digits that the lattice keeps are no words, which leaves most of a number out.
    """
    core = token.strip("#%&*.,;:?\"'()[]{}<>~`=^")
    core = core.rstrip("!$|") if len(core.rstrip("!$|")) > 1 else core
    if core.isalpha() and not _RUN.search(core):
        words = [core]
        if _DOUBLE.search(core):
            words += [w for w in _words(model.restore(core)) if w != core]
    elif _ODD.search(core) or _RUN.search(core) or any(c in STREWN for c in core):
        words = _words(model.restore(core))
    else:
        words = _words(core)
    signs = token.strip("#%&*.,;:?\"')[]{}<>~`=^").rstrip("!")
    if core and signs != core:
        words += [w for w in _words(model.restore(signs)) if w not in words]
    return words


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(4, 8) if len(word) > k)]


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of all texts. The table has CLASSES ** 3 = 21,952 cells, whatever the corpus."""
    size = CLASSES ** 3

    def run(batches):
        import pyarrow as pa
        total = np.zeros(size, np.int64)
        for batch in batches:
            text = "\n\n".join(x or "" for x in batch.column(0).to_pylist()).lower()
            c = classes(text)
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


def _values(counts: np.ndarray, n_words: float) -> np.ndarray:
    """Feature values of one document: how often against its length, saturating."""
    return counts / (counts + 0.5 + n_words / 150)


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, sample_rows: int):
    """(text, y) of the sample, and the share of label 1 among all training labels."""
    marks = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
             .groupBy("id").agg(F.max("y").alias("y")).where(common.fold("id", folds) != 0))
    marks = common.staged(marks, "training-labels")
    share = marks.agg(F.avg("y")).first()[0]
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = marks.where("y = 1").orderBy(*by_hash).limit(sample_rows).unionByName(marks.where("y = 0").orderBy(*by_hash).limit(sample_rows))
    # At most 2 * sample_rows ids and labels: small enough to broadcast by construction.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    return rows.select("text", "y"), share


def _fit(cost_counts: np.ndarray, n_features: int):
    """mapInArrow body, one task over the bounded sample: selects features and fits their weights."""

    def run(batches):
        import pyarrow as pa
        model = CharModel(cost_counts)
        numbers = common.Numbers()
        memo = Memo(lambda t: tuple(numbers[f] for w in restored(t, model) for f in features_of(w)))
        # The sample as sparse rows: which features a document has, and how often.
        cols, counts, sizes, lengths, ys = [], [], [], [], []
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = tokens_of(text or "")
                found = np.fromiter((f for t in tokens for f in memo[t]), np.int32)
                at, n = np.unique(found, return_counts=True)
                cols.append(at)
                counts.append(n.astype(np.int32))
                sizes.append(len(at))
                lengths.append(len(tokens))
                ys.append(y)
        y, names = np.array(ys, float), list(numbers)
        col = np.concatenate([np.zeros(0, np.int32), *cols])
        row = np.repeat(np.arange(len(ys)), sizes)
        in1 = np.bincount(col, y[row] if len(row) else None, minlength=len(names))
        in0 = np.bincount(col, minlength=len(names)) - in1
        n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
        pool = (in0 + in1) / (n0 + n1)
        strength = np.abs(in1 / n1 - in0 / n0) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0) + 1e-9)
        chosen = sorted(np.flatnonzero(in0 + in1 >= 3).tolist(), key=lambda f: (-strength[f], names[f]))[:n_features]
        ranked = [names[f] for f in chosen]
        place = np.full(len(names) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        kept = place[col] >= 0
        value = _values(np.concatenate([np.zeros(0), *counts])[kept], np.array(lengths, float)[row[kept]])
        row, col = row[kept], place[col[kept]]
        w, b = np.zeros(len(ranked)), 0.0
        m, v = np.zeros(len(ranked) + 1), np.zeros(len(ranked) + 1)
        for step in range(1, 301 if len(ys) else 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], minlength=len(y)) + b, -30, 30)))
            err = (p - y) / len(y)
            g = np.append(np.bincount(col, value * err[row], minlength=len(ranked)) + 2e-4 * w, err.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        yield pa.RecordBatch.from_arrays([pa.array([*ranked, ""], pa.string()), pa.array([*w.tolist(), float(b)], pa.float64()), pa.array([int(n1)] * (len(ranked) + 1), pa.int64()), pa.array([int(n0)] * (len(ranked) + 1), pa.int64())], ["feature", "weight", "n1", "n0"])

    return run


class Scorer:
    """Score of a text under fitted weights; picklable, at most FEATURES weights and the character model. A worker keeps
    the lattice and the memo of the last model it scored with, so later tasks start warm."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias
        self.key = hashlib.sha256(repr((bias, sorted(weights.items()))).encode() + counts.tobytes()).hexdigest()

    def _unpack(self) -> tuple[Memo, np.ndarray]:
        model, number = CharModel(self.counts), {f: i for i, f in enumerate(self.weights)}
        memo = Memo(lambda t: tuple(number[f] for w in restored(t, model) for f in features_of(w) if f in number))
        return memo, np.array(list(self.weights.values()))

    def score(self, text: str) -> float:
        memo, w = common.kept(("toxicity", self.key), self._unpack)
        tokens = tokens_of(text)
        hits = [i for found in map(memo.__getitem__, tokens) for i in found]
        logit = self.bias
        if hits:
            at, n = np.unique(hits, return_counts=True)
            logit += float(_values(n, len(tokens)) @ w[at])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Scorer:
    """Character model over all of `docs`; classifier from labels whose fold is not 0.

    Labels are never inputs of a score. Several labels of one id count as toxic if one does. Without any
    training label all scores are 0.
    """
    common.arrow_batches(docs.sparkSession)
    counts = character_counts(docs, text_col)
    rows, share = _training_rows(docs, labels, id_col, text_col, label_col, folds, sample_rows)
    if share is None:
        return Scorer(counts, {}, -30.0)
    share = min(max(share, 1e-6), 1 - 1e-6)
    out = rows.repartition(1).sortWithinPartitions("y", "text").mapInArrow(_fit(counts, n_features), "feature string, weight double, n1 long, n0 long").toArrow().to_pylist()
    if not out:
        return Scorer(counts, {}, -30.0)
    weights = {r["feature"]: r["weight"] for r in out if r["feature"]}
    bias = next(r["weight"] for r in out if not r["feature"])
    # The sample is drawn by class; shift the odds back to those of all training labels.
    bias += math.log(share / (1 - share)) - math.log(out[0]["n1"] / out[0]["n0"])
    return Scorer(counts, weights, bias)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without features. A null id is held out. Repeated rows
    each get a row; extra columns are ignored; an empty table gives an empty result.
    """
    scorer = train(docs, labels, id_col, text_col, label_col, folds, **how)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return slim.mapInArrow(run, out).select("doc_id", F.coalesce(common.fold("doc_id", folds) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_mild(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """The rows of `docs` scored below 0.5, with all their columns, in one pass after training."""
    scorer = train(docs, labels, id_col, text_col, label_col, **how)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            col = batch.column(0)
            mild = pa.array([scorer.score(t or "") < 0.5 for t in col.field(text_col).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([col.filter(mild)], ["row"])

    row = docs.select(common.row_struct(docs).alias("row"))
    return row.mapInArrow(run, row.schema).select("row.*")
