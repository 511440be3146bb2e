"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has affix, character n-gram and lexicon features; learned transitions tie neighbouring words, so
the words of code-switched text are labelled by forward-backward. A document's language is the one with the
largest share of the words' marginal probabilities.

Forward-backward runs over all documents of a batch at once: the step into a document's first word forgets what
came before, the chain is cut into blocks whose transfer matrices are multiplied side by side, and only
the short chain of blocks is walked one by one. The result is that of the plain recursion.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.llm import common
from pricelens.llm.bpe import Memo

#: Labelled documents of each language that the field is fitted on, at most.
SAMPLE_ROWS = 150
FOLDS, HELD_OUT = 3, 1
#: Hashed feature space.
DIMENSIONS = 1 << 17
STEPS = 40
L2 = 1e-6
BLOCK = 64
#: Least log potential of a word against its best language: very long runs sum many weights, and exp() must not underflow.
LEAST = -200.0
UNKNOWN = "und"

words_of = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[int]:
    """Hashed features: the word itself (lexicon), affixes of one to three letters, bigrams and trigrams."""
    import zlib
    marked = f"<{word}>"
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3)),
             *(f"g{marked[i:i + 2]}" for i in range(len(marked) - 1)), *(f"g{marked[i:i + 3]}" for i in range(len(marked) - 2))]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


class Chain:
    """Forward-backward for a transition matrix (log potentials) and start potentials."""

    def __init__(self, transition: np.ndarray, start: np.ndarray):
        self.step = np.exp(transition - transition.max())
        self.begin = np.exp(start - start.max())

    def marginals(self, emission: np.ndarray, first: np.ndarray, pairs: bool = False):
        """emission (n, k) log potentials; first (n,) marks the first word of a document -> (n, k) marginals.

        With `pairs`, also the summed (k, k) marginals of neighbouring words within documents."""
        n, k = emission.shape
        size = -(-n // BLOCK) * BLOCK
        e = np.ones((size, k))
        e[:n] = np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), LEAST))
        head = np.ones(size, bool)
        head[:n] = first
        blocks = size // BLOCK
        e, head = e.reshape(blocks, BLOCK, k), head.reshape(blocks, BLOCK)
        fresh = np.broadcast_to(self.begin, (k, k))  # any state before a document leads to its start potentials

        def steps(t):
            return np.where(head[:, t, None, None], fresh, self.step) * e[:, t, None, :]

        transfer = np.broadcast_to(np.eye(k), (blocks, k, k))
        for t in range(BLOCK):
            transfer = np.einsum("bij,bjk->bik", transfer, steps(t))
            transfer = transfer / transfer.sum(axis=(1, 2), keepdims=True)
        enter, leave = np.zeros((blocks, k)), np.zeros((blocks, k))
        vector = np.full(k, 1 / k)
        for b in range(blocks):
            enter[b] = vector
            vector = vector @ transfer[b]
            vector = vector / vector.sum()
        vector = np.ones(k)
        for b in range(blocks - 1, -1, -1):
            leave[b] = vector
            vector = transfer[b] @ vector
            vector = vector / vector.sum()
        forward = np.zeros((blocks, BLOCK, k))
        state = enter
        for t in range(BLOCK):
            state = np.where(head[:, t, None], self.begin * state.sum(axis=1, keepdims=True), state @ self.step) * e[:, t]
            state = state / state.sum(axis=1, keepdims=True)
            forward[:, t] = state
        backward = np.zeros((blocks, BLOCK, k))
        state = leave
        for t in range(BLOCK - 1, -1, -1):
            backward[:, t] = state
            weighed = e[:, t] * state
            state = np.where(head[:, t, None], (weighed @ self.begin)[:, None], weighed @ self.step.T)
            state = state / state.sum(axis=1, keepdims=True)
        out = (forward * backward).reshape(size, k)[:n]
        out /= out.sum(axis=1, keepdims=True)
        if not pairs:
            return out
        f, b, flat = forward.reshape(size, k)[:n - 1], backward.reshape(size, k)[1:n], e.reshape(size, k)[1:n]
        joint = f[:, :, None] * self.step[None] * (flat * b)[:, None, :]
        joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
        return out, joint[~first[1:n]].sum(axis=0)


def _fit(langs: list[str], steps: int):
    """mapInArrow body, one task over the bounded sample: weights by Adam on the conditional likelihood."""

    def run(batches):
        import pyarrow as pa
        number: dict[str, int] = {}
        ids, labels, first = [], [], []
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of((text or "").lower())
                if words:
                    ids += [number.setdefault(w, len(number)) for w in words]
                    labels += [langs.index(lang)] * len(words)
                    first += [True] + [False] * (len(words) - 1)
        k = len(langs)
        weights, trans, start = np.zeros((DIMENSIONS, k)), np.zeros((k, k)), np.zeros(k)
        if ids:
            ids, labels, first = np.array(ids), np.array(labels), np.array(first)
            lists = [features_of(w) for w in number]
            flat = np.concatenate(lists)
            sizes = np.array([len(x) for x in lists])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            used, slot = np.unique(flat, return_inverse=True)
            order = np.argsort(slot, kind="stable")
            runs = np.concatenate([[0], np.nonzero(np.diff(slot[order]))[0] + 1])
            owner = np.repeat(np.arange(len(lists)), sizes)[order]
            gold = np.eye(k)[labels]
            inner = ~first[1:]
            gold_pairs = np.zeros((k, k))
            np.add.at(gold_pairs, (labels[:-1][inner], labels[1:][inner]), 1)
            gold_start = gold[first].sum(axis=0)
            theta = np.zeros(len(used) * k + k * k + k)
            m, v = np.zeros_like(theta), np.zeros_like(theta)
            cut = len(used) * k
            for step in range(1, steps + 1):
                w = theta[:cut].reshape(-1, k)
                emission = np.add.reduceat(w[slot], begins, axis=0)
                chain = Chain(theta[cut:cut + k * k].reshape(k, k), theta[cut + k * k:])
                got, pairs = chain.marginals(emission[ids], first, pairs=True)
                miss = got - gold
                per_word = np.stack([np.bincount(ids, miss[:, j], len(lists)) for j in range(k)], axis=1)
                g_words = np.add.reduceat(per_word[owner], runs, axis=0)
                g = np.concatenate([g_words.ravel(), (pairs - gold_pairs).ravel(), got[first].sum(axis=0) - gold_start]) / len(ids) + L2 * theta
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                theta = theta - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
            weights[used] = theta[:cut].reshape(-1, k)
            trans, start = theta[cut:cut + k * k].reshape(k, k), theta[cut + k * k:]
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([trans.astype("<f8").tobytes()]), pa.array([start.astype("<f8").tobytes()])], ["weights", "trans", "start"])

    return run


class Tagger:
    """A fitted field: DIMENSIONS x languages floats, so its size does not depend on the corpus."""

    def __init__(self, langs: list[str], weights: bytes, trans: bytes, start: bytes):
        self.langs, self._state = langs, (weights, trans, start)
        self._ready = None

    def __getstate__(self):
        return self.langs, self._state

    def __setstate__(self, state):
        self.langs, self._state = state
        self._ready = None

    def _load(self):
        k = len(self.langs)
        weights = np.frombuffer(self._state[0], "<f4").reshape(-1, k)
        chain = Chain(np.frombuffer(self._state[1], "<f8").reshape(k, k), np.frombuffer(self._state[2], "<f8"))
        self._ready = Memo(lambda w: weights[features_of(w)].sum(axis=0).astype("<f4").tobytes()), chain

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginal probabilities (words, languages) of each list of lower-cased words."""
        k, sizes = len(self.langs), np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not k:
            return [np.zeros((0, k)) for _ in texts]
        if self._ready is None:
            self._load()
        memo, chain = self._ready
        emission = np.frombuffer(b"".join([memo[w] for t in texts for w in t]), "<f4").reshape(-1, k).astype(float)
        first = np.zeros(len(emission), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        return np.split(chain.marginals(emission, first), ends[:-1])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, share of the marginals) of each text; texts without a letter are unknown with score 0."""
        words = [words_of((t or "").lower()) for t in texts]
        out = []
        for share in (m.mean(axis=0) if len(m) else None for m in self.label(words)):
            best = None if share is None or not len(share) else int(np.argmax(share))
            out.append((UNKNOWN, 0.0) if best is None else (self.langs[best], float(min(1.0, share[best]))))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS,
          held_out: int = HELD_OUT, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Tagger:
    """Field fitted on whole texts of at most `sample_rows` documents per language, outside the held-out fold."""
    common.arrow_batches(docs.sparkSession)
    known = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
             .where("lang is not null and id is not null and text is not null").where(common.fold("id", folds) != held_out))
    # row_number() <= n keeps n candidates per language in each task before anything is shuffled.
    ranked = known.select("id", "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= sample_rows)
    chosen = common.staged(ranked.select("id", "lang"), "language-sample")
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    if not langs:
        return Tagger([], b"", b"", b"")
    # sample_rows ids per language: small enough to broadcast by construction.
    rows = known.join(F.broadcast(chosen.distinct()), ["id", "lang"]).select("text", "lang", "id")
    row = rows.repartition(1).sortWithinPartitions("lang", "id", "text").select("text", "lang").mapInArrow(_fit(langs, steps), "weights binary, trans binary, start binary").first()
    return Tagger(langs, bytes(row["weights"]), bytes(row["trans"]), bytes(row["start"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, **how) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1).

    Null texts and texts without a letter are `und` with score 0, as is all text when no row has a
    language. A null id is held out. Ties go to the first language in order. Repeated rows each get a row;
    extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tagger = train(docs, id_col, text_col, lang_col, folds, held_out, **how)
    model = spark.sparkContext.broadcast(tagger)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = T.StructType([slim.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, out).select("doc_id", F.coalesce(common.fold("doc_id", folds) == held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
