"""Operator 1: toxicity from subword embeddings.

A word is the bag of its character n-grams, each with an embedding (n-grams are
hashed into buckets); a window of words is the average of its words' vectors and
goes through a linear softmax.  Embeddings and softmax are trained jointly, in
numpy, on a bounded sample of labelled rows.  A misspelling that was never seen
shares most n-grams with the word it comes from.

Labels say that a document is toxic, not where.  Training starts with random
windows labelled as their documents and goes on with the windows that the model
so far takes for the most toxic ones.  A document scores as its most toxic
window does, on a scale fitted to the sample, so toxic words don't fade in long
texts.

As the softmax is linear, a trained model is one number a bucket: scoring
averages numbers, not vectors.

Only texts enter a score.  Defined results: null counts as the empty text, which
has no window and scores as the model's bias; repeated rows score alike; an
empty table gives no rows; a sample without labels of both kinds gives the score
0 for all.  Texts of any length are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import labelled_sample

N_GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 4
WINDOW = 3
SAMPLE_PER_LABEL = 1_500
RARE_DOCUMENTS = 20  # a bucket counts for n / (n + this) if n documents of the sample have it
HARD_WINDOWS = 6
SAMPLE_CHARS = 20_000
MEMO_WORDS = 800_000
_WORDS = re.compile(r"\S+")


def word_buckets(word: str) -> list[int]:
    """Buckets of the n-grams of a word with its ends marked."""
    w = f"<{word}>"
    encoded = w.encode("utf-8", "replace")
    if len(encoded) == len(w):  # a byte is a character
        grams = [encoded[i:i + n] for n in N_GRAMS for i in range(len(w) - n + 1)]
    else:
        grams = [w[i:i + n].encode("utf-8", "replace") for n in N_GRAMS for i in range(len(w) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in grams or [encoded]]


def largest_average(values: np.ndarray) -> float:
    """The largest average of ``WINDOW`` neighbours, of all if they are fewer, 0 if none."""
    if len(values) <= WINDOW:
        return float(values.mean()) if len(values) else 0.0
    total = np.concatenate(([0.0], np.cumsum(values)))
    return float((total[WINDOW:] - total[:-WINDOW]).max()) / WINDOW


@dataclass
class ToxicityModel:
    """weights: a number for each bucket; bias; scale and shift of the score."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)
    table: list[float] = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "table": []}

    def word(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.table = self.table or self.weights.tolist()  # single numbers are read faster from a list
            buckets = word_buckets(word)
            got = self.memo[word] = sum(map(self.table.__getitem__, buckets)) / len(buckets)
        return got

    def margin(self, text: str) -> float:
        memo = self.memo
        values = [memo[w] if w in memo else self.word(w) for w in _WORDS.findall(text.lower())]
        return largest_average(np.array(values)) + self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(text) + self.shift, -50, 50))))


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``."""
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1)


class _Adam:
    """Adam with a floor under the step's scale, so that what few examples move
    only a little is not moved as far as what many agree on."""

    def __init__(self, rate: float, floor: float) -> None:
        self.rate, self.floor, self.t, self.m, self.v = rate, floor, 0, {}, {}

    def step(self, **parameters) -> None:
        self.t += 1
        for name, (p, g) in parameters.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + self.floor)


@dataclass
class _Windows:
    """The sample's windows: word_of[start[i]:start[i + 1]] are the words of
    window i, which belongs to document doc_of[i]; grams[w] are word w's buckets."""

    word_of: np.ndarray
    start: np.ndarray
    doc_of: np.ndarray
    grams: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str]) -> _Windows:
        known: dict[str, int] = {}
        word_of, start, doc_of = [], [0], []
        for doc, text in enumerate(texts):
            words = [known.setdefault(w, len(known)) for w in _WORDS.findall(text.lower())]
            word_of += words
            for at in range(0, len(words), WINDOW):
                start.append(start[-1] + min(WINDOW, len(words) - at))
                doc_of.append(doc)
        return cls(np.array(word_of), np.array(start), np.array(doc_of), [np.array(word_buckets(w)) for w in known])

    def word_margins(self, weights: np.ndarray) -> np.ndarray:
        sizes = np.array([len(g) for g in self.grams])
        ends = np.cumsum(sizes)
        return (np.add.reduceat(weights[np.concatenate(self.grams)], ends - sizes) / sizes)[self.word_of]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.word_margins(weights), self.start[:-1]) / np.diff(self.start)

    def best(self, weights: np.ndarray, n_docs: int) -> np.ndarray:
        """Each document's largest average over ``WINDOW`` neighbouring words."""
        of_word = self.word_margins(weights)
        doc = np.repeat(self.doc_of, np.diff(self.start))
        ends = np.searchsorted(doc, np.arange(n_docs), "right")
        return np.array([largest_average(of_word[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)])

    def document_counts(self) -> np.ndarray:
        """In how many documents each bucket occurs."""
        doc = np.repeat(self.doc_of, np.diff(self.start))
        pairs = np.unique(doc * np.int64(len(self.grams)) + self.word_of)
        return np.bincount(np.concatenate([self.grams[w] for w in pairs % len(self.grams)]), minlength=BUCKETS)


def _fit_windows(w: _Windows, chosen: np.ndarray, target: np.ndarray, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray,
                 steps: int, rate: float) -> None:
    """Gradient steps on the chosen windows; both labels weigh the same."""
    n_words = np.diff(w.start)[chosen].astype(float)
    window_of = np.repeat(np.arange(len(chosen)), n_words.astype(int))
    at = np.concatenate([np.arange(w.start[i], w.start[i + 1]) for i in chosen])
    words, word_of = np.unique(w.word_of[at], return_inverse=True)
    n_grams = np.array([len(w.grams[i]) for i in words], dtype=float)
    gram_word = np.repeat(np.arange(len(words)), n_grams.astype(int))
    used, bucket = np.unique(np.concatenate([w.grams[i] for i in words]), return_inverse=True)
    own = vectors[used]
    weight = np.ones(len(chosen))
    for y in (0.0, 1.0):
        weight[target == y] /= max((target == y).sum(), 1)
    adam = _Adam(rate, 1e-5)
    for _ in range(steps):
        word_vectors = _sums(gram_word, own[bucket], len(words)) / n_grams[:, None]
        averages = _sums(window_of, word_vectors[word_of], len(chosen)) / n_words[:, None]
        margins = averages @ softmax + bias
        p = 1 / (1 + np.exp(-np.clip(margins[:, 1] - margins[:, 0], -50, 50)))
        off = ((p - target) * weight)[:, None] * np.array([[-1.0, 1.0]])
        back = _sums(word_of, ((off @ softmax.T) / n_words[:, None])[window_of], len(words)) / n_grams[:, None]
        adam.step(own=(own, _sums(bucket, back[gram_word], len(used))), softmax=(softmax, averages.T @ off), bias=(bias, off.sum(axis=0)))
    vectors[used] = own


def fit(sample: list[tuple[str, int]], turns: int = 6, steps: int = 12, rate: float = 0.1, seed: int = 5) -> ToxicityModel:
    """Joint training.  Each turn takes the windows that the model so far finds
    most toxic: of a toxic document the best and those above even odds, of
    another the best few; the first turn takes random windows."""
    toxic = np.array([y for _, y in sample], dtype=float)
    if len(set(toxic)) < 2 or not any(_WORDS.search(t) for t, _ in sample):
        return ToxicityModel(np.zeros(BUCKETS), shift=-50.0)
    w = _Windows.of([t for t, _ in sample])
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    is_toxic = toxic[w.doc_of] == 1
    seen = w.document_counts()
    trust = seen / (seen + RARE_DOCUMENTS)
    hard = np.zeros(0, dtype=int)
    weights = np.zeros(BUCKETS)
    for turn in range(turns):
        rank = w.margins(weights) if turn else rng.random(len(w.doc_of))
        order = np.lexsort((-rank, w.doc_of))
        place = np.arange(len(order)) - np.searchsorted(w.doc_of, w.doc_of[order])
        if turn:
            even = float(bias[0] - bias[1])
            positive = order[is_toxic[order] & ((place == 0) | (rank[order] > even))]
            hard = np.union1d(hard, order[~is_toxic[order] & (place < HARD_WINDOWS)])
        else:
            positive, hard = order[is_toxic[order] & (place < 20)], order[~is_toxic[order] & (place < 10)]
        chosen = np.concatenate([hard, positive])
        _fit_windows(w, chosen, is_toxic[chosen].astype(float), vectors, softmax, bias, steps, rate)
        weights = (vectors @ (softmax[:, 1] - softmax[:, 0])) * trust
    model = ToxicityModel(weights, float(bias[1] - bias[0]))
    return _calibrate(model, w.best(weights, len(sample)) + model.bias, toxic)


def _calibrate(model: ToxicityModel, margins: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """Logistic fit of the labels on the documents' margins, by Newton steps."""
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        ridge = np.diag([1e-2, 1e-2])
        b -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - toxic) + ridge @ b)
    model.scale, model.shift = float(max(b[0], 0.0)), float(b[1])
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> ToxicityModel:
    return fit(labelled_sample(docs, labels, F.col(label), [0, 1], per_label, SAMPLE_CHARS, key, text))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without ``text``, with the toxicity of each whole text."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded table of weights
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(scores, pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, schema)


def score_held_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text",
                   label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; the model
    learns only from labels whose crc32(id as text) mod 4 is not 2."""
    held_out = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2
    model = train(docs, labels.where(~held_out), key=key, text=text, label=label)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
