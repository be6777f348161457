"""Operator 2: quality by ordinal cumulative-link regression.

A graded rating has ordered grades 0 .. K-1.  The model has one weight for each
hashed text feature, shared by all grades, and K-1 ordered thresholds t(1) < ..:
P(grade >= k) = logistic(w x - t(k)).  From these come the expected grade (their
sum) and the tail probability that documents are selected by.

Features are relative frequencies of: lower-cased words; word shapes (runs of
capitals, small letters and digits as one sign each, other characters as they
are); pairs of neighbouring shapes; a word that repeats the one before it.

The model is fitted in numpy to a bounded sample of rated rows.  Thresholds stay
ordered as their differences are exponentials.

Defined results: null counts as the empty text, which has no features, so the
thresholds alone decide; repeated rows are graded alike; an empty table gives no
rows; other columns are kept by :func:`accept` and ignored by :func:`grade`.
Texts of any length are graded whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import labelled_sample

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 9
SAMPLE_PER_GRADE = 1_500
SAMPLE_CHARS = 20_000
MEMO_WORDS = 200_000
#: Longer words are not remembered.
SHORT = 64
_WORDS = re.compile(r"\S+")
_PAIRS_AT = WORD_BUCKETS + SHAPE_BUCKETS
_REPEAT_AT = _PAIRS_AT + SHAPE_BUCKETS * SHAPE_BUCKETS
N_FEATURES = _REPEAT_AT + 1


def shape(word: str) -> str:
    """The word with each run of one kind of character as one sign."""
    runs, before = [], ""
    for c in word:
        kind = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if kind != before:
            runs.append(kind)
            before = kind
    return "".join(runs)


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % n


@dataclass
class OrdinalModel:
    """weights by feature; thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray
    #: Of a word, its bucket and its shape's as one number: a third of a pair's memory.
    memo: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def _code(self, word: str) -> int:
        code = _bucket(word.lower(), WORD_BUCKETS) * SHAPE_BUCKETS + _bucket(shape(word), SHAPE_BUCKETS)
        if len(word) <= SHORT:
            self.memo[word] = code
        return code

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and their relative frequencies."""
        memo, words = self.memo, _WORDS.findall(text)
        if not words:
            return np.zeros(0, dtype=int), np.zeros(0)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        codes = np.array([memo[w] if w in memo else self._code(w) for w in words])
        shapes = codes % SHAPE_BUCKETS
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        numbers = np.concatenate([codes // SHAPE_BUCKETS, WORD_BUCKETS + shapes, _PAIRS_AT + shapes[:-1] * SHAPE_BUCKETS + shapes[1:], [_REPEAT_AT]])
        shares = np.full(len(numbers), 1 / len(words))
        shares[-1] *= repeats
        return numbers, shares

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1."""
        numbers, shares = self.features(text)
        return 1 / (1 + np.exp(-np.clip(self.weights[numbers] @ shares - self.thresholds, -50, 50)))


def fit(sample: list[tuple[str, int]], grades: int, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood with a small ridge.  P(y = k) is the difference of
    neighbouring tails; grades weigh alike, however many rows they have."""
    model = OrdinalModel(np.zeros(N_FEATURES), np.linspace(-0.5, 0.5, grades - 1))
    y = np.array([g for _, g in sample], dtype=int)
    if not len(y):
        return model
    rows, numbers, shares = [], [], []
    for i, (text, _) in enumerate(sample):
        n, s = model.features(text)
        distinct, at = np.unique(n, return_inverse=True)
        rows.append(np.full(len(distinct), i))
        numbers.append(distinct)
        shares.append(np.bincount(at, s, len(distinct)))
    row, x = np.concatenate(rows), np.concatenate(shares)
    used, number = np.unique(np.concatenate(numbers), return_inverse=True)
    weight = 1.0 / np.bincount(y, minlength=grades)[y]
    weight /= weight.sum()
    w, first, gaps = np.zeros(len(used)), -0.5, np.zeros(max(grades - 2, 0))
    m, v = [np.zeros(len(w)), 0.0, np.zeros(len(gaps))], [np.zeros(len(w)), 0.0, np.zeros(len(gaps))]
    for t in range(1, steps + 1):
        thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        margin = np.bincount(row, w[number] * x, len(y))
        tail = 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -50, 50)))
        edges = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], axis=1)
        slopes = edges * (1 - edges)
        here = np.arange(len(y))
        p = np.maximum(edges[here, y] - edges[here, y + 1], 1e-9)
        d_margin = -weight * (slopes[here, y] - slopes[here, y + 1]) / p
        d_threshold = np.zeros((len(y), grades + 1))
        d_threshold[here, y] += weight * slopes[here, y] / p
        d_threshold[here, y + 1] -= weight * slopes[here, y + 1] / p
        d_t = d_threshold[:, 1:grades].sum(axis=0)
        after = np.cumsum(d_t[::-1])[::-1]
        grads = [np.bincount(number, d_margin[row] * x, len(w)) + ridge * w, after[0], after[1:] * np.exp(gaps)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
        step = [rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-5) for a, b in zip(m, v, strict=True)]
        w, first, gaps = w - step[0], first - 0.2 * step[1], gaps - 0.2 * step[2]
    model.weights[used] = w
    model.thresholds = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return model


def train(docs: DataFrame, labels: DataFrame, rating: Column, grades: int, per_grade: int = SAMPLE_PER_GRADE,
          key: str = "doc_id", text: str = "text") -> OrdinalModel:
    return fit(labelled_sample(docs, labels, rating, list(range(grades)), per_grade, SAMPLE_CHARS, key, text), grades)


def _graded(docs: DataFrame, model: OrdinalModel, text: str, keep_text: bool, out: tuple[str, str], select_grade: int) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in out and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded table of weights
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{x}` double" for x in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            tails = np.array([m.tails(t.as_py() or "") for t in batch.column(text)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(tails.sum(axis=1)), pa.array(tails[:, select_grade - 1])],
                                             names=[*names, *out])

    return docs.mapInArrow(run, schema)


def grade(docs: DataFrame, model: OrdinalModel, select_grade: int = 1, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``select_grade`` or more)
    and accepted (that is ``threshold`` or more) for each row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return (_graded(rows, model, "text", False, ("expected_grade", "tail_probability"), select_grade)
            .withColumn("accepted", F.col("tail_probability") >= threshold))


def accept(docs: DataFrame, model: OrdinalModel, select_grade: int = 1, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are accepted, with their columns."""
    out = ("__expected", "__tail")
    return _graded(docs, model, text, True, out, select_grade).where(F.col(out[1]) >= threshold).drop(*out)
