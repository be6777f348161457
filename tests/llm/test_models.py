"""Operators 1 and 2: held-out accuracy and edge rows."""

import random
import zlib

import numpy as np
import pytest

from tablewright.llm import ordinal_quality as oq, queries, toxicity as tx
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs, labels, prose

BAD = ["stupid", "idiot", "moron", "trash"]


def _corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(seed * 10_000 + i, r.randint(5, 200)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_held_out_and_misspelled():
    model = tx.fit(_corpus(400, 1))
    test = _corpus(200, 2)
    scores = np.array([model.score(t) for t, _ in test])
    toxic = np.array([y for _, y in test]) == 1
    assert ((scores >= 0.3) == toxic).mean() > 0.93
    clean = prose(77, 50)
    for word in ("stupiid", "idiott", "moronn"):
        assert model.score(f"{clean} {word} {clean}") > 10 * model.score(f"{clean} {clean}")


def test_toxic_word_does_not_fade_in_long_texts():
    model = tx.fit(_corpus(400, 1))
    before, after = prose(5, 5000), prose(6, 5000)
    near = " ".join([*before.split()[-2:], "idiot", *after.split()[:2]])
    assert model.score(f"{before} idiot {after}") >= model.score(near) >= 0.3
    words = "the of and to in".split()
    assert model.score(" ".join(words * 1000)) < 0.3


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    ids = [i for i, *_ in edge_rows() if i]
    marks = labels(spark, [(i, 1, i % 2) for i in ids] + [(1, None, None), (None, 1, 1), (999, 1, 1)])
    got = tx.score_held_out(docs, marks).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    none = tx.score_held_out(docs, labels(spark, [])).collect()
    assert len(none) == len(got) and all(r.score < 1e-9 for r in none)
    assert tx.score_held_out(empty_docs(spark), marks).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_corpus(120, 4))], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = labels(spark, [(i, 1, y) for i, (_, y) in enumerate(_corpus(120, 4))])
    b = labels(spark, [(i, 1, 1 - y if held(i) else y) for i, (_, y) in enumerate(_corpus(120, 4))])
    one, other = (sorted(map(tuple, tx.score_held_out(docs, x).collect())) for x in (a, b))
    assert one == other


def _graded(n, seed):
    out = []
    for i in range(n):
        g, t = i % 3, prose(seed * 10_000 + i, 60)
        out.append((" ".join(w.upper() + "!!" for w in t.split()) if g == 0 else t + " stupid idiot trash" if g == 1 else t, g))
    return out


def test_ordinal_grades_held_out():
    model = oq.fit(_graded(300, 1), 3)
    assert model.thresholds[0] < model.thresholds[1]
    tails = np.array([model.tails(t) for t, _ in _graded(150, 2)])
    grade = np.array([g for _, g in _graded(150, 2)])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 0] >= 0.5) == (grade >= 1)).mean() > 0.97
    expected = tails.sum(axis=1)
    assert expected[grade == 0].mean() < expected[grade == 1].mean() < expected[grade == 2].mean()


def test_ordinal_features_and_shapes():
    assert oq.shape("Hello!!") == "Aa!" and oq.shape("x12y") == "a9a" and oq.shape("Über") == "Aa"
    model = oq.OrdinalModel(np.zeros(oq.N_FEATURES), np.array([0.0]))
    numbers, shares = model.features("a a B")
    assert len(numbers) == 3 + 3 + 2 + 1 and shares[-1] == pytest.approx(1 / 3)
    assert model.features("")[0].size == 0 and model.tails("")[0] == 0.5


def test_quality_edges(spark):
    docs = edge_docs(spark)
    ids = [i for i, *_ in edge_rows() if i]
    marks = labels(spark, [(i, i % 2, 0) for i in ids] + [(1, None, 1), (None, 1, 1), (999, 1, 1)])
    model = oq.train(docs, marks, queries.rating(), 3)
    got = oq.grade(docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.tail_probability <= r.expected_grade + 1e-12 <= 2.1 for r in got)
    kept = oq.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)
    empty = oq.train(empty_docs(spark), labels(spark, []), queries.rating(), 3)
    assert oq.grade(empty_docs(spark), empty).count() == 0 and oq.accept(empty_docs(spark), empty).count() == 0


def test_ordinal_memo_is_small():
    """A word is remembered as one number, a long one not at all, and the features are those of each word alone."""
    model = oq.OrdinalModel(np.zeros(oq.N_FEATURES), np.zeros(2))
    words = ["Word", "word,", "x" * 65, "Word", "9" * 70_000, "a1B", "é" * 64]
    for _ in range(2):
        numbers, shares = model.features(" ".join(words))
        shapes = [oq._bucket(oq.shape(w), oq.SHAPE_BUCKETS) for w in words]
        assert numbers[:len(words)].tolist() == [oq._bucket(w.lower(), oq.WORD_BUCKETS) for w in words]
        assert numbers[len(words):2 * len(words)].tolist() == [oq.WORD_BUCKETS + s for s in shapes]
        assert len(numbers) == len(shares) == 3 * len(words)
    assert set(model.memo) == {"Word", "word,", "a1B", "é" * 64} and {type(x) for x in model.memo.values()} == {int}
