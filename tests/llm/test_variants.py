"""Operator 11 against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import variants
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_length=5, min_count=3, drop_every=97, ratio=2):
    n = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    out, form = {}, {}
    for w in n:
        near = sorted((v for v in n if distance_is_one(w, v)), key=lambda v: (-n[v], v))
        form[w] = near[0] if near and n[near[0]] >= ratio * n[w] else None
        out[w] = (len(near), n.get(form[w]))
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], *out[w]))
    return rows


def typos(seed, n_words, n_rows):
    r = random.Random(seed)
    letters = "abcdeéßÿ÷"
    words = ["".join(r.choice(letters) for _ in range(r.choice((4, 5, 6, 7, 8, 9, 10, 14)))) for _ in range(n_words)]
    rows = []
    for i in range(n_rows):
        text = []
        for _ in range(30):
            w = words[min(int(r.expovariate(0.2)), n_words - 1)]
            for _ in range(r.choice((0, 0, 1, 2))):
                at = r.randrange(len(w) + 1)
                w = r.choice((w[:at] + r.choice(letters) + w[at:], w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at + 1:]))
            text.append(r.choice((w, w.upper(), w + "42")))
        rows.append((i, " ".join(text)))
    return rows


def test_variants_equal_brute_force(spark):
    rows = typos(7, 40, 150) + [(None, "abcdé abcdé"), (150, None), (151, ""), (152, "x" * 3000 + " " + "x" * 2999), (152, "x" * 3000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, drop_every=5)
    assert sum(r[1] is not None for r in want) > 30 and sum(r[2] not in (r[0], r[1]) for r in want) > 0
    for min_list, max_grams in ((1, 10_000), (3, 40), (10_000, 10)):
        got = variants.spelling_variants(docs, drop_every=5, min_list=min_list, max_grams=max_grams)
        assert {tuple(r) for r in got.collect()} == want


def test_variants_edges(spark):
    docs = edge_docs(spark)
    got = variants.spelling_variants(docs, min_length=2, min_count=1)
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert {tuple(r) for r in got.collect()} == brute(rows, 2, 1)
    assert variants.spelling_variants(empty_docs(spark)).collect() == []
    one = spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string")
    assert [tuple(r) for r in variants.spelling_variants(one).collect()] == [("alone", None, "alone", 3, 0, None)]


words_ = st.text("ab÷", min_size=2, max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words_, min_size=1, max_size=12, unique=True), words_, st.integers(0, 20), st.sampled_from("abc÷"), st.integers(0, 5))
def test_near_words_share_a_rare_token(others, word, at, letter, min_list):
    at %= len(word) + 1
    near = {word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:], word[:at] + word[at + 1:]} - {word}
    words = set(others) | near | {word}
    counts = Counter()
    for w in words:
        s = variants.START + w + variants.END
        for c in variants._classes(len(w)):
            for q in range(2, variants.CLASSES[c][2] + 1):
                counts.update((c, s[p:p + q]) for p in range(len(s) - q + 1))
    grams = variants.GramDictionary({k: n for k, n in counts.items() if len(k[1]) == 2 or counts[k[0], k[1][:-1]] > min_list})
    for w in words:
        for c in variants._classes(len(w)):
            tokens, affected = grams.decompose(w, c)
            assert affected < len(tokens)
    for w in near:
        if len(w) >= 2:
            assert set(grams.probes(word)) & set(grams.probes(w))
