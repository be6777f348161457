"""Operator 12 against exact shingle sets in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import fingerprints as fp
from tests.conftest import SF_CHECK
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs, prose


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(text, edited, following) by place, ``rows`` in order."""
    out = []
    for i, (_, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((text, text[:len(text) - half] + following[:half], following))
    return out


@pytest.mark.parametrize("per_range", [7, 1000])
def test_fingerprints_against_exact_sets(spark, monkeypatch, per_range):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", per_range)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs, k=64).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, _), (text, new, following) in zip(rows, edited(rows), strict=True):
        r, a, e, f = got[i], shingles(text), shingles(new), shingles(following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert len(r.fingerprint) == 16 * min(64, len(a))
        if len(a) < 64 and len(e) < 64:
            assert abs(r.near_edited - jaccard(a, e)) < 1e-9 and r.n_shingles == len(a)
        assert abs(r.near_edited - jaccard(a, e)) < 0.3 and abs(r.near_next - jaccard(a, f)) < 0.3
        errors.append(r.near_edited - jaccard(a, e))
        if len(a) >= 64:
            assert abs(r.n_shingles / len(a) - 1) < 0.7 and abs(r.kept_share - len(a & e) / len(a)) < 0.4
    assert abs(sum(errors) / len(errors)) < 0.01 and (sum(x * x for x in errors) / len(errors)) ** 0.5 < 0.07
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_fingerprint_edges(spark):
    rows = sorted(((r[0], r[1]) for r in edge_rows() if r[0] is not None), key=lambda r: r[0])
    got = fp.edited_fingerprints(edge_docs(spark).where("doc_id IS NOT NULL")).orderBy("doc_id").collect()
    for r, (_, (text, new, _)) in zip(got, zip(rows, edited(rows), strict=True), strict=True):
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    assert fp.edited_fingerprints(edge_docs(spark)).count() == len(edge_rows())
    assert fp.edited_fingerprints(empty_docs(spark)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab cab c").hexdigest()
    assert one.near_next == 1.0
    none = fp.edited_fingerprints(spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")).collect()
    assert {(r.fingerprint, r.near_edited, r.near_next) for r in none} == {("", 1.0, 1.0)}


def test_next_of_a_frequent_identifier(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 10)
    texts = [(i, f"t{i}") for i in range(100)] + [(50, f"u{i}") for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = fp.next_texts(rows, ["text"]).collect()
    follows = {r.text: r.next_text for r in got}
    assert len(got) == len(texts) and sorted(follows.values()) == sorted(t for _, t in texts)
    at, seen = "t0", []
    for _ in texts:
        seen.append(at)
        at = follows[at]
    assert at == "t0" and seen[:50] == [f"t{i}" for i in range(50)] and seen[-49:] == [f"t{i}" for i in range(51, 100)]


def test_merged_parts_equal_the_whole(spark):
    texts = [("a", prose(i, 40)) for i in range(6)] + [("b", prose(i, 90)) for i in range(3, 9)]
    docs = spark.createDataFrame(texts, "part string, text string")
    sketches = fp.with_sketch(docs, F.col("text"), "s", k=32)
    merged = {r.part: r.s for r in fp.merge_by(sketches, ["part"], "s", k=32).collect()}
    every = {r.part: sorted({h for s in r.all for h in s})[:32] for r in sketches.groupBy("part").agg(F.collect_list("s").alias("all")).collect()}
    assert merged == every
    a, b = (spark.createDataFrame([(merged["a"], merged["b"])], "a array<long>, b array<long>").select(
        fp.merge(F.col("a"), F.col("b"), 32).alias("m"), fp.resemblance(F.col("a"), F.col("b"), 32).alias("r")).first())
    assert a == sorted(set(merged["a"]) | set(merged["b"]))[:32] and 0 <= b <= 1
