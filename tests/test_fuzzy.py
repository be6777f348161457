"""Fuzzy resolution (M3-M8, M11): score values, and the distributed join equal
to brute force (every pair scored in plain Python) on a small fixture."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import fuzzy
from tablewright.plans.requests import clean_name

DICT = ["MARA", "MAKT", "MARC", "material type", "material group", "Plant", "customer master", "BUT020",
        "ADRC", "x", "small ring", "small  ring", "ring small", "MARA "]
QUERIES = ["mara", "MARA", "Marc", "materal type", "material  grp", "plant", "custmer master data", "but 020",
           "adr", "x", "small ring", "ring", "zzzz", "", "MARA  ", "mat"]


def brute(queries, words, threshold):
    out = {}
    for q in queries:
        for o, w in enumerate(words):
            s = fuzzy.fuzzy_score(q, w)
            if s >= threshold and q:
                if (q, w) not in out:
                    out[(q, w)] = (s, o)
    return out


def test_score_values():
    assert fuzzy.fuzzy_score("MARA", "mara") == 1.0
    assert fuzzy.fuzzy_score("", "x") == 0.0
    # raw stripped texts equal, cleaned texts differ -> +0.1 bonus
    assert fuzzy.fuzzy_score("MARA", "MARA ") > fuzzy.fuzzy_score("mara", "MARA ")
    s = fuzzy.fuzzy_score("materal type", "material type")
    assert 0.7 < s < 1.0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_matches_equal_brute_force(spark, threshold):
    left = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "id int, q string")
    right = spark.createDataFrame([(o, w) for o, w in enumerate(DICT)], "o int, w string")
    got = fuzzy.fuzzy_matches(left, "q", right, "w", threshold, "o", dict_chunk=3, query_slices=4)
    got = {(r.q, r.match): (r.score, r.match_order) for r in got.collect()}
    exp = brute(QUERIES, DICT, threshold)
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k][0] - exp[k][0]) < 1e-12 and got[k][1] == exp[k][1]


def test_best_ties_in_dictionary_order(spark):
    left = spark.createDataFrame([(1, "ab")], "id int, q string")
    right = spark.createDataFrame([(0, "abx"), (1, "abz"), (2, "aby")], "o int, w string")
    best = fuzzy.fuzzy_best(left, "q", right, "w", 0.1, "o").first()
    assert best.match == "abx" and best.n_matches == 3


def test_resolve_names_rules(spark):
    dict_df = spark.createDataFrame([(0, "MARA"), (1, "MARC"), (2, "MAKT"), (3, "customer")], "o int, w string")
    m = spark.createDataFrame([("mara",), ("MAR",), ("custmer",), ("qqqq",)], "t string")
    got = {r.t: (r.resolved, r.confidence) for r in fuzzy.resolve_names(m, "t", dict_df, "w", 0.4, "o").collect()}
    assert got["mara"] == ("MARA", 1.0)
    assert got["MAR"] == ("MAR", 0.5)            # MARA / MARC tie: ambiguous
    assert got["custmer"][0] == "customer"
    assert got["qqqq"] == ("qqqq", 0.0)


def test_two_pass_glossary_segment(spark):
    cols = spark.createDataFrame([("MARA", 0, "MATNR", 0), ("MARA", 0, "MTART", 1), ("MAKT", 1, "MAKTX", 0)],
                                 "table_name string, table_order int, column_name string, column_order int")
    m = spark.createDataFrame([("MATNR",), ("MTARTT",), ("nothing",)], "t string")
    got = {r.t: (r.matched_column, r.match_type) for r in fuzzy.match_two_pass(m, "t", cols).collect()}
    assert got == {"MATNR": ("MATNR", "exact"), "MTARTT": ("MTART", "fuzzy"), "nothing": (None, "missing")}
    gl = spark.createDataFrame([(1, "Material Number", "MATNR"), (2, "material type", "MTART"),
                                (3, "Material Number", "MATNR2")], "field_id int, description string, target_sap_field string")
    dbc = spark.createDataFrame([("MATNR",)], "column_name string")
    mm = spark.createDataFrame([("material number",), ("materal typ",), ("MATNR",)], "t string")
    g = {r.t: (r.actual_column, r.match_type) for r in fuzzy.glossary_match(mm, "t", gl, dbc).collect()}
    assert g == {"material number": ("MATNR2", "direct_glossary"), "materal typ": ("MTART", "fuzzy_glossary")}
    seg = spark.createDataFrame([(1, "Basic Data", "t_24_basic"), (1, "Basic Data", "t_25_basic"),
                                 (2, "Plant Data", "t_24_plant")], "segment_id int, segement_name string, table_name string")
    sm = spark.createDataFrame([("basic data",), ("zz",)], "t string")
    s = sorted((r.t, r.matched_segment, r.table_name) for r in fuzzy.segment_match(sm, "t", seg, "t_24").collect())
    assert s == [("basic data", "Basic Data", "t_24_basic"), ("zz", "zz", None)]


def test_clean_name(spark):
    df = spark.createDataFrame([("MARA Table",), ("MARA_table",), ("Tablespace",)], "n string")
    assert [r[0] for r in df.select(clean_name("n")).collect()] == ["MARA", "MARA", "Tablespace"]


def test_no_cartesian_in_plan(spark):
    left = spark.createDataFrame([(1, "mara")], "id int, q string")
    right = spark.createDataFrame([(0, "MARA")], "o int, w string")
    plan = fuzzy.fuzzy_matches(left, "q", right, "w", 0.6, "o")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_block_bounds_are_sound_on_random_texts():
    """The vectorised upper bounds may only skip pairs that cannot reach the
    threshold: random texts (small alphabet so they overlap, repeated and
    padded spaces, case changes, non-ASCII) scored by the block equal brute
    force at several thresholds."""
    import random

    import pandas as pd

    rnd = random.Random(11)
    alphabet = "abcde fgAB  éß"

    def text():
        n = rnd.randint(0, 14)
        return "".join(rnd.choice(alphabet) for _ in range(n))
    qs = list(dict.fromkeys(text() for _ in range(160)))
    ws = list(dict.fromkeys(text() for _ in range(90)))
    qs = [q for q in qs if q] + ["   ", " AB ", "ab  c"]
    ws = ws + ["", "ab c", "AB"]
    pdf = pd.DataFrame({"__side": [0] * len(qs) + [1] * len(ws), "__text": qs + ws,
                        "__order": [0] * len(qs) + list(range(len(ws)))})
    for threshold in (0.3, 0.5, 0.7, 0.9):
        out = fuzzy._score_block(threshold)(pdf)
        got = {(a, b): s for a, b, s in zip(out["__q"], out["match"], out["score"])}
        exp = {(q, w): fuzzy.fuzzy_score(q, w) for q in qs for w in ws if fuzzy.fuzzy_score(q, w) >= threshold}
        assert got.keys() == exp.keys(), threshold
        assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_band_routing_edge_cases(spark):
    """Tabs around a query, a case-bonus pair far apart in cleaned length, and
    a whitespace-only query against an empty entry: distributed result equals
    brute force at a high threshold."""
    qs = ["\tabc\t", "ABC", "   ", "abc def", "MARA"]
    ws = ["abc", "ABC      ", "", "abc  def", "MARA "]
    left = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "id int, q string")
    right = spark.createDataFrame([(o, w) for o, w in enumerate(ws)], "o int, w string")
    for threshold in (0.5, 0.9):
        got = {(r.q, r.match): r.score for r in fuzzy.fuzzy_matches(left, "q", right, "w", threshold, "o").collect()}
        exp = {(q, w): fuzzy.fuzzy_score(q, w) for q in qs for w in ws if fuzzy.fuzzy_score(q, w) >= threshold}
        assert got == exp, threshold


def _formula(query, candidate):
    """M3 written out from its description (independent of the library)."""
    import re
    from difflib import SequenceMatcher
    if not query:
        return 0.0
    q = re.sub(r"\s+", " ", query.strip().lower())
    w = candidate.lower()
    if q == w:
        return 1.0
    ratio = SequenceMatcher(None, q, w).ratio()
    sub = len(q) / len(w) if q in w else (len(w) / len(q) if w in q else 0.0)
    qw, ww = q.split(), w.split()
    single = len(qw) == 1 and len(ww) == 1
    if single:
        words = ratio
    else:
        best = [1.0 if x in ww else max([SequenceMatcher(None, x, y).ratio() for y in ww] or [0.0]) for x in qw]
        words = sum(best) / max(len(qw), len(ww)) if max(len(qw), len(ww)) else 0.0
    n = 0
    while n < min(len(q), len(w)) and q[n] == w[n]:
        n += 1
    prefix = n / max(len(q), len(w)) if min(len(q), len(w)) >= 3 and n >= 3 else 0.0
    bonus = 0.1 if query.strip() == candidate.strip() and q != w else 0.0
    mix = (0.7 * ratio + 0.2 * sub + 0.1 * prefix) if single else \
        (0.5 * words + 0.3 * ratio + 0.15 * sub + 0.05 * prefix)
    return min(mix + bonus, 1.0)


def test_score_equals_written_out_formula():
    import random
    rnd = random.Random(5)
    alphabet = "abcd efAB  x"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(120)]
    texts += ["MARA", "mara ", "MARA  ", "material type", "Material  Type"]
    for q in texts:
        for w in texts[:60] + texts[-5:]:
            assert abs(fuzzy.fuzzy_score(q, w) - _formula(q, w)) < 1e-12, (q, w)


def _random_texts(seed, n):
    import random
    rnd = random.Random(seed)
    words = ["plant", "plan", "material", "materal", "group", "grp", "customer", "Master", "data", "dat", "x", "BUT", "é"]
    return [" " * rnd.randint(0, 1) + "  ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_best_without_counts_is_the_best(spark, threshold):
    """Equal texts and bounds end the search early; the best stays the best, ties in order."""
    qs, ws = list(dict.fromkeys(_random_texts(3, 60))), list(dict.fromkeys(_random_texts(4, 50)))
    left = spark.createDataFrame([(q,) for q in qs], "q string")
    right = spark.createDataFrame(list(enumerate(ws)), "o int, w string")
    exp = {}
    for q in qs:
        found = sorted((-fuzzy.fuzzy_score(q, w), o, w) for o, w in enumerate(ws) if fuzzy.fuzzy_score(q, w) >= threshold)
        exp[q] = (found[0][2], -found[0][0]) if found else (None, 0.0)
    for kw in ({}, {"dict_chunk": 7, "query_slices": 3}):
        got = fuzzy.fuzzy_best(left, "q", right, "w", threshold, "o", count_matches=False, **kw)
        assert {r.q: (r.match, r.score) for r in got.collect()} == exp
    # M5 needs the second best as well.
    two = fuzzy.resolve_names(left, "q", right, "w", threshold, "o").collect()
    for r in two:
        found = sorted(((fuzzy.fuzzy_score(r.q, w), -o) for o, w in enumerate(ws) if fuzzy.fuzzy_score(r.q, w) >= threshold), reverse=True)
        if not found:
            assert (r.resolved, r.confidence) == (r.q, 0.0)
        elif found[0][0] >= 0.9 or len(found) == 1:
            assert (r.resolved, r.confidence) == (ws[-found[0][1]], found[0][0])
        elif round(found[0][0], 3) - round(found[1][0], 3) > 0.2001:
            assert r.resolved == ws[-found[0][1]]
        elif round(found[0][0], 3) - round(found[1][0], 3) < 0.1999:
            assert (r.resolved, r.confidence) == (r.q, 0.5)


def test_grid_sends_few_rows():
    """Rows sent grow with the square root of the pairs until cells are full."""
    for n_query, n_dict in ((10, 10), (1_000, 1_000_000), (1_000_000, 1_000), (1_000_000, 1_000_000)):
        slices, rows = fuzzy._grid(n_query, n_dict, 64)
        chunks = -(-n_dict // rows)
        sent = n_query * chunks + n_dict * slices
        assert slices * chunks >= 1 and rows <= fuzzy.CELL_ROWS and n_query / slices <= fuzzy.CELL_ROWS
        assert n_query * n_dict / (slices * chunks) <= 2 * fuzzy.CELL_PAIRS
        assert sent <= 3 * (n_query * n_dict * slices * chunks) ** 0.5 + n_query + n_dict


@pytest.mark.parametrize("left", [0, 3])
def test_grid_follows_the_queries_without_an_equal_text(spark, monkeypatch, left):
    """Queries with an equal text need no cell, so the dictionary is not sent for them."""
    names = [f"name {i:04d}" for i in range(400)]
    odd = ["nam 0007", "name 12", "~~~~"][:left]
    laid, grid = [], fuzzy._grid
    monkeypatch.setattr(fuzzy, "_grid", lambda n, m, cores: (laid.append((n, m)), grid(n, m, cores))[1])
    q = spark.createDataFrame([(x,) for x in [n.upper() for n in names] + odd], "q string")
    d = spark.createDataFrame(list(enumerate(names)), "o int, w string")
    got = fuzzy.fuzzy_best(q, "q", d, "w", 0.6, "o", count_matches=False).collect()
    assert laid == ([(left, len(names))] if left else [])
    exp = {n.upper(): (n, 1.0) for n in names}
    for x in odd:
        score, o = max((fuzzy.fuzzy_score(x, w), -o) for o, w in enumerate(names))
        exp[x] = (names[-o], score) if score >= 0.6 else (None, 0.0)
    assert {r.q: (r.match, r.score) for r in got} == exp


def test_rows_sent_to_cells_are_dealt_to_tasks(spark, monkeypatch):
    """Small tasks send the same rows: the result equals scoring every pair."""
    monkeypatch.setattr(fuzzy, "SENT_ROWS", 40)
    q = spark.createDataFrame([(x,) for x in QUERIES], "q string")
    d = spark.createDataFrame(list(enumerate(DICT)), "o int, w string")
    got = fuzzy.fuzzy_matches(q, "q", d, "w", 0.3, "o", dict_chunk=2, query_slices=3).collect()
    assert {(r.q, r.match): (r.score, r.match_order) for r in got} == brute(QUERIES, DICT, 0.3)
    assert fuzzy._dealt(q.select(F.col("q").alias("__text")), 16, 10).rdd.getNumPartitions() == 4
