"""Fuzzy name resolution.

Score (M3), per (query, candidate): both texts lower-cased, the query trimmed
with runs of whitespace collapsed.  Equal -> 1.  Otherwise
  ratio     difflib ``SequenceMatcher.ratio``,
  substring shorter/longer length when one contains the other,
  prefix    common prefix length / longer length when the prefix is >= 3,
  words     sum over query words of the best word ratio (1 for an equal word)
            divided by the larger word count,
one word each: 0.7 ratio + 0.2 substring + 0.1 prefix, else 0.5 words +
0.3 ratio + 0.15 substring + 0.05 prefix; +0.1 when the raw stripped texts are
equal but the cleaned ones are not; capped at 1.

Distribution (M4).  A ratio of 0.6 arises from blocks of one or two characters, so
no gram or word must be shared and every length-compatible pair may match.  Both
sides are reduced to distinct texts, prepared once (cleaned text, length) and
staged.  Equal texts (cleaned, or raw once stripped, which earns the bonus) are
found by equi-joins.  All others meet in a grid of cells: dictionary chunks within a
length band, query slices by hash.  Chunks and slices are balanced, so with N cells
the rows shuffled are 2 sqrt(Q W N), and N follows the cores until a cell would
exceed ``CELL_ROWS`` texts a side or ``CELL_PAIRS`` pairs.

A cell keeps an inverted index: word -> texts that hold it.  A query's words are
compared with the distinct words of the cell, not with its texts; the index spreads
each word's best bound over the texts.  Length and word bounds leave a short list,
character counts a shorter one, then exact word ratios, and last the text's own
ratio.  Where only the best ``top`` are asked for, candidates are taken in the order
of their bounds until none can be among them.  Nothing is capped and no candidate
is dropped: the result equals scoring every pair.

M5 to M8 read one table of candidates each (``candidates``), planned once.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

from tablewright.functions._util import py_strip
from tablewright.session import staged

_WS = re.compile(r"\s+")

# The per-block scorer runs in Python workers: ship this module's code with
# the task (pickled by value) so executors need no copy of the package.
try:
    import sys as _sys
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass


# ---------------------------------------------------------------- M3 (per-pair helper)

def _clean_query(q: str) -> str:
    return _WS.sub(" ", q.strip().lower())


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def fuzzy_score(query: str, candidate: str) -> float:
    """M3: similarity of a query text and a candidate text in [0, 1]
    (one pair; the distributed join scores blocks with ``_BlockScorer``)."""
    if not query:
        return 0.0
    q, w = _clean_query(query), candidate.lower()
    matcher = SequenceMatcher(None)
    matcher.set_seq2(w)
    return _BlockScorer().score(query, q, q.split(), candidate, w, w.split(), matcher)


# ---------------------------------------------------------------- bounds

def _length_bound(rho: float) -> float:
    """Largest score reachable by texts whose length ratio (shorter/longer) is
    ``rho``, bonus excluded: ratio <= 2 rho/(1+rho), substring and prefix <=
    rho, words <= 1; the larger of the two weightings."""
    r = 2 * rho / (1 + rho)
    return max(0.7 * r + 0.3 * rho, 0.5 + 0.3 * r + 0.2 * rho)


def min_length_ratio(threshold: float) -> float:
    """Smallest shorter/longer length ratio that can still reach ``threshold``."""
    if threshold <= 0.5:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        if _length_bound(mid) >= threshold:
            hi = mid
        else:
            lo = mid
    return max(0.0, lo - 1e-9)


_BAND_BASE = 1.25


def _band(length: int) -> int:
    return int(math.floor(math.log(max(length, 1)) / math.log(_BAND_BASE)))


_NBUCKETS = 64


def _char_counts(texts: Sequence[str]) -> np.ndarray:
    """Counts of the characters by code modulo ``_NBUCKETS``; a minimum of two
    such rows over-estimates what the texts share, never the reverse."""
    out = np.zeros((len(texts), _NBUCKETS), dtype=np.int32)
    for i, t in enumerate(texts):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % _NBUCKETS
            out[i] = np.bincount(codes, minlength=_NBUCKETS)
    return out


class _CellIndex:
    """The dictionary texts of one cell: inverted words, lengths, character counts."""

    _CACHE_BYTES = 64 << 20

    def __init__(self, texts: list[str]) -> None:
        self.words = [t.split() for t in texts]
        self.length = np.array([len(t) for t in texts], dtype=np.float64)
        self.n_words = np.array([len(w) for w in self.words], dtype=np.float64)
        self.counts = _char_counts(texts)
        vocabulary: dict[str, int] = {}
        posting: list[tuple[int, int]] = []
        for j, ws in enumerate(self.words):
            posting += {(vocabulary.setdefault(w, len(vocabulary)), j) for w in ws}
        pairs = np.array(sorted(posting, key=lambda p: p[1]), dtype=np.int64).reshape(-1, 2)
        self.word_of, text_of = pairs[:, 0], pairs[:, 1]
        #: Where the words of each text that has any begin.
        self.with_words, self.begin = np.unique(text_of, return_index=True)
        self.word_counts = _char_counts(list(vocabulary))
        self.word_length = np.array([len(w) for w in vocabulary], dtype=np.float64)
        self._best: dict[str, np.ndarray] = {}

    def best_word(self, x: str) -> np.ndarray:
        """Per text, an upper bound of the best ratio of ``x`` to one of its words."""
        got = self._best.get(x)
        if got is None:
            got = np.zeros(len(self.words), dtype=np.float32)
            if len(self.word_of):
                shared = np.minimum(self.word_counts, _char_counts([x])).sum(axis=1)
                bound = np.minimum(1.0, 2 * shared / (self.word_length + len(x))).astype(np.float32)
                got[self.with_words] = np.maximum.reduceat(bound[self.word_of], self.begin)
            if (len(self._best) + 1) * got.nbytes > self._CACHE_BYTES:
                self._best.clear()
            self._best[x] = got
        return got

    def candidates(self, q: str, q_words: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts whose score may reach ``threshold`` (bonus excluded), their bounds
        of the score and of the ratio."""
        lq, nq = len(q), len(q_words)
        both = np.maximum(self.length + lq, 1)
        ratio = 2 * np.minimum(self.length, lq) / both
        # What follows holds as substring and prefix parts are at most the ratio's bound.
        if nq:
            words = sum((self.best_word(x) for x in q_words), np.zeros(len(self.words), dtype=np.float32)) / np.maximum(self.n_words, nq)
        else:
            words = np.zeros(len(self.words))
        single = (self.n_words == 1) if nq == 1 else np.zeros(len(self.words), dtype=bool)
        rough = np.where(single, ratio, 0.5 * words + 0.5 * ratio)
        at = np.flatnonzero(rough >= threshold - 1e-6)
        if not len(at):
            return at, at, at
        shared = np.minimum(self.counts[at], _char_counts([q])).sum(axis=1)
        short, long_ = np.minimum(self.length[at], lq), np.maximum(np.maximum(self.length[at], lq), 1)
        ratio = 2 * shared / both[at]
        sub = np.where(shared >= short, short / long_, 0)
        common = np.minimum(shared, short)
        prefix = np.where(common >= 3, common / long_, 0)
        bound = np.where(single[at], 0.7 * ratio + 0.2 * sub + 0.1 * prefix, 0.5 * words[at] + 0.3 * ratio + 0.15 * sub + 0.05 * prefix)
        fit = bound >= threshold - 1e-6
        return at[fit], bound[fit], ratio[fit]


# ---------------------------------------------------------------- M4 distributed join

_MATCH_SCHEMA = StructType([
    StructField("__q", StringType()), StructField("match", StringType()),
    StructField("match_order", LongType()), StructField("score", DoubleType())])


class _BlockScorer:
    """``fuzzy_score`` for one block of pairs, with the expensive parts shared:
    one ``SequenceMatcher`` per candidate text (its index is built once and
    reused for every query) and a cache of word-pair ratios."""

    def __init__(self) -> None:
        self.word_cache: dict[tuple[str, str], float] = {}

    def word_ratio(self, x: str, y: str) -> float:
        key = (x, y)
        r = self.word_cache.get(key)
        if r is None:
            r = self.word_cache[key] = _ratio(x, y)
        return r

    def score(self, query: str, q: str, qw: list[str], candidate: str, w: str, ww: list[str],
              matcher: SequenceMatcher, least: float = -1.0, most_ratio: float = 1.0) -> float:
        """The score, or -1 as soon as it can't reach ``least``; ``most_ratio`` is
        an upper bound of the ratio."""
        if not query:
            return 0.0
        if q == w:
            return 1.0
        if q in w:
            sub = len(q) / len(w)
        elif w in q:
            sub = len(w) / len(q)
        else:
            sub = 0.0
        shorter = min(len(q), len(w))
        prefix = 0.0
        if shorter >= 3:
            n = 0
            while n < shorter and q[n] == w[n]:
                n += 1
            if n >= 3:
                prefix = n / max(len(q), len(w))
        bonus = 0.1 if query.strip() == candidate.strip() else 0.0
        single = len(qw) == 1 and len(ww) == 1
        words = 0.0
        if not single:
            total = 0.0
            wset = set(ww)
            for x in qw:
                total += 1.0 if x in wset else max((self.word_ratio(x, y) for y in ww), default=0.0)
            denom = max(len(qw), len(ww))
            words = total / denom if denom else 0.0

        def weighted(ratio: float) -> float:
            if single:
                return 0.7 * ratio + 0.2 * sub + 0.1 * prefix + bonus
            return 0.5 * words + 0.3 * ratio + 0.15 * sub + 0.05 * prefix + bonus
        if weighted(most_ratio) < least - 1e-6:
            return -1.0
        matcher.set_seq1(q)
        return min(weighted(matcher.ratio()), 1.0)


def _score_block(threshold: float, top: int | None = None):
    """Score the pairs of one cell; ``top``: only those that may be among a
    query's best ``top``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qs = pdf[pdf["__side"] == 0]["__text"].tolist()
        ws = pdf[pdf["__side"] == 1]
        w_raw, w_ord = ws["__text"].tolist(), ws["__order"].tolist()
        if not qs or not w_raw:
            return _result([], [], [], [])
        w_clean = [x.lower() for x in w_raw]
        index, scorer = _CellIndex(w_clean), _BlockScorer()
        matchers: dict[int, SequenceMatcher] = {}
        equal: dict[str, set[int]] = {}
        for j, w in enumerate(w_raw):
            for k in {w.strip() + "\0", w_clean[j]}:
                equal.setdefault(k, set()).add(j)
        out: list[tuple[str, int, float]] = []
        for raw in qs:
            q = _clean_query(raw)
            q_words = q.split()
            at, bound, ratio = index.candidates(q, q_words, threshold)
            todo = sorted(zip(bound.tolist(), at.tolist(), ratio.tolist()), reverse=True)
            # Equal pairs first: their score is 1 or holds the bonus, which the bounds leave out.
            same = equal.get(q, set()) | equal.get(raw.strip() + "\0", set())
            todo = [(2.0, j, 1.0) for j in same] + [x for x in todo if x[1] not in same]
            found: list[tuple[float, int]] = []
            least = threshold
            for most, j, r in todo:
                if most < least - 1e-6:
                    break
                matcher = matchers.get(j)
                if matcher is None:
                    if len(matchers) >= 4096:
                        matchers.clear()
                    matcher = matchers[j] = SequenceMatcher(None)
                    matcher.set_seq2(w_clean[j])
                sc = scorer.score(raw, q, q_words, w_raw[j], w_clean[j], index.words[j], matcher, least, r)
                if sc >= threshold:
                    found.append((sc, j))
                    if top and sc > least and len(found) >= top:
                        least = max(least, sorted((x for x, _ in found), reverse=True)[top - 1])
            out += [(raw, j, sc) for sc, j in found if sc >= least]
        return _result([o[0] for o in out], [w_raw[o[1]] for o in out], [int(w_ord[o[1]]) for o in out], [o[2] for o in out])
    return run


def _result(q: list, w: list, o: list, sc: list) -> pd.DataFrame:
    return pd.DataFrame({"__q": pd.Series(q, dtype=object), "match": pd.Series(w, dtype=object),
                         "match_order": pd.Series(o, dtype="int64"), "score": pd.Series(sc, dtype="float64")})


#: Texts a side and pairs that a cell holds at most.
CELL_ROWS = 50_000
CELL_PAIRS = 200_000_000
#: Rows that a task sends to cells, about 300 bytes of its shuffle memory each.
SENT_ROWS = 1_000_000
_SIDE = "__text string, __order long, __side int, __key string, __strip string, __len int"


def _prepared(texts: DataFrame) -> DataFrame:
    """(__text, __order, __side) with what the score compares, computed once by the score's own rules."""
    def run(batches):
        for pdf in batches:
            clean = [t.lower() if side else _clean_query(t) for t, side in zip(pdf["__text"], pdf["__side"])]
            yield pd.DataFrame({"__text": pdf["__text"], "__order": pdf["__order"], "__side": pdf["__side"], "__key": clean,
                                "__strip": [t.strip() for t in pdf["__text"]], "__len": np.array([len(c) for c in clean], dtype=np.int32)})
    return texts.mapInPandas(run, _SIDE)


def _equal_pairs(q: DataFrame, w: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose cleaned texts or stripped raw texts are equal, scored."""
    def run(batches):
        for pdf in batches:
            score = [fuzzy_score(a, b) for a, b in zip(pdf["__q"], pdf["match"])]
            yield _result(pdf["__q"].tolist(), pdf["match"].tolist(), pdf["match_order"].tolist(), score)
    qs = q.select(F.col("__text").alias("__q"), F.col("__key").alias("__k"), F.col("__strip").alias("__s"))
    ws = w.select(F.col("__text").alias("match"), F.col("__order").alias("match_order"), F.col("__key").alias("__wk"), F.col("__strip").alias("__ws"))
    cols = ["__q", "match", "match_order"]
    same = qs.join(ws, F.col("__k") == F.col("__wk")).select(*cols, F.lit(1.0).alias("score"))
    bonus = qs.join(ws, (F.col("__s") == F.col("__ws")) & (F.col("__k") != F.col("__wk"))).select(*cols).mapInPandas(run, _MATCH_SCHEMA)
    return same.unionByName(bonus.where(F.col("score") >= threshold))


def _grid(n_query: int, n_dict: int, cores: int) -> tuple[int, int]:
    """(slices of the queries, rows of a dictionary chunk): cells for the cores,
    more where a cell would be too large, chunks and slices balanced so that the
    rows sent, queries x chunks + dictionary x slices, are fewest."""
    pairs = max(1, n_query * n_dict)
    cells = max(1, min(4 * cores, pairs // 20_000), math.ceil(pairs / CELL_PAIRS))
    slices = max(1, min(n_query, round(math.sqrt(cells * n_query / max(1, n_dict)))), math.ceil(n_query / CELL_ROWS))
    chunks = max(1, min(n_dict, math.ceil(cells / slices)), math.ceil(n_dict / CELL_ROWS))
    return slices, max(1, math.ceil(n_dict / chunks))


def _dealt(side: DataFrame, n: int, times: int) -> DataFrame:
    """``side``, of ``n`` rows that are each to be sent ``times`` times, over so
    many tasks that none sends more than about ``SENT_ROWS``."""
    tasks = math.ceil(n * times / SENT_ROWS)
    return side.repartition(tasks, F.xxhash64("__text")) if times > 1 and tasks > 1 else side


def candidates(texts: DataFrame, text_col: str, dictionary: DataFrame, dict_col: str, threshold: float,
               dict_order: str | None = None, top: int | None = None, dict_chunk: int | None = None,
               query_slices: int | None = None) -> DataFrame:
    """The table (__q, match, match_order, score) of all pairs of distinct texts
    that score ``threshold`` or more.  With ``top``, a text with an equal one
    keeps its equal ones only, and others at least their best ``top``."""
    spark = texts.sparkSession
    q = (texts.select(F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("__order"))
         .where(F.col("__text").isNotNull() & (F.col("__text") != "")).distinct())
    order = F.col(dict_order) if dict_order else F.lit(0)
    w = (dictionary.select(F.col(dict_col).alias("__text"), order.cast("long").alias("__order"))
         .where(F.col("__text").isNotNull()).groupBy("__text").agg(F.min("__order").alias("__order")))
    both = staged(_prepared(q.withColumn("__side", F.lit(0)).unionByName(w.withColumn("__side", F.lit(1)))), "fuzzy-texts")
    both = both.withColumn("__band", F.floor(F.log(F.greatest("__len", F.lit(1)).cast("double")) / F.lit(math.log(_BAND_BASE))).cast("int"))
    # Rows by side and length band, under two hundred numbers.
    sizes = both.groupBy("__side", "__band").agg(F.count(F.lit(1)).alias("n")).collect()
    per_band = {r["__band"]: r["n"] for r in sizes if r["__side"] == 1}
    n_query, n_dict = sum(r["n"] for r in sizes if r["__side"] == 0), sum(per_band.values())
    q, w = (both.where(F.col("__side") == i) for i in (0, 1))
    equal = _equal_pairs(q.drop("__band"), w, threshold)
    if not per_band or not n_query:
        return equal
    q = q.drop("__band")
    if top:
        # The grid is laid out for the queries that are left: each slice of them is sent the whole dictionary.
        q = staged(q.join(w.select(F.col("__key").alias("__known")), F.col("__key") == F.col("__known"), "left_anti"), "fuzzy-left")
        n_query = q.count()
        if not n_query:
            return equal
    cores = spark.sparkContext.defaultParallelism
    slices, rows = _grid(n_query, n_dict, cores)
    slices, rows = query_slices or slices, dict_chunk or rows
    plan = spark.createDataFrame([(b, math.ceil(n / rows)) for b, n in per_band.items()], "__b int, __chunks int")
    w = w.join(F.broadcast(plan), F.col("__band") == F.col("__b")).withColumn("__chunk", F.pmod(F.xxhash64("__text"), F.col("__chunks")).cast("int"))
    # A query goes to the bands whose lengths can reach the threshold (equal pairs are found above).
    rho = min_length_ratio(threshold)
    low, high = min(per_band), max(per_band)
    at = lambda length: F.floor(F.log(F.greatest(length, F.lit(1.0))) / F.lit(math.log(_BAND_BASE))).cast("int")
    first = at(F.floor(F.col("__len") * rho).cast("double")) if rho > 0 else F.lit(low)
    last = at(F.ceil(F.col("__len") / rho).cast("double")) if rho > 0 else F.lit(high)
    bands = F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high)))
    q = q.withColumn("__slice", F.pmod(F.xxhash64("__text"), F.lit(slices)).cast("int"))
    q = q.withColumn("__band", F.explode(F.when((first <= high) & (last >= low), bands).otherwise(F.array().cast("array<int>"))))
    cell = ["__band", "__chunk", "__slice"]
    cols = [*cell, "__text", "__order", "__side"]
    chunks = sum(math.ceil(n / rows) for n in per_band.values())
    q_side = _dealt(q, n_query, chunks).join(F.broadcast(plan), F.col("__band") == F.col("__b")).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    w_side = _dealt(w, n_dict, slices).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # An explicit partition count: cells are small in bytes but heavy in CPU, so
    # they must not be coalesced into a few tasks.
    cells = q_side.select(*cols).unionByName(w_side.select(*cols)).repartition(max(cores, slices * chunks), *cell)
    scored = cells.groupBy(*cell).applyInPandas(_score_block(threshold, top), _MATCH_SCHEMA)
    return scored.unionByName(equal).dropDuplicates(["__q", "match"])


def fuzzy_matches(left: DataFrame, left_text: str, right: DataFrame, right_text: str,
                  threshold: float = 0.6, right_order: str | None = None,
                  dict_chunk: int | None = None, query_slices: int | None = None) -> DataFrame:
    """M4 (all matches): one row per (left row, dictionary text) whose score is
    >= ``threshold``: left columns + ``match``, ``match_order`` (first position
    of that text in the dictionary order) and ``score``.  Exact, see module doc."""
    scored = candidates(left, left_text, right, right_text, threshold, right_order, None, dict_chunk, query_slices)
    return left.join(scored, left[left_text] == scored["__q"], "inner").drop("__q")


def _best(found: DataFrame) -> DataFrame:
    """The best candidate of each text (ties by order, then by text), and how many there are."""
    key = F.struct((-F.col("score")).alias("s"), F.col("match_order").isNull().alias("z"), F.col("match_order").alias("o"), F.col("match").alias("m"))
    return found.groupBy("__q").agg(F.min(key).alias("__b"), F.count(F.lit(1)).alias("n_matches")).select(
        "__q", F.col("__b.m").alias("match"), (-F.col("__b.s")).alias("score"), "n_matches")


def fuzzy_best(left: DataFrame, left_text: str, right: DataFrame, right_text: str,
               threshold: float = 0.6, right_order: str | None = None, count_matches: bool = True, **kw) -> DataFrame:
    """M4 (best match): per left row the highest score, ties -> first in
    dictionary order; rows without a match get NULL match and score 0.0.
    ``count_matches=False`` leaves out ``n_matches``, and with it every candidate
    that can't be the best."""
    best = _best(candidates(left, left_text, right, right_text, threshold, right_order, None if count_matches else 1, **kw))
    out = left.join(best, left[left_text] == best["__q"], "left").drop("__q").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if not count_matches:
        return out.drop("n_matches")
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long"))


# ---------------------------------------------------------------- M5

def resolve_names(mentions: DataFrame, text_col: str, dictionary: DataFrame, dict_col: str,
                  threshold: float = 0.4, dict_order: str | None = None, **kw) -> DataFrame:
    """M5: accept the best match if its score >= 0.9 or it is the only match, or
    if it beats the second by more than 0.2 (scores rounded to 3 places);
    otherwise keep the mention with confidence 0.5; no match -> the mention with
    confidence 0.0.  Output: mention columns + ``resolved``, ``confidence``."""
    # Two readers, the best and the best of the rest: written once instead of scored twice.
    m = staged(candidates(mentions, text_col, dictionary, dict_col, threshold, dict_order, top=2, **kw), "fuzzy-matches")
    best = _best(m).select(F.col("__q").alias("__t"), "match", F.col("score").alias("__s1"), F.col("n_matches").alias("__n"))
    # Second best: best among the matches with other texts (another partial aggregate).
    rest = m.join(best.select("__t", F.col("match").alias("__m1")), (m["__q"] == F.col("__t")) & (m["match"] != F.col("__m1")), "inner")
    second = rest.groupBy("__t").agg(F.max("score").alias("__s2"))
    top = best.join(second, "__t", "left")
    r1, r2 = F.round("__s1", 3), F.round("__s2", 3)
    take = (F.col("__s1") >= 0.9) | (F.col("__n") == 1)
    gap = F.col("__s2").isNull() | ((r1 - r2) > 0.2)
    top = top.select(
        "__t",
        F.when(take | gap, F.col("match")).alias("__m"),
        F.when(take, F.col("__s1")).when(gap, r1).otherwise(F.lit(0.5)).alias("__c"))
    out = mentions.join(top, mentions[text_col] == top["__t"], "left")
    return out.select(*[mentions[c] for c in mentions.columns],
                      F.coalesce(F.col("__m"), mentions[text_col]).alias("resolved"),
                      F.coalesce(F.col("__c"), F.lit(0.0)).alias("confidence"))


# ---------------------------------------------------------------- M6

def match_two_pass(mentions: DataFrame, text_col: str, columns: DataFrame, table_col: str = "table_name",
                   column_col: str = "column_name", table_order: str = "table_order",
                   column_order: str = "column_order", **kw) -> DataFrame:
    """M6: exact column name in any table -> ``exact`` (1.0).  Otherwise, per
    table, the best fuzzy match >= 0.5; tables are visited in ``table_order``
    and a later table replaces the current best only if it scores more than 0.1
    higher; the final best is accepted when >= 0.7 (``fuzzy``), else
    ``missing``.  Per-table bests are folded with ``aggregate`` over an array
    that holds one entry per table (bounded by the catalogue, not the data)."""
    # one left join marks the names that are a column somewhere (pass 1)
    known = columns.select(F.col(column_col).alias("__c")).distinct().withColumn("__exact", F.lit(True))
    flagged = (mentions.select(text_col).distinct()
               .join(known, F.col(text_col) == F.col("__c"), "left").drop("__c")
               .withColumn("__exact", F.coalesce("__exact", F.lit(False))))
    todo = flagged.where(~F.col("__exact")).select(text_col)
    dict_rows = columns.select(F.col(table_col).alias("__tab"), F.col(table_order).alias("__tord"),
                               F.col(column_col).alias("__col"), F.col(column_order).alias("__cord"))
    # Score against the distinct column names once; the table is joined back.
    m = fuzzy_matches(todo, text_col, dict_rows.select(F.col("__col").alias("__text"), F.col("__cord").alias("__o")),
                      "__text", threshold=0.5, right_order="__o", **kw)
    # A column text may belong to several tables: expand to (table, column) again.
    m = m.join(dict_rows, m["match"] == dict_rows["__col"], "inner")
    best_per_table = m.groupBy(text_col, "__tab", "__tord").agg(
        F.max_by(F.struct("match", "score"), F.struct("score", -F.col("__cord"))).alias("__b"))
    folded = best_per_table.groupBy(text_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__tord").alias("o"), F.col("__b.match").alias("m"),
                                             F.col("__b.score").alias("s")))).alias("__arr"))
    init = F.struct(F.lit(None).cast("string").alias("m"), F.lit(0.0).alias("s"))
    folded = folded.select(text_col, F.aggregate(
        "__arr", init, lambda acc, x: F.when(x["s"] > acc["s"] + 0.1, F.struct(x["m"].alias("m"), x["s"].alias("s")))
        .otherwise(acc)).alias("__best"))
    fuzzy = folded.select(text_col, F.col("__best.m").alias("matched_column"), F.col("__best.s").alias("confidence"))
    fuzzy = fuzzy.withColumn("match_type", F.when(F.col("confidence") >= 0.7, F.lit("fuzzy")))
    res = flagged.join(fuzzy, text_col, "left")
    res = res.select(
        text_col,
        F.when(F.col("__exact"), F.col(text_col)).when(F.col("match_type") == "fuzzy", F.col("matched_column"))
        .alias("matched_column"),
        F.when(F.col("__exact"), F.lit("exact")).when(F.col("match_type") == "fuzzy", F.lit("fuzzy"))
        .otherwise(F.lit("missing")).alias("match_type"),
        F.when(F.col("__exact"), F.lit(1.0)).when(F.col("match_type") == "fuzzy", F.col("confidence"))
        .otherwise(F.lit(0.0)).alias("confidence"))
    return mentions.join(res, text_col, "left")


# ---------------------------------------------------------------- M7

def glossary_match(mentions: DataFrame, text_col: str, glossary: DataFrame, db_columns: DataFrame,
                   description_col: str = "description", field_col: str = "target_sap_field",
                   order_col: str = "field_id", column_col: str = "column_name", **kw) -> DataFrame:
    """M7: mentions that are not a database column are looked up in the
    glossary (description -> field): equal lower-cased description ->
    ``direct_glossary`` (1.0); else best fuzzy description >= 0.4 ->
    ``fuzzy_glossary`` with its score.  For a description listed twice the
    later row (largest ``order_col``) wins."""
    g = (glossary.select(F.lower(py_strip(F.col(description_col).cast("string"))).alias("__d"),
                         py_strip(F.col(field_col).cast("string")).alias("__f"), F.col(order_col).alias("__o"))
         .where((F.col("__d") != "") & (F.col("__f") != "") & F.col("__d").isNotNull() & F.col("__f").isNotNull()))
    g = g.groupBy("__d").agg(F.max_by("__f", "__o").alias("__f"), F.min("__o").alias("__o"))
    names = mentions.select(text_col).distinct().join(
        db_columns.select(F.col(column_col).alias("__c")).distinct(), F.col(text_col) == F.col("__c"), "left_anti")
    names = names.withColumn("__low", py_strip(F.lower(F.col(text_col))))
    # one left join splits direct glossary hits from the rest
    joined = names.join(g.withColumn("__hit", F.lit(True)), F.col("__low") == F.col("__d"), "left")
    direct = joined.where(F.col("__hit")).select(
        text_col, F.col("__f").alias("actual_column"), F.lit(None).cast("string").alias("matched_glossary_term"),
        F.lit("direct_glossary").alias("match_type"), F.lit(1.0).alias("confidence"))
    rest = joined.where(F.col("__hit").isNull()).select(text_col, "__low")
    best = fuzzy_best(rest, "__low", g.select("__d", "__o"), "__d", 0.4, "__o", count_matches=False, **kw).where(F.col("match").isNotNull())
    best = best.join(g.select(F.col("__d").alias("__gd"), F.col("__f")), F.col("match") == F.col("__gd"))
    fuzzy = best.select(text_col, F.col("__f").alias("actual_column"), F.col("match").alias("matched_glossary_term"),
                        F.lit("fuzzy_glossary").alias("match_type"), F.col("score").alias("confidence"))
    return direct.unionByName(fuzzy)


# ---------------------------------------------------------------- M8

def segment_match(mentions: DataFrame, text_col: str, segments: DataFrame, current_prefix: str | None = None,
                  name_col: str = "segement_name", table_col: str = "table_name",
                  order_col: str = "segment_id", **kw) -> DataFrame:
    """M8: best segment name >= 0.3 for each mention; its target tables, and
    when there are several, only those starting with the current ``t_<n>``
    prefix (if any do).  Unmatched mentions keep their text and no table."""
    best = fuzzy_best(mentions.select(text_col).distinct(), text_col, segments, name_col, 0.3, order_col, count_matches=False, **kw)
    best = best.select(text_col, F.col("match").alias("matched_segment"))
    tabs = segments.select(F.col(name_col).alias("__s"), F.col(table_col).alias("table_name")).distinct()
    j = best.join(tabs, F.col("matched_segment") == F.col("__s"), "left").drop("__s")
    if current_prefix:
        hit = F.lower(F.col("table_name")).startswith(current_prefix.lower())
        stats = j.groupBy(text_col).agg(F.count("table_name").alias("__n"),
                                        F.count_if(hit).alias("__hits"))
        j = j.join(stats, text_col).where(~((F.col("__n") > 1) & (F.col("__hits") > 0)) | hit) \
            .drop("__n", "__hits")
    return j.select(text_col, F.coalesce("matched_segment", F.col(text_col)).alias("matched_segment"),
                    F.when(F.col("matched_segment").isNotNull(), F.col("table_name")).alias("table_name"))


def fuzzy_join(left: DataFrame, left_text: str, right: DataFrame, right_text: str, threshold: float = 0.6,
               right_order: str | None = None, all_matches: bool = False, **kw) -> DataFrame:
    """M4: the best match per left row (ties -> first in dictionary order), or
    with ``all_matches`` one row per match >= threshold."""
    if all_matches:
        return fuzzy_matches(left, left_text, right, right_text, threshold, right_order, **kw)
    return fuzzy_best(left, left_text, right, right_text, threshold, right_order, **kw)
