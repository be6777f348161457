"""Operator 11: spelling variants through a variable-length gram index.

Words are counted over all texts.  The grams of the words (2 to 5 symbols, with
a start and an end mark) are counted too, and a *gram dictionary* is pruned by
frequency: all grams of two symbols, and a longer gram only where its prefix
stands in more than ``min_list`` words, so a rare gram is not extended and a
frequent one gives way to its extensions.  The dictionary holds at most
``max_grams`` longer grams; beyond that the frequency bound rises.

A word is *decomposed* by taking the longest gram at each place and dropping
those that lie inside an earlier one.  For each place of an edit the grams that
it may change are known: those whose lookup reads the place, and those to its
right that a gram through the place could swallow.  The largest such number is
the word's bound of affected grams.  So of any ``bound + 1`` grams of a word one
is left in each near word, and only the lists of the ``bound + 1`` rarest grams
are merged.  Every pair that meets in a list is verified by its edit distance.

The bound never reaches the number of grams, hence no word is left out: a word of
n letters has n + 2 symbols, one side of an edit keeps (n + 1) / 2 of them at
least, and grams are no longer than that (``CLASSES``; lengths where two classes
meet are indexed in both, so near words always share a class).

Defined results: null and empty texts hold no words; a null identifier is
written as an empty string in the hash that picks misspelt runs; rows that are
repeated count each; equal counts are ordered by code points; an empty table
gives no rows; columns beside identifier and text are ignored.  Texts and runs of
any length are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import stage, text_or_empty

#: Word lengths from, to, and the longest gram for them.
CLASSES = ((2, 4, 2), (4, 6, 3), (6, 9, 4), (9, None, 5))
START, END = "^", "$"
MIN_LIST = 24
MAX_GRAMS = 150_000
RUN = "[a-zÀ-ÿ]+"


def _classes(length: int) -> list[int]:
    return [c for c, (low, high, _) in enumerate(CLASSES) if low <= length and (high is None or length <= high)]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int = 97, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters, lower-cased in A-Z.  A run whose hash with
    the identifier is a multiple of ``drop_every`` loses the letter at hash modulo
    length (0: no run does)."""
    lower = F.translate(text_or_empty(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= min_length)
    word: Column = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % drop_every == 0, short).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(cls, gram, n) over all places of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[int, str]] = Counter()
            for word in batch.column(0).to_pylist():
                s = START + word + END
                for c in _classes(len(word)):
                    for q in range(2, CLASSES[c][2] + 1):
                        found.update((c, s[p:p + q]) for p in range(len(s) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([g for _, g in found], pa.string()),
                                              pa.array(found.values(), pa.int64())], names=["cls", "gram", "n"])
    return words.select("word").mapInArrow(run, "cls int, gram string, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n"))


class GramDictionary:
    """The pruned grams, ranked from the shortest list to the longest."""

    def __init__(self, counts: dict[tuple[int, str], int]) -> None:
        # A place that takes a longer gram doesn't enter the list of the shorter one.
        lists = dict(counts)
        for (c, g), n in counts.items():
            if len(g) > 2:
                lists[c, g[:-1]] -= n
        self.size = len(lists)
        self.rank: list[dict[str, int]] = [{} for _ in CLASSES]
        for i, (c, g) in enumerate(sorted(lists, key=lambda x: (lists[x], x))):
            self.rank[c][g] = i
        self.extended = [{g[:-1] for g in r if len(g) > 2} for r in self.rank]
        #: What may stand inside a gram behind its first symbol.
        self.inner = [{g[a:b] for g in r for a in range(1, len(g) - 1) for b in range(a + 2, len(g) + 1)} for r in self.rank]

    def decompose(self, word: str, cls: int) -> tuple[list[int], int]:
        """The tokens of a word, a number for each gram and its repeats, and the
        most of them that one edit can change."""
        s = START + word + END
        m, longest = len(s), CLASSES[cls][2]
        rank, extended, inner = self.rank[cls], self.extended[cls], self.inner[cls]
        tokens: list[int] = []
        steps = [0] * (m + 2)
        seen: Counter[str] = Counter()
        end = 0
        for p in range(m - 1):
            q = 2
            while q < longest and p + q < m and s[p:p + q + 1] in rank:
                q += 1
            if p + q <= end:
                continue
            end = p + q
            gram = s[p:end]
            tokens.append(rank[gram] + self.size * seen[gram])
            seen[gram] += 1
            # The places that the lookup reads, and those left of it from which a gram could swallow this one.
            reads = end if gram in extended and end < m else end - 1
            first = p
            while first > 0 and s[first:end] in inner:
                first -= 1
            steps[first] += 1
            steps[reads + 1] -= 1
        most = here = 0
        for x in steps[:m]:
            here += x
            most = max(most, here)
        return tokens, most

    def probes(self, word: str) -> list[int]:
        """The rarest tokens of a word, of which each near word shares one."""
        out: list[int] = []
        for c in _classes(len(word)):
            tokens, affected = self.decompose(word, c)
            out += sorted(tokens)[:affected + 1]
        return out


def gram_dictionary(words: DataFrame, min_list: int = MIN_LIST, max_grams: int = MAX_GRAMS) -> GramDictionary:
    """Grams of two symbols are bounded by the letters, longer ones by ``max_grams``."""
    counts = stage(_gram_counts(words), "variants-grams")
    above = counts.select(F.col("cls").alias("c"), F.col("gram").alias("prefix"), F.col("n").alias("above")).where(F.col("above") > min_list)
    longer = counts.where(F.length("gram") > 2).withColumn("prefix", F.expr("substring(gram, 1, length(gram) - 1)"))
    found = (longer.join(above, (F.col("cls") == F.col("c")) & (longer["prefix"] == above["prefix"])).select("cls", "gram", "n", "above")
             .orderBy(F.desc("above"), "cls", "gram").limit(max_grams + 1).collect())
    bound = found[max_grams].above if len(found) > max_grams else min_list
    grams = {(r.cls, r.gram): r.n for r in found if r.above > bound}
    grams |= {(r.cls, r.gram): r.n for r in counts.where(F.length("gram") == 2).collect()}
    return GramDictionary(grams)


def near_words(words: DataFrame, min_list: int = MIN_LIST, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(a, n_a, b, n_b), a < b: pairs of words of ``words`` (word, n; at least two
    letters each) that differ by one inserted, deleted or replaced letter."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, min_list, max_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            tokens = [grams.probes(w) for w in batch.column(0).to_pylist()]
            at = pa.array([i for i, t in enumerate(tokens) for _ in t], pa.int64())
            rows = batch.take(at)
            yield pa.RecordBatch.from_arrays([pa.array([x for t in tokens for x in t], pa.int64()), *rows.columns], names=["token", "word", "n"])

    lists = words.select("word", "n").mapInArrow(run, "token long, word string, n long").withColumn("len", F.length("word"))
    # Staged, so that both sides of the join are plain shuffles and a long list can be split.
    lists = stage(lists, "variants-lists")
    a, b = lists.alias("a"), lists.alias("b")
    near = ((F.col("a.token") == F.col("b.token")) & F.abs(F.col("a.len") - F.col("b.len")).__le__(1)
            & (F.col("a.word") < F.col("b.word")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return a.join(b, near).select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): each form is followed to the last.  Every step leads to a
    more frequent word, so there are no circles; pointers double in each round,
    and only words whose pointer still has a form go on."""
    links = stage(forms.select("word", F.col("form").alias("root")), "variants-links")
    done, todo = [], links
    steps = links.select(F.col("word").alias("from"), F.col("root").alias("to"))
    while True:
        joined = stage(todo.join(steps, todo["root"] == steps["from"], "left").select("word", "root", "to"), "variants-roots")
        done.append(joined.where("to IS NULL").select("word", "root"))
        todo = joined.where("to IS NOT NULL").select("word", F.col("to").alias("root"))
        if todo.isEmpty():
            break
        # Pointers of twice the length; words that are through keep theirs.
        steps = joined.select(F.col("word").alias("from"), F.coalesce("to", "root").alias("to")) if len(done) == 1 else stage(
            steps.alias("s").join(steps.alias("t"), F.col("s.to") == F.col("t.from"), "left")
            .select(F.col("s.from").alias("from"), F.coalesce("t.to", "s.to").alias("to")), "variants-steps")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int = 97, ratio: int = 2,
                      key: str = "doc_id", text: str = "text", min_list: int = MIN_LIST, max_grams: int = MAX_GRAMS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its form is the most
    frequent near word, if that occurs ``ratio`` times as often at least."""
    if min_length < CLASSES[0][0]:
        raise ValueError("words of one letter share no grams")
    words = stage(count_words(docs, min_length, min_count, drop_every, key, text), "variants-words")
    pairs = stage(near_words(words, min_list, max_grams), "variants-pairs")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("near"), F.col("n_b").alias("n_of")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("near"), F.col("n_a").alias("n_of")))
    best = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_of")).alias("n"), "near")).alias("best"))
    best = stage(best.select("w", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("n_of")), "variants-best")
    is_form = F.col("n_of") >= ratio * F.col("n")
    rows = stage(words.join(best, words["word"] == best["w"], "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("n_of")).alias("form_n")), "variants-forms")
    roots = _roots(rows.where("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    return rows.join(roots, rows["word"] == roots["w"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
