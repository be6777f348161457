"""Operator 12: document fingerprints as bottom-k sketches of shingle hashes.

A document's shingles are its runs of five words (lower-cased); a text with fewer
words is one shingle.  Each shingle is hashed to 64 bits, and the ``k`` smallest
distinct hashes are the sketch.  A sketch of a union is the ``k`` smallest hashes
of the sketches, so parts can be sketched apart and merged (``merge``,
``merge_by``).  Of two sketches, the share of the smallest hashes of their union
that both hold estimates the resemblance, the place of the k-th hash the number of
distinct shingles, and both the containment.  Sketches with fewer than ``k`` hashes
hold all of them, and what they give is exact.

``next_texts`` gives each document the one that follows in the order of the
identifiers.  Identifiers are cut at quantiles into ranges, a document goes once to
its range, and the first of each range to the range before as well; so no task sorts
more than a range.  An identifier so frequent that it fills several ranges is spread
over them by a hash of its text, which is also the order among equal identifiers.

Native: DataFrame functions only.

Defined results: null counts as the empty text; a text without words has an empty
sketch, which resembles empty ones by 1 and others by 0; equal texts have equal
sketches; null identifiers come first; rows that are repeated stand next to each
other, and the last row is followed by the first (a single row by itself); an empty
table gives no rows; other columns are ignored.  Texts of any length are taken whole.
Identifiers are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import WORD, text_or_empty

WORDS = 5
K = 128
ROWS_PER_RANGE = 1000
MAX_RANGES = 8192


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def sketch(hashes: str, words: int = WORDS, k: int = K) -> Column:
    """The sketch of a text from the column that holds its word hashes."""
    h = F.col(hashes)
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
    whole = F.array(F.aggregate(h, F.lit(words).cast("long"), lambda a, w: F.xxhash64(a, w)))
    shingles = F.when(F.size(h) >= words, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def with_sketch(df: DataFrame, text: Column, out: str, words: int = WORDS, k: int = K) -> DataFrame:
    """``df`` with the sketch of ``text``; the word hashes are a column of their own, so they are computed once."""
    return df.withColumn("__hashes", word_hashes(text)).withColumn(out, sketch("__hashes", words, k)).drop("__hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(sketches: DataFrame, group: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch a group of rows: each task sends at most ``k`` hashes of a group."""
    rows = sketches.select(*group, F.explode(column).alias("__hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__hash"))
    least = rows.withColumn("__place", place).where(F.col("__place") <= k)
    return least.groupBy(*group).agg(F.sort_array(F.collect_list("__hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.sort_array(F.array_union(a, b))
    seen = F.when(whole, union).otherwise(F.slice(union, 1, k))
    both = F.array_intersect(a, b)
    alike = F.size(F.array_intersect(seen, both)) / F.size(seen)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(alike)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    share = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds, 0 to 1."""
    n_a, r = distinct_shingles(a, k), resemblance(a, b, k)
    common = r / (1 + r) * (n_a + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / n_a))


def as_text(a: Column) -> Column:
    """The sketch as 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _below(cuts: Column, strides: Column, key: Column, or_equal: bool) -> Column:
    """How many of the sorted cuts are below the key (or equal), by halving."""
    def step(at: Column, s: Column) -> Column:
        cut = F.get(cuts, at + s - 1)
        return F.when(cut <= key if or_equal else cut < key, at + s).otherwise(at)
    return F.aggregate(strides, F.lit(0), step)


def next_texts(rows: DataFrame, carried: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with ``next_<name>`` of the row that follows, for each name of ``carried``."""
    n = rows.count()
    ranges = min(MAX_RANGES, 1 + n // ROWS_PER_RANGE)
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(rows.agg(F.percentile_approx(key, shares, max(10_000, 10 * ranges))).first()[0] or [])
    strides = F.lit([1 << i for i in reversed(range(max(1, len(cuts)).bit_length()))])
    fixed = F.lit(cuts) if cuts else F.array().cast("array<long>")
    id_ = F.col(key)
    order = F.xxhash64(text)
    share = F.shiftrightunsigned(order, 1).cast("double") / 2.0 ** 63
    below, upto = _below(fixed, strides, id_, False), _below(fixed, strides, id_, True)
    placed = rows.withColumn("__order", F.shiftrightunsigned(order, 1)).withColumn("__below", below).withColumn("__upto", upto).withColumn(
        "__range", F.coalesce(F.col("__below") + F.least(F.floor(share * (F.col("__upto") - F.col("__below") + 1)), F.col("__upto") - F.col("__below")), F.lit(0)).cast("int"))
    # One row a range, MAX_RANGES at most: its first row, and the range before it that holds rows.
    firsts = placed.groupBy("__range").agg(F.min(F.struct(F.col(key).alias("id"), F.col("__order").alias("order"))).alias("first"))
    bounds = sorted(firsts.collect(), key=lambda r: r["__range"])
    table = rows.sparkSession.createDataFrame(
        [(r["__range"], r.first.id, r.first.order, bounds[i - 1]["__range"]) for i, r in enumerate(bounds)],
        f"r int, first_id {dict(rows.dtypes)[key]}, first_order long, before int")
    marked = placed.join(F.broadcast(table), F.col("__range") == F.col("r"))
    is_first = id_.eqNullSafe(F.col("first_id")) & (F.col("__order") == F.col("first_order"))
    copies = F.when(is_first, F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy")),
                                      F.struct(F.col("before").alias("at"), F.lit(1).alias("copy")))).otherwise(
        F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy"))))
    sent = marked.select(*rows.columns, "__order", F.inline(copies))
    w = Window.partitionBy("at").orderBy("copy", key, "__order")
    following = sent.select("copy", *rows.columns, *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return following.where("copy = 0").drop("copy")


def edited_fingerprints(docs: DataFrame, words: int = WORDS, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced
    by the start of the next document, and their likeness."""
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = with_sketch(rows, F.col("text"), "a", words, k)
    rows = next_texts(rows, ["text", "a"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "a", "next_a", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_sketch(rows, F.col("edited"), "e", words, k)
    a, e, following = F.col("a"), F.col("e"), F.col("next_a")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(a).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
                       resemblance(a, e, k).alias("near_edited"), resemblance(a, following, k).alias("near_next"),
                       distinct_shingles(a, k).alias("n_shingles"), containment(a, e, k).alias("kept_share"))
