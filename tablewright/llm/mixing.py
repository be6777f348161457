"""Operator 3: mixing sources to target weights.

The words of each source, in an order that only the rows decide, form one
stream that is packed into blocks of ``block_words`` words.  The mix takes
blocks:

1. targets: sources share the words of all rows by weight; a source is taken
   ``max_repeats`` times at most, and what it cannot give is shared again;
2. slots: the target of a source is so many block slots, the last one cut so
   that the words add up to the target exactly;
3. multinomial counts: each slot of a source draws its output shard, which gives
   each shard a multinomial number of blocks of the source, given the source's
   total (so the whole mix does not drift from the targets);
4. permutation: the slots of a source, numbered shard after shard, run through
   pseudorandom permutations of the source's block numbers, one for each pass;
   a block comes again only when all blocks of its source have come;
5. join: blocks are joined by (source, block number).

Native: DataFrame operations only.  Sources are split by blocks and by hash
buckets of the row key, so a source with a third of all rows spreads over all
tasks.  Tables of one row per source (and per source and output shard) are the
only ones that are not split.

The permutation is a swap-or-not shuffle (Hoang, Morris and Rogaway, 2012): it
permutes any number of blocks without a table and can be run backwards.

Defined results: null text has size 0; null is a source of its own, the last
one; rows of size 0 are taken 0 words; repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored by :func:`mix` and kept by
:func:`mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import WORD, stage, word_count
from ._prefix import bucket_count, running_start

BLOCK_WORDS = 512
SHARD_BLOCKS = 4096
_DRAWS = 4096
#: Slots that one task deals, so that tasks follow the slots, not the few bytes of their ranges.
_TASK_SLOTS = 16_384
_ROUNDS = 24


@dataclass
class Mix:
    """rows: rid and the input columns, size, sid, start; sources: one row per
    source; slots: sid, shard, slot, epoch, block, take; pieces: rid, sid, block
    and the words [low, high) of the block that the row holds, from word ``at``."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    block_words: int


def targets(totals: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """Add sid, weight and target to (source, source_size).

    Capped shares add up to the total T for the one level x with
    sum(min(cap, x * weight)) = T.  With the sources in the order of cap / weight
    and the first k capped, x is the largest (T - caps of the first k) / (weight
    of the rest) over k."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    return (totals.withColumn("sid", F.row_number().over(by_source) - 1).withColumn("weight", w)
            .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("capped_before", F.sum("cap").over(by_ratio) - F.col("cap"))
            .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
            .withColumn("level", F.max((F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_left")).over(everything))
            .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
            .select("source", "source_size", "sid", "weight", "target"))


def permuted(x: Column, n: Column, seed: list[Column], backwards: bool = False) -> Column:
    """Swap-or-not permutation of 0 .. n-1."""
    rounds = F.sequence(F.lit(_ROUNDS - 1), F.lit(0)) if backwards else F.sequence(F.lit(0), F.lit(_ROUNDS - 1))

    def swap(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - v, n)
        top = F.greatest(v, other)
        return F.when(F.xxhash64(*seed, r, top).bitwiseAND(F.lit(1)) == 1, other).otherwise(v)

    return F.aggregate(rounds, x.cast("long"), swap)


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def _plan(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Blocks, passes and slots of each source.  ``rest`` words are taken in the
    last pass; ``short_at`` is the slot there that holds the last, short block."""
    n, size = F.col("n_blocks"), F.col("source_size")
    return (sources.where((size > 0) & (F.round("target") > 0))
            .withColumn("words", F.round("target").cast("long"))
            .withColumn("n_blocks", _ceil_div(size, block)).withColumn("short", size - (n - 1) * block)
            .withColumn("passes", F.expr("words div source_size")).withColumn("rest", F.col("words") - F.col("passes") * size)
            .withColumn("short_at", permuted(n - 1, n, [F.lit(seed), F.col("sid"), F.col("passes")], backwards=True))
            .withColumn("full", _ceil_div(F.col("rest"), block))
            .withColumn("last_slots", F.when(F.col("full") <= F.col("short_at"), F.col("full"))
                        .otherwise(F.least(n, _ceil_div(F.col("rest") + block - F.col("short"), block))))
            .withColumn("n_slots", F.col("passes") * n + F.col("last_slots")))


def _slots(plan: DataFrame, block: int, shard_blocks: int, seed: int) -> DataFrame:
    m = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("m")).first()["m"]
    n_shards, tasks = max(1, -(-m // shard_blocks)), max(1, -(-m // _TASK_SLOTS))
    # Draws, in ranges, so that no row of a large source becomes many rows in one task.
    ranges = plan.select("sid", "n_slots", F.explode(F.sequence(F.lit(0), F.expr(f"(n_slots - 1) div {_DRAWS}"))).alias("part"))
    draws = (ranges.repartition(tasks, "sid", "part")
             .select("sid", F.explode(F.sequence(F.col("part") * _DRAWS, F.least("n_slots", (F.col("part") + 1) * _DRAWS) - 1)).alias("draw")))
    counts = (draws.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "sid", "draw"), F.lit(n_shards).cast("long")))
              .groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")))
    first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    numbered = (counts.withColumn("first", first).repartition(tasks, "sid", "shard")
                .select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")))
    n, j, short_at = F.col("n_blocks"), F.col("j"), F.col("short_at")
    placed = (numbered.join(plan.drop("source"), "sid")
              .withColumn("epoch", F.expr("slot div n_blocks")).withColumn("j", F.col("slot") - F.col("epoch") * n)
              .withColumn("block", permuted(j, n, [F.lit(seed), F.col("sid"), F.col("epoch")]))
              .withColumn("length", F.when(F.col("block") == n - 1, F.col("short")).otherwise(F.lit(block)))
              .withColumn("before", j * block - F.when(j > short_at, block - F.col("short")).otherwise(0))
              .withColumn("take", F.when(F.col("epoch") < F.col("passes"), F.col("length"))
                          .otherwise(F.least("length", F.col("rest") - F.col("before")))))
    return placed.where(F.col("take") > 0).select("sid", "shard", "slot", "epoch", "block", F.col("take").cast("long").alias("take"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0, block_words: int = BLOCK_WORDS,
             shard_blocks: int = SHARD_BLOCKS, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", row_id: str | None = None) -> Mix:
    """The whole plan of a mix; nothing here moves texts.  ``row_id`` names a
    unique column; without it the rows are numbered as they are written."""
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    narrow = stage(docs.select(rid.alias("rid"), F.col(key).alias("doc_id"),
                               F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(targets(totals, weights, max_repeats), "mix-sources")
    known = sources.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    rows = narrow.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = stage(running_start(rows, "sid", ["doc_id", "size", "rid"], F.col("size"), bucket_count(narrow.count()), "start"), "mix-rows")
    slots = _slots(stage(_plan(sources, block_words, seed), "mix-plan"), block_words, shard_blocks, seed)
    first = F.expr(f"start div {block_words}")
    block = F.col("block")
    pieces = (rows.where("size > 0")
              .select("rid", "sid", "start", "size", F.explode(F.sequence(first, F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
              .select("rid", "sid", "block", F.greatest(F.col("start") - block * block_words, F.lit(0)).alias("low"),
                      F.least(F.col("start") + F.col("size") - block * block_words, F.lit(block_words)).alias("high"),
                      F.greatest(block * block_words - F.col("start"), F.lit(0)).alias("at")))
    return Mix(rows, sources, slots, pieces, block_words)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target and taken,
    the words of the row that the mix holds, repeats counted."""
    m = plan_mix(docs, **options)
    uses = m.slots.groupBy("sid", "block", "take").agg(F.count(F.lit(1)).alias("times"))
    words = F.least("high", "take") - F.col("low")
    taken = (m.pieces.join(uses, ["sid", "block"]).where(words > 0)
             .groupBy("rid").agg(F.sum(F.col("times") * words).alias("taken")))
    return (m.rows.join(taken, "rid", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_blocks(m: Mix) -> DataFrame:
    """The mix itself: for each output shard and slot the row pieces that its
    block holds: shard, sid, slot, epoch, rid, words [at, at + n_words) of the row."""
    return (m.slots.join(m.pieces, ["sid", "block"]).withColumn("n_words", F.least("high", "take") - F.col("low"))
            .where("n_words > 0").select("shard", "sid", "slot", "epoch", "rid", "at", "n_words"))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass
    that takes words of a row.  A pass that takes all of them gives the text
    unchanged, else the taken words, joined by blanks, in their order."""
    docs = stage(docs.withColumn("__rid", F.monotonically_increasing_id()), "mix-docs")
    m = plan_mix(docs, text=text, row_id="__rid", **options)
    taken = (mixed_blocks(m).groupBy("rid", "epoch")
             .agg(F.sum("n_words").alias("n"), F.sort_array(F.collect_list(F.struct("at", "n_words"))).alias("parts"))
             .join(m.rows.select("rid", "size"), "rid")
             .select(F.col("rid").alias("__rid"), F.when(F.col("n") < F.col("size"), F.col("parts")).alias("__parts")))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    part = F.flatten(F.transform("__parts", lambda p: F.slice(F.col("__words"), (p["at"] + 1).cast("int"), p["n_words"].cast("int"))))
    return (docs.join(taken, "__rid").withColumn("__words", F.when(F.col("__parts").isNotNull(), words))
            .withColumn(text, F.when(F.col("__parts").isNull(), F.col(text)).otherwise(F.array_join(part, " ")))
            .drop("__rid", "__parts", "__words"))
