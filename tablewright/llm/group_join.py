"""Operator 4: set-similarity join of documents through a token-group matrix.

A document is its set of word shingles; two link when their Jaccard similarity
is at least ``num / den``.  Documents with the same set are one *class*, which
takes part once.

1. Order: tokens are ordered by how common they are, from a sketch of fixed size
   that counts the tokens of all documents, then by value.  Two sets that link
   share one of their first |set| - ceil(t |set|) + 1 tokens in any order; in
   this order these *first tokens* are the rare ones.
2. Groups: classes are partitioned by the smallest hash of their set, which
   similar sets mostly share; large groups are split by size.  Any partition
   gives the same links.
3. Matrix: for each group the union of the first tokens of its classes, with the
   smallest and largest set that has the token.
4. Bound: a class is sent to a group only if they share a first token and the
   sizes fit; there it is compared with no one unless the whole token union of
   the group covers ceil(t |set|) of its tokens.
5. Open: blocks of bounded size are first opened with the classes' *parity bits*
   (each token flips one of about |set| bits): two sets differ in at least as many
   tokens as their bits differ in, which rules out most pairs that share a passage
   but are not similar.  Only classes with a pair that is left send their tokens;
   those pairs are compared by exact overlap.

A block returns a spanning forest of its links, which is enough for components
and keeps a group of very many similar documents from returning all pairs.

Defined results: null and empty texts have the empty set and link with nothing;
repeated rows and repeated identifiers are rows of their own with one component;
a null identifier takes the component of its class; an empty table gives no
rows; other columns are ignored.  Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._io import stage
from ._shingles import shingle_sets

SKETCH_BITS = 18
BLOCK_TOKENS = 400_000
FILTER_CELLS = 1 << 20
_SLICE = 512


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many sets have a token of each sketch cell; a table of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                sets = list(shingle_sets(batch.column("text").slice(at, _SLICE).to_pylist(), words))
                total += np.bincount(_cell(np.concatenate(sets)), minlength=1 << SKETCH_BITS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[rows["cell"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity_bits(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens in each cell of a power of two of cells."""
    cells = max(256, 1 << int(len(tokens) - 1).bit_length())
    return np.packbits(np.bincount(tokens & (cells - 1), minlength=cells) & 1).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits for fewer cells: halves laid over each other."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _features(docs: DataFrame, words: int, num: int, den: int, counts: np.ndarray, kind: str) -> DataFrame:
    """doc_id, digest of the set, its size, its group hash and first tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                sets = list(shingle_sets(part.column("text").to_pylist(), words))
                first = []
                for s in sets:
                    keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    order = np.lexsort((s, common[_cell(s)]))[:keep]
                    first.append(s[order])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([int(s[0]) if len(s) else None for s in sets], pa.int64()),
                    pa.array(first, pa.list_(pa.int64())), pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "digest", "n", "lead", "first", "bits"])

    return docs.mapInArrow(run, f"doc_id {kind}, digest binary, n long, lead long, first array<long>, bits binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id's text as digest and token set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                sets = list(shingle_sets(part.column("text").to_pylist(), words))
                mine = np.array([bool(len(s)) and _digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column("digest").filter(pa.array(mine)),
                                                  pa.array([_packed(s) for s, m in zip(sets, mine, strict=True) if m], pa.binary())],
                                                 names=["digest", "tokens"])

    return docs.mapInArrow(run, "digest binary, tokens binary")


def _packed(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each token: enough to tell the tokens of two sets
    apart, a quarter less to move."""
    return np.unique(tokens.view(np.uint64) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def sift_block(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """The rows of a block with a pair that sizes and parity bits do not rule out.
    Similarity needs |difference| <= (den - num) / (den + num) * (sum of sizes)."""
    n = rows["n"].to_numpy()
    bits = [np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]]
    width = np.array([len(b) for b in bits])
    member, query = rows["member"].to_numpy(), rows["query"].to_numpy()
    left = np.zeros(len(rows), dtype=bool)
    stacks = {w: (at := np.flatnonzero(member & (width == w)), np.stack([bits[i] for i in at])) for w in np.unique(width[member])}
    for q in np.flatnonzero(query):
        for w, (at, stack) in stacks.items():
            fits = (n[at] * den >= num * n[q]) & (n[q] * den >= num * n[at]) & (at != q)
            if fits.any():
                size = min(w, width[q])
                differ = np.bitwise_count(_folded(stack[fits], size) ^ _folded(bits[q], size)).sum(axis=1, dtype=np.int64)
                close = at[fits][differ * (den + num) <= (den - num) * (n[at[fits]] + n[q])]
                if len(close):
                    left[close] = left[q] = True
    return rows.loc[left, ["lead", "part", "block", "digest", "member", "query"]]


def open_block(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between the queries and the members of one block; a spanning forest."""
    rows = rows.drop_duplicates("digest")  # an identifier may stand in several rows
    members, queries = rows[rows["member"]], rows[rows["query"]]
    if not len(members) or not len(queries):
        return pd.DataFrame({"a": [], "b": []})
    names = members["digest"].tolist()
    sets = [_unpacked(x) for x in members["tokens"]]
    size = np.array([len(s) for s in sets])
    union, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links: list[tuple[bytes, bytes]] = []
    marked = np.zeros(len(union), dtype=bool)
    for name, packed in zip(queries["digest"], queries["tokens"], strict=True):
        tokens = _unpacked(packed)
        place = np.searchsorted(union, tokens)
        place[place == len(union)] = 0
        hit = place[union[place] == tokens]
        if len(hit) * den < num * len(tokens):
            continue  # the whole union covers too little
        fits = (size * den >= num * len(tokens)) & (len(tokens) * den >= num * size)
        if not fits.any():
            continue
        marked[hit] = True
        shared = np.add.reduceat(marked[at], starts, dtype=np.int64)
        marked[hit] = False
        for i in np.flatnonzero(fits & (shared * den >= num * (size + len(tokens) - shared))):
            x, y = root(name), root(names[i])
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((name, names[i]))
    return pd.DataFrame(links, columns=["a", "b"])


def _candidates(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(members, queries): the classes of each group that is opened, and the
    classes that are sent there; both with lead, part, digest, n."""
    rows = classes.count()
    tokens = classes.select("cid", F.explode("first").alias("token"))  # narrow: there is a row for each first token
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("token")
    tokens = stage(tokens.join(shared, "token"), "join-tokens")
    active = classes.select("cid", "digest", "n", "lead").join(tokens.select("cid").distinct(), "cid")
    parts = active.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    grouped = stage(active.join(parts, "lead").select("cid", "digest", "n", "lead", F.pmod(F.xxhash64("digest"), "parts").alias("part")), "join-groups", rows)
    tokens = tokens.join(grouped, "cid")
    matrix = (tokens.groupBy("token", F.col("lead").alias("to_lead"), F.col("part").alias("to_part"))
              .agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high")))
    own = (F.col("lead") == F.col("to_lead")) & (F.col("part") == F.col("to_part"))
    later = F.struct("to_lead", "to_part") > F.struct("lead", "part")
    sent = (tokens.join(matrix, "token").where((later | (own & (F.col("members") > 1)))
                                               & (F.col("high") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("low") * num))
            .select("digest", "n", F.col("to_lead").alias("lead"), F.col("to_part").alias("part")).distinct())
    queries = stage(sent, "join-queries")
    members = grouped.join(queries.select("lead", "part").distinct(), ["lead", "part"], "left_semi")
    return stage(members.select("lead", "part", "digest", "n"), "join-members", rows), queries


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The texts of the rows in ``needed`` (digest, rep).  A filter of fixed size,
    the hash cells of the needed identifiers, keeps most other texts out of the
    shuffle."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    cells = needed.select(cell("rep").alias("cell")).distinct()  # FILTER_CELLS rows at most
    some = docs.select("doc_id", "text").join(F.broadcast(cells), cell(docs["doc_id"]) == F.col("cell"), "left_semi")
    return some.join(needed, F.col("doc_id").eqNullSafe(F.col("rep"))).select("digest", "text")


def links(docs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): digests of linked classes, a spanning forest of each block."""
    members, queries = _candidates(classes, num, den)
    blocks = queries.groupBy("lead", "part").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    sent = queries.join(blocks, ["lead", "part"]).select(
        "lead", "part", F.pmod(F.xxhash64("digest"), "blocks").cast("int").alias("block"), "digest", F.lit(False).alias("member"))
    there = members.join(blocks, ["lead", "part"]).select(
        "lead", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "digest", F.lit(True).alias("member"))
    # A class that is a query and a member of a block goes there once.
    rows = (sent.unionByName(there).groupBy("lead", "part", "block", "digest")
            .agg(F.max("member").alias("member"), F.max(~F.col("member")).alias("query")))
    key = ["lead", "part", "block"]
    left = stage(rows.join(classes.select("digest", "n", "bits"), "digest").groupBy(*key).applyInPandas(
        lambda x: sift_block(x, num, den), "lead long, part long, block int, digest binary, member boolean, query boolean"), "join-left")
    needed = stage(left.select("digest").distinct().join(classes.select("digest", "rep"), "digest"), "join-needed", classes.count())
    sets = stage(_sets(_texts_of(docs, needed), words), "join-sets")
    return left.join(sets, "digest").groupBy(*key).applyInPandas(lambda x: open_block(x, num, den), "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest identifier that links lead to, its own included)."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    features = stage(_features(rows, words, num, den, _counts(rows, words), kind), "join-features")
    known, n_rows = features.where("n > 0"), features.count()
    classes = stage(known.groupBy("digest").agg(F.first(F.xxhash64("digest")).alias("cid"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("lead").alias("lead"),
                                                F.first("first").alias("first"), F.first("bits").alias("bits")), "join-classes", n_rows)
    of = components(links(rows, classes, words, num, den), "a", "b")
    reps = classes.select("digest", "rep").join(of, F.col("digest") == F.col("node"), "left")
    reps = stage(reps.select("digest", "rep", F.coalesce("component", "digest").alias("component")), "join-components", n_rows)
    smallest = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    smallest = stage(reps.join(smallest, "component").select("digest", "component_id"), "join-ids", n_rows)
    return (features.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(smallest, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component,
    with all their columns."""
    found = near_duplicates(docs, words, num, den, key, text)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, F.col(key).eqNullSafe(F.col("__id")), "left_semi")
