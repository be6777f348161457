"""Operator 6: near-duplicate vectors through a pivot-permutation index.

Reference points (*pivots*) are drawn from the vectors.  A vector is described
by the ordered list of its nearest pivots; an inverted list holds, for each label
and pivot, the vectors that have it among their nearest.  Two vectors that share
enough pivots are candidates and are verified by their exact cosine in double
precision.

Equal vectors with equal labels are one *class*, which takes part once.  A list
is read in blocks of bounded size.  In a block, a pair counts only for the
smallest pivot that it shares, so each pair is verified once.  A block returns
the number of links of each of its classes and a spanning forest, not the pairs,
so a group of very many similar vectors returns as many rows as it has vectors.

The index is fitted to a bounded sample: of the ``SAMPLE * MAX_PIVOTS`` vectors
with the smallest hashes, those that are not close to one taken before become
pivots, ``MAX_PIVOTS`` at most (and twice the square root of the number of classes,
if that is less), so a large group of similar vectors has one pivot and not most
of them.  Where fewer than ``MIN_PIVOTS`` are apart (one cluster, a large shared
mean) the sampled vectors least similar to the pivots fill them up.  Every vector
is indexed.  The number of nearest pivots and how many of them a pair must share
are tried on the sample, against its links and against pairs made to lie just at
the threshold: the first setting that finds ``RECALL`` of both is taken, and if
none does, all pairs are verified.  Links are exact but not necessarily all; the
tests hold the recall against brute force.

Defined results: vectors that are null, zero, empty or hold null, infinite or
NaN components, and rows without label, link with nothing; neither do vectors of
different lengths; equal vectors link (repeated rows too); a null identifier is
no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ._components import components
from ._io import stage

MIN_PIVOTS, MAX_PIVOTS, SAMPLE = 64, 4096, 4
APART = 0.6  # pivots have a smaller cosine than this
NEAREST = 8
SHARED = 2
RECALL, TRIAL = 0.99, 2_000  # share of the links of so many sampled vectors that a setting must find
BLOCK_VECTORS = 2_000
_TILE = 500


def _classes(vectors: DataFrame) -> DataFrame:
    """cid, label, vector, rep (smallest identifier) and size of each class of
    equal vectors that can link."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = (F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    cid = F.concat(F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64("vector", F.lit(1), "label")))
    return (vectors.where(usable).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
            .select(cid.alias("cid"), "label", "vector", "rep", "size"))


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _wide(vectors: list, width: int) -> np.ndarray:
    """Unit vectors, filled up with zeros."""
    return np.stack([np.pad(_unit([v])[0], (0, width - len(v))) for v in vectors])


def _pivots(sample: list, n: int) -> list[np.ndarray]:
    """Up to ``n`` unit vectors of the sample that are apart from one another, and
    while fewer than ``MIN_PIVOTS`` are, the least similar of the others."""
    width = max(len(v) for v in sample)
    kept = np.zeros((0, width))
    out: list[np.ndarray] = []
    for v in sample:
        p = _unit([v])[0]
        wide = np.pad(p, (0, width - len(p)))
        if len(out) < n and not (kept @ wide >= APART).any():
            kept = np.vstack([kept, wide])
            out.append(p)
    rest = sample[:TRIAL]
    if len(out) < min(n, MIN_PIVOTS):
        wide = _wide(rest, width)
        closest = (wide @ kept.T).max(axis=1)
        while len(out) < min(n, MIN_PIVOTS) and closest.min() < 1 - 1e-9:
            i = int(closest.argmin())
            out.append(_unit([rest[i]])[0])
            closest = np.maximum(closest, wide @ wide[i])
    return out


def _nearest(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :k]


def _setting(sample: list, pivots: list[np.ndarray], threshold: float, shared: int) -> tuple[list[np.ndarray], int, int]:
    """Pivots, how many of them describe a vector, and how many a pair must share."""
    trial = sample[:TRIAL]
    pairs = []  # points, x, y, found links of x and y
    for d in {len(v) for v in trial}:
        x = _unit([v for v in trial if len(v) == d])
        if len(x) < 2:
            continue
        points = np.stack([np.pad(p[:d], (0, max(d - len(p), 0))) for p in pivots])
        close = x @ x.T
        links = np.triu(close >= threshold, 1)
        z = np.roll(x, -1, axis=0)
        cosine = (x * z).sum(axis=1, keepdims=True)
        far = cosine[:, 0] < min(threshold, 1 - 1e-9)
        aside = (z - cosine * x)[far]
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        edge = threshold * x[far] + math.sqrt(max(1 - threshold * threshold, 0)) * aside
        pairs.append((points, x, links, far, edge))

    def has(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(x), len(points)), dtype=np.float32)
        np.put_along_axis(out, _nearest(x, points, k), 1, axis=1)
        return out

    for k, need in ((NEAREST, shared), (NEAREST, 1), (2 * NEAREST, 1), (4 * NEAREST, 1)):
        k = min(k, len(pivots))
        need = min(need, k)
        found, of = np.zeros(2), np.zeros(2)
        for points, x, links, far, edge in pairs:
            near = has(x, points, k)
            found += ((near @ near.T >= need)[links].sum(), ((near[far] * has(edge, points, k)).sum(axis=1) >= need).sum())
            of += links.sum(), len(edge)
        if (found >= RECALL * of).all():
            return pivots, k, need
    return pivots[:1], 1, 1  # one list of all vectors


def _described(classes: DataFrame, pivots: list[np.ndarray], k: int) -> DataFrame:
    """``classes`` with ``near``: the numbers of the nearest pivots, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors at most
    names = classes.columns
    schema = StructType([*classes.schema.fields, StructField("near", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        by_length: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            near: list = [None] * len(vectors)
            lengths = np.array([len(v) for v in vectors])
            for d in np.unique(lengths):
                if d not in by_length:  # other lengths: cut or filled up with zeros
                    by_length[d] = np.stack([np.pad(p[:d], (0, max(d - len(p), 0))) for p in points])
                at = np.flatnonzero(lengths == d)
                top = _nearest(_unit([vectors[i] for i in at]), by_length[d], k)
                for i, row in zip(at, top, strict=True):
                    near[i] = row.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near, pa.list_(pa.int32()))], names=[*names, "near"])

    return classes.mapInArrow(run, schema)


def verify_block(rows: pd.DataFrame, pivot: int, same: bool, low_part: int, threshold: float, shared: int) -> pd.DataFrame:
    """(cid, n) links of the block's classes and (cid, other) forest links."""
    left = rows if same else rows[rows["part"] == low_part]
    right = rows if same else rows[rows["part"] != low_part]
    if not len(left) or not len(right):
        return pd.DataFrame({"cid": [], "other": [], "n": []})
    width = max(max(map(max, rows["near"])) + 1, 1)
    used = np.unique(np.concatenate(rows["near"].tolist()))
    column = np.full(width, -1)
    column[used] = np.arange(len(used))

    def has(part: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(part), len(used)), dtype=np.float32)
        out[np.repeat(np.arange(len(part)), [len(x) for x in part["near"]]), column[np.concatenate(part["near"].tolist())]] = 1
        return out

    before = used < pivot
    x, y, hx, hy = _unit(left["vector"].tolist()), _unit(right["vector"].tolist()), has(left), has(right)
    names_x, names_y = left["cid"].tolist(), right["cid"].tolist()
    size_x, size_y = left["size"].to_numpy(), right["size"].to_numpy()
    n_x, n_y = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    forest = []
    for at in range(0, len(x), _TILE):
        rest = at if same else 0
        part = slice(at, at + _TILE)
        found = (hx[part] @ hy[rest:].T >= shared) & (hx[part][:, before] @ hy[rest:][:, before].T == 0)
        found &= x[part] @ y[rest:].T >= threshold
        if same:
            found &= np.arange(rest, len(y))[None, :] > np.arange(at, min(at + _TILE, len(x)))[:, None]
        n_x[part] += found @ size_y[rest:]
        n_y[rest:] += size_x[part] @ found
        for i, j in zip(*np.nonzero(found), strict=True):
            a, b = root(names_x[at + i]), root(names_y[rest + j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((a, b))
    if same:
        n_x, n_y = n_x + n_y, n_y[:0]
    counts = [(c, None, int(n)) for c, n in [*zip(names_x, n_x, strict=True), *zip(names_y, n_y, strict=False)] if n]
    return pd.DataFrame([*counts, *((a, b, 0) for a, b in forest)], columns=["cid", "other", "n"])


def _links(described: DataFrame, threshold: float, shared: int) -> DataFrame:
    lists = described.withColumn("length", F.size("vector")).withColumn("pivot", F.explode("near"))
    key = ["label", "length", "pivot"]
    sizes = lists.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("parts"), F.count(F.lit(1)).alias("__n"))
    sizes = sizes.where("__n > 1").drop("__n")
    rows = (lists.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with"))
            .select(*key, "low", "high", "part", "cid", "size", "near", "vector"))

    def block(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return verify_block(part, int(k[2]), k[3] == k[4], int(k[3]), threshold, shared)

    return rows.groupBy(*key, "low", "high").applyInPandas(block, "cid string, other string, n long")


def link_vectors(vectors: DataFrame, threshold: float = 0.93, shared: int = SHARED, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    classes = stage(_classes(rows), "vector-classes")
    n = classes.count()
    n_pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(2 * math.sqrt(n))))
    sample = [r[0] for r in classes.orderBy("cid").limit(SAMPLE * n_pivots).select("vector").collect()]
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    pivots, k, need = _setting(sample, _pivots(sample, n_pivots), threshold, shared)
    found = stage(_links(_described(classes, pivots, k), threshold, need), "vector-links")
    counts = found.where("other IS NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    of = components(found.where("other IS NOT NULL"), "cid", "other")
    known = stage(classes.select("cid", "label", "vector", "rep", "size").join(counts, "cid", "left")
                  .join(of, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid")), "vector-components")
    smallest = known.groupBy("component").agg(F.min("rep").alias("smallest"))
    known = stage(known.join(smallest, "component").select(F.col("label").alias("__l"), F.col("vector").alias("__v"), "smallest",
                                                           (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n")), "vector-ids")
    joined = rows.join(known, (F.col("label") == F.col("__l")) & (F.col("vector") == F.col("__v")), "left")
    component = F.coalesce("smallest", "id").cast("long")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
