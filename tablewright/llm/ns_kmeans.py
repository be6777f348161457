"""Operator 13: centroid clustering with ns-bounds.

Each vector keeps, for every centroid, the distance at its last evaluation, the
round of that evaluation, and the same for its own centroid.  The history of all
centroids is kept, so a bound is loosened by the *norm of the sum* of the moves
since then, the distance between the centroid then and now, and not by the sum of
the moves' norms.  A centroid whose loosened lower bound stays above the upper
bound is not looked at.  If one fails, the vector's own distance is made exact
first and then only the centroids that still fail are evaluated, in integers.

Components are integers (64 times the number, rounded down), so assignments,
means and sums are exact.  Distances are held in 64-bit integers where the
components allow it and in Python's integers beyond.  Sums of moved vectors are
added as four 40-bit limbs by Spark; the driver gets one row a centroid.

State is written to the shared folder after each round; a lost executor costs the
tasks that ran.

Defined results: vectors that are null, have another length or hold null or
non-finite components are left out; repeated rows count each; a null identifier is
hashed as the empty text and comes last among the first centroids; of equal hashes
the smaller vector (by its components) is the first; with fewer vectors than
centroids each is a centroid; an empty table gives no rows; a distance or sum
beyond a long is given as the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import stage

SCALE = 64
#: Components up to this size give differences, squares and sums within 64 bits.
_SMALL = 1 << 26
_LONG = (1 << 63) - 1
_LIMB = 40
_STATE = "vec_id long, vector array<double>, cluster int, was int, upper double, lower array<double>, seen array<short>, distance long"


def kept_vectors(vectors: DataFrame, dims: int, key: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the usable vectors; the components times 64, rounded
    down, as doubles, which hold them exactly."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: _floor(x.cast("double") * SCALE))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(key).cast("long").alias("vec_id"), whole.alias("vector"))


def _floor(x: Column) -> Column:
    """Floor of a double as a double; beyond 2^53 a double is whole already."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Exact integers: 64 bits where they are small enough, else Python's."""
    if not rows.size or np.abs(rows).max() <= _SMALL:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows], dtype=object)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from the matching rows of ``c``."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class History:
    """The centroids of all rounds so far, as exact integers."""

    def __init__(self, rounds: list[list[list[int]]]) -> None:
        big = any(abs(x) > _SMALL for r in rounds for c in r for x in c)
        self.rounds = [np.array(r, dtype=object if big else np.int64) for r in rounds]

    @property
    def now(self) -> np.ndarray:
        return self.rounds[-1]

    def moved(self) -> np.ndarray:
        """[round, centroid]: how far the centroid is now from where it was then."""
        return np.stack([_root(_squared(self.now, then)) for then in self.rounds])


def assign(x: np.ndarray, history: History, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Move each row to its nearest centroid; the bounds are updated in place.
    ``upper`` is the distance of a row's own centroid, evaluated in the round
    ``seen[row, own]``.  Returns the exact squared distances."""
    now, k = len(history.rounds) - 1, len(history.now)
    c, rows = history.now, np.arange(len(x))
    moved = history.moved()
    # Bounds are rounded outwards, so a rounding error leads to an evaluation, never to a miss.
    loose = lower - moved[seen, np.arange(k)[None, :]]
    loose -= 1e-9 * (1 + np.abs(lower))
    above = upper + moved[seen[rows, cluster], cluster]
    above += 1e-9 * (1 + above)
    failed = loose <= above[:, None]
    failed[rows, cluster] = False
    own = _squared(x, c[cluster])
    tight = _root(own)
    tight += 1e-9 * (1 + tight)
    failed &= loose <= tight[:, None]
    lower[rows, cluster] = _root(own)
    seen[rows, cluster] = now
    best = own.copy()
    for j in range(k):
        at = np.flatnonzero(failed[:, j])
        if not len(at):
            continue
        d = _squared(x[at], np.broadcast_to(c[j], (len(at), c.shape[1])))
        lower[at, j] = _root(d)
        seen[at, j] = now
        better = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        best[at[better]] = d[better]
        cluster[at[better]] = j
    upper[:] = _root(best)
    return best


def _rounds(rows: DataFrame, history: list[list[list[int]]], first: bool) -> DataFrame:
    """One assignment of all vectors; ``first``: without bounds so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = History(history)
        k = len(past.now)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _whole(np.stack(batch.column("vector").to_numpy(zero_copy_only=False)))
            if first:
                # Nothing is known of the others: their lower bound is 0.
                cluster, lower, seen = np.zeros(n, np.int64), np.zeros((n, k)), np.zeros((n, k), np.int16)
                upper = _root(_squared(x, past.now[cluster]))
                was = np.full(n, -1)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                upper = batch.column("upper").to_numpy().copy()
                lower = np.stack(batch.column("lower").to_numpy(zero_copy_only=False)).copy()
                seen = np.stack(batch.column("seen").to_numpy(zero_copy_only=False)).copy()
                was = cluster.copy()
            d = assign(x, past, cluster, upper, lower, seen)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper),
                pa.array(list(lower), pa.list_(pa.float64())), pa.array(list(seen), pa.list_(pa.int16())), pa.array([min(_LONG, int(v)) for v in d], pa.int64())],
                names=["vec_id", "vector", "cluster", "was", "upper", "lower", "seen", "distance"])
    return rows.mapInArrow(run, _STATE)


def _limbs(value: int) -> list[int]:
    mask = (1 << _LIMB) - 1
    return [value & mask, value >> _LIMB & mask, value >> 2 * _LIMB & mask, value >> 3 * _LIMB]


def _moves(state: DataFrame, k: int, dims: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid: how many vectors came (less those that left), and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(np.stack(batch.column("vector").to_numpy(zero_copy_only=False)))
            out: list[tuple[int, int, list[int]]] = []
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy()
                for j in np.unique(of[of >= 0]):
                    total = x[of == j].sum(axis=0)
                    out.append((int(j), sign * int((of == j).sum()), [y for v in total for y in _limbs(sign * int(v))]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.where("cluster <> was").select("vector", "cluster", "was").mapInArrow(run, "cluster int, n long, sums array<long>")
    # One row a centroid and place, 4 x dims + 1 places: bounded by the centroids.
    places = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "value"))
    found: dict[int, list[int]] = {}
    for r in places.groupBy("cluster", "place").agg(F.sum("value").alias("s")).collect():
        found.setdefault(r.cluster, [0] * (4 * dims + 1))[r.place] = r.s
    out = {j: (v[0], [sum(v[1 + 4 * i + b] << (_LIMB * b) for b in range(4)) for i in range(dims)]) for j, v in found.items()}
    return out


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1, key: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every
    kept vector after ``rounds`` updates of ``k`` centroids and a last assignment."""
    spark = vectors.sparkSession
    rows = stage(kept_vectors(vectors, dims, key, vector), "clusters-vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = rows.orderBy(F.col("vec_id").isNull(), named, "vector").limit(k).select("vector").collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = [[[int(x) for x in r.vector] for r in start]]
    counts, sums = [0] * len(start), [[0] * dims for _ in start]
    state = stage(_rounds(rows, history, True), "clusters-state")
    for _ in range(rounds):
        for j, (n, total) in _moves(state, len(start), dims).items():
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], total, strict=True)]
        history.append([[s // counts[j] for s in sums[j]] if counts[j] else history[-1][j] for j in range(len(start))])
        state = stage(_rounds(state, history, False), "clusters-state")
    # One row a centroid.
    totals = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(_LONG, sum(totals.values()))
    table = spark.createDataFrame(
        [(j, min(_LONG, totals.get(j, 0)), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1])],
        "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(table), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
