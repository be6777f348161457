"""Operator 13 against plain rounds over all vectors and centroids."""

import hashlib
import math
import random

import numpy as np

from tablewright.llm import ns_kmeans
from tablewright.llm.ns_kmeans import History, assign, cluster_vectors

LONG = (1 << 63) - 1


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = nearest()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    of = nearest() if kept else []
    inertia = [sum(d for d, c in of if c == j) for j in range(len(centroids))]
    return sorted((repr(i), c, min(LONG, d), min(LONG, inertia[c]), min(LONG, sum(inertia)),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, of))


def got(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


def vectors(seed, n, dims, spread=0.2):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(centres)]) for i in range(n)]


def test_clusters_equal_plain_rounds(spark):
    rows = vectors(1, 400, 6) + [(400, [0.5] * 6)] * 3 + [(401, [0.5] * 6), (3, [-1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k, rounds in ((5, 1), (16, 3), (9, 8)):
        assert got(cluster_vectors(df, k=k, rounds=rounds, dims=6)) == brute(rows, k, rounds, 6)


def test_cluster_edges(spark):
    rows = [(1, [0.0, -0.01]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (None, [2.0, 2.0]),
            (7, [1e12, -3e12]), (8, [1e30, 1e30]), (9, []), (10, [1.0, 1.0]), (10, [1.0, 1.5]), (11, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    for k in (1, 3, 50):
        assert got(cluster_vectors(df, k=k, rounds=3, dims=2)) == brute(rows, k, 3, 2)
    assert cluster_vectors(df.where("false"), dims=2).collect() == []


def test_bounds_skip_and_stay_exact():
    """Most centroids are not evaluated in later rounds, and no row is misplaced."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    past = [x[:12].tolist()]
    n, k = len(x), 12
    cluster, lower, seen = np.zeros(n, np.int64), np.zeros((n, k)), np.zeros((n, k), np.int16)
    upper = np.sqrt(((x - x[0]) ** 2).sum(1).astype(float))
    for step in range(6):
        history = History(past)
        d = assign(x, history, cluster, upper, lower, seen)
        full = ((x[:, None, :] - history.now[None]) ** 2).sum(2)
        assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()
        looked = (seen == step).mean()
        past.append([(x[cluster == j].sum(0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else past[-1][j] for j in range(k)])
    assert looked < 0.3
    # The norm of a sum of moves is never above the sum of their norms, so the bounds are at least as tight.
    history = History(past)
    step_norms = np.array([np.linalg.norm(np.array(a, float) - np.array(b, float), axis=1) for a, b in zip(past, past[1:])])
    assert (history.moved()[:-1] <= step_norms[::-1].cumsum(0)[::-1] + 1e-6).all()
    assert ns_kmeans._limbs(-5) == [(1 << 40) - 5, (1 << 40) - 1, (1 << 40) - 1, -1]
