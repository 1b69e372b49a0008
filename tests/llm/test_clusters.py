"""Clustering with drifting bounds, held against plain Lloyd rounds."""

import hashlib

import numpy as np
import pytest
from placeloom.llm import drift_kmeans as dk
from pyspark.sql import functions as F

SETTINGS = dk.KMeansSettings(clusters=5, rounds=7, dimensions=6, scale=16, salt="s:")


def plain(rows, settings):
    """Every vector against every centroid, in every round."""
    kept = [
        (i, [int(np.floor(float(x) * settings.scale)) for x in v])
        for i, v in rows
        if v is not None and len(v) == settings.dimensions and all(x is not None and np.isfinite(x) for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"{settings.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[: settings.clusters]]
    for r in range(settings.rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        if r < settings.rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), o, d[o]) for (i, _), o, d in zip(kept, own, far)), centroids


def rows_of(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(0, 3, dims) + 8 * (k % 4)).tolist()) for k in range(n)]


def clustered(spark, rows, settings=SETTINGS):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    members, centroids = dk.cluster(frame, settings)
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in members.collect())
    return got, {r.cluster: r for r in centroids.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_rounds(spark, seed):
    rows = rows_of(seed, 400)
    got, centroids = clustered(spark, rows)
    want, places = plain(rows, SETTINGS)
    assert got == want
    assert [centroids[c].centroid for c in range(5)] == places
    for c, r in centroids.items():
        assert (r.n, r.inertia) == (sum(w[1] == c for w in want), sum(w[2] for w in want if w[1] == c))


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 6), (None, [1.0] * 6), (7, [1.0] * 6), (7, [1.0] * 6), (8, None), (9, []), (10, [1.0] * 5),
        (11, [1.0] * 7), (12, [1.0, None] * 3), (13, [nan] * 6), (14, [inf] + [0.0] * 5), (15, [-0.01] * 6),
        (16, [0.5, -0.5] * 3), (17, [-0.5, 0.5] * 3), (18, [0.0] * 6),
    ]
    got, _ = clustered(spark, odd)
    assert got == plain(odd, SETTINGS)[0]
    same = [(k, [2.0] * 6) for k in range(20)]
    got, centroids = clustered(spark, same)
    assert {g[1] for g in got} == {0} and [centroids[c].n for c in range(5)] == [20, 0, 0, 0, 0]


def test_few_or_no_vectors_large_values(spark):
    few = rows_of(4, 3)
    assert clustered(spark, few)[0] == plain(few, SETTINGS)[0]
    assert clustered(spark, few[:1])[0] == plain(few[:1], SETTINGS)[0]
    assert clustered(spark, []) == ([], {})
    assert clustered(spark, [(1, None)]) == ([], {})
    wide = [(k, [float((k * 7919 + d * 104729) % 8_000_000) for d in range(6)]) for k in range(60)]
    assert clustered(spark, wide)[0] == plain(wide, SETTINGS)[0]
    assert clustered(spark, [*few, (99, [1e300] * 6)])[0] == plain(few, SETTINGS)[0]


def test_other_columns_are_not_read(spark):
    rows = spark.createDataFrame(rows_of(5, 30), "vec_id long, embedding array<double>")
    named = rows.select("*", *[F.lit("x").alias(c) for c in ("cluster", "vector", "ids", "distance", "hash")])
    assert sorted(dk.cluster(named, SETTINGS)[0].collect()) == sorted(dk.cluster(rows, SETTINGS)[0].collect())


def test_bounds_hold_and_drift_is_tightened():
    """No vector comes nearer to another centroid than the loosening says, which is less than the drift."""
    rng = np.random.default_rng(9)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-400, 400, (4, 8))
        new = old + rng.integers(-60, 60, (4, 8))
        vectors = old[0] + rng.integers(-90, 90, (50, 8))
        radius = np.sqrt(((vectors - old[0]) ** 2).sum(axis=1)).max()
        moved = dk.drift(old, new, np.array([radius, 0.0, 0.0, 0.0]))
        before, after = (np.sqrt(dk.squared_distances(vectors, c)[:, 1:]) for c in (old, new))
        assert (before - after).max() <= moved.loosening[0] + 1e-6
        assert moved.loosening[0] <= moved.own[1:].max() + 1e-9
        tighter += moved.loosening[0] < 0.95 * moved.own[1:].max()
    assert tighter > 50


def test_most_vectors_are_not_scanned():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (6, 16))
    vectors = (centres[rng.integers(0, 6, 4000)] + rng.normal(0, 250, (4000, 16))).astype(np.int64)
    centroids = vectors[:6].copy()
    cluster, upper, lower = np.zeros(4000, np.int32), np.zeros(4000), np.zeros(4000)
    dk.scan(vectors, cluster, upper, lower, centroids, np.arange(4000))
    scanned = []
    for _ in range(10):
        radii = np.array([upper[cluster == c].max(initial=0) for c in range(6)])
        old, centroids = centroids, centroids.copy()
        for c in np.unique(cluster):
            centroids[c] = vectors[cluster == c].sum(axis=0) // (cluster == c).sum()
        scanned.append(dk.step(vectors, cluster, upper, lower, centroids, dk.drift(old, centroids, radii)))
        assert (cluster == dk.squared_distances(vectors, centroids).argmin(axis=1)).all()
    assert sum(scanned) < 0.3 * 4000 * 10
