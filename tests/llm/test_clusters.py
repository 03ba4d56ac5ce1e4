"""Centroid clustering against plain rounds in Python, and the bounds by themselves."""

import hashlib
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kotomill.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, a int, v string"


def plain(rows, k=clusters.K, rounds=clusters.ROUNDS):
    """Sorted (id, cluster, distance) by the definition, and the final centroids."""
    kept = [(i, tuple(floor(1024 * x) for x in v)) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and isfinite(x) and abs(1024 * x) < 1 << 27 for x in v)]
    hashed = sorted((i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for *_, v in hashed[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), a in zip(kept, own, strict=True) if a == j]:
                centroids[j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    return sorted(((i, *reversed(place(v))) for i, v in kept), key=str), centroids


def cluster(spark, rows, parts=3):
    found, centroids = clusters.clustered(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return sorted(map(tuple, found.collect()), key=str), [tuple(c) for c in centroids.tolist()]


def vectors(seed, n, spots=5, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(spots, 64))
    return [(i, [float(np.float32(x)) for x in middle[rng.integers(spots)] + spread * rng.normal(size=64)], 1, "x") for i in range(n)]


@pytest.mark.parametrize(("seed", "spots", "spread"), [(0, 5, 0.05), (1, 12, 0.4), (2, 1, 1.0)])
def test_rounds_against_the_definition(spark, seed, spots, spread):
    rows = vectors(seed, 300, spots, spread)
    assert cluster(spark, rows) == plain(rows)


def test_bounds_written_once(spark, monkeypatch):
    """Bounds that are never written anew give the same result: they only decide what is measured."""
    monkeypatch.setattr(clusters, "REFRESH", 1.0)
    rows = vectors(3, 300, 9, 0.3)
    assert cluster(spark, rows) == plain(rows)


def test_ties_repeats_and_odd_rows(spark):
    """Vectors between two centroids, equal vectors, repeated and null ids, and rows that take no part."""
    at = lambda *x: [*map(float, x), *[0.0] * (64 - len(x))]
    rows = [(i, at(i % 3, -(i % 2)), 1, "x") for i in range(40)] + [(7, at(7), 1, "x")] * 5 + [(None, at(1, 1), 1, "x")]
    odd = [(50, None), (51, []), (52, at(1)[:63]), (53, [*at(1), 1.0]), (54, [None, *at(1)[1:]]), (55, at(float("nan"))), (56, at(float("inf"))), (57, at(2.0**17)), (58, at(3e38))]
    assert cluster(spark, rows + [(i, v, 1, "x") for i, v in odd]) == plain(rows)
    assert cluster(spark, [(50, None, 1, "x")]) == ([], [])
    assert cluster(spark, rows[:1]) == plain(rows[:1])
    large = [(i, at((-1) ** i * 131071.5, i), 1, "x") for i in range(9)]
    assert cluster(spark, large) == plain(large)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 4), min_size=1, max_size=30), st.lists(st.tuples(*[st.integers(-3, 3)] * 4), min_size=1, max_size=5), st.lists(st.tuples(*[st.integers(-2, 2)] * 4), min_size=5, max_size=5))
def test_bounds_never_lose_a_nearest(points, before, steps):
    """Small whole numbers tie often; the bounds of one set of centroids, used for another."""
    rows, then = np.array(points, np.int64), np.array(before, np.int64)
    now = then + np.array(steps[: len(then)], np.int64)
    nothing = np.zeros(len(rows), np.int32), np.full(len(rows), np.inf), np.zeros((len(rows), len(then)))
    a, _, up, low = clusters.Bounds(then, then).assign(rows, *nothing)
    after = clusters.Bounds(then, now)
    got, square, *_ = after.assign(rows, a, up, low, exact=True)
    want = clusters.gaps(rows, now)
    assert (got == want.argmin(1)).all() and (square == want.min(1)).all()
    assert after.measured <= len(rows) * len(then)
    assert (clusters.Bounds(then, now).assign(rows, a, up, low)[0] == got).all()


def test_bounds_save_measuring():
    rows = np.array([[floor(1024 * x) for x in v] for _, v, *_ in vectors(4, 2000, 8, 0.02)], np.int64)
    centroids = rows[:8]
    nothing = np.zeros(len(rows), np.int32), np.full(len(rows), np.inf), np.zeros((len(rows), 8))
    a, _, up, low = clusters.Bounds(centroids, centroids).assign(rows, *nothing)
    again = clusters.Bounds(centroids, centroids + 1)
    again.assign(rows, a, up, low)
    assert again.measured < 0.5 * len(rows) * 8


def test_query_digests(spark):
    """The query's sums and hashes follow from its own rows."""
    rows = clusters.op11_clusters(spark, "/root/testdata/sf0.001").collect()
    own: dict = {}
    for r in rows:
        own[r.cluster] = own.get(r.cluster, 0) + r.distance
    assert rows and all(r.cluster_inertia == own[r.cluster] and r.inertia == sum(own.values()) for r in rows)
    _, centroids = clusters.clustered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert {(r.cluster, r.centroid_sha256) for r in rows} == {(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist()) if j in own}
