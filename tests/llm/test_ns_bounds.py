"""Centroid clustering against plain rounds, its bounds and its odd cases."""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from epochloom.llm import ns_bounds

SMALL = ns_bounds.Params(clusters=5, width=4, rounds=4)
VECTORS = "vec_id long, embedding array<double>"


def plain(table, params):
    kept = []
    for vec_id, v in table:
        if v is None or len(v) != params.width or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [int(np.floor(params.scale * x)) for x in v]))
    named = sorted((hashlib.sha256(f"{params.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[: params.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(params.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def check(spark, table, params):
    got = sorted((tuple(r) for r in ns_bounds.report(spark.createDataFrame(table, VECTORS), params=params).collect()), key=repr)
    rows, centroids = plain(table, params)
    inertia = {k: sum(d for _, c, d in rows if c == k) for _, k, _ in rows}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert got == sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in rows), key=repr)


def test_equals_plain_rounds(spark):
    draw = np.random.default_rng(3)
    table = [(i, (draw.standard_normal(4) + draw.integers(0, 4)).tolist()) for i in range(400)]
    check(spark, table, SMALL)


def test_nulls_ties_copies_and_large_components(spark):
    table = [(i % 7, [0.25 * (i % 3), 0.0, -0.25, 1.0]) for i in range(60)]
    table += [(100 + i, [4e5, -4e5, float(i), 0.5]) for i in range(4)] + [(None, [1.0, 2.0, 3.0, 4.0])]
    table += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [1.0])]
    check(spark, table, SMALL)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [0.1, 0.2, 0.3, 0.4]), (2, [0.0, 0.0, 0.0, 0.0])], SMALL)
    empty = ns_bounds.report(spark.createDataFrame([], VECTORS), params=SMALL)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    clash = spark.createDataFrame([(1, [0.1] * 4, 9, 9.0)], VECTORS + ", cluster long, upper double")
    assert ns_bounds.report(clash, params=SMALL).select("cluster", "distance").collect() == [(0, 0)]


def test_bounds_hold_and_spare_most_vectors():
    """Bounds are never crossed, and after some rounds few vectors are looked at again."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-2_000, 2_000, (20, 16))
    v = centres[draw.integers(0, 20, 4_000)] + draw.integers(-60, 60, (4_000, 16))
    history, known, seen = [centres + draw.integers(-300, 300, centres.shape)], None, []
    for _ in range(7):
        before = known.seen if known else 0
        known = ns_bounds.settle(v, known, history)
        seen.append(known.seen - before)
        exact = ns_bounds.squared(v, history[-1])
        assert (known.cluster == exact.argmin(1)).all()
        moved = np.array([np.sqrt(((history[-1] - h) ** 2.0).sum(1)) for h in history])
        assert (known.lower - moved[known.lower_at] <= np.sqrt(exact) + 1e-6).all()
        assert (known.upper + moved[known.upper_at, known.cluster] >= np.sqrt(exact[np.arange(len(v)), known.cluster]) - 1e-6).all()
        history.append(np.array([v[known.cluster == k].sum(0) // max(1, (known.cluster == k).sum()) if (known.cluster == k).any() else c for k, c in enumerate(history[-1])]))
    assert seen[0] == 4_000 and sum(seen[2:]) < 400


def test_displacement_is_the_norm_of_the_sum():
    """A centroid that went away and came back loosens nothing."""
    v = np.array([[0, 0], [10, 0]])
    first = np.array([[0, 0], [10, 0]])
    known = ns_bounds.settle(v, None, [first])
    away = np.array([[0, 4], [10, 4]])
    known = ns_bounds.settle(v, known, [first, away, first])
    assert known.seen == 2


def test_means_round_down(spark):
    state = spark.createDataFrame([(0, [-1, 2]), (0, [-2, 3])], "cluster int, v array<int>")
    assert ns_bounds._means(state.withColumn("x", F.lit(1)), np.array([[7, 7], [9, 9]]), 2).tolist() == [[-2, 2], [9, 9]]
