"""Exact centroid clustering that skips distances by ns-bounds.

Every vector keeps its centroid, an upper bound on the distance to it and a lower bound on the distance to each
centroid, with the rounds at which they were last exact. The history of all centroids is kept, so a bound is
loosened by the norm of the total displacement of its centroid since that round and not by the sum of the steps in
between. A vector whose upper bound stays below all other lower bounds keeps its centroid unseen; else its upper bound
is made exact, and if that doesn't settle it, all its distances are computed anew. Decisions are exact: vectors are
integers, distances are exact integers, and bounds carry a slack above their rounding.

Spark holds vectors and bounds as one written table for each round (the one before goes, so a lost executor costs a
reread). Sums of a round are grouped aggregates, combined before the shuffle, so a centroid that holds most vectors is no
hot key. Only the centroids pass through the driver: ``clusters`` times ``width`` integers a round.

Defined cases: vectors that are null, of another length than ``width``, or with null or non-finite components take no
part, nor do those with a component of 2^19 or more, whose distances no long holds; repeated rows are vectors each;
rows without an id take part but are no starts; equal hashes of repeated ids are ordered by the vector; with fewer
vectors than ``clusters`` all are starts; ties go to the smaller centroid; an empty table, or one without ids, gives
no rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochloom.llm.common import replaced, saved


@dataclass(frozen=True)
class Params:
    clusters: int = 40
    width: int = 64
    rounds: int = 5
    scale: int = 256
    #: Part of the hashed name of a start vector.
    seed: str = "2"


#: Components from here on would give distances beyond a long.
MOST = 1 << 19
#: Below this, distances by matrix product are exact in double precision.
EXACT = 1 << 21
STATE = "vec_id long, v array<int>, cluster int, upper double, upper_at int, lower array<float>, lower_at int"


def integers(rows: DataFrame, id_col: str, vector_col: str, params: Params) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, scaled and rounded down."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") == params.width)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    return rows.filter(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * params.scale).cast("int")).alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids) of integer vectors."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = v.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


@dataclass
class Bounds:
    """What is known of a batch of vectors; ``seen`` counts full rescans."""

    cluster: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray
    lower_at: np.ndarray
    seen: int = 0


def settle(v: np.ndarray, known: Bounds | None, history: list[np.ndarray]) -> Bounds:
    """Exact assignment to the last centroids of ``history``, with new bounds."""
    now = len(history) - 1
    centroids = history[now]
    if known is None:
        n = len(v)
        known = Bounds(
            np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int32), np.full((n, len(centroids)), -np.inf, np.float32),
            np.zeros(n, np.int32),
        )
    moved = np.array([np.sqrt(((centroids - old).astype(float) ** 2).sum(1)) for old in history])  # round x centroid
    each = np.arange(len(v))
    others = known.lower.astype(float) - moved[known.lower_at]
    others[each, known.cluster] = np.inf
    nearest = others.min(1, initial=np.inf)
    loose = known.upper + moved[known.upper_at, known.cluster]
    open_ = np.flatnonzero(~(loose + 1e-6 * (1 + loose) < nearest))
    # the upper bound alone made exact
    own = ((v[open_] - centroids[known.cluster[open_]]) ** 2).sum(1)
    known.upper[open_], known.upper_at[open_] = np.sqrt(own.astype(float)), now
    tight = known.upper[open_]
    rescan = open_[~(tight + 1e-6 * (1 + tight) < nearest[open_])]
    if len(rescan):
        found = squared(v[rescan], centroids)
        best = found.argmin(1)
        root = np.sqrt(found.astype(float))
        known.cluster[rescan] = best
        known.upper[rescan] = root[np.arange(len(rescan)), best]
        known.upper_at[rescan] = known.lower_at[rescan] = now
        known.lower[rescan] = np.nextafter(root.astype(np.float32), np.float32(-np.inf))
        known.seen += len(rescan)
    return known


def _matrix(column: pa.Array, n: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten()).astype(dtype).reshape(n, -1)


def _round(history: list[np.ndarray], last: bool):
    def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
        n, width = matrix.shape
        return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(matrix.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column("v"), n, np.int64)
            known = None
            if "cluster" in batch.schema.names:
                one = lambda name: np.array(batch.column(name))
                known = Bounds(one("cluster"), one("upper"), one("upper_at"), _matrix(batch.column("lower"), n, np.float32), one("lower_at"))
            known = settle(v, known, history)
            if last:
                distance = ((v - history[-1][known.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(known.cluster), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"), batch.column("v"), pa.array(known.cluster), pa.array(known.upper),
                        pa.array(known.upper_at), lists(known.lower, pa.float32()), pa.array(known.lower_at),
                    ],
                    ["vec_id", "v", "cluster", "upper", "upper_at", "lower", "lower_at"],
                )

    return run


def _means(state: DataFrame, before: np.ndarray, width: int) -> np.ndarray:
    """Rounded-down means of each centroid's vectors; one without vectors stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    after = before.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids."""
    spark = rows.sparkSession
    state, path = replaced(integers(rows, id_col, vector_col, params), "vectors", None)
    name = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    starts = state.filter("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(params.clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, params.width), np.int64)
    history = [np.array([r["v"] for r in starts], np.int64)]
    for _ in range(params.rounds):
        state, path = replaced(state.mapInArrow(_round(list(history), False), STATE), "bounds", path)
        history.append(_means(state, history[-1], params.width))
    return state.mapInArrow(_round(history, True), "vec_id long, cluster int, distance long"), history[-1]


def report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """Every vector with its cluster, the inertia of that and of all, and the digest of its centroid."""
    spark = rows.sparkSession
    found, centroids = cluster(rows, id_col, vector_col, params)
    found = saved(found, "clusters")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a cluster
    whole = sum(r["cluster_inertia"] for r in each)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], whole, digest[r["cluster"]]) for r in each],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
