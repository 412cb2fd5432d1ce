"""Nearest neighbours by a few stable projections and kd-trees, with a chi-square stopping test.

Inner products become distances by one more coordinate: with ``M`` the largest norm, ``|x'-q'|^2`` is
``M^2 + |q|^2 - 2 q.x``. Vectors are projected on ``projections`` Gaussian (2-stable) directions; the squared
projected distance over the squared distance then follows a chi-square law. (The further coordinate is known and not projected.) A query meets the leaves of a kd-tree over
the projections in order of their projected distance and verifies, by the true inner product, those vectors whose projected
distance is below ``t`` times the squared distance of its k-th best so far, ``t`` being the chi-square quantile of
``confidence``; it stops at the first leaf that lies beyond. A vector nearer than the k-th best is thus missed with
probability 1 - ``confidence`` at most.

Equal vectors are one entry with its smallest ids, found by a grouped aggregate, so copies fill no task; queries of equal
vectors are one query. A top tree, made from a bounded sample, deals the entries to cells; cells of large tables are dealt on
to blocks by hash. Each query first meets its own block, which gives it a k-th best, then in one join the blocks of all cells
that its stopping test doesn't rule out, queries in chunks. Nothing but the sample and the cells' boxes comes to the driver.

As the home block's k-th best is further away than the final one, and most neighbours are nearer than the last, recall is above
``confidence``. On nearly isotropic vectors (the given ones, 64 dimensions) most cells must be met, and 32 projections at 0.88
verify about a quarter of all (query, vector) pairs at a recall of 0.95; fewer projections verify more.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those
without an id or of another length than most; a query with fewer candidates than ``k`` gets all; ties go to the
smaller id; rows that repeat an id are candidates each, and such a query asks with its smallest vector; an empty table
gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epochloom.llm.common import saved


@dataclass(frozen=True)
class Params:
    k: int = 20
    every: int = 20
    projections: int = 32
    confidence: float = 0.88
    leaf: int = 512
    block_rows: int = 8_192
    cells: int = 4_096
    sample_per_cell: int = 64
    chunk_queries: int = 8_192
    seed: int = 20_240_601


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1 - np.exp(-half) * total


def quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 40.0 * freedom
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Space:
    """The projection of one table."""

    width: int
    norm: float
    params: Params

    @property
    def dims(self) -> int:
        return self.params.projections + 1

    @property
    def t(self) -> float:
        return quantile(self.params.confidence, self.params.projections)

    def directions(self) -> np.ndarray:
        return np.random.default_rng(self.params.seed).standard_normal((self.width, self.params.projections))

    def entries(self, v: np.ndarray) -> np.ndarray:
        """Projections, and the further coordinate; it is known exactly, so it counts as if projected to just ``t``."""
        further = np.sqrt(np.maximum(0, self.norm**2 - (v**2).sum(1)) * self.t)
        return np.column_stack([v @ self.directions(), further])

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v @ self.directions(), np.zeros(len(v))])


def split(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Leaves of at most ``rows`` points, halved along the widest direction."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        some = stack.pop()
        if len(some) <= rows:
            leaves.append(some)
            continue
        half = len(some) // 2
        some = some[np.argpartition(points[some, np.ptp(points[some], axis=0).argmax()], half)]
        stack += [some[half:], some[:half]]
    return leaves


class TopTree:
    """Cells by cuts through a sample; ``place`` gives the cell of any point."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # direction, cut, then node or -1 - cell on either side
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
        if cells <= 1 or not spread.max():
            self.cells += 1
            return -self.cells
        axis = int(spread.argmax())
        cut = float(np.median(points[:, axis]))
        low = points[:, axis] < cut
        if not low.any():
            cut = float(points[points[:, axis] > cut, axis].min())
            low = points[:, axis] < cut
        at = len(self.cuts)
        self.cuts.append((axis, cut, 0, 0))
        self.cuts[at] = (axis, cut, self._grow(points[low], cells // 2), self._grow(points[~low], cells - cells // 2))
        return at

    def place(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                axis, cut, low, high = self.cuts[node]
                below = points[rows, axis] < cut
                stack += [(low, rows[below]), (high, rows[~below])]
        return out


def box_distance(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (queries x boxes)."""
    out = np.zeros((len(z), len(low)))
    for d in range(z.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, d] - z[:, None, d], z[:, None, d] - high[None, :, d])) ** 2
    return out


class Search:
    """Queries against the entries of one block; ``verified`` counts true inner products."""

    def __init__(self, space: Space, vectors: np.ndarray, first: np.ndarray, keep: int):
        self.space, self.vectors, self.first, self.keep = space, vectors, first, keep
        self.z = space.entries(vectors)
        self.leaves = split(self.z, space.params.leaf)
        self.low = np.array([self.z[rows].min(0) for rows in self.leaves])
        self.high = np.array([self.z[rows].max(0) for rows in self.leaves])
        self.t = space.t
        self.verified = 0

    def run(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, entry, score`` of the best ``keep`` entries whose score isn't below ``bound``, ties by first id."""
        z = self.space.queries(queries)
        near = box_distance(z, self.low, self.high)
        order = np.argsort(near, axis=1, kind="stable")
        reach = self.space.norm**2 + (queries**2).sum(1)
        worst = bound.astype(float).copy()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        active = np.arange(len(queries))
        for step in range(len(self.leaves)):
            limit = np.where(np.isfinite(worst[active]), self.t * np.maximum(reach[active] - 2 * worst[active], 0), np.inf)
            go = near[active, order[active, step]] <= limit
            active, limit = active[go], limit[go]
            if not len(active):
                break
            found = [held]
            at = order[active, step]
            by_leaf = np.argsort(at, kind="stable")
            for group in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1):
                rows, q = self.leaves[at[group[0]]], active[group]
                projected = (z[q] ** 2).sum(1)[:, None] - 2 * z[q] @ self.z[rows].T + (self.z[rows] ** 2).sum(1)
                a, b = np.nonzero(projected <= limit[group][:, None])
                score = np.einsum("ij,ij->i", queries[q[a]], self.vectors[rows[b]])
                self.verified += len(a)
                good = score >= worst[q[a]]
                found.append([q[a[good]], rows[b[good]], score[good]])
            query, entry, score = (np.concatenate(c) for c in zip(*found))
            best = np.lexsort((self.first[entry], -score, query))
            query, entry, score = query[best], entry[best], score[best]
            start = np.searchsorted(query, query)
            rank = np.arange(len(query)) - start
            top = rank < self.keep
            last = rank == self.keep - 1
            worst[query[last]] = np.maximum(worst[query[last]], score[last])
            held = [query[top], entry[top], score[top]]
        return tuple(held)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0))


def entries_of(vectors: DataFrame, keep: int) -> DataFrame:
    """``v, ids`` of the different vectors: the ``keep`` smallest ids of each, and how often each stands there."""
    each = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return each.withColumn("place", place).filter(F.col("place") <= keep).groupBy("v").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")
    )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _placed(space: Space, tree: TopTree, project):
    """Rows with the cell of their vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = tree.place(project(space, _matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _boxes(space: Space):
    """Boxes of the cells of a batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z, cell = space.entries(_matrix(batch.column("v"))), np.asarray(batch.column("cell"))
                known = np.unique(cell)
                low = [z[cell == c].min(0) for c in known]
                high = [z[cell == c].max(0) for c in known]
                columns = [pa.array(known)] + [pa.array(np.array(side)[:, d]) for side in (low, high) for d in range(z.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell"] + [f"{s}{d}" for s in ("low", "high") for d in range(z.shape[1])])

    return run


def _met(space: Space, keep: int):
    """Queries of a chunk and entries of a block to ``qkey, vec_id, n, score``."""
    empty = {"qkey": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "score": pa.array([], pa.float64())}

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return pa.table(empty)
        ids = block["ids"].combine_chunks()
        start = np.asarray(ids.offsets)
        flat = ids.flatten()
        one, n = np.asarray(flat.field("vec_id")), np.asarray(flat.field("n"))
        start = start - start[0]
        search = Search(space, _matrix(block["v"]), one[start[:-1]], keep)
        query, entry, score = search.run(_matrix(asked["v"]), np.asarray(asked["bound"].combine_chunks(), float))
        many = np.diff(start)[entry]
        row = np.repeat(np.arange(len(entry)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[entry], many)
        key = np.asarray(asked["qkey"].combine_chunks())[query]
        return pa.table({"qkey": pa.array(key[row]), "vec_id": pa.array(one[at]), "n": pa.array(n[at]), "score": pa.array(score[row])})

    return run


MET = "qkey long, vec_id long, n int, score double"


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries whose id ``params.every`` divides."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = usable(rows, id_col, vector_col)
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return nothing
    vectors = vectors.filter(F.size("v") == lengths["n"])
    asks = F.col("vec_id") % params.every == 0
    # an id with several vectors can take several places from its own list
    own = vectors.filter(asks).groupBy("vec_id").agg(F.count_distinct("v").alias("r")).agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).first()
    if not own["n"]:
        return nothing
    keep = params.k + own["r"]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    entries = saved(entries_of(vectors, keep), "entries")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("norm")).first()
    space = Space(lengths["n"], float(size["norm"]), params)
    blocks = max(1, -(-size["n"] // params.block_rows))
    cells = min(params.cells, blocks)
    subs = -(-blocks // cells)

    # the top tree, from a bounded sample
    hashed = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, cells * params.sample_per_cell / size["n"]))
    sample = _matrix(entries.filter(hashed).select("v").orderBy("v").toArrow()["v"])
    tree = TopTree(space.entries(sample) if len(sample) else np.zeros((0, space.dims)), cells)
    kind = entries.schema["ids"].dataType.simpleString()
    placed = entries.mapInArrow(_placed(space, tree, Space.entries), f"v array<double>, ids {kind}, cell int").withColumn(
        "sub", F.pmod(F.xxhash64("v"), F.lit(subs)).cast("int")
    )
    placed = saved(placed, "cells")
    sides = [f"{s}{d}" for s in ("low", "high") for d in range(space.dims)]
    each = placed.select("v", "cell").mapInArrow(_boxes(space), "cell int, " + ", ".join(f"{c} double" for c in sides))
    boxes = each.groupBy("cell").agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides]).orderBy("cell").collect()  # at most params.cells
    known = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{s}{d}"] for d in range(space.dims)] for b in boxes]) for s in ("low", "high"))

    # equal queries ask once
    queries = saved(vectors.filter(asks).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("qkey"))
    home = asked.mapInArrow(_placed(space, tree, Space.entries), "v array<double>, qkey long, cell int").withColumn(
        "sub", F.pmod(F.xxhash64("v"), F.lit(subs)).cast("int")
    )
    home = saved(home, "home")
    chunks = max(1, -(-home.count() // params.chunk_queries))
    chunk = F.pmod(F.xxhash64("qkey"), F.lit(chunks)).cast("int")
    copies = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    where = ["cell", "sub", "chunk"]
    meet = lambda q: q.withColumn("chunk", chunk).groupBy(*where).cogroup(copies.groupBy(*where)).applyInArrow(_met(space, keep), MET)
    near = saved(meet(home.withColumn("bound", F.lit(float("-inf")))), "near")
    # the k-th best so far; an entry's further ids stand in the same place as its first, so distinct scores are enough of a bound
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")))
    bound = ranked.filter(F.col("place") == keep).select("qkey", F.col("score").alias("bound"))
    t = space.t

    def others(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, cell = _matrix(batch.column("v")), np.asarray(batch.column("cell"))
            limit = np.array([np.inf if b is None else b for b in batch.column("bound").to_pylist()])
            limit = np.where(np.isfinite(limit), t * np.maximum(space.norm**2 + (v**2).sum(1) - 2 * np.where(np.isfinite(limit), limit, 0), 0), np.inf)
            for at in range(0, len(v), 512):
                part = slice(at, at + 512)
                a, b = np.nonzero(box_distance(space.queries(v[part]), low, high) <= limit[part, None])
                row = pa.array(a + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("v").take(row), batch.column("qkey").take(row), batch.column("cell").take(row), batch.column("sub").take(row), batch.column("bound").take(row), pa.array(known[b].astype(np.int32))],
                    ["v", "qkey", "cell", "sub", "bound", "to"],
                )

    routed = home.join(bound, "qkey", "left").select("v", "qkey", "cell", "sub", "bound").mapInArrow(
        others, "v array<double>, qkey long, cell int, sub int, bound double, to int"
    ).withColumn("to_sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    routed = routed.filter("cell <> to or sub <> to_sub").select(
        "v", "qkey", F.col("to").alias("cell"), F.col("to_sub").alias("sub"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound")
    )
    found = near.unionByName(meet(routed))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")))
    best = best.filter(F.col("place") <= keep).drop("place")
    named = queries.withColumnRenamed("vec_id", "query_id").join(asked, "v").select("query_id", "qkey")
    listed = named.join(best, "qkey").filter("vec_id <> query_id").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(params.k))))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy"))
    return listed.withColumn("rank", rank).filter(F.col("rank") <= params.k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
