"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its shingles of five words (lower case, split at white space), the n-th
occurrence of a shingle being labelled n. Each of ``tables`` repetitions takes the ``sample`` shingles
that hash lowest and keeps them in text order: equal signatures mean that the texts share those shingles
in that order, which follows edit similarity and not just the set of shingles. The similarity is that of
the aligned sequences: ``m / (n1 + n2 - m)`` for ``m`` shingles matched in order; two texts are linked
where it is at least ``similarity``. A banded alignment gives ``m`` exactly whenever a link is possible.

1. One row for each different sequence of shingles, with signatures and a sketch of 64 bin minima.
2. Texts that share a signature are compared by sketch, inside their buckets. A bucket over ``most`` texts is
   compared block against block, whole. No bucket is cut off.
3. Texts whose sketches agree make families (connected components). A family over ``most`` texts is cut into
   blocks, and every pair of blocks is a task of its own.
4. Within a family, texts that aren't yet connected are aligned; links that join two classes are kept.

At the threshold a pair shares one of 16 signatures with probability 1 - 1e-5, whatever the size of its buckets.
Work is linear in the texts, but for buckets of more than ``most`` texts that share a passage and families of more
than ``most`` that all resemble each other, where it grows with the square of their number over ``most``.

Defined cases: a null text counts as empty; equal texts (so all empty ones) are one class, and so
are texts with the same words in the same order; texts under five words are one shingle, so they only join such; repeated rows, equal or null ids all get a
row; an empty table gives an empty result; further columns are ignored. A class is named by its
smallest document id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochloom.llm.common import fresh, saved, text_of
from epochloom.llm.components import components

BINS = 64
#: Sketches of texts at the threshold agree in 0.8 of the bins, with a deviation of 0.05.
SKETCH_AGREES = 0.6


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    tables: int = 16
    sample: int = 3
    #: Texts that one task compares with each other at most.
    most: int = 2_000


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 17, 1 << n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """A 64-bit hash of each shingle, in text order."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(tokens).encode("utf-8", "surrogatepass"), np.uint8)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    space = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], space + 1])
    ends = np.append(space, len(data))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return _mix((total[ends] - total[starts]) * down[starts])


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell the n-th occurrence of a shingle from the others."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return hashes
    run = np.arange(len(order))
    first = np.concatenate([[True], ~same])
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = run - np.maximum.accumulate(np.where(first, run, 0))
    return _mix(hashes + occurrence * _MULT)


def signatures(labels: np.ndarray, params: Params) -> np.ndarray:
    """One value for each table; one in all for a text of so few shingles that only equal ones can be linked."""
    k = params.sample
    if len(labels) <= k:
        value = np.full(min(1, len(labels)), len(labels), np.uint64)
        for label in labels:
            value = _mix(value + label)
        return value.view(np.int64)
    seeds = _mix(np.arange(1, params.tables + 1, dtype=np.uint64) * _MULT)
    drawn = (labels[None, :] ^ seeds[:, None]) * _MULT
    drawn ^= drawn >> np.uint64(29)
    drawn *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.sort(np.argpartition(drawn, k - 1, axis=1)[:, :k], axis=1)
    value = seeds.copy()
    for at in range(k):
        value = _mix(value + labels[low[:, at]])
    return value.view(np.int64)


def sketch(labels: np.ndarray) -> np.ndarray:
    """The lowest hash in each of 64 bins, as 16 bits; 65535 marks an empty bin."""
    out = np.full(BINS, 65535, np.uint16)
    drawn = _mix(labels ^ np.uint64(0xD6E8FEB86659FD93))
    lowest = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(lowest, (drawn & np.uint64(BINS - 1)).astype(np.int64), drawn >> np.uint64(6))
    filled = lowest != np.iinfo(np.uint64).max
    out[filled] = _mix(lowest[filled]) % np.uint64(65535)
    return out


def _sketched(params: Params):
    names = ["doc_id", "fp", "seq", "sigs", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, sigs, sketches = [], [], []
            for fp, text in zip(batch.column(1), batch.column(2)):
                hashes = shingle_hashes(text.as_py(), params.words)
                seqs.append(hashlib.md5(hashes.tobytes()).digest() if len(hashes) else fp.as_py())
                labels = occurrences(hashes)
                sigs.append(signatures(labels, params))
                sketches.append(sketch(labels).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seqs, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names
            )

    return run


def by_group(columns: list[str], work: Callable[[list[dict]], list[tuple]], schema: pa.Schema):
    """Call ``work`` on each run of rows that agree in ``columns``; only one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            made = list(zip(*out)) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, schema.types)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[c] for c in columns)
                if own != key:
                    if len(held) > 1:
                        out += work(held)
                    key, held = own, []
                    if len(out) > 20_000:
                        yield flush()
                        out = []
                held.append(row)
        if len(held) > 1:
            out += work(held)
        yield flush()

    return run


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Share of bins in which sketches agree, of those that either has filled."""
    filled = (many != 65535) | (one != 65535)
    return ((many == one) & filled).sum(axis=-1) / np.maximum(1, filled.sum(axis=-1))


def _kin(rows: list[dict]) -> list[tuple]:
    """Links ``(smallest, other)`` of the sketch components of one bucket."""
    sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint16).reshape(len(rows), BINS)
    uids = [r["uid"] for r in rows]
    left = np.arange(len(rows))
    out = []
    while len(left) > 1:
        group, frontier, left = [left[0]], [left[0]], left[1:]
        while frontier and len(left):
            near = agreement(sketches[frontier.pop()], sketches[left]) >= SKETCH_AGREES
            group += left[near].tolist()
            frontier += left[near].tolist()
            left = left[~near]
        ids = sorted(uids[k] for k in group)
        out += [(ids[0], other) for other in ids[1:]]
    return out


# --- alignment ----------------------------------------------------------------------


def matched(a: list, b: list, band: int) -> int:
    """Longest common subsequence within ``band`` of the diagonal, by bit-parallel rows.

    It is never more than the true length, and equal to it if at most ``band`` elements of either
    sequence stay unmatched.
    """
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return head + tail
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    lo, width, found = 0, min(len(a), band + 1), 0
    row = (1 << width) - 1  # bit k: column lo + k adds no match so far
    for i, y in enumerate(b):
        if i > band:  # the lowest column leaves the band
            if lo >= len(a):
                break
            found += ~row & 1
            row >>= 1
            lo += 1
            width -= 1
        if lo + width < len(a) and i:
            row |= 1 << width
            width += 1
        match = where.get(y, 0) >> lo & ((1 << width) - 1)
        both = row & match
        row = ((row + both) | (row - both)) & ((1 << width) - 1)
    return head + tail + found + width - row.bit_count()


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether the aligned similarity reaches the threshold."""
    n, m = len(a), len(b)
    need = similarity * (n + m) / (1 + similarity) - 1e-9
    if min(n, m) < need:
        return False
    return matched(a, b, int(max(n, m) - need) + 1) >= need


def _linked(params: Params):
    def work(rows: list[dict]) -> list[tuple]:
        """Spanning links of one family or pair of blocks.

        A text is counted against the earlier ones outside its class, all at once, by the shingles that they
        share; only where these are enough for a link is the pair aligned.
        """
        sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint16).reshape(len(rows), BINS)
        hashes = [shingle_hashes(r["text"], params.words) for r in rows]
        sizes = np.array([len(h) for h in hashes])
        kinds, dense = np.unique(np.concatenate([occurrences(h) for h in hashes]), return_inverse=True)
        held = np.split(dense.astype(np.int32), np.cumsum(sizes)[:-1])
        own, cls, out = np.zeros(len(kinds), bool), np.arange(len(rows)), []
        for k in range(1, len(rows)):
            agree = agreement(sketches[k], sketches[:k])
            near = np.flatnonzero((agree >= SKETCH_AGREES) & (sizes[:k] > 0))
            if not len(near) or not sizes[k]:
                continue
            own[held[k]] = True
            ends = np.cumsum(sizes[near])
            shared = np.add.reduceat(own[np.concatenate([held[o] for o in near])].astype(np.int64), ends - sizes[near])
            own[held[k]] = False
            near = near[shared >= params.similarity * (sizes[near] + sizes[k]) / (1 + params.similarity) - 1e-9]
            mine = hashes[k].tolist()
            for other in near[np.argsort(-agree[near], kind="stable")].tolist():
                if cls[other] != cls[k] and alike(mine, hashes[other].tolist(), params.similarity):
                    cls[cls == cls[k]] = cls[other]
                    out.append(tuple(sorted((rows[k]["uid"], rows[other]["uid"]))))
        return out

    return work


def in_blocks(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """Deal the rows of ``group`` to tasks ``(group, first, second)`` of at most about ``most`` rows.

    A group up to ``most`` rows is one task; a larger one is cut into blocks of half that, and each pair of
    blocks is a task.
    """
    blocks = F.when(F.col(size) <= most, F.lit(1)).otherwise(F.ceil(F.col(size) * 2 / most).cast("int"))
    own = F.pmod(F.xxhash64("uid"), F.col("_blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda o: F.struct(F.least(F.col("_own"), o).alias("first"), F.greatest(F.col("_own"), o).alias("second")),
    )
    return rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_pair", F.explode(pairs)).select(
        *rows.columns, F.col("_pair.first").alias("first"), F.col("_pair.second").alias("second")
    )


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grouped(rows: DataFrame, columns: list[str], work) -> DataFrame:
    return rows.repartition(*columns).sortWithinPartitions(*columns, "uid").mapInArrow(
        by_group(columns, work, EDGES), "a long, b long"
    ).distinct()


def kin(texts: DataFrame, params: Params) -> DataFrame:
    """Pairs ``a, b`` of texts whose sketches agree, from the buckets of their signatures."""
    bucket = texts.select("uid", F.explode("sigs").alias("bucket"))
    sizes = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = in_blocks(bucket.join(sizes, "bucket"), "bucket", "size", params.most)
    rows = dealt.select("bucket", "first", "second", "uid").join(texts.select("uid", "sketch"), "uid")
    return _grouped(rows, ["bucket", "first", "second"], _kin)


def _classes(docs: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """``doc_id, fp, cls`` of every row: its id, the fingerprint of its text and the class of that text."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("fp"), text_of(text_col).alias("text")
    )
    all_rows = saved(
        rows.mapInArrow(_sketched(params), "doc_id long, fp binary, seq binary, sigs array<long>, sketch binary"), "sketches"
    )
    texts = saved(
        all_rows.groupBy("seq").agg(F.min("fp").alias("fp"), F.first("sigs").alias("sigs"), F.first("sketch").alias("sketch")).withColumn(
            "uid", F.monotonically_increasing_id()
        ), "texts",
    )
    families = saved(components(kin(texts, params)).withColumnRenamed("node", "uid"), "families")
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = saved(families.join(sizes, "component").join(texts.select("uid", "fp", "sketch"), "uid"), "members")
    wanted = rows.select("fp", "text").join(members.select("fp"), "fp", "left_semi")
    one_each = wanted.groupBy("fp").agg(F.first("text").alias("text"))
    dealt = in_blocks(members.join(one_each, "fp").select("component", "size", "uid", "sketch", "text"), "component", "size", params.most)
    links = _grouped(dealt.drop("size"), ["component", "first", "second"], _linked(params))
    classes = components(links).withColumnRenamed("node", "uid")
    named = texts.select("uid", "seq").join(classes, "uid", "left").select("seq", F.coalesce("component", "uid").alias("cls"))
    return all_rows.select("doc_id", "fp", "seq").join(named, "seq").drop("seq")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """``doc_id, class_id, class_size`` of every row; a class holds the texts that links connect."""
    labelled = _classes(docs, id_col, text_col, params).select("doc_id", "cls")
    totals = labelled.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labelled.join(totals, "cls").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row of ``docs`` for each class, the one with the smallest id, with all its columns."""
    labelled = saved(_classes(docs, id_col, text_col, params), "classes")
    first = labelled.groupBy("cls").agg(F.min(F.struct("doc_id", "fp")).alias("first")).select("first.*")
    copies = labelled.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    first = saved(first.join(copies, (first.fp == copies.fp) & first.doc_id.eqNullSafe(copies.doc_id)).select(
        first.fp.alias(fresh(docs, "first_fp")), first.doc_id.alias(fresh(docs, "first_id")), "n"
    ), "first")
    fp, same = fresh(docs, "own_fp"), fresh(docs, "own_id")
    rows = docs.withColumn(fp, F.unhex(F.md5(text_of(text_col)))).withColumn(same, F.col(id_col).cast("long"))
    match = (F.col(fp) == F.col(first.columns[0])) & F.col(same).eqNullSafe(F.col(first.columns[1]))
    once = rows.join(first.filter("n = 1").drop("n"), match, "left_semi")
    # rows that repeat both id and text: one of them stays
    again = rows.join(first.filter("n > 1").drop("n"), match, "left_semi").dropDuplicates([fp, same])
    return once.unionByName(again).drop(fp, same)
