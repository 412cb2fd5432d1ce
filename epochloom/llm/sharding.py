"""Shards of nearly equal bytes whose groups stay whole, by Karmarkar-Karp differencing.

Rows with equal texts are one indivisible group. Groups above a share of a shard's bytes are units of their own
(their number is bounded by that share); the others are pooled by hash into ``pools`` units, and Spark sums their
bytes. Only these unit totals, at most ``pools + shards * per_shard`` numbers, go through the driver, where
differencing starts with each unit as a partial partition (its bytes in one part, nothing in the others) and
repeatedly takes the two with the largest spread and adds them up oppositely ordered. Units go back to the
rows by a broadcast of that bounded table. Slots are numbered cell by cell, so no task holds a whole shard.

Defined cases: a null text has no bytes and forms one group with the empty texts; repeated rows and null ids
are rows like any other; an empty table gives no rows; texts are measured whole; further columns are ignored by
``assign`` and kept by ``write_shards``.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from epochloom.llm.common import fresh, saved, text_of


@dataclass(frozen=True)
class Params:
    shards: int = 8
    pools: int = 4_096
    #: A group over 1 / per_shard of an even shard is a unit of its own.
    per_shard: int = 128
    #: Rows of one numbering cell, on average.
    cell_rows: int = 250_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each unit."""
    heap = []
    for k, size in enumerate(sizes):
        # parts in descending order, each (bytes, its units as a linked list)
        parts = [(size, (k, None))] + [(0, None)] * (shards - 1)
        heap.append((-size, k, parts))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        both = [(a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1]) for a, b in zip(one, reversed(two))]
        both.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], number, both))
        number += 1
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if node is None:
                continue
            if isinstance(node[0], int):
                out[node[0]] = shard
            else:
                stack += node
    return out


def _units(sized: DataFrame, params: Params) -> DataFrame:
    """``sized`` (with ``fp`` and ``size``) with the shard of each row."""
    spark = sized.sparkSession
    groups = saved(sized.groupBy("fp").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = groups.filter(F.col("bytes") * params.shards * params.per_shard > total)  # fewer than shards * per_shard
    pool = F.pmod(F.xxhash64("fp"), F.lit(params.pools)).cast("int")
    own = large.orderBy(F.desc("bytes"), "fp").collect()
    pooled = groups.join(F.broadcast(large.select("fp")), "fp", "left_anti").groupBy(pool.alias("unit")).agg(
        F.sum("bytes").alias("bytes")
    ).orderBy("unit").collect()
    shard = difference([r["bytes"] for r in own] + [r["bytes"] for r in pooled], params.shards)
    own_map = spark.createDataFrame(
        [(bytearray(r["fp"]), s) for r, s in zip(own, shard)], "fp binary, own int"
    )
    pool_map = spark.createDataFrame([(r["unit"], s) for r, s in zip(pooled, shard[len(own) :])], "unit int, pooled int")
    return sized.withColumn("unit", pool).join(F.broadcast(own_map), "fp", "left").join(
        F.broadcast(pool_map), "unit", "left"
    ).withColumn("shard", F.coalesce("own", "pooled")).drop("own", "pooled", "unit")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = text_of(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("fp"),
    )
    rows = saved(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    placed = saved(_units(rows, params).drop("fp"), "placed")
    cells = max(1, -(-placed.count() // (params.shards * params.cell_rows))) * 4
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    return dealt.withColumn("within", within).join(counts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, text_col: str = "text", params: Params = Params(), files: int = 8) -> None:
    """``docs`` with all columns below ``path/shard=k``, each shard in ``files`` files."""
    text, fp, size, shard = text_of(text_col), fresh(docs, "fp"), fresh(docs, "size"), fresh(docs, "shard")
    sized = docs.select(F.unhex(F.md5(text)).alias("fp"), (F.octet_length(text) + 1).cast("long").alias("size"))
    map_ = _units(sized, params).groupBy("fp").agg(F.first("shard").alias(shard)).withColumnRenamed("fp", fp)
    out = docs.withColumn(fp, F.unhex(F.md5(text))).join(map_, fp).drop(fp)
    out.withColumn(size, F.pmod(F.monotonically_increasing_id(), F.lit(files))).repartition(shard, size).drop(size).write.partitionBy(
        shard
    ).parquet(path)
