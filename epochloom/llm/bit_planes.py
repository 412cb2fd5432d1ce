"""Token-id files: fixed-size blocks of ids, transposed into planes, each compressed by itself.

A file row is a segment: some consecutive documents with their ids, cut into blocks of ``block_ids``
ids. A block is transposed into byte planes (or bit planes), so that the nearly constant high planes
shrink to a few bytes and the low ones compress by their own statistics. The chunk index has a row for
each segment: where its ids begin, how many ids, documents and blocks it has and the bytes of each block.

Segments are Parquet rows written by Spark, so they can lie in any store, and a task that is run again
replaces its files.

Defined cases: a null text counts as empty and gets the end id alone; equal document ids keep all their
rows (shorter ones first); a null document id sorts first; an empty table gives empty files; further columns
are ignored. A text of any length is one document of many blocks.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from epochloom.llm.common import text_of
from epochloom.llm.tokens import END_BYTES, default_tokenizer, encoder

BLOCK_IDS = 16_384
SEGMENT_IDS = 1 << 18
SEGMENTS = "part int, seg long, n_ids long, doc_ids array<long>, lengths array<long>, blocks array<array<binary>>"
INDEX = "part int, seg long, n_ids long, n_docs long, block_bytes array<long>"


@dataclass(frozen=True)
class Layout:
    """Parameters of the format; ``planes`` is ``byte`` or ``bit``."""

    block_ids: int = BLOCK_IDS
    segment_ids: int = SEGMENT_IDS
    planes: str = "byte"
    level: int = 3


def to_planes(ids: np.ndarray, layout: Layout) -> list[bytes]:
    """Planes of one block, low bits first; what follows the last plane is zero."""
    squeeze = zstandard.ZstdCompressor(level=layout.level).compress
    if not len(ids):
        return []
    top = int(ids.max())
    if layout.planes == "byte":
        rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return [squeeze(rows[k].tobytes()) for k in range(max(1, (top.bit_length() + 7) // 8))]
    return [
        squeeze(np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes()) for k in range(max(1, top.bit_length()))
    ]


def from_planes(planes: list[bytes], count: int, layout: Layout) -> np.ndarray:
    """The ids of one block of ``count`` ids."""
    expand = zstandard.ZstdDecompressor().decompress
    if layout.planes == "byte":
        rows = np.zeros((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            rows[:, k] = np.frombuffer(expand(plane), np.uint8)
        return rows.view("<u4").reshape(-1)
    ids = np.zeros(count, np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(expand(plane), np.uint8), count=count).astype(np.uint32) << np.uint32(k)
    return ids.astype("<u4")


ENCODED = "to int, doc_id long, n long, planes array<binary>"


def _encoded(tokenizer: str, layout: Layout, bounds: list[int]):
    names, cuts = ["to", "doc_id", "n", "planes"], np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                ids = [np.frombuffer(coder.encode(t.as_py()) + END_BYTES, "<u4") for t in part.column(1)]
                to = np.searchsorted(cuts, part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
                columns = [
                    pa.array(to, pa.int32()), part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([to_planes(x, layout) for x in ids], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        coder.forget()

    return run


def _segments(layout: Layout):
    schema = pa.schema([
        ("part", pa.int32()), ("seg", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.list_(pa.binary()))),
    ])

    def row(part: int, seg: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, step = np.concatenate(parts), layout.block_ids
        blocks = [to_planes(ids[k : k + step], layout) for k in range(0, len(ids), step)]
        values = (part, seg, len(ids), docs, [len(p) for p in parts], blocks)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seg, held, docs, parts = 0, 0, [], []
        for batch in batches:
            for doc_id, n, planes in zip(*(batch.column(k) for k in range(3))):
                docs.append(doc_id.as_py())
                parts.append(from_planes(planes.as_py(), n.as_py(), layout))
                held += len(parts[-1])
                if held >= layout.segment_ids:
                    yield row(part, seg, docs, parts)
                    seg, held, docs, parts = seg + 1, 0, [], []
        if docs:
            yield row(part, seg, docs, parts)

    return run


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` ids that cut the table into about equal parts, from the id column alone."""
    cuts = ids.filter("doc_id is not null").agg(
        F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 50 * parts).alias("cuts")
    ).first()["cuts"]
    return sorted(set(cuts or []))


def write_ids(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    layout: Layout = Layout(), parts: int | None = None,
) -> None:
    """Encode, append the end id and write ``path/segments`` and ``path/index`` in ascending id order.

    ``parts`` is the number of files, the session's shuffle partitions by default. Texts are encoded where
    they are read; what is shuffled are the compressed planes of each document.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    bounds = _bounds(rows.select("doc_id"), parts)
    encoded = rows.mapInArrow(_encoded(tokenizer or default_tokenizer(), layout, bounds), ENCODED)
    spread = encoded.repartitionById(len(bounds) + 1, "to")
    ordered = spread.sortWithinPartitions("doc_id", "n", F.xxhash64("planes")).select("doc_id", "n", "planes")
    ordered.mapInArrow(_segments(layout), SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    size = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, p: s + F.length(p))
    spark.read.parquet(f"{path}/segments").select(
        "part", "seg", "n_ids", F.size("doc_ids").cast("long").alias("n_docs"), F.transform("blocks", size).alias("block_bytes")
    ).write.parquet(f"{path}/index")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, seg, start)`` of every segment: running totals inside a part, then over the parts."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return index.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner")).join(
        parts, "part"
    ).select("part", "seg", (F.col("part_start") + F.col("inner")).alias("start"))


def _decoded(layout: Layout, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.to_pylist():
                left, ids = segment["n_ids"], []
                for planes in segment["blocks"]:
                    count = min(layout.block_ids, left)
                    ids.append(from_planes(planes, count, layout))
                    left -= count
                flat = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
                lengths = np.array(segment["lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts, n = ends - lengths, len(lengths)
                cut = [flat[s:e] for s, e in zip(starts, ends)]
                columns = [
                    pa.array([segment["part"]] * n, pa.int32()), pa.array([segment["seg"]] * n, pa.int64()),
                    pa.array(segment["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                ]
                names = ["part", "seg", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_ids(spark: SparkSession, path: str, layout: Layout = Layout(), keep_ids: bool = True) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    schema = "part int, seg long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").mapInArrow(_decoded(layout, keep_ids), schema)
    return rows.join(segment_starts(spark, path), ["part", "seg"]).select(
        "doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids
    )


def ids_between(spark: SparkSession, path: str, first: int, last: int, layout: Layout = Layout()) -> DataFrame:
    """The documents that hold ids ``first`` to ``last`` (exclusive), from the segments that the index names."""
    starts = segment_starts(spark, path)
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    wanted = starts.join(index.select("part", "seg", "n_ids"), ["part", "seg"]).filter(
        (F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)
    ).select("part", "seg", F.col("start").alias("seg_start"))
    schema = "part int, seg long, doc_id long, inner long, n_tokens long, ids_crc32 long, ids array<int>"
    rows = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(wanted.select("part", "seg"), ["part", "seg"], "left_semi")
    begin = F.col("seg_start") + F.col("inner")
    return rows.mapInArrow(_decoded(layout, True), schema).join(wanted, ["part", "seg"]).filter(
        (begin < last) & (begin + F.col("n_tokens") > first)
    ).select("doc_id", begin.alias("start"), "n_tokens", "ids")
