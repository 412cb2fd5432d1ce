"""Anchor retrieval: scoring every epoch against a vocabulary without a cross join."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from epochloom.functions import arrays
from epochloom.functions.hashed import gaussian_units, order_hash
from epochloom.functions.scale import ranked, small_side

#: Bytes of vectors in one block of the vocabulary, and of epochs in one group of the block product.
BLOCK_BYTES = 32 << 20
#: Scores held at once.
CELLS = 1 << 22
TIE = 1e-12


def _blocks_of(vocab: DataFrame, block: int | None) -> tuple[int, int]:
    """Number of vocabulary blocks, and the dimension; one small aggregate."""
    got = vocab.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = max(1, got["dim"] or 1)
    rows = block or max(1, BLOCK_BYTES // (8 * dim))
    return -(-got["n"] // rows), dim


def _one_block(vocab: DataFrame):
    """A vocabulary of one block, broadcast: positions in order, surfaces, vectors."""
    rows = vocab.select("pos", "surface", "vec").orderBy("pos").toArrow()
    return vocab.sparkSession.sparkContext.broadcast((
        np.asarray(rows["pos"].combine_chunks(), dtype=np.int64), rows["surface"].to_pylist(), _matrix_of(rows["vec"]),
    ))


def _matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def block_product(
    epochs: DataFrame, vocab: DataFrame, parts: int, dim: int, fn: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str,
    group_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``fn(group of epochs, block of vocabulary, first block)`` for every group and every block, as one join.

    The vocabulary is dealt to ``parts`` blocks and the epochs to groups of about ``group_bytes``; each side is copied
    for every number of the other, and equal (block, group) numbers meet in one task that holds one block and one
    group. The number of stages depends on neither side's size.
    """
    groups = max(1, -(-epochs.count() * dim * 8 // group_bytes))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = epochs.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")).withColumn("_block", numbers(parts))
    dealt = F.pmod(F.xxhash64("pos"), F.lit(parts)).cast("int")
    right = vocab.select("pos", "surface", "vec", dealt.alias("_block")).withColumn("_group", numbers(groups))

    def meet(key: tuple, some: pa.Table, block: pa.Table) -> pa.Table:
        return fn(some.drop_columns(["_group", "_block"]), block.sort_by("pos"), key[0].as_py() == 0)

    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(meet, schema)


def _best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of each row, best first, ties by column; only k columns a row are sorted."""
    k = min(k, scores.shape[1])
    scores = np.where(np.isnan(scores), -np.inf, scores)
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, at = scores > cut, scores == cut
    taken = above | (at & (np.cumsum(at, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    columns = np.nonzero(taken)[1].reshape(len(scores), k)
    order = np.lexsort((columns, -np.take_along_axis(scores, columns, 1)), axis=1)
    return np.take_along_axis(columns, order, 1)


def _top(emb: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and dots of the best k for each epoch."""
    step = max(1, CELLS // max(1, len(vectors)))
    columns, dots = [], []
    for at in range(0, len(emb), step):
        scores = emb[at : at + step] @ vectors.T
        best = _best_of(scores, k)
        columns.append(best)
        dots.append(np.take_along_axis(scores, best, 1))
    return np.concatenate(columns), np.concatenate(dots)


def _top_rows(ids: pa.Array, emb: np.ndarray, pos: np.ndarray, surfaces: list, vectors: np.ndarray, k: int, names: list[str]) -> pa.Table:
    columns, dots = _top(emb, vectors, k)
    each = columns.shape[1]
    flat = columns.ravel()
    made = [
        ids.take(pa.array(np.repeat(np.arange(len(emb)), each))), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(emb))),
        pa.array(pos[flat]), pa.array([surfaces[c] for c in flat], pa.string()), pa.array(dots.ravel()),
    ]
    return pa.Table.from_arrays(made, names=names)


def top_anchors(
    epochs: DataFrame, vocab: DataFrame, k: int = 5, epoch_id: str = "epoch_id", emb: str = "emb",
    block: int | None = None,
) -> DataFrame:
    """The k best anchors of every epoch by dot product, ties in vocabulary order.

    A vocabulary of one block (``BLOCK_BYTES`` of vectors) is broadcast and epochs aren't shuffled. A larger one is
    multiplied block by block; the bests of the blocks are cut to k before and after their shuffle.
    """
    kind = epochs.schema[epoch_id].dataType.simpleString()
    rows = epochs.select(F.col(epoch_id).alias("epoch_id"), F.col(emb).alias("emb"))
    parts, dim = _blocks_of(vocab, block)
    if parts <= 1:
        shared = _one_block(vocab)
        names = ["epoch_id", "rank", "pos", "surface", "dot"]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos, surfaces, vectors = shared.value
            for batch in batches:
                if batch.num_rows and len(pos):
                    table = pa.Table.from_batches([batch])
                    yield from _top_rows(batch.column("epoch_id"), _matrix_of(table["emb"]), pos, surfaces, vectors, k, names).to_batches()

        return rows.mapInArrow(score, f"epoch_id {kind}, rank int, pos bigint, surface string, dot double")
    if epochs.isStreaming:
        raise ValueError("a stream meets one block of vocabulary; hand its micro-batches over for more")
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    names = ["at", "rank", "pos", "surface", "dot"]

    def meet(some: pa.Table, words: pa.Table, first: bool) -> pa.Table:
        if not some.num_rows or not words.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(["uid", "epoch_id", "pos", "surface", "dot"], [pa.int64(), some["epoch_id"].type, pa.int64(), pa.string(), pa.float64()])})
        at = pa.array(np.arange(some.num_rows))
        best = _top_rows(at, _matrix_of(some["emb"]), np.asarray(words["pos"].combine_chunks()), words["surface"].to_pylist(), _matrix_of(words["vec"]), k, names)
        where = best["at"]
        return pa.table({
            "uid": some["uid"].take(where), "epoch_id": some["epoch_id"].take(where), "pos": best["pos"], "surface": best["surface"], "dot": best["dot"],
        })

    found = block_product(rows, vocab, parts, dim, meet, f"uid bigint, epoch_id {kind}, pos bigint, surface string, dot double")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("dot"), "pos"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("epoch_id", "rank", "pos", "surface", "dot")


def as_anchors(top: DataFrame) -> DataFrame:
    """Retrieval rows in anchor form: id, confidence and epoch provenance."""
    return top.select(
        "epoch_id", anchor_id("surface").alias("anchor_id"), "surface",
        confidence("dot").alias("score"), "rank",
        F.array(epoch_provenance("epoch_id")).alias("provenance"),
    )


def confidence(dot: str) -> Column:
    return (F.col(dot) + 1.0) / 2.0


def anchor_id(surface: str) -> Column:
    return F.concat(F.lit("anchor:"), F.replace(F.col(surface), F.lit(" "), F.lit("_")))


def epoch_provenance(epoch_id: str) -> Column:
    key = F.col(epoch_id).cast("string")
    return F.when(key.startswith("eeg:"), key).otherwise(F.concat(F.lit("eeg:"), key))


def _ahead(emb: np.ndarray, own: np.ndarray, own_pos: np.ndarray, pos: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """How many anchors stand before each epoch's own."""
    step = max(1, CELLS // max(1, len(vectors)))
    out = np.zeros(len(emb), dtype=np.int64)
    for at in range(0, len(emb), step):
        part = slice(at, at + step)
        scores = emb[part] @ vectors.T
        mine, place = own[part, None], own_pos[part, None]
        out[part] = ((scores > mine + TIE) | ((np.abs(scores - mine) <= TIE) & (pos < place))).sum(axis=1)
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)


def gold_ranks(
    epochs: DataFrame, vocab: DataFrame, epoch_id: str = "epoch_id", emb: str = "emb",
    label: str = "label", block: int | None = None,
) -> DataFrame:
    """Rank of each epoch's own label among the whole vocabulary; NULL for an unknown label.

    Counting the anchors ahead of the label replaces materialising a ranking, so the
    only output per epoch is one number, summed over the blocks. Other columns of the epochs are kept.
    """
    gold = vocab.groupBy(F.lower("surface").alias("_gold")).agg(
        F.min("pos").alias("gold_pos"), F.min_by("vec", "pos").alias("_gold_vec")
    )
    kept = [c for c in epochs.columns if c != emb]
    rows = epochs.withColumn("_gold", F.lower(label)).join(small_side(gold), "_gold", "left").select(
        F.struct(*kept).alias("row"), F.col(emb).alias("emb"), arrays.dot(emb, "_gold_vec").alias("gold_dot"), "gold_pos"
    )
    row_type = rows.schema["row"].dataType.simpleString()
    parts, dim = _blocks_of(vocab, block)
    rank = F.when(F.col("gold_pos").isNotNull(), F.col("ahead") + 1).alias("gold_rank")
    if parts <= 1:
        shared = _one_block(vocab)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos, _, vectors = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                some = pa.Table.from_batches([batch])
                ahead = _ahead(_matrix_of(some["emb"]), _numbers(some["gold_dot"]), _numbers(some["gold_pos"]), pos, vectors) if len(pos) else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("gold_pos"), pa.array(ahead)], ["row", "gold_pos", "ahead"])

        counted = rows.mapInArrow(count, f"row {row_type}, gold_pos bigint, ahead bigint")
        return counted.select("row.*", rank)

    def meet(some: pa.Table, words: pa.Table, first: bool) -> pa.Table:
        ahead = np.zeros(some.num_rows, np.int64)
        if some.num_rows and words.num_rows:
            ahead = _ahead(_matrix_of(some["emb"]), _numbers(some["gold_dot"]), _numbers(some["gold_pos"]), np.asarray(words["pos"].combine_chunks()), _matrix_of(words["vec"]))
        row = some["row"] if first else pa.nulls(some.num_rows, some["row"].type)  # one block brings the row itself
        return pa.table({"uid": some["uid"], "row": row, "gold_pos": some["gold_pos"], "ahead": pa.array(ahead)})

    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    counted = block_product(numbered, vocab, parts, dim, meet, f"uid bigint, row {row_type}, gold_pos bigint, ahead bigint")
    summed = counted.groupBy("uid").agg(F.first("row", ignorenulls=True).alias("row"), F.max("gold_pos").alias("gold_pos"), F.sum("ahead").alias("ahead"))
    return summed.select("row.*", rank)


def label_vocab(df: DataFrame, label: str, pos: str, embedder) -> DataFrame:
    """Observed labels in first-occurrence order, embedded once each."""
    seen = df.groupBy(F.col(label).alias("surface")).agg(F.min(pos).alias("pos"))
    return embedder.transform(seen, "pos", "surface", "vec").select("pos", "surface", "vec")


def operating_k(n_labels: Column, top_k: int = 5) -> Column:
    """Top-k saturates when every label fits in it; one less than the labels then."""
    return F.when(n_labels <= 1, F.lit(1)).otherwise(F.least(F.lit(top_k), n_labels - 1))


def hit_rates(ranks: DataFrame, k: Column | int, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of epochs whose own label is within 1, k and 25."""
    rate = lambda limit: F.avg(F.when(F.col("gold_rank") <= limit, 1.0).otherwise(0.0))
    k = F.lit(k) if isinstance(k, int) else k
    return ranks.groupBy(*by).agg(
        rate(F.lit(1)).alias("top1"), rate(k).alias("top5"), rate(F.lit(25)).alias("top25"),
        F.count(F.lit(1)).alias("n_test"),
    )


def shuffled_labels(df: DataFrame, epoch_id: str, label: str, seed: str = "1", out: str = "label") -> DataFrame:
    """Labels permuted over the rows: the i-th row by id gets the i-th label by hash."""
    rows = ranked(df, [], [epoch_id], "_i")
    donors = ranked(
        df.select(F.col(label).alias("_donor"), order_hash(F.col(epoch_id), seed).alias("_h")), [], ["_h"], "_i"
    )
    mixed = rows.join(donors.select("_i", "_donor"), "_i", "inner").drop("_i")
    return mixed.drop(label).withColumnRenamed("_donor", out) if out == label else mixed.withColumnRenamed("_donor", out)


def random_unit(df: DataFrame, epoch_id: str, dim: int, seed: str, out: str = "emb") -> DataFrame:
    """A random unit vector per epoch, drawn from its id."""
    return df.withColumn(out, gaussian_units(F.col(epoch_id), dim, seed))


def passes(topk: Column, controls: list[Column]) -> Column:
    """True when the score beats every control; False when one is missing."""
    best = F.greatest(*controls) if len(controls) > 1 else controls[0]
    missing = F.lit(False)
    for c in [topk, *controls]:
        missing = missing | c.isNull()
    return F.when(missing, False).otherwise(topk > best)
