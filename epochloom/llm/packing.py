"""Best-fit packing of documents into sequences, improved by swap-based local search.

Pieces (documents, or the cuts of those over the capacity) are dealt at random to groups of bounded
size. Each group packs by best fit, longest first, and then exchanges pieces between its underfull
sequences: a piece moves, one changes places with one, or two with one, whenever the fuller sequence
becomes fuller still. Each exchange raises the sum of squared fills, so the search ends, and the sequences
that are drained go. All underfull sequences are tried, the emptiest first and with the best partner of all, until none of
them changes or the fewest possible sequences are reached. What stays loosely filled (below 98 %) is dealt to fewer
groups again, until one group holds it all or a pass saves no sequence.

Only lengths and row numbers go through the groups; ids are joined to them where they are wanted.

Defined cases: a null text counts as empty and is a piece of one end id; repeated rows are packed as often
as they stand in the table; a null document id is kept; an empty table gives no sequences; further columns
are ignored. Ties between equally good places go to the smaller free space, then to the earlier sequence.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochloom.llm.common import saved, text_of
from epochloom.llm.tokens import END_BYTES, default_tokenizer, encoder

CAPACITY = 4096
#: Pieces of a group, on average.
GROUP_PIECES = 8_192
#: Sequences filled to a smaller share than this are packed again over many groups.
LOOSE = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids_of, docs, piece, start, length, crc = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + END_BYTES
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    docs.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids_of.append(np.frombuffer(part, "<i4"))
            columns = [
                pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ] + [pa.array(ids_of, pa.list_(pa.int32()))] * keep_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids; the end id closes each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = PIECES + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity, keep_ids), schema)


# --- one group --------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions; each piece, longest first, goes where the least space stays free."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit s: some bin has s free places
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[at]
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            which = by_space[space].pop()
            if not by_space[space]:
                free ^= 1 << space
            bins[which].append(at)
        else:
            space, which = capacity, len(bins)
            bins.append([at])
        left = space - size
        by_space[left].append(which)
        free |= 1 << left
    return bins


class _Exchange:
    """Local search over the underfull bins of one group."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        #: Of the underfull bins, in order: (free, bin), and (free + length, length, bin) for each length they hold.
        self.spaces: list[tuple[int, int]] = []
        self.offers: list[tuple[int, int, int]] = []
        for k, fill in enumerate(self.fill):
            if fill < capacity and bins[k]:
                space = capacity - fill
                self.spaces.append((space, k))
                self.offers += [(space + size, size, k) for size in {lengths[i] for i in bins[k]}]
        self.spaces.sort()
        self.offers.sort()

    def _enter(self, k: int) -> None:
        space = self.capacity - self.fill[k]
        if space and self.bins[k]:
            insort(self.spaces, (space, k))
            for size in {self.lengths[i] for i in self.bins[k]}:
                insort(self.offers, (space + size, size, k))

    def _leave(self, k: int) -> None:
        space = self.capacity - self.fill[k]
        if space and self.bins[k]:
            del self.spaces[bisect_left(self.spaces, (space, k))]
            for size in {self.lengths[i] for i in self.bins[k]}:
                del self.offers[bisect_left(self.offers, (space + size, size, k))]

    def _swap(self, low: int, out: list[int], high: int, back: list[int]) -> None:
        for k in (low, high):
            self._leave(k)
        for i in out:
            self.bins[low].remove(i)
        for i in back:
            self.bins[high].remove(i)
        self.bins[low] += back
        self.bins[high] += out
        for k in (low, high):
            self.fill[k] = sum(self.lengths[i] for i in self.bins[k])
            self._enter(k)

    def _move(self, low: int) -> bool:
        """A piece into another bin with room that becomes fuller than this one was, the one left with least space."""
        free = self.capacity - self.fill[low]
        for i in sorted(self.bins[low], key=lambda i: -self.lengths[i]):
            size = self.lengths[i]
            pos = bisect_left(self.spaces, (size, -1))
            while pos < len(self.spaces) and self.spaces[pos][0] < size + free:
                high = self.spaces[pos][1]
                if high != low:
                    self._swap(low, [i], high, [])
                    return True
                pos += 1
        return False

    def _trade(self, low: int, out: list[int]) -> bool:
        """``out`` for one smaller piece of a bin that it makes fuller than either was, filling it best.

        A bin with ``space`` free that gives a piece of ``small`` is left with ``space + small - size``. So the best partner
        is the first offer from ``size`` on, and none is one from ``size`` and the own free space on.
        """
        size = sum(self.lengths[i] for i in out)
        free = self.capacity - self.fill[low]
        pos = bisect_left(self.offers, (size, -1, -1))
        while pos < len(self.offers) and self.offers[pos][0] < size + free:
            _, small, high = self.offers[pos]
            if small < size and high != low:
                back = next(i for i in self.bins[high] if self.lengths[i] == small)
                self._swap(low, out, high, [back])
                return True
            pos += 1
        return False

    def _drain(self, low: int) -> bool:
        """Exchange until ``low`` is empty or nothing helps; whether anything changed."""
        changed = False
        while self.bins[low]:
            own = sorted({self.lengths[i]: i for i in self.bins[low]}.values(), key=lambda i: -self.lengths[i])
            if self._move(low) or any(self._trade(low, [i]) for i in own):
                changed = True
                continue
            if any(self._trade(low, pair) for pair in self._pairs(low)):
                changed = True
                continue
            break
        return changed

    def _pairs(self, low: int) -> Iterator[list[int]]:
        """Pairs of pieces of different lengths, the longest first; equal lengths stand for each other."""
        seen = set()
        own = sorted(self.bins[low], key=lambda i: -self.lengths[i])
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                pair = (self.lengths[a], self.lengths[b])
                if pair not in seen:
                    seen.add(pair)
                    yield [a, b]

    def run(self) -> list[list[int]]:
        """All underfull bins are tried, the emptiest first, until a round changes none of them or none can be saved."""
        least = -(-sum(self.lengths) // self.capacity)
        held = sum(1 for b in self.bins if b)
        changed = True
        while changed and held > least:
            changed = False
            for _, low in list(reversed(self.spaces)):
                if held <= least:
                    break
                if self.bins[low] and self._drain(low):
                    changed = True
                    held -= not self.bins[low]
        return [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions of ``lengths``: best fit, then local search."""
    return _Exchange(best_fit(lengths, capacity), lengths, capacity).run()


def _packed(capacity: int, loose: float, level: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # rows of a group may arrive in any order; the row number makes the packing repeatable
        frame = frame.sort_values("uid", kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        number, offset, open_ = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        for k, members in enumerate(pack(lengths, capacity)):
            place = 0
            for i in members:
                number[i], offset[i] = k, place
                place += lengths[i]
            open_[members] = place < loose * capacity
        base = (level << 56) + (int(key[0]) << 24)
        return pd.DataFrame({"uid": frame["uid"], "length": frame["length"], "sequence_id": base + number, "offset": offset, "loose": open_})

    return run


PLACES = "uid long, length long, sequence_id long, offset long, loose boolean"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``uid, sequence_id, offset`` for pieces with ``uid, length``; ``uid`` numbers the rows.

    What a pass leaves loose is dealt anew to fewer groups, until one group holds it all or a pass saves nothing.
    """
    rows = pieces.select("uid", "length")
    keep = lambda df: df.select("uid", "sequence_id", "offset")
    out = rows.filter(F.col("length") >= capacity).select(
        "uid", (F.lit(1 << 62).cast("long") + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left, level, before = rows.filter(F.col("length") < capacity), 1, None
    while True:
        groups = max(1, -(-left.count() // group_pieces))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        placed = saved(dealt.groupBy("grp").applyInPandas(_packed(capacity, LOOSE if groups > 1 else 0.0, level), PLACES), "places")
        if groups == 1:
            return out.unionByName(keep(placed))
        loose = placed.filter("loose")
        open_ = loose.agg(F.count_distinct("sequence_id")).first()[0]
        if not open_ or (before is not None and open_ >= before):
            return out.unionByName(keep(placed))
        out = out.unionByName(keep(placed.filter(~F.col("loose"))))
        left, level, before = loose.select("uid", "length"), level + 1, open_


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, keep_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence and its place there; with ``keep_ids`` also its ids."""
    cut = token_pieces(docs, id_col, text_col, tokenizer, capacity, keep_ids)
    pieces = saved(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack_pieces(pieces, capacity), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the sequences themselves, each of at most the capacity."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    return parts.select("sequence_id", "n_tokens", F.flatten(F.col("parts.ids")).alias("ids"))
