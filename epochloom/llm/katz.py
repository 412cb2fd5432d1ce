"""Katz backoff scores of texts by a word bigram model with Good-Turing discounts.

Words are runs without white space, A-Z in lower case; every text ends with an end token and begins after a start
context. A count r is discounted to r* by Good-Turing: (r + 1) n(r+1) / n(r) for r up to ``k``, where that lies between 0
and r, else r (1 + 1/r)^(b+1) with the slope b of log n(r) over log r (simple Good-Turing). So every context has mass left:

    P(w|h) = c*(h w) / c(h)                 if h w was seen
           = alpha(h) P(w)                  if h was seen, alpha(h) = left(h) / (1 - sum of P(v) over the v seen after h)
           = P(w)                           else
    P(w)   = c*(w) / N, and for all unknown words together what these leave

so each context's probabilities sum to 1. All counts and statistics cover the whole training part.

How it runs. Tokens are 64-bit hashes of words. A task groups the (word, context, document) triples of some texts and sends
them to ``parts`` partitions by word, packed in sorted blocks (6 to 8 bytes a token). There the unigram and pair tables of the
partition are counted and stored, and each document gets the two counts of each of its pairs back (2 to 3 bytes a token), which
are evaluated once the discounts are known. Pairs then send (c, left, P) to their context, combined
by partition; documents of the training part need no more, as all their pairs were seen and c(h) is the count of a word
of their own; the others' contexts meet the context sums in the context's partition. Words and pairs that are
frequent in a bounded sample (``head``) are counted exactly beforehand, broadcast and evaluated where the text is, so that
none of them fills a partition; frequent words' other pairs are spread by the pair, and their sums as contexts are
broadcast as well. The sample decides only where work is done.

Why order 2: with a second context word every token's block entry, table row and context sum grows by 7 bytes, which at the
given disk bound doesn't fit.

Defined cases: null texts count as empty (an end token only); a null id is not held out; repeated rows are texts each;
without training rows all words are unknown and all scores are 0; an empty table gives no rows; texts are scored whole;
further columns are ignored.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from epochloom.llm.common import BATCH_BYTES, fresh, saved, setting, text_of
from epochloom.llm.labelled import held_out

U64 = np.uint64
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
#: Documents of one block at most; the low bits of a row's number.
DOC_BITS = 17


@dataclass(frozen=True)
class Params:
    #: Counts up to here take the Turing estimate.
    k: int = 5
    #: Counts of counts that the slope is fitted to.
    fit: int = 32
    #: Frequent pairs, and words for each partition, of the sample that are evaluated where the text is.
    head: int = 20_000
    head_words: int = 4
    sample_docs: int = 4_000
    #: Tokens of a block, and characters of text of a partition.
    block_tokens: int = 5 << 18
    part_chars: int = 1 << 23
    #: Bytes of texts or blocks that a task is sent at once, or one row.
    batch_bytes: int = 1 << 22


# --- packing ----------------------------------------------------------------------


def _small(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind in "iu" and len(a):
        for kind in (np.uint8, np.uint16, np.uint32):
            if a.max() <= np.iinfo(kind).max:
                return a.astype(kind)
    return a


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned or floating numbers in byte planes, compressed."""
    arrays = [np.ascontiguousarray(_small(a)) for a in arrays]
    head = pickle.dumps([(a.dtype.str, len(a)) for a in arrays])
    out = zstandard.ZstdCompressor(level=1).compressobj(size=4 + len(head) + sum(a.nbytes for a in arrays))
    made = [out.compress(len(head).to_bytes(4, "little") + head)]
    for a in arrays:
        if len(a):
            made += [out.compress(np.ascontiguousarray(plane)) for plane in a.view(np.uint8).reshape(len(a), -1).T]
    return b"".join([*made, out.flush()])


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in pickle.loads(raw[4:at]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the place of each; as ``np.unique``, in half of its memory."""
    order = np.argsort(a).astype(np.uint32)
    ranked = a[order]
    new = np.ones(len(a), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    known = ranked[new]
    del ranked
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    place = np.empty(len(a), np.int32)
    place[order] = rank
    return known, place


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=U64(0))


# --- tokens -----------------------------------------------------------------------


#: 1 for the bytes of words.
_WORD = bytes(c not in b" \t\n\x0b\x0c\r" for c in range(256))
#: Longer words are hashed one by one.
LONG = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _hashed(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``start``, eight bytes of all of them at a time."""
    buffer = np.frombuffer(raw + bytes(8), np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer, 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    out = _mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONG)
    live, at, left = None, start, np.where(size > LONG, 0, size) if len(long) else size
    while True:
        chunk = eight[at] & masks[np.minimum(left, 8)]
        if live is None:
            out = _mix(out ^ chunk)
            live = np.flatnonzero(left > 8)
            at, left = at[live], left[live]
        else:
            out[live] = _mix(out[live] ^ chunk)
            more = left > 8
            live, at, left = live[more], at[more], left[more]
        if not len(live):
            break
        at, left = at + 8, left - 8
    for k in long:
        out[k] = xxhash.xxh64_intdigest(raw[start[k] : start[k] + size[k]])
    return out


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, an end after each text, and the number of tokens of each; only A-Z is lowered."""
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    bounds = np.frombuffer(text.buffers()[1], wide, len(text) + 1, text.offset * np.dtype(wide).itemsize).astype(np.int64)
    body = text.buffers()[2]
    raw = body[int(bounds[0]) : int(bounds[-1])].to_pybytes().lower() if body is not None else b""
    bounds = bounds - bounds[0]
    inside = np.frombuffer(raw.translate(_WORD), bool)
    # a word begins and ends at white space or at the bounds of its text
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    first, last = bounds[some], bounds[some + 1] - 1
    begins[first], ends[last] = inside[first], inside[last]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    before = np.searchsorted(start, bounds)
    out = np.empty(len(start) + len(text), U64)
    sizes = np.diff(before) + 1
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = _hashed(raw, start, size)
    out[~word] = END
    return out, sizes


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about ``most`` bytes together, or one row."""
    ends = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mixed(w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """One hash for a pair."""
    x = w ^ (ctx * U64(0x9E3779B97F4A7C15) + U64(0x7F4A7C15))
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class Places:
    """Places of hashes in a sorted table, by their upper bits."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = min(22, len(table).bit_length() + 3)
        self.shift = U64(64 - bits)
        self.first = np.searchsorted((table >> self.shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """-1 where absent."""
        out = np.full(len(x), -1)
        if not len(self.table):
            return out
        bucket = (x >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        rows = np.flatnonzero(at < end)
        at, end = at[rows], end[rows]
        for _ in range(self.most):
            hit = self.table[at] == x[rows]
            out[rows[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            rows, at, end = rows[more], at[more] + 1, end[more]
            if not len(rows):
                break
        return out


class Head:
    """Frequent words and pairs with their exact counts."""

    def __init__(self, words: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
        self.w = np.unique(words)
        keys = mixed(*pairs)
        _, first = np.unique(keys, return_index=True)
        self.key, self.pw, self.pc = keys[first], pairs[0][first], pairs[1][first]
        self.words, self.pairs = Places(self.w), Places(self.key)
        self.c1, self.c2 = np.zeros(len(self.w), np.int64), np.zeros(len(self.key), np.int64)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places in ``table``, -1 where absent."""
        if not len(table):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, at, -1)

    def word(self, w: np.ndarray) -> np.ndarray:
        return self.words(w)

    def pair(self, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        at = self.pairs(mixed(w, ctx))
        some = np.flatnonzero(at >= 0)
        other = some[(self.pw[at[some]] != w[some]) | (self.pc[at[some]] != ctx[some])]
        at[other] = -1
        return at


def _contexts(w: np.ndarray, sizes: np.ndarray, start=START) -> np.ndarray:
    """The token before each, ``start`` before the first of a text."""
    out = np.empty_like(w)
    out[1:] = w[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


def _ordered(rank: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of small numbers in order, and how often each occurs; as one number each, where that fits."""
    if not len(rank):
        return rank, ctx, doc, np.zeros(0, np.int64)
    low, mid, high = (int(a.max()).bit_length() for a in (doc, ctx, rank))
    if low + mid + high > 64:
        order = np.lexsort((doc, ctx, rank))
        rank, ctx, doc = rank[order], ctx[order], doc[order]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return rank[first], ctx[first], doc[first], np.diff(first, append=len(new))
    key = rank.astype(U64)
    del rank
    key <<= U64(mid)
    key |= ctx.astype(U64)
    del ctx
    key <<= U64(low)
    key |= doc.astype(U64)
    del doc
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    del new
    n = np.diff(first, append=len(key)).astype(np.int32)
    key = key[first]
    del first
    cut = lambda bits: (key & U64((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
    doc = cut(low)
    key >>= U64(low)
    ctx = cut(mid)
    key >>= U64(mid)
    return cut(high), ctx, doc, n


# --- sums of a document -----------------------------------------------------------


class Sums:
    """Columns of what frequent words and pairs add to a document; discounts, which multiply them, are not known yet."""

    def __init__(self, k: int):
        self.k = k
        self.names = ["known", "base", "fixed", "step"] + [f"seen{r}" for r in range(1, k + 1)]
        self.at = {name: i for i, name in enumerate(self.names)}

    def add(self, out: np.ndarray, name: str, doc: np.ndarray, value: np.ndarray) -> None:
        out[:, self.at[name]] += np.bincount(doc, value, len(out))

    def words(self, out, doc, c1, inner) -> None:
        """A token's own count: known, base score, and (``inner``) as the context of the next token of a training text."""
        self.add(out, "known", doc, (c1 > 0) * 1.0)
        self.add(out, "base", doc, np.log10(c1 + 1.0))
        self.add(out, "fixed", doc[inner], -np.log10(c1[inner]))

    def pairs(self, out, doc, c2) -> None:
        """Seen pairs: log c* is log c and a multiple of log(1 + 1/c), or that of one of the first counts."""
        big = c2 > self.k
        self.add(out, "fixed", doc[big], np.log10(c2[big]))
        self.add(out, "step", doc[big], np.log10(1 + 1 / c2[big]))
        for r in range(1, self.k + 1):
            self.add(out, f"seen{r}", doc[c2 == r], (c2[c2 == r] > 0) * 1.0)


# --- stages -----------------------------------------------------------------------

ROWS = "kind string, part int, batch long, body binary, stats array<long>"


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    names = ("kind", "part", "batch", "body", "stats")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, 1 << 17):
            w, sizes = tokens(some.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(_contexts(w, sizes).view(np.int64))], ["w", "ctx"])


def _head(trained: DataFrame, rows: int, parts: int, params: Params) -> Head:
    """Candidates from a bounded sample, then their exact counts over all training rows; also their tokens and rows."""
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, params.sample_docs / max(1, rows)))
    sample = saved(trained.filter(share).mapInArrow(_sampled, "w long, ctx long").groupBy("w", "ctx").count(), "sample")
    top = lambda df, most: df.orderBy(F.desc("n"), *[c for c in df.columns if c != "n"]).limit(most).collect()
    # a word with less than a quarter of a partition's tokens needn't be spread
    words = top(sample.groupBy("w").agg(F.sum("count").alias("n")), min(params.head, params.head_words * parts))
    pairs = top(sample.select("w", "ctx", F.col("count").alias("n")), params.head)
    w = np.array([r["w"] for r in words], np.int64).view(U64)
    held = set(w.tolist())
    pairs = [r for r in pairs if r["w"] % (1 << 64) in held]  # a frequent pair's word is evaluated with it
    return Head(w, tuple(np.array([r[c] for r in pairs], np.int64).view(U64) for c in ("w", "ctx")))


def _count_head(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        c1, c2, total = np.zeros(len(head.w), np.int64), np.zeros(len(head.key), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for some in slices(batch, 1 << 20):
                w, sizes = tokens(some.column("text"))
                at = head.word(w)
                hot = np.flatnonzero(at >= 0)
                pair = head.pair(w[hot], _contexts(w, sizes)[hot])
                c1 += np.bincount(at[hot], minlength=len(c1))
                c2 += np.bincount(pair[pair >= 0], minlength=len(c2))
                total += (len(w), len(sizes))
        for kind, values in enumerate((c1, c2, total)):
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(values[some])], ["kind", "at", "n"]
            )

    return run


def _blocks(shared, parts: int, params: Params):
    """Documents to blocks of triples for the partitions, and what the head says of them."""
    sums = Sums(params.k)

    def block(batch_id: int, docs: list[tuple], arrays: list[tuple], head: Head) -> Iterator[pa.RecordBatch]:
        w, sizes = (np.concatenate(a) for a in zip(*arrays))
        arrays.clear()
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # places in the block's sorted words stand for them
        w = np.append(w, U64(START))
        known, code = _distinct(w)
        del w
        code, start = code[:-1], code[-1]
        ctx = _contexts(code, sizes, start)
        train = np.array([not held for _, held in docs])
        out = np.zeros((len(docs), len(sums.names)))
        of_known = head.word(known).astype(np.int32)
        at = of_known[code]
        hot = at >= 0
        sums.words(out, doc[hot], head.c1[at[hot]], train[doc[hot]] & (known[code[hot]] != U64(END)))
        pair = np.full(len(code), -1, np.int32)
        pair[hot] = head.pair(known[code[hot]], known[ctx[hot]])
        got = pair >= 0
        sums.pairs(out, doc[got], head.c2[pair[got]])
        ids = np.array([0 if i is None else i for i, _ in docs], np.int64)
        none = np.array([i is None for i, _ in docs])
        made = [("docs", batch_id % parts, batch_id, pack(ids.view(U64), none.astype(np.uint8), train.astype(np.uint8), sizes, *out.T), None)]
        asks = got & ~train[doc]
        if asks.any():
            order = np.lexsort((doc[asks], ctx[asks]))
            n = np.ones(len(order), np.int64)
            made.append(("want", batch_id % parts, batch_id, _wants(known[ctx[asks][order]], doc[asks][order], n, np.zeros_like(n)), None))
        del pair, asks
        # a word goes to its partition, a frequent word's pairs each to theirs
        part = (known % U64(parts)).astype(np.int64)
        by_part = np.lexsort((known, part))
        rank = np.empty(len(known), np.int32)
        rank[by_part] = np.arange(len(known), dtype=np.int32)
        cold = ~hot
        rank = rank[code[cold]]
        del code
        where, c, d, n = _ordered(rank, ctx[cold], doc[cold])
        ends = np.searchsorted(where, np.searchsorted(part[by_part], np.arange(parts + 1)))
        groups = [(ends, known[by_part[where]], known[c], d * 2 + train[d], n)]
        del cold, where, c, d, n, rank, by_part
        spread = np.flatnonzero(hot & ~got)
        if len(spread):
            own, c, d = at[spread], ctx[spread], doc[spread]
            to = (mixed(head.w[own], known[c]) % U64(parts)).astype(np.int64)
            where, c, d, n = _ordered(to * len(head.w) + own, c, d)
            ends = np.searchsorted(where, np.arange(parts + 1) * len(head.w))
            groups.append((ends, head.w[where % len(head.w)], known[c], d * 2 + train[d], n))
        del at, hot, got, ctx, doc, spread
        for p in range(parts):
            mine = [[v[g[0][p] : g[0][p + 1]] for v in g[1:]] for g in groups if g[0][p] < g[0][p + 1]]
            if mine:
                made.append(("pairs", p, batch_id, _pairs(*(mine[0] if len(mine) == 1 else map(np.concatenate, zip(*mine)))), None))
        for k in range(0, len(made), 256):
            yield _rows(made[k : k + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        first, number = TaskContext.get().partitionId() << 22, 0
        docs, arrays, held = [], [], 0
        for batch in batches:
            for some in slices(batch, params.block_tokens):
                # a block has no more documents than their numbers have room for
                for at in range(0, some.num_rows, 1 << DOC_BITS - 1):
                    few = some.slice(at, 1 << DOC_BITS - 1)
                    arrays.append(tokens(few.column("text")))
                    docs += zip(few.column("doc_id").to_pylist(), few.column("held_out").to_pylist())
                    held += len(arrays[-1][0])
                    if held >= params.block_tokens or len(docs) > 1 << DOC_BITS - 1:
                        yield from block(first + number, docs, arrays, head)
                        docs, arrays, held, number = [], [], 0, number + 1
        if docs:
            yield from block(first + number, docs, arrays, head)

    return run


def _coded(ctx: np.ndarray) -> list[np.ndarray]:
    known, place = _distinct(ctx)
    return [_steps(known), place]


def _pairs(w, ctx, doc, n) -> bytes:
    """Triples in order of the word; contexts as places in a sorted list."""
    return pack(_steps(w), *_coded(ctx), doc, n)


def _wants(ctx, doc, seen, unseen) -> bytes:
    return pack(_steps(ctx), doc, seen, unseen)


def _counted(shared, params: Params):
    """Blocks of a partition to its tables, and to counts and wants for the documents."""

    def part_of(part: int, blocks: list[tuple[int, bytes]], head: Head) -> Iterator[pa.RecordBatch]:
        ids = [batch_id for batch_id, _ in blocks]
        got = [unpack(body) for _, body in blocks]
        blocks.clear()
        # an array is made, ordered and let go before the next, and places are held in four bytes
        w = np.concatenate([np.cumsum(g[0].astype(U64), dtype=U64) for g in got])
        ctx = np.concatenate([np.cumsum(g[1].astype(U64), dtype=U64)[g[2]] for g in got])
        got = [g[3:] for g in got]
        order = np.lexsort((ctx, w)).astype(np.uint32)
        w = w[order]
        ctx = ctx[order]
        number = np.uint32 if len(ids) < 1 << 31 - DOC_BITS else np.int64
        doc = np.concatenate([(g[0] >> 1).astype(number) + number(k << DOC_BITS + 1) for k, g in enumerate(got)])[order]
        train = np.concatenate([(g[0] & 1).astype(bool) for g in got])[order]
        n = _small(np.concatenate([g[1] for g in got])[order])
        del got, order
        new_w = np.ones(len(w), bool)
        new_w[1:] = w[1:] != w[:-1]
        new = new_w.copy()
        new[1:] |= ctx[1:] != ctx[:-1]
        first, first_w = np.flatnonzero(new), np.flatnonzero(new_w)
        pair, word = (np.cumsum(a, dtype=np.int32) for a in (new, new_w))
        pair -= 1
        word -= 1
        del new, new_w
        c2, c1 = (np.add.reduceat(n * train, at, dtype=np.int64) for at in (first, first_w))
        at = head.word(w[first_w])
        hot = at >= 0
        c1[hot] = head.c1[at[hot]]
        # tables
        stats = [0] * (2 * params.fit + 1)
        cold = c1[~hot]
        stats[0] = int((cold > 0).sum())
        for r in range(1, params.fit + 1):
            stats[r] = int((cold == r).sum())
            stats[params.fit + r] = int((c2 == r).sum())
        made = [("stats", part, None, None, stats)]
        if len(cold):
            made.append(("words", part, None, pack(_steps(w[first_w][~hot]), cold), None))
        del first_w
        seen = first[c2 > 0]
        del first
        if len(seen):
            known, place = _coded(ctx[seen])
            made.append(("table", part, None, pack(_small(_steps(w[seen])), known, place, _small(c2[c2 > 0]), _small(c1[word[seen]])), None))
            del known, place
        del seen
        yield _rows(made)
        # documents: what was counted, as small numbers in order of the document
        own = ~hot[word]
        flags = own.astype(np.uint8) + np.uint8(2) * (w == U64(END))
        del w, own
        r1, r2 = c1[word], c2[pair]
        del word, pair, c1, c2
        back = np.argsort(doc, kind="stable")
        mask = (1 << DOC_BITS + 1) - 1
        numbers = np.arange(len(ids) + 1, dtype=number)
        bounds = np.searchsorted(doc[back] >> DOC_BITS + 1, numbers)
        asks = np.flatnonzero(~train)
        asks = asks[np.lexsort((ctx[asks], doc[asks] >> DOC_BITS + 1))]
        cuts = np.searchsorted(doc[asks] >> DOC_BITS + 1, numbers)
        hit = r2 > 0
        made = []
        for k, batch_id in enumerate(ids):
            rows = back[bounds[k] : bounds[k + 1]]
            made.append(("seen", part, batch_id, pack(_steps((doc[rows] & mask).astype(U64)), n[rows], r2[rows], r1[rows], flags[rows]), None))
            rows = asks[cuts[k] : cuts[k + 1]]
            if len(rows):
                made.append(("want", part, batch_id, _wants(ctx[rows], doc[rows] & mask, n[rows] * hit[rows], n[rows] * ~hit[rows]), None))
        for k in range(0, len(made), 256):
            yield _rows(made[k : k + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, part, blocks = shared.value, None, []
        for batch in batches:
            pairs = pa.compute.equal(batch.column("kind"), "pairs")
            rest = [tuple(r.values()) for r in batch.filter(pa.compute.invert(pairs)).to_pylist()]
            if rest:
                yield _rows(rest)
            for r in batch.filter(pairs).select(["part", "batch", "body"]).to_pylist():
                if r["part"] != part and blocks:
                    yield from part_of(part, blocks, head)
                    blocks = []
                part = r["part"]
                blocks.append((r["batch"], r["body"]))
        if blocks:
            yield from part_of(part, blocks, head)

    return run


# --- the model --------------------------------------------------------------------


class Discount:
    """r* of simple Good-Turing from counts of counts ``n[r]``."""

    def __init__(self, n: dict[int, int], k: int):
        points = [(math.log(r), math.log(c)) for r, c in sorted(n.items()) if r > 0 and c > 0]
        slope = -2.0
        if len(points) > 1:
            x, y = np.array(points).T
            slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        self.power = min(slope, -1.1) + 1
        self.k = k
        self.star = np.zeros(k + 1)
        for r in range(1, k + 1):
            turing = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
            self.star[r] = turing if 0 < turing < r else r * (1 + 1 / r) ** self.power

    def __call__(self, r: np.ndarray) -> np.ndarray:
        big = np.maximum(r, 1).astype(float)
        return np.where(r > self.k, big * (1 + 1 / big) ** self.power, self.star[np.minimum(r, self.k)])


@dataclass
class Model:
    """What the whole training part says."""

    total: int
    docs: int
    vocabulary: int
    one: Discount
    two: Discount
    #: Probability of the words of each count up to ``k`` is one.star / total; of all unknown words together:
    unknown: float


def _model(tables: DataFrame, head: Head, total: int, docs: int, params: Params) -> Model:
    fit = params.fit
    got = tables.filter("kind = 'stats'").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    stats = np.zeros(2 * fit + 1, np.int64)
    for r in got:
        stats[r["at"]] = r["n"]
    n1 = {r: int(stats[r] + (head.c1 == r).sum()) for r in range(1, fit + 1)}
    n2 = {r: int(stats[fit + r] + (head.c2 == r).sum()) for r in range(1, fit + 1)}
    one, two = Discount(n1, params.k), Discount(n2, params.k)
    # what the discounts of all words leave
    words = tables.filter("kind = 'words'").mapInArrow(_left(one), "left double").agg(F.sum("left")).first()[0] or 0.0
    left = words + float((head.c1 - one(head.c1))[head.c1 > 0].sum())
    return Model(total, docs, int(stats[0] + (head.c1 > 0).sum()), one, two, left / total if total else 1.0)


def _left(discount: Discount):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column("body"):
                c = unpack(body.as_py())[1].astype(np.int64)
                out.append(float((c - discount(c))[c > 0].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["left"])

    return run


def _sent(model: Model, body: bytes) -> list[np.ndarray]:
    """``ctx, c, left, p`` of the contexts of a table block."""
    _, known, place, c2, c1 = unpack(body)
    c2, c1 = c2.astype(np.int64), c1.astype(np.int64)
    ctx = np.cumsum(known.astype(U64), dtype=U64)
    return [ctx, *[np.bincount(place, v, len(ctx)) for v in (c2, c2 - model.two(c2), model.one(c1) / model.total)]]


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of ``c, left, p`` for each context of several lists."""
    ctx, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [ctx, *[np.bincount(place, np.concatenate([p[k] for p in parts]), len(ctx)) for k in (1, 2, 3)]]


def _weights(contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with log c(h) and log alpha(h)."""
    ctx, c, left, p = contexts
    return ctx, np.log10(c), np.log10(left) - np.log10(c) - np.log10(1 - p)


def _terms(weights, ctx, batch, doc, seen, unseen) -> list[tuple]:
    """What the contexts of held-out tokens add, for each document; unknown contexts add nothing."""
    table, log_c, alpha = weights
    if not len(table) or not len(ctx):
        return []
    at = np.minimum(np.searchsorted(table, ctx), len(table) - 1)
    value = np.where(table[at] == ctx, unseen * alpha[at] - seen * log_c[at], 0.0)
    uid, row = np.unique((batch << DOC_BITS + 1) + doc, return_inverse=True)
    total = np.bincount(row, value, len(uid))
    cuts = np.flatnonzero(np.diff(uid >> DOC_BITS + 1)) + 1
    return [
        ("terms", None, int(u[0] >> DOC_BITS + 1), pack(u & ((1 << DOC_BITS + 1) - 1), v), None)
        for u, v in zip(np.split(uid, cuts), np.split(total, cuts))
    ]


def _hot_contexts(model: Model, hot: np.ndarray):
    """The share of each table block in the contexts ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                sent = _sent(model, body.as_py())
                some = Head._find(hot, sent[0]) >= 0
                ctx, c, left, p = (v[some] for v in sent)
                yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(c), pa.array(left), pa.array(p)], ["ctx", "c", "left", "p"])

    return run


def _to_contexts(shared, model: Model, parts: int, most: int = 1 << 18):
    """Tables and wants to the partitions of their contexts; frequent contexts are answered here."""

    def split(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = (ctx % U64(parts)).astype(np.int32)
        order = np.lexsort((ctx, part))
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        return order, ends[:-1], ends[1:]

    def sent(columns: list[np.ndarray], weights) -> list[tuple]:
        cold = Head._find(weights[0], columns[0]) < 0
        columns = [v[cold] for v in columns]
        order, first, last = split(columns[0])
        ctx, c, left, p = (v[order] for v in columns)
        return [
            ("ctx", k, None, pack(_steps(ctx[a:b]), c[a:b].astype(np.int64), left[a:b], p[a:b]), None)
            for k, (a, b) in enumerate(zip(first, last)) if a < b
        ]

    def asked(held: list[list[np.ndarray]], weights) -> list[tuple]:
        ctx, batch, doc, seen, unseen = (np.concatenate(c) for c in zip(*held))
        cold = Head._find(weights[0], ctx) < 0
        out = _terms(weights, *[v[~cold] for v in (ctx, batch, doc, seen, unseen)])
        ctx, batch, doc, seen, unseen = (v[cold] for v in (ctx, batch, doc, seen, unseen))
        order, first, last = split(ctx)
        for k, (a, b) in enumerate(zip(first, last)):
            if a < b:
                rows = order[a:b]
                ids, place = np.unique(batch[rows], return_inverse=True)
                out.append(("want", k, None, pack(_steps(ctx[rows]), ids, place, doc[rows], seen[rows], unseen[rows]), None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, n = shared.value, [], 0
        for batch in batches:
            for kind, b, body in zip(batch.column("kind").to_pylist(), batch.column("batch").to_pylist(), batch.column("body")):
                if kind == "table":
                    made = sent(_sent(model, body.as_py()), weights)
                elif kind == "own":
                    own = unpack(body.as_py())
                    made = sent([np.cumsum(own[0].astype(U64), dtype=U64), *own[1:]], weights)
                else:
                    ctx, doc, seen, unseen = unpack(body.as_py())
                    held.append([np.cumsum(ctx.astype(U64), dtype=U64), np.full(len(doc), b), doc.astype(np.int64), seen.astype(np.int32), unseen.astype(np.int32)])
                    n += len(doc)
                    if n < most:
                        continue
                    made, held, n = asked(held, weights), [], 0
                if made:
                    yield _rows(made)
        if held:
            made = asked(held, weights)
            if made:
                yield _rows(made)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's contexts, summed, answer its wants; answers that were given before pass through."""
    part, sent, held = None, [], []

    def answer() -> Iterator[pa.RecordBatch]:
        if sent and held:
            made = _terms(_weights(_added(sent)), *[np.concatenate(c) for c in zip(*held)])
            if made:
                yield _rows(made)

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == "terms":
                yield _rows([tuple(r.values())])
                continue
            if r["part"] != part:
                yield from answer()
                part, sent, held = r["part"], [], []
            got = unpack(r["body"])
            ctx = np.cumsum(got[0].astype(U64), dtype=U64)
            if r["kind"] == "ctx":
                sent.append([ctx, *got[1:]])
            else:
                held.append([ctx, got[1].astype(np.int64)[got[2]], got[3].astype(np.int64), got[4].astype(np.int32), got[5].astype(np.int32)])
    yield from answer()


def _finished(model: Model, params: Params):
    """Everything about a block's documents, to one row each."""
    sums = Sums(params.k)
    weight = np.zeros(len(sums.names))
    log = lambda x: math.log10(x) if x > 0 else 0.0
    weight[sums.at["fixed"]], weight[sums.at["step"]] = 1.0, model.two.power
    for r in range(1, params.k + 1):
        weight[sums.at[f"seen{r}"]] = log(model.two.star[r])

    def seen(body: list[np.ndarray], train: np.ndarray, out: np.ndarray) -> None:
        step, n, c2, c1, flags = body
        doc = np.cumsum(step.astype(U64), dtype=U64).astype(np.int64)
        n, c2, c1, own = n.astype(float), c2.astype(np.int64), c1.astype(np.int64), (flags & 1).astype(bool)
        word = np.where(c1 > 0, np.log10(np.maximum(model.one(np.maximum(c1, 1)), 1e-300)) - log(model.total), log(model.unknown))
        value = np.where(c2 > 0, np.log10(model.two(np.maximum(c2, 1))), word)
        inner = own & train[doc] & (flags < 2)
        value[inner] -= np.log10(c1[inner])
        add = lambda name, v: sums.add(out[:, :-1], name, doc, v)
        add("known", n * (own & (c1 > 0)))
        add("base", n * own * np.log10(c1 + 1.0))
        add("fixed", n * value)

    norm = math.log10(model.total + model.vocabulary + 1)
    start = log(model.docs)

    def flush(head: list[np.ndarray], out: np.ndarray) -> pa.RecordBatch:
        ids, none, train, sizes = head
        base = out[:, sums.at["base"]] - sizes * norm
        score = out[:, :-1] @ weight - np.where(train.astype(bool), start, 0.0) + out[:, -1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids.astype(np.int64), mask=none.astype(bool)), pa.array(~train.astype(bool)),
                pa.array(sizes.astype(np.int64)), pa.array(np.rint(out[:, sums.at["known"]]).astype(np.int64)), pa.array(base), pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, out = None, None, None
        for batch in batches:
            for kind, b, body in zip(batch.column("kind").to_pylist(), batch.column("batch").to_pylist(), batch.column("body")):
                got = unpack(body.as_py())
                if kind == "docs":  # first of its batch
                    if now is not None:
                        yield flush(head, out)
                    now, head, out = b, got[:4], np.zeros((len(got[0]), len(got) - 3))
                    out[:, :-1] = np.array(got[4:], float).T
                elif kind == "terms":
                    out[got[0], -1] += got[1]
                else:
                    seen(got, head[2].astype(bool), out)
        if now is not None:
            yield flush(head, out)

    return run


FINISHED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, out: Column, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """Score of every text by the model of those where ``out`` is false.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; logarithms are decimal.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    flag = fresh(docs, "held_out")
    rows = docs.withColumn(flag, out).select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.col(flag).alias("held_out")
    )
    trained = rows.filter("not held_out")
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count_if(~F.col("held_out")).alias("trained")).first()
    parts = max(4, -(-(size["chars"] or 0) // params.part_chars))
    with setting(spark, BATCH_BYTES, str(params.batch_bytes)):
        head = _head(trained, size["trained"], parts, params)
        total = trained_docs = 0
        exact = trained.select("text").mapInArrow(_count_head(sc.broadcast(head)), "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
        for r in exact.collect():  # at most one for each word and pair of the head
            if r["kind"] < 2:
                (head.c1, head.c2)[r["kind"]][r["at"]] = r["n"]
            elif r["at"]:
                trained_docs = r["n"]
            else:
                total = r["n"]
        shared = sc.broadcast(head)
        blocks = rows.mapInArrow(_blocks(shared, parts, params), ROWS)
        # by its own number, as hashes of the numbers would bring several partitions to one task
        dealt = blocks.repartitionById(parts, "part").sortWithinPartitions("part", "batch")
        tables = saved(dealt.mapInArrow(_counted(shared, params), ROWS), "tables")
    model = _model(tables, head, total, trained_docs, params)

    # contexts: what was seen after each
    p = model.one(head.c1[head.word(head.pw)]) / max(1, model.total) if len(head.pw) else np.zeros(0)
    own = _added([[head.pc, head.c2, head.c2 - model.two(head.c2), p]])
    hot = np.unique(np.append(head.w, U64(START)))
    table = tables.filter("kind = 'table'").select("body").mapInArrow(_hot_contexts(model, hot), "ctx long, c double, left double, p double")
    summed = table.groupBy("ctx").agg(F.sum("c").alias("c"), F.sum("left").alias("left"), F.sum("p").alias("p")).collect()  # no more than hot
    mine = Head._find(hot, own[0]) >= 0
    frequent = [np.array([r["ctx"] for r in summed], np.int64).view(U64), *[np.array([r[k] for r in summed], float) for k in ("c", "left", "p")]]
    frequent = _added([frequent, [v[mine] for v in own]])
    body = spark.createDataFrame([("own", bytearray(pack(_steps(own[0]), *own[1:])))], "kind string, body binary")
    body = body.select("kind", F.lit(None).cast("long").alias("batch"), "body")
    asked = tables.filter("kind in ('table', 'want')").select("kind", "batch", "body").unionByName(body).mapInArrow(
        _to_contexts(sc.broadcast(_weights(frequent)), model, parts), ROWS
    )
    spread = F.coalesce("part", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int"))
    terms = asked.withColumn("_to", spread).repartitionById(parts, "_to").drop("_to").sortWithinPartitions("part", "kind").mapInArrow(_answered, ROWS)
    rows = tables.filter("kind in ('docs', 'seen')").unionByName(terms).select("kind", "batch", "body")
    return rows.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_finished(model, params), FINISHED).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def held_out_scores(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Scores of ``documents`` by the model of those whose id's hash isn't held out."""
    return scores(docs, held_out(F.col("doc_id"), 7, 2), params=params)
