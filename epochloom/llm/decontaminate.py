"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the test items, in blocks of ``block_items``; impacts are BM25 contributions over the
item's score for itself, so a threshold means the same for every item. Words are runs of word signs, and single
signs in scripts without spaces, for items and texts alike. An item of more than ``passage_words`` words has several
entries of that length, half overlapping, so it is retrieved by any part. Passages are all windows of ``passage_words`` words,
half overlapping. Retrieval returns every (passage, item) at or above the threshold
and skips as block-max WAND does: the terms of most items are left out as long as the sum of their maxima
cannot close the gap, the block maxima of the other terms tell which blocks could reach the threshold, and
postings are read for those blocks only. All passages of a batch take each step together.

A retrieved item is verified on the passage and what lies within a passage, or the item's length if that is more,
on both sides: the share of the item's word n-grams that
occur there, for the question and the answer apart. The item counts as leaked if ``overlap`` of all its n-grams
are found; ``part`` says whether question, answer or both reach ``overlap``. Where the test items have no answer
column, the answer is the last sentence, or the last quarter of a single sentence.

Defined cases: a null or empty text has no passages; a text of any length is searched whole; items without words
match nothing; null or equal ids keep their rows (one for each item found in a row); an empty benchmark or an
empty table finds nothing; further columns are kept by ``clean`` and ignored by ``leaks``. Benchmarks of more than
``slice_items`` entries are searched slice by slice, so the broadcast index stays bounded.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from epochloom.llm.common import fresh, text_of

#: Signs of scripts without spaces (Thai to Khmer, kana, ideographs), each of which is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")
SENTENCE = re.compile(r"[.!?]+(?:\s+|$)|\n+")

@dataclass(frozen=True)
class Params:
    passage_words: int = 64
    threshold: float = 0.3
    overlap: float = 0.5
    ngram: int = 5
    k1: float = 1.2
    b: float = 0.75
    block_items: int = 8
    slice_items: int = 50_000


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer of an item that comes as one text."""
    parts = [p for p in SENTENCE.split(text) if WORD.search(p)]
    if len(parts) > 1:
        return WORD.findall(" ".join(parts[:-1]).lower()), WORD.findall(parts[-1].lower())
    words = WORD.findall(text.lower())
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:]


def ngrams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def entries(words: int, size: int) -> list[tuple[int, int]]:
    """Cuts of an item of so many words into index entries of at most ``size`` words, half overlapping."""
    if words <= size:
        return [(0, words)]
    return [(k, k + size) for k in range(0, words - size, max(1, size // 2))] + [(words - size, words)]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start, start + 1, ...`` of the given lengths."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.diff(a, prepend=-1) > 0]


class Index:
    """Inverted index of one slice of items."""

    def __init__(self, items: list[tuple], params: Params):
        self.params = params
        self.ids = [i[0] for i in items]
        self.parts = [(WORD.findall(i[1].lower()), WORD.findall(i[2].lower())) if i[2] is not None else split_item(i[1]) for i in items]
        whole = [q + a for q, a in self.parts]
        cuts = [entries(len(w), params.passage_words) for w in whole]
        #: The item of each entry.
        self.owner = np.repeat(np.arange(len(whole)), [len(c) for c in cuts])
        words = [w[a:b] for w, c in zip(whole, cuts) for a, b in c]
        self.terms = sorted({w for ws in words for w in ws})
        vocabulary = {w: k for k, w in enumerate(self.terms)}
        n = max(1, len(words))
        self.blocks = -(-n // params.block_items)
        lengths = np.array([len(w) for w in words], float)
        mean = lengths.mean() if len(words) and lengths.sum() else 1.0
        frequency = np.zeros(len(vocabulary))
        counted = []
        for ws in words:
            terms, tf = np.unique(np.array([vocabulary[w] for w in ws], np.int64), return_counts=True)
            frequency[terms] += 1
            counted.append((terms, tf))
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        term, item, impact = [], [], []
        for k, (terms, tf) in enumerate(counted):
            if not len(terms):
                continue
            score = idf[terms] * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * lengths[k] / mean))
            term.append(terms)
            item.append(np.full(len(terms), k))
            impact.append(score / score.sum())
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        term, item, impact = join(term, np.int64), join(item, np.int64), join(impact, np.float64)
        order = np.lexsort((item, term))
        self.term, self.item, self.impact = term[order], item[order], impact[order]
        #: Postings in order of (term, block).
        self.cell = self.term * self.blocks + self.item // params.block_items
        self.cells, first = np.unique(self.cell, return_index=True)
        self.cell_start = np.append(first, len(self.cell))
        self.cell_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.term_cells = np.searchsorted(self.cells // self.blocks, np.arange(len(vocabulary) + 1))
        self.term_max = np.array([self.cell_max[a:b].max() for a, b in zip(self.term_cells[:-1], self.term_cells[1:])])
        #: Terms in so many items that their postings are read last.
        self.common = frequency > max(2.0, n / 16)
        rows = np.flatnonzero(self.common)
        self.late_row = np.zeros(len(vocabulary), np.int64)
        self.late_row[rows] = np.arange(len(rows))
        self.late_max = np.zeros((len(rows), self.blocks if len(rows) * self.blocks <= DENSE else 0), np.float32)
        if self.late_max.size:
            for k, t in enumerate(rows):
                cells = slice(self.term_cells[t], self.term_cells[t + 1])
                self.late_max[k, self.cells[cells] % self.blocks] = self.cell_max[cells]
        self.vocabulary = vocabulary
        self.grams = [(ngrams(q, params.ngram) if q else set(), ngrams(a, params.ngram) if a else set(), ngrams(q + a, params.ngram) if q or a else set()) for q, a in self.parts]

    def terms_of(self, text: str) -> np.ndarray:
        """The term of each word of ``text``, -1 for words that no item has."""
        return np.fromiter(map(self.vocabulary.get, WORD.findall(text.lower()), repeat(-1)), np.int64)

    def add_late(self, bound: np.ndarray, row: np.ndarray, late: np.ndarray) -> None:
        """Add the block maxima of common terms to the rows that hold them; ``row`` ascends."""
        step = max(1, DENSE // max(1, self.blocks))
        for at in range(0, len(row), step):
            part = row[at : at + step]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            bound[part[first]] += np.add.reduceat(self.late_max[late[at : at + step]], first)

    def retrieve(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """``(text, passage, entry, score)`` of every passage and entry at or above the threshold."""
        half, theta, vocab = self.params.passage_words // 2, self.params.threshold, len(self.term_max)
        terms, slots, starts, base = [], [], [], 0
        for text in texts:
            ids = self.terms_of(text)
            at = np.flatnonzero(ids >= 0)
            terms.append(ids[at])
            slots.append(base + at // half)
            starts.append(base)
            base += max(1, -(-len(ids) // half)) + 1  # an empty half parts a text from the next
        starts = np.array(starts)
        slot, term = np.concatenate(slots), np.concatenate(terms)
        # first the sum of all words' maxima over all blocks: many passages end here
        most = np.bincount(slot, self.term_max[term], base + 1) if vocab else np.zeros(base + 1)
        alive = np.flatnonzero(most[:-1] + most[1:] >= theta - 1e-12)
        if not len(alive):
            return []
        halves = np.union1d(alive, alive + 1)
        begin = np.searchsorted(slot, halves)
        counts = np.searchsorted(slot, halves, side="right") - begin
        left = _expand(begin, counts)
        # each term once a half
        pair = _distinct(np.repeat(np.arange(len(halves)), counts) * vocab + term[left])
        row, term = pair // vocab, pair % vocab
        slot = halves[row]
        one, two = np.searchsorted(halves, alive), np.searchsorted(halves, alive + 1)
        # bounds of each half from term maxima (common terms) and block maxima (the others); a passage, which
        # is a half and the next one, has at most the sum of both
        late = self.common[term]
        rest = np.bincount(row[late], self.term_max[term[late]], len(halves))
        rest = rest[one] + rest[two]
        p, t = row[~late], term[~late]
        counts = self.term_cells[t + 1] - self.term_cells[t]
        cell = _expand(self.term_cells[t], counts)
        where, value = np.repeat(p, counts) * self.blocks + self.cells[cell] % self.blocks, self.cell_max[cell]
        if len(halves) * self.blocks <= DENSE and self.late_max.shape[1] == self.blocks:
            bound = np.bincount(where, value, len(halves) * self.blocks).astype(float).reshape(len(halves), self.blocks)
            self.add_late(bound, row[late], self.late_row[term[late]])  # block maxima count for common terms too
            at, block = np.nonzero(bound[one] + bound[two] >= theta - 1e-6)
            keys = alive[at] * self.blocks + block
        else:
            half, block, n = where // self.blocks, where % self.blocks, len(halves)
            places = np.full((2, n), -1)
            places[0, one], places[1, two] = np.arange(len(alive)), np.arange(len(alive))
            meets = [(places[k, half], k) for k in (0, 1)]
            keys = np.concatenate([at[at >= 0] * self.blocks + block[at >= 0] for at, _ in meets])
            keys, inverse = np.unique(keys, return_inverse=True)
            bound = np.bincount(inverse, np.concatenate([value[at >= 0] for at, _ in meets]), len(keys))
            keys = keys[bound + rest[keys // self.blocks] >= theta - 1e-12]
            open_ = np.flatnonzero(rest >= theta - 1e-12)  # what common terms alone could lift keeps all blocks
            keys = np.union1d(keys, (open_[:, None] * self.blocks + np.arange(self.blocks)[None, :]).ravel())
            keys = alive[keys // self.blocks] * self.blocks + keys % self.blocks
        if not len(keys):
            return []
        # the terms of both halves, of the passages that are left
        open_ = np.unique(keys // self.blocks)
        begin = np.searchsorted(slot, open_)
        counts = np.searchsorted(slot, open_ + 1, side="right") - begin
        pair = _distinct(np.repeat(open_, counts) * vocab + term[_expand(begin, counts)])
        passage, term = pair // vocab, pair % vocab
        # exact scores from the postings of those blocks
        begin = np.searchsorted(passage, keys // self.blocks)
        counts = np.searchsorted(passage, keys // self.blocks, side="right") - begin
        which = np.repeat(np.arange(len(keys)), counts)
        wanted = term[_expand(begin, counts)] * self.blocks + keys[which] % self.blocks
        at = np.searchsorted(self.cells, wanted)
        ok = (at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == wanted)
        at, which = at[ok], which[ok]
        counts = self.cell_start[at + 1] - self.cell_start[at]
        posting = _expand(self.cell_start[at], counts)
        n = len(self.owner)
        hits, inverse = np.unique((keys[np.repeat(which, counts)] // self.blocks) * n + self.item[posting], return_inverse=True)
        score = np.bincount(inverse, self.impact[posting], len(hits))
        kept = np.flatnonzero(score >= theta - 1e-12)
        place, item = hits[kept] // n, hits[kept] % n
        owner = np.searchsorted(starts, place, side="right") - 1
        return list(zip(owner.tolist(), (place - starts[owner]).tolist(), item.tolist(), score[kept].tolist()))

    def search(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its leaked items: ``(item_id, part, score, question, answer, all, first word)``."""
        hits: list[dict[int, dict[int, float]]] = [{} for _ in texts]
        for k, place, entry, score in self.retrieve(texts):
            places = hits[k].setdefault(int(self.owner[entry]), {})
            places[place] = max(score, places.get(place, 0.0))
        found = []
        for text, items in zip(texts, hits):
            words = WORD.findall(text.lower()) if items else []
            rows = [self.verify(words, item, items[item]) for item in sorted(items)]
            found.append([row for row in rows if row is not None])
        return found

    def verify(self, words: list[str], item: int, places: dict[int, float]) -> tuple | None:
        """The best span of ``words`` that leaks ``item``, if any; a span is a passage and the item's length around it."""
        half, parts = self.params.passage_words // 2, self.grams[item]
        around = max(2 * half, sum(map(len, self.parts[item])))
        sizes = {len(next(iter(part))) for part in parts if part}
        last: dict[int, int] = dict.fromkeys(sizes, 0)
        seen: dict[int, list[tuple]] = {size: [] for size in sizes}  # n-grams of the item by place, those of open spans
        dropped = dict.fromkeys(sizes, 0)
        inside: dict[int, Counter] = {size: Counter() for size in sizes}
        count = [0, 0, 0]
        of_size = {size: [(k, part) for k, part in enumerate(parts) if part and len(next(iter(part))) == size] for size in sizes}
        best = None
        for place in sorted(places):
            begin, end = max(0, place * half - around), min(len(words), (place + 2) * half + around)
            for size in sizes:
                held, kept = inside[size], seen[size]
                for at in range(max(begin, last[size]), end - size + 1):
                    gram = tuple(words[at : at + size])
                    owners = [k for k, part in of_size[size] if gram in part]
                    if owners:
                        kept.append((at, gram, owners))
                        held[gram] += 1
                        if held[gram] == 1:
                            for k in owners:
                                count[k] += 1
                last[size] = max(last[size], end - size + 1)
                while dropped[size] < len(kept) and kept[dropped[size]][0] < begin:
                    _, gram, owners = kept[dropped[size]]
                    dropped[size] += 1
                    held[gram] -= 1
                    if not held[gram]:
                        for k in owners:
                            count[k] -= 1
            shares = [n / len(part) if part else 0.0 for n, part in zip(count, parts)]
            if shares[2] < self.params.overlap:
                continue
            part = "both" if min(shares[:2]) >= self.params.overlap else "question" if shares[0] >= shares[1] else "answer"
            row = (self.ids[item], part, places[place], *shares, begin)
            if best is None or (row[5], row[2]) > (best[5], best[2]):
                best = row
        return best


FOUND = "doc_id long, item_id long, part string, score double, question_overlap double, answer_overlap double, item_overlap double, first_word long"
BATCH = 256
#: Cells of the dense table of bounds; larger benchmarks use a sorted one.
DENSE = 4_000_000


def slices(bench: DataFrame, id_col: str, text_col: str, answer_col: str | None, params: Params) -> Iterator[Index]:
    """Indexes of about ``slice_items`` entries each at most, or of one item."""
    rows = bench.select(
        F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"),
        (text_of(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"),
    )
    words = sum((F.regexp_count(c, F.lit(f"(?U){WORD.pattern}")) for c in (F.col("text"), F.coalesce("answer", F.lit("")))), F.lit(0))
    count = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(words * 2 / params.passage_words) - 1))).first()[0] or 0
    cuts = max(1, -(-count // params.slice_items))
    for k in range(cuts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)) == k) if cuts > 1 else rows
        items = sorted((tuple(r) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Index(items, params)


def leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", answer_col: str | None = None, params: Params = Params(),
) -> DataFrame:
    """One row for each document row and test item that it leaks; clean documents have none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.int64()]
    out = None
    for index in slices(bench, item_col, item_text, answer_col, params):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    for doc_id, found in zip(part.column(0).to_pylist(), shared.value.search(part.column(1).to_pylist())):
                        made += [(doc_id, *row) for row in found]
                columns = list(zip(*made)) if made else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        found = rows.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    answer_col: str | None = None, params: Params = Params(),
) -> DataFrame:
    """The rows of ``docs`` that leak no test item, with all their columns."""
    flag = fresh(docs, "leaks")
    for index in slices(bench, item_col, item_text, answer_col, params):
        docs = docs.withColumn(flag, _leaked(docs.sparkSession.sparkContext.broadcast(index), text_of(text_col)))
        docs = docs.filter(~F.col(flag)).drop(flag)
    return docs


def _leaked(shared, text: Column) -> Column:
    def leaked(texts: pd.Series) -> pd.Series:
        found: list[bool] = []
        for at in range(0, len(texts), BATCH):
            found += [bool(rows) for rows in shared.value.search(texts.iloc[at : at + BATCH].tolist())]
        return pd.Series(found, dtype=bool)

    return F.pandas_udf(leaked, T.BooleanType())(text)
