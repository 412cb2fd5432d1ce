"""Backoff scores against a plain model, normalisation, and odd cases."""
from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochloom.llm import katz, registered

END, START = object(), object()


def words(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "")] + [END]


class Plain:
    """The same model from counters alone."""

    def __init__(self, texts, k=5, fit=32):
        self.c1, self.c2, self.after = Counter(), Counter(), {}
        self.docs = len(texts)
        for t in texts:
            w = words(t)
            self.c1.update(w)
            self.c2.update(zip([START, *w], w))
        self.total, self.size = sum(self.c1.values()), len(self.c1)
        for (h, w), c in self.c2.items():
            self.after.setdefault(h, {})[w] = c
        self.star1, self.star2 = self.stars(self.c1, k, fit), self.stars(self.c2, k, fit)
        self.unknown = sum(c - self.star1(c) for c in self.c1.values()) / self.total if self.total else 1.0
        self.alpha = {}

    @staticmethod
    def stars(counts, k, fit):
        n = Counter(counts.values())
        points = [(math.log(r), math.log(n[r])) for r in range(1, fit + 1) if n[r]]
        slope = np.polyfit(*zip(*points), 1)[0] if len(points) > 1 else -2.0
        power = min(slope, -1.1) + 1

        def star(r):
            turing = (r + 1) * n[r + 1] / n[r] if r <= k and r + 1 <= fit and n[r] else 0
            return turing if 0 < turing < r else r * (1 + 1 / r) ** power

        return star

    def one(self, w):
        return self.star1(self.c1[w]) / self.total if w in self.c1 else self.unknown

    def two(self, h, w):
        if h not in self.after:
            return self.one(w)
        seen = self.after[h]
        c = sum(seen.values())
        if w in seen:
            return self.star2(seen[w]) / c
        if h not in self.alpha:
            left = sum(x - self.star2(x) for x in seen.values()) / c
            self.alpha[h] = left / (1 - sum(self.one(v) for v in seen))
        return self.alpha[h] * self.one(w)

    def row(self, text):
        w = words(text)
        base = sum(math.log10((self.c1[x] + 1) / (self.total + self.size + 1)) for x in w)
        score = sum(math.log10(self.two(h, x)) for h, x in zip([START, *w], w))
        return len(w), sum(x in self.c1 for x in w), self.total, base, score


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(spark, table, params):
    df = spark.createDataFrame(table, "doc_id long, text string, held_out string, w long")
    got = sorted((tuple(r) for r in katz.held_out_scores(df, params).collect()), key=repr)
    model = Plain([t for i, t, *_ in table if not out(i)])
    want = sorted(((i, out(i), *model.row(t)) for i, t, *_ in table), key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6]))):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-8) and a[6] == pytest.approx(b[6], abs=1e-8)
    return model


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"Ö{i}é" for i in range(120)]
    sep = [" ", "  ", "\n", "\t", "\x0b"]
    rows = []
    for i in range(n):
        size = int(draw.expovariate(1 / 25))
        rows.append((i, "".join(vocabulary[int(120 * draw.random() ** 3)] + draw.choice(sep) for _ in range(size)), "x", i))
    return rows


@pytest.mark.parametrize("params", [
    katz.Params(), katz.Params(head=3, sample_docs=20, block_tokens=300, part_chars=800), katz.Params(head=0, block_tokens=50, part_chars=300),
])
def test_equals_plain_model(spark, params):
    check(spark, texts(300, 1), params)


def test_odd_texts(spark):
    table = [
        (None, None, None, None), (None, "a b", "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "A b   c\x1c", "x", 1), (3, "spam " * 5_000, "x", 1),
        (4, "new words only", "x", 1), (4, "new words only", "x", 1), (9, "İ ß ퟿ ẞ", "x", 2),
    ] + [(i, "a b a b", "x", 1) for i in range(100, 140)]
    check(spark, table, katz.Params(head=4, part_chars=2_000))


def test_nothing_to_learn_from(spark):
    left = [i for i in range(200) if out(i)]
    got = katz.held_out_scores(spark.createDataFrame([(i, "a b", "x", 1) for i in left], "doc_id long, text string, lang string, n_chars long"))
    rows = got.collect()
    assert len(rows) == len(left) and {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert katz.held_out_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_sum_to_one():
    model = Plain([t for _, t, *_ in texts(200, 2)])
    for h in [START, *list(model.after)[:40], "never seen"]:
        unseen = model.alpha.get(h) if h in model.after else 1.0
        total = sum(model.two(h, w) for w in model.c1) + model.two(h, "unknown word")
        assert total == pytest.approx(1.0, abs=1e-9), (h, unseen)


def test_packing_round_trip():
    arrays = [np.array([1, 5, 2**63], np.uint64), np.arange(300), np.array([0.5, -1.0]), np.array([], np.int64)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))):
        assert a.tolist() == b.tolist()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    model = Plain([t for i, t in docs if not out(i)])
    got = {r["doc_id"]: r for r in registered.op11(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        n, known, total, base, score = model.row(t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_better_than_base_on_held_out(spark):
    r = registered.op11(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_a_partition_is_counted_in_bounded_memory():
    """Bytes a triple at the peak; the arrays of the triples are not held in two orders at once."""
    rng = np.random.default_rng(5)
    blocks = []
    for batch in range(4):
        w, ctx = (rng.zipf(1.3, 150_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        doc = np.sort(rng.integers(0, 2_000, len(w)))
        order = np.lexsort((doc, ctx, w))
        blocks.append((batch, katz._pairs(w[order], ctx[order], doc[order] * 2 + doc[order] % 2, np.ones(len(w), np.int64))))
    batch = katz._rows([("pairs", 0, b, body, None) for b, body in blocks])
    none = np.zeros(0, np.uint64)

    class Shared:
        value = katz.Head(none, (none, none))

    run = katz._counted(Shared, katz.Params())
    tracemalloc.start()
    try:
        made = sum(out.num_rows for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made >= 6
    assert peak < 85 * 600_000, peak / 600_000


def test_words_are_hashed_together(monkeypatch):
    """A batch's words are hashed at once; only very long ones have a call each."""
    made = [f"word{i} {'x' * 70}{i} Ä{i}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(made)], ["text"])
    none, calls = np.zeros(0, np.uint64), []
    digest = katz.xxhash.xxh64_intdigest
    monkeypatch.setattr(katz.xxhash, "xxh64_intdigest", lambda word: calls.append(word) or digest(word))

    class Shared:
        value = katz.Head(none, (none, none))

    got = {(r["kind"], r["at"]): r["n"] for out in katz._count_head(Shared)(iter([batch])) for r in out.to_pylist()}
    assert got == {(2, 0): 200 * 4, (2, 1): 200}
    assert len(calls) == 200


def test_tokens_are_those_of_split():
    draw = random.Random(9)
    signs = ["a", "B", "\x00", "é", "Ä", " ", "\x1c", "\x85", " ", "\t", "\n", "\x0b", "\x0c", "\r", "x" * 63, "y" * 64, "z" * 65, "q" * 8]
    made = ["".join(draw.choice(signs) for _ in range(draw.randrange(12))) for _ in range(3_000)] + ["", " ", "a", "a\x00", "a\x00\x00", "\x00"]
    ids = {}
    for column in (pa.array(made), pa.array(["before", *made, "after"]).slice(1, len(made)), pa.array(made, pa.large_string())):
        got, sizes = katz.tokens(column)
        want = [w for t in made for w in [*t.encode().lower().split(), None]]
        assert sizes.tolist() == [len(t.encode().split()) + 1 for t in made] and len(got) == len(want)
        for word, code in zip(want, got.tolist()):
            assert ids.setdefault(word, code) == code
    assert len(set(ids.values())) == len(ids) and ids[None] == katz.END


def test_triples_in_order_on_both_ways():
    rng = np.random.default_rng(1)
    rank, ctx, doc = rng.integers(0, 9, 500), rng.integers(0, 7, 500), rng.integers(0, 5, 500)
    want = sorted(Counter(zip(rank.tolist(), ctx.tolist(), doc.tolist())).items())
    for wide in (0, 1 << 40):  # the second doesn't fit one number
        got = list(zip(*(a.tolist() for a in katz._ordered(rank + wide, ctx + wide, doc))))
        assert got == [(r + wide, c + wide, d, n) for (r, c, d), n in want]


NONE = np.zeros(0, np.uint64)


class Nothing:
    """A broadcast of no frequent words and pairs."""

    value = katz.Head(NONE, (NONE, NONE))


def peak_of(run):
    tracemalloc.start()
    try:
        made = sum(out.num_rows for out in run())
        return made, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_is_made_and_counted_in_narrow_arrays(monkeypatch):
    """Bytes a token at the peak: 78 to count and 64 to make a block, when places and documents took eight bytes each."""
    rng = np.random.default_rng(5)
    made = [" ".join(f"w{x}" for x in rng.zipf(1.3, 500)) for _ in range(1_200)]
    columns = [pa.array(range(1_200), pa.int64()), pa.array(made), pa.array([i % 7 == 2 for i in range(1_200)])]
    rows = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "held_out"])

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(katz, "TaskContext", Task)
    n, peak = peak_of(lambda: katz._blocks(Nothing, 100, katz.Params())(iter([rows])))
    assert n > 100 and peak < 56 * 1_200 * 501, peak / (1_200 * 501)

    blocks = []
    for batch in range(4):
        w, ctx = (rng.zipf(1.3, 150_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        doc = np.sort(rng.integers(0, 2_000, len(w)))
        order = np.lexsort((doc, ctx, w))
        body = katz._pairs(w[order], ctx[order], doc[order] * 2 + doc[order] % 2, np.ones(len(w), np.int64))
        blocks.append(("pairs", 0, batch, body, None))
    got = katz._rows(blocks)
    n, peak = peak_of(lambda: katz._counted(Nothing, katz.Params())(iter([got])))
    assert n >= 6 and peak < 66 * 600_000, peak / 600_000


def test_tasks_get_one_partition_in_bounded_batches(spark, monkeypatch):
    """Partitions come to tasks by their number, texts and blocks in batches bounded by bytes."""
    saved, seen = katz.saved, []

    def watched(df, label):
        if label == "tables":
            seen.append(spark.conf.get(katz.BATCH_BYTES))
            tables = saved(df.withColumn("task", F.spark_partition_id()), label)
            at = tables.filter("kind = 'stats'").select("part", "task").collect()
            seen.append(sorted((r["part"], r["task"]) for r in at))
            return tables.drop("task")
        return saved(df, label)

    monkeypatch.setattr(katz, "saved", watched)
    before = spark.conf.get(katz.BATCH_BYTES)
    params = katz.Params(part_chars=2_000, batch_bytes=4_096)
    check(spark, texts(300, 3), params)
    assert seen[0] == "4096" and spark.conf.get(katz.BATCH_BYTES) == before
    assert len(seen[1]) > 10 and len({task for _, task in seen[1]}) == len(seen[1])
