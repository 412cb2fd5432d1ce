"""Hot-key helpers against brute force, with the bucketed path forced."""
from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import Window, functions as F

from epochloom.functions import scale
from epochloom.operators import audit, embedders, selection, splits


@pytest.fixture(autouse=True)
def force_buckets(monkeypatch):
    monkeypatch.setattr(scale, "SMALL_ROWS", 8)
    monkeypatch.setattr(scale, "SAMPLE_PER_BUCKET", 4)


def skewed(n: int, seed: int = 1) -> list[tuple[str, int, int]]:
    """A third of the rows under one key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.35 else f"k{rng.randrange(40)}", i, rng.randrange(50)) for i in range(n)]


def test_ranked_is_a_row_number(spark):
    rows = skewed(600)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): r.rn for r in scale.ranked(df, ["k"], ["v", "i"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for at, (_, i, _v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])), 1):
            want[key, i] = at
    assert got == want


def test_ranked_without_keys_is_global(spark):
    df = spark.createDataFrame(skewed(300), "k string, i int, v int")
    got = [r.i for r in scale.ranked(df, [], ["k", "i"]).orderBy("rn").collect()]
    assert got == [r[1] for r in sorted(skewed(300), key=lambda r: (r[0], r[1]))]


def test_exact_median_with_ties_and_even_counts(spark):
    rows = skewed(501) + [("one", 0, 7)] + [("flat", i, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.k: r.m for r in scale.exact_median(df, ["k"], "v", "m").collect()}
    want = {key: float(median(r[2] for r in rows if r[0] == key)) for key in {r[0] for r in rows}}
    assert got == want


def test_trailing_count(spark):
    rows = skewed(400)
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("us", F.col("v").cast("long"))
    got = {r.i: r.n for r in scale.trailing_count(df, ["k"], "us", 5, "n").collect()}
    want = {i: sum(k2 == k and v - 5 <= v2 <= v for k2, _, v2 in rows) for k, i, v in rows}
    assert got == want


def test_buffer_anti_join_on_one_hot_subject(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        on = rng.random() * 2000
        rows.append(("hot" if rng.random() < 0.4 else f"s{rng.randrange(20)}", i, rng.randrange(12), on, on + rng.random() * 9))
    df = spark.createDataFrame(rows, "subject_id string, epoch_id int, segment int, onset double, offset_s double")
    train, test = splits.stimulus_block(df, (10, 11))
    held = [r for r in rows if r[2] in (10, 11)]
    want = {r[1] for r in rows if r[2] not in (10, 11) and not any(
        h[0] == r[0] and r[3] - 1.0 < h[4] and r[4] + 1.0 > h[3] for h in held)}
    assert {r.epoch_id for r in train.collect()} == want
    assert {r.epoch_id for r in test.collect()} == {r[1] for r in held}


@pytest.mark.parametrize("n,budget", [(84, 60), (59, 60), (61, 60), (200, 7), (13, 5)])
def test_strided_budget_keeps_the_floating_point_step(spark, n, budget):
    df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
    got = sorted(r.i for r in selection.strided_budget(df, ["g"], ["i"], budget).collect())
    step = n / budget
    assert got == (list(range(n)) if n <= budget else [int(k * step) for k in range(budget)])


def timeline(n: int, keys: int, span_s: int, seed: int) -> list[tuple[str, int, datetime, bool]]:
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(keys)}", i, start + timedelta(seconds=rng.randrange(span_s)), rng.random() < 0.2) for i in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def test_sliding_limit_against_replay(spark):
    rows = timeline(900, 6, 3000, 5)
    df = spark.createDataFrame(rows, "u string, e int, t timestamp, ok boolean")
    got = {r.e: r.allowed for r in audit.sliding_limit(df, "u", "t", "e", 5, 60).collect()}
    logs: dict[str, deque] = {}
    want = {}
    for u, e, t, _ in rows:
        log = logs.setdefault(u, deque())
        while log and (t - log[0]).total_seconds() >= 60:
            log.popleft()
        want[e] = len(log) < 5
        if want[e]:
            log.append(t)
    assert got == want and not all(want.values())


def test_lockout_against_replay(spark):
    rows = timeline(900, 6, 9000, 6)
    df = spark.createDataFrame(rows, "u string, e int, t timestamp, ok boolean")
    got = {r.e: r.outcome for r in audit.lockout(df, "u", "t", "e", "ok").collect()}
    logs: dict[str, deque] = {}
    want = {}
    for u, e, t, ok in rows:
        log = logs.setdefault(u, deque())
        while log and (t - log[0]).total_seconds() >= 300:
            log.popleft()
        if len(log) >= 5:
            want[e] = "locked"
        elif ok:
            log.clear()
            want[e] = "verified"
        else:
            log.append(t)
            want[e] = "failed"
    assert got == want and "locked" in want.values()


def test_small_side_falls_back_to_a_shuffle_join(spark):
    df = spark.range(50)
    assert scale.fits(df, 50) and not scale.fits(df, 49)
    plan = spark.range(10).join(scale.small_side(df, 49), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


@pytest.mark.parametrize("rows", [9_000, 12_000])
def test_null_order_and_null_keys_on_both_sides_of_the_switch(spark, rows, monkeypatch):
    monkeypatch.setattr(scale, "SMALL_ROWS", 10_000)
    df = spark.range(rows).select(
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("x"), "id"
    )
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")).cast("long"))
    got = scale.ranked(df, ["g"], ["x", "id"], "n")
    assert got.exceptAll(want).isEmpty() and got.count() == rows
    medians = {r.g: r.m for r in scale.exact_median(df, ["g"], "x", "m").collect()}
    assert medians == {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()} and None in medians


def test_prefix_max_keeps_null_keys(spark):
    probe = spark.createDataFrame([(None, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, 5, "d")], "k int, t int, name string")
    base = spark.createDataFrame([(None, 1, 10), (1, 4, 20), (1, None, 99), (1, 6, 30)], "k int, u int, v int")
    got = {r.name: r.m for r in scale.prefix_max(probe, base, ["k"], "t", "u", "v", "m", inclusive=False).collect()}
    assert got == {"a": 10, "b": 20, "c": None, "d": None}


def test_numbers_are_padded_and_never_cut(spark):
    from epochloom.functions import paths

    rows = spark.createDataFrame([(1,), (10,), (1000,), (None,)], "n int")
    assert [r.s for r in rows.select(paths.numbered("sub-", "n", 2).alias("s")).collect()] == ["sub-01", "sub-10", "sub-1000", None]


def test_budget_keeps_groups_without_a_name(spark):
    from epochloom.operators.selection import strided_budget

    rows = spark.createDataFrame([(None, k) for k in range(3)] + [(1, k) for k in range(3)], "g int, k int")
    assert strided_budget(rows, ["g"], ["k"], 5).count() == 6


def test_trailing_counts_of_a_burst_equal_the_window(spark):
    """The ways with a window for each slot and with prefix counts, against a count by hand."""
    import random

    draw = random.Random(12)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.randint(0, 4_000), draw.randint(900, 960), 950]), i) for i in range(900)]
    rows += [("a", None, 901), ("a", None, 902), (None, None, 903)]
    df = spark.createDataFrame(rows, "k string, t long, i int").repartition(5)
    want = {
        i: sum(k2 == k and ((t2 is None) if t is None else t2 is not None and t - 100 <= t2 <= t) for k2, t2, _ in rows) for k, t, i in rows
    }
    for limit in (10**6, 10):
        got = scale.trailing_count(df, ["k"], "t", 100, "n", slot_rows=limit)
        assert got.columns == ["k", "t", "i", "n"]
        assert {r.i: r.n for r in got.collect()} == want


def test_terms_are_counted_before_their_shuffle(spark):
    docs = spark.createDataFrame([(i, "a b a") for i in range(300)] + [(300, ""), (301, "c")], "id int, t string").coalesce(2)
    rows = {r.term: (r.tf_total, r.df) for r in embedders.document_frequency(docs, "id", "t").collect()}
    assert rows == {"a": (600, 300), "b": (300, 300), "a b": (300, 300), "b a": (300, 300), "c": (1, 1)}
    plan = embedders.term_totals(docs, "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in embedders.document_frequency(docs, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan


def test_cut_points_bring_one_row_to_the_driver(spark, monkeypatch):
    frame = type(spark.range(1))
    real, sizes = frame.collect, []

    def counted(self):
        rows = real(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    cuts = scale.cut_points(spark.range(0, 30_000, numPartitions=6), ["id"], 4)
    assert len(cuts) == 3 and all(isinstance(c, tuple) for c in cuts) and max(sizes) == 1
