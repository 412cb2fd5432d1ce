from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epochloom.llm import packing, projected_neighbours, registered, sharding, url_filter
from tests.harness import compare, duck

PAGES = "page_id long, url string, rule string"

# --- URLs -----------------------------------------------------------------------------


def test_urls_match_sql(spark, sf):
    assert compare(spark, duck(sf), sf, registered.QUERIES["op1_blocked_bloom_urls"], registered.OP1_SQL) is None


def test_rules_and_list(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q"), (2, "http://example.net/de/"), (3, "https://x.net"), (4, "http://b.example.com/de/1"), (5, "http://spam.io/p/?utm_source=a&b=1#f"),
        (6, "http://spam.io/p?b=1"), (7, "http://spam.io/p?b=2"), (8, None), (9, "no scheme"), (10, ""), (11, "http://notnet/"), (12, "http://x.org/fr/a"), (6, "http://spam.io/p?b=1"),
        (13, "a://b://example.net/en/"), (None, "http://spam.io/p?b=1"), (14, "http://ÀB.net/"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], PAGES)
    listed = spark.createDataFrame([("http://www.spam.io:80//p//?b=1&ref=z",), (None,), ("http://x.org/fr/a",)], "url string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect())
    assert got == Counter({
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"): 1, (2, "example.net", "/de/", "net/", "block"): 1, (3, "x.net", "", None, "allow"): 1,
        (4, "b.example.com", "/de/1", "example.com/de/", "block"): 1, (5, "spam.io", "/p/", None, "block"): 1, (6, "spam.io", "/p", None, "block"): 2,
        (7, "spam.io", "/p", None, "allow"): 1, (8, "", "", None, "allow"): 1, (9, "", "", None, "allow"): 1, (10, "", "", None, "allow"): 1,
        (11, "notnet", "/", None, "allow"): 1, (12, "x.org", "/fr/a", "org/fr/", "allow"): 1, (13, "b:", "//example.net/en/", None, "allow"): 1,
        (None, "spam.io", "/p", None, "block"): 1, (14, "Àb.net", "/", "net/", "block"): 1,
    })
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).filter("rule is null").collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_a_full_filter_stays_exact(spark):
    listed = spark.range(400).select(F.concat(F.lit("http://h.io/"), F.col("id").cast("string")).alias("url"))
    pages = spark.range(800).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.io/"), F.col("id").cast("string")).alias("url"))
    for blocks in (1, 1 << 16):
        got = url_filter.judge(pages, listed, params=url_filter.Params(max_blocks=blocks)).collect()
        assert all((r.verdict == "block") == (r.page_id < 400) for r in got) and len(got) == 800


# --- shards ---------------------------------------------------------------------------


def brute_difference(sizes, shards):
    parts = [sorted([s] + [0] * (shards - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        one, two = parts[0], parts[1]
        parts = parts[2:] + [sorted((a + b for a, b in zip(one, reversed(two))), reverse=True)]
    return parts[0] if parts else []


def test_differencing():
    draw = random.Random(1)
    for count in (0, 1, 5, 60):
        sizes = [draw.randint(1, 10_000) for _ in range(count)]
        shard = sharding.difference(sizes, 4)
        sums = [sum(s for s, k in zip(sizes, shard) if k == own) for own in range(4)]
        want = brute_difference(sizes, 4)
        if count:
            assert abs((max(sums) - min(sums)) - (want[0] - want[-1])) <= 3 and len(shard) == count


def test_shards_keep_groups_whole(spark, docs_of):
    draw = random.Random(2)
    hot = "hot text " * 30
    rows = [(k, "x" * draw.randint(0, 300) + str(k)) for k in range(400)] + [(1_000 + k, hot) for k in range(60)] + [(7, None), (8, ""), (7, None), (None, "ñ")]
    docs = docs_of(rows).withColumnRenamed("lang", "shard")
    got = sharding.assign(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 1_000}) == 1
    assert len({r.shard for r in got if r.size == 1}) == 1
    sums = sorted(sum(r.size for r in rs) for rs in by.values())
    assert len(sums) == 8 and sums[-2] - sums[0] <= 2  # the hot group alone is larger than an even shard
    assert sharding.assign(docs_of([])).count() == 0


def test_written_shards(spark, docs_of):
    from epochloom.session import new_folder

    rows = [(k, f"text {k % 20}") for k in range(100)] + [(5, None)]
    docs = docs_of(rows)
    path = new_folder(spark, "shards")
    sharding.write_shards(docs, path, files=2)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*docs.columns, "shard"} and back.count() == 101
    assert back.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()


# --- neighbours -------------------------------------------------------------------------


def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            scored = sorted(((-float((v * w).sum()), i) for i, w in usable if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    rows = [(k, draw.normal(size=8).astype(np.float32).tolist()) for k in range(1_500)]
    rows += [(2_000 + k, rows[40][1]) for k in range(60)]  # a vector with many copies
    rows += [(3_000, None), (3_020, [0.0] * 8), (3_040, [float("nan")] * 8), (3_060, [1.0, None] * 4), (3_080, [float("inf")] * 8), (None, [1.0] * 8), (3_100, [1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    params = projected_neighbours.Params(block_rows=500, projections=8, confidence=0.99)
    for r in projected_neighbours.nearest(table, params=params).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    for q in (40, 2_000, 2_020):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]  # ties go to the smaller id
    assert all(abs(s - dict(want[q])[i]) < 1e-9 for q in want for i, s in got[q] if i in dict(want[q]))


def test_few_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [1.0, 1.0])], schema)
    got = [(r.query_id, r["rank"], r.vec_id) for r in projected_neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 1), (20, 2, 0)]
    assert projected_neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    assert projected_neighbours.nearest(table.filter("vec_id = 1")).count() == 0


def test_blocks_and_chunks_give_the_same(spark):
    draw = np.random.default_rng(4)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sure = {"confidence": 1 - 1e-12, "projections": 4}
    got = {
        tuple(sorted((r.query_id, r["rank"], r.vec_id) for r in projected_neighbours.nearest(table, params=projected_neighbours.Params(**sure, **more)).collect()))
        for more in ({}, {"block_rows": 60, "leaf": 16}, {"block_rows": 40, "cells": 4, "chunk_queries": 7, "leaf": 8})
    }
    assert got == {tuple(sorted((q, k + 1, i) for q, near in brute_nearest(rows, 20).items() for k, (i, _) in enumerate(near)))}


def test_ties_of_different_vectors_and_repeated_ids(spark):
    """Equal scores go to the smaller id, whatever the vectors; rows of the query's own id take no place."""
    draw = np.random.default_rng(6)
    rows = [(0, [1.0] + [0.0] * 7)]
    rows += [(k, [0.5, *draw.permutation([2.0, 1.0, 0.0, 0.0, -1.0, -2.0, 3.0]).tolist()]) for k in range(1, 700)]
    near = [1.0, 0.25] + [0.0] * 6
    rows += [(0, near)] * 6 + [(1_001 + k, near) for k in range(15)] + [(1_001, near)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sure = projected_neighbours.Params(confidence=1 - 1e-12, block_rows=90, leaf=32)
    got = [(r.vec_id, r.score) for r in projected_neighbours.nearest(table, params=sure).filter("query_id = 0").orderBy("rank").collect()]
    copies = sorted([1_001 + k for k in range(15)] + [1_001] * 2)
    # the query asks with its smallest vector, [1, 0, ...]
    assert got == [(i, 1.0) for i in copies] + [(i, 0.5) for i in (1, 2, 3)]


def test_search_stops_early():
    """On 50,000 nearly isotropic rows at most three pairs in ten are verified, and 95 of 100 true neighbours found."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    params = projected_neighbours.Params()
    space = projected_neighbours.Space(64, 1.0, params)
    queries, z = x[:200], space.entries(x)
    tree = projected_neighbours.TopTree(z[::100], 7)
    cell, home = tree.place(z), tree.place(space.queries(queries))
    rows = [np.flatnonzero(cell == c) for c in range(tree.cells)]
    search = [projected_neighbours.Search(space, x[r], r, 21) for r in rows]
    bound, found = np.full(200, -np.inf), [[] for _ in range(200)]
    for at_home in (True, False):  # the own block first, then all others with its bound
        for c in range(tree.cells):
            mine = np.flatnonzero((home == c) == at_home)
            for q, entry, score in zip(*search[c].run(queries[mine], bound[mine])):
                found[mine[q]].append((-score, rows[c][entry]))
        if at_home:
            bound = np.array([-sorted(f)[20][0] for f in found])
    verified = sum(s.verified for s in search)
    hits = sum(len({i for _, i in sorted(f)[:21]} & set(np.argsort(-(x @ q), kind="stable")[:21].tolist())) for f, q in zip(found, queries))
    assert hits / (200 * 21) >= 0.95
    assert verified / (200 * len(x)) <= 0.3


# --- pipeline -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, docs_of, tmp_path_factory):
    """A small folder of tables: toxic documents, copies, leaks and personal data among clean ones."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, text(draw.randint(60, 200))) for k in range(200)]
    for k in range(0, 200, 5):
        rows[k] = (k, rows[k][1] + " you " + draw.choice(["idiot", "scum", "moron"]) + " " + draw.choice(["idiot", "trash"]))
    item = text(40) + ". " + text(10) + "."
    rows += [(300, rows[1][1]), (301, rows[2][1] + " extra words"), (302, text(80) + " " + item), (303, "mail a.b@c.de now " + text(30)), (304, None), (305, "")]
    folder = tmp_path_factory.mktemp("tables")
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows)


def test_pipeline_equals_brute_force(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = [i for i, t in texts.items() if i % 5 == 0 and i < 200]
    kept = {i: t for i, t in texts.items() if i not in toxic}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "benchmark decontamination", "personal data", "best-fit packing"]
    after = stages["toxicity"](spark, docs, folder)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == set(kept)
    for gone in (300, 301, 305):  # copies of 1 and 2, and the second empty text
        del kept[gone]
    after = stages["near duplicates"](spark, after, folder)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == set(kept)
    del kept[302]
    after = stages["benchmark decontamination"](spark, after, folder)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == set(kept)
    after = stages["personal data"](spark, after, folder)
    got = {r.doc_id: r.text for r in after.collect()}
    assert after.columns == docs.columns
    kept[303] = kept[303].replace("a.b@c.de", "<EMAIL>")
    assert got == kept
    packed = corpus_pipeline.run(spark, folder).collect()
    want = {(i, zlib.crc32(packing.encoder(packing.default_tokenizer()).encode(t or "") + packing.END_BYTES)) for i, t in kept.items()}
    assert {(r.doc_id, r.ids_crc32) for r in packed} == want
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) == -(-total // 4096)


def test_stages_take_no_rows(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in registered.QUERIES if n not in registered.ORACLE))
def test_queries_give_rows(spark, sf, name):
    assert not registered.QUERIES[name](spark, sf).isEmpty()
