from __future__ import annotations

import random

import pytest

from epochloom.llm import order_minhash as om
from epochloom.llm.components import components


def shingled(text):
    words = (text or "").lower().split()
    return [tuple(words)] if 0 < len(words) <= 5 else list(zip(*(words[k:] for k in range(5))))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_classes(rows):
    cut, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            m = lcs(cut[a], cut[b])
            n = len(cut[a]) + len(cut[b]) - m
            if (m and m / n >= 0.8 - 1e-12) or (rows[a][1] or "") == (rows[b][1] or ""):
                root[find(a)] = find(b)
    out: dict = {}
    for k, (i, _) in enumerate(rows):
        out.setdefault(find(k), []).append(i)
    return sorted(sorted(v) for v in out.values())


def corpus(seed, families=8, copies=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(draw.randint(40, 160))]
        for c in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = [word()]
            if c == 0:
                words = passage + words
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "one two", "one  two", "One two", "three", rows[3][1], rows[3][1]])]
    return rows


def classes(frame):
    out: dict = {}
    for r in frame.collect():
        out.setdefault(r.class_id, []).append(r.doc_id)
        assert r.class_id <= r.doc_id
    return sorted(sorted(v) for v in out.values())


def test_alignment_is_exact_within_the_band():
    draw = random.Random(3)
    for _ in range(800):
        a = [draw.randint(0, draw.choice([3, 12, 60])) for _ in range(draw.randint(1, 40))]
        b = [x for x in a if draw.random() > 0.1] or [0]
        for _ in range(draw.randint(0, 5)):
            b.insert(draw.randint(0, len(b)), draw.randint(0, 60))
        m = lcs(a, b)
        assert om.matched(a, b, max(len(a) - m, len(b) - m)) == m
        assert om.matched(a, b, 2) <= m
        assert om.alike(a, b, 0.8) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-12)


def test_signatures_keep_the_order():
    words = [str(k) for k in range(200)]
    one = om.signatures(om.occurrences(om.shingle_hashes(" ".join(words), 5)), om.Params())
    two = om.signatures(om.occurrences(om.shingle_hashes(" ".join(words[100:] + words[:100]), 5)), om.Params())
    assert (one == two).sum() < 10  # nearly the same set of shingles, in another order
    same = om.signatures(om.occurrences(om.shingle_hashes("  ".join(words).upper(), 5)), om.Params())
    assert (one == same).all()


@pytest.mark.parametrize("most", [2_000, 4])
def test_classes_equal_brute_force(spark, docs_of, most):
    rows = corpus(5)
    got = om.near_duplicates(docs_of(rows).withColumnRenamed("lang", "cls"), params=om.Params(most=most))
    assert classes(got) == brute_classes(rows)


def test_short_texts_with_the_same_words_are_one_class(spark, docs_of):
    words = "one two three four five six".split()
    rows = [(k, " ".join(w.upper() if k >> at & 1 else w for at, w in enumerate(words))) for k in range(64)]
    rows += [(100 + k, (" " * k).join(["left ", "right"])) for k in range(64)] + [(300, "left"), (301, "right left")]
    docs = docs_of(rows)
    got = om.near_duplicates(docs, params=om.Params(most=8)).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(0, 64), (100, 64), (300, 1), (301, 1)} and len(got) == len(rows)
    assert sorted(r.doc_id for r in om.keep_one(docs, params=om.Params(most=8)).collect()) == [0, 100, 300, 301]


def test_a_bucket_over_most_keeps_pairs_of_one_signature(spark, docs_of):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = " ".join(word() for _ in range(8))
    rows = [(0, base)] + [(k, f"{base} {word()}") for k in range(1, 300)]  # each links to the first text only
    whole, dealt = (
        {(r.doc_id, r.class_id) for r in om.near_duplicates(docs_of(rows), params=om.Params(most=most)).collect()}
        for most in (2_000, 40)
    )
    assert dealt == whole and sum(c == 0 for _, c in whole) > 295


def test_one_document_of_each_class_stays(spark, docs_of):
    rows = corpus(6, families=4) + [(2, "same id, other text here now"), (0, corpus(6, families=4)[0][1])]
    kept = om.keep_one(docs_of(rows).withColumnRenamed("lang", "fp"))
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    texts = dict(enumerate(t for _, t in rows))
    number = [(k, t) for k, t in texts.items()]
    want = sorted(min((rows[k][0], texts[k] or "") for k in group) for group in brute_classes(number))
    assert [(i, t or "") for i, t in got] == want
    assert kept.columns == ["doc_id", "text", "fp", "source", "n_chars"]


def test_null_ids_and_no_rows(spark, docs_of):
    assert om.near_duplicates(docs_of([])).count() == 0
    assert om.keep_one(docs_of([])).count() == 0
    got = om.near_duplicates(docs_of([(None, "x y"), (None, "x y"), (4, "z")])).collect()
    assert sorted(r.class_size for r in got) == [1, 2, 2]
    assert om.keep_one(docs_of([(None, "x y"), (None, "x y"), (4, "z")])).count() == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
