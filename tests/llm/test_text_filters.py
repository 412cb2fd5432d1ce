from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.llm import decontaminate, labelled, pii, quality, toxicity

# --- personal data ---------------------------------------------------------------


def plain(text):
    """The base patterns, read literally."""
    out = {
        "email": [m.span() for m in pii.EMAIL.finditer(text)],
        "ip": [m.span() for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [], "phone": [],
    }
    for m in pii.CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and doubled % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["ab.-_%+@@ 1", "01.25 -(+)", "4111 -.x"])
def test_plain_spans_are_those_of_the_patterns(alphabet):
    draw = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        assert pii.plain_spans(text) == plain(text)
        base, full = pii.all_spans(text)
        assert base == plain(text) and all(set(base[k]) <= set(full[k]) for k in pii.KINDS)


@pytest.mark.parametrize("text, kind, found", [
    ("write bob.smith [at] mail [dot] example (dot) com now", "email", "bob.smith [at] mail [dot] example (dot) com"),
    ("x bob at mail dot example dot com.", "email", "bob at mail dot example dot com"),
    ("to ｂｏｂ＠ｍａｉｌ．ｅｘａｍｐｌｅ．ｃｏｍ now", "email", "ｂｏｂ＠ｍａｉｌ．ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("to bоb@mаil.example.com now", "email", "bоb@mаil.example.com"),
    ("call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
    ("４２.１４４.３５.２５４ up", "ip", "４２.１４４.３５.２５４"), ("at 192 [dot] 168 [dot] 1 [dot] 20 now", "ip", "192 [dot] 168 [dot] 1 [dot] 20"),
    ("4111 1111​ 1111 1111", "card", "4111 1111​ 1111 1111"),
])
def test_disguised_spans_lie_in_the_source(text, kind, found):
    base, full = pii.all_spans(text)
    assert [text[s:e] for s, e in full[kind]] == [found] and not base[kind]
    assert found not in pii.redacted(text) and f"<{kind.upper()}>" in pii.redacted(text)


def test_prose_stays():
    for text in ("look at the dot here at noon", "one two three", "meet at dawn (at the gate)", "Ered*** reed###", ""):
        assert pii.redacted(text) == text and not any(pii.all_spans(text)[1].values())


def test_long_texts_take_linear_time():
    for part in ("1", " ", "at ", "a@", "one ", "[ ", "1.1.1.", "+1 ", ". ", " @ ", "x dot "):
        pii.all_spans(part * 20_000)


def test_find_and_redact(spark, docs_of):
    rows = [(1, "a@b.de and a@b.de"), (1, "a@b.de and a@b.de"), (None, None), (3, ""), (4, "+1 (988) 555-2485")]
    docs = docs_of(rows).withColumnRenamed("lang", "spans")
    got = pii.find(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_phone, r.spans) for r in got) == Counter(
        {(1, 2, 0, "email:0:6,email:11:17"): 2, (None, 0, 0, ""): 1, (3, 0, 0, ""): 1, (4, 0, 1, "phone:0:17"): 1}
    )
    kept = pii.redact(docs)
    assert kept.columns == docs.columns
    assert sorted(("-" if r.text is None else r.text) for r in kept.collect()) == ["", "-", "<EMAIL> and <EMAIL>", "<EMAIL> and <EMAIL>", "<PHONE>"]
    assert pii.find(docs_of([])).count() == 0


# --- benchmark ---------------------------------------------------------------------


def invented(draw, count):
    return [draw.choice(["the", "of", "and"]) if draw.random() < 0.4 else "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(count)]


@pytest.mark.parametrize("dense", [4_000_000, 10])
def test_retrieval_equals_brute_force(dense, monkeypatch):
    monkeypatch.setattr(decontaminate, "DENSE", dense)
    draw = random.Random(4)
    items = [(k, " ".join(invented(draw, draw.randint(5, 60))) + ".", None) for k in range(40)]
    params = decontaminate.Params(threshold=0.2)
    index = decontaminate.Index(items, params)
    texts = [" ".join(invented(draw, draw.randint(0, 300))) for _ in range(30)] + ["", "zzz"]
    texts += [" ".join(invented(draw, 50) + items[k][1].split() + invented(draw, 40)) for k in range(0, 40, 5)]
    got = sorted((a, b, c, round(s, 9)) for a, b, c, s in index.retrieve(texts))
    want = []
    for k, text in enumerate(texts):
        words = decontaminate.WORD.findall(text.lower())
        for place in range(max(1, -(-len(words) // 32))):
            terms = {index.vocabulary[w] for w in words[place * 32 : place * 32 + 64] if w in index.vocabulary}
            scores: Counter = Counter()
            for t, i, v in zip(index.term, index.item, index.impact):
                if t in terms:
                    scores[int(i)] += v
            want += [(k, place, i, round(v, 9)) for i, v in scores.items() if v >= 0.2]
    assert got == sorted(want) and want


@pytest.mark.parametrize("join", ["|", "-", "** **", '":"', "...", "» «", "!! "])
def test_punctuated_leaks_are_retrieved(join):
    draw = random.Random(14)
    items = [(k, " ".join(invented(draw, draw.randint(20, 60))), None) for k in range(40)]
    index = decontaminate.Index(items, decontaminate.Params())
    texts = [join.join(invented(draw, 70) + items[k][1].split() + invented(draw, 50)) for k in range(0, 40, 5)]
    want = []
    for k, text in enumerate(texts):
        words = re.findall(r"\w+", text.lower())
        for place in range(max(1, -(-len(words) // 32))):
            inside = set(words[place * 32 : place * 32 + 64])
            scores: Counter = Counter()
            for t, i, v in zip(index.term, index.item, index.impact):
                if index.terms[t] in inside:
                    scores[int(i)] += v
            want += [(k, place, i, round(v, 9)) for i, v in scores.items() if v >= 0.3]
    assert sorted((a, b, c, round(s, 9)) for a, b, c, s in index.retrieve(texts)) == sorted(want)
    assert all(5 * k in {row[0] for row in rows} for k, rows in enumerate(index.search(texts)))


def test_leaks_without_spaces_are_found():
    draw = random.Random(15)
    signs = lambda n: "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(n))
    items = [(k, signs(40) + "。" + signs(12), None) for k in range(10)]
    index = decontaminate.Index(items, decontaminate.Params())
    got = index.search([signs(90) + items[3][1].replace("。", "") + signs(90), signs(300), '{"問":"' + items[6][1] + '"}'])
    assert [[row[0] for row in rows] for rows in got] == [[3], [], [6]]


@pytest.mark.parametrize("length", [64, 65, 250, 600, 3_000])
def test_long_items_are_found(spark, docs_of, length):
    draw = random.Random(length)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(length - 20) + ". " + text(20) + "." for _ in range(4)]
    words = items[2].split()
    rows = [
        (1, text(77) + " " + items[1] + " " + text(150)), (2, text(400)), (3, " ".join(words[: int(0.7 * length)]) + " " + text(90)),
        (4, text(10) + " " + " ".join(words[: length // 3]) + " " + text(30)), (5, text(41) + " " + " ".join(words[-int(0.6 * length) :])),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for params in (decontaminate.Params(), decontaminate.Params(slice_items=5)):
        found = decontaminate.leaks(docs_of(rows), bench, params=params).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (3, 2), (5, 2)]
        assert [(r.part, r.item_overlap) for r in found if r.doc_id == 1] == [("both", 1.0)]


def test_leaks_and_clean(spark, docs_of):
    draw = random.Random(5)
    items = [" ".join(invented(draw, 30)) + ". " + " ".join(invented(draw, 12)) + "." for _ in range(12)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, ""), (91, None)], "item_id long, text string")
    leak = lambda k: " ".join(invented(draw, 90)) + "\n" + items[k].upper() + " " + " ".join(invented(draw, 200))
    question = items[5].split(".")[0] + ". " + " ".join(invented(draw, 12))
    rows = [(1, leak(3)), (2, leak(7) + leak(8)), (3, " ".join(invented(draw, 400))), (4, None), (5, ""), (6, question), (1, leak(3)), (None, leak(0))]
    rows.append((8, " ".join(invented(draw, 9_000)) + items[2]))
    docs = docs_of(rows).withColumnRenamed("lang", "leaks")
    for slice_items in (50_000, 5):
        params = decontaminate.Params(slice_items=slice_items)
        got = Counter((r.doc_id, r.item_id, r.part) for r in decontaminate.leaks(docs, bench, params=params).collect())
        assert got == Counter({(1, 3, "both"): 2, (2, 7, "both"): 1, (2, 8, "both"): 1, (6, 5, "question"): 1, (None, 0, "both"): 1, (8, 2, "both"): 1})
        kept = decontaminate.clean(docs, bench, params=params)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs_of([]), bench).count() == 0


# --- classifiers ---------------------------------------------------------------------


def test_held_out_follows_the_id_as_text(spark):
    ids = [*range(60), None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", labelled.held_out(F.col("i"), 4, 2).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 4 == 2) for r in got)


def test_trees_in_flat_arrays_equal_a_walk():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(900, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y, quality.Params(trees=30))
    binned = model.binned(x[:50])
    for row, score in zip(binned, model.scores(x[:50])):
        total = model.base
        for root in model.roots:
            at = root
            while model.statistic[at] >= 0:
                at = model.left[at] + (row[model.statistic[at]] > model.bin[at])
            total += model.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95
    assert (quality.fit(x, np.ones(900)).scores(x) > 0.9).all()
    assert (quality.fit(x[:0], y[:0]).scores(x) == 0.5).all()


def held_out_auc(scored, labels, column):
    rows = scored.filter("held_out").join(labels.select("doc_id", column), "doc_id").toPandas()
    one, zero = rows[rows[column] == 1].score.to_numpy(), rows[rows[column] == 0].score.to_numpy()
    return ((one[:, None] > zero[None, :]).mean() + (one[:, None] == zero[None, :]).mean() / 2), rows


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels))
    auc, _ = held_out_auc(scored, labels, "quality")
    assert auc > 0.95 and scored.count() == docs.count()


def toxic_corpus(draw):
    stems = ["lowei", "vequa"]
    rows, labels = [], []
    for k in range(600):
        words = invented(draw, draw.randint(10, 60))
        toxic = k % 6 == 0
        if toxic:
            bad = ["idiot", "scum", "moron"] if k % 12 else [s + draw.choice(["an", "ou", "ti"]) for s in stems]
            for w in draw.sample(bad, draw.randint(1, len(bad))):
                words.insert(draw.randrange(len(words)), w)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, docs_of):
    rows, labels = toxic_corpus(random.Random(9))
    docs, labels = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    auc, held = held_out_auc(toxicity.score(docs, model), labels, "toxic")
    assert auc > 0.99 and (held.predicted == held.toxic).mean() > 0.97
    odd = docs_of([(1, None), (1, ""), (None, "You are an idiot"), (2, "idiot " * 20_000)]).withColumnRenamed("lang", "toxicity")
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.score(odd, model).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 1)]
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and sorted("-" if r.text is None else r.text for r in kept.collect()) == ["", "-"]


def test_without_labels(spark, docs_of):
    docs, none = docs_of([(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, odd)).count() == 2
    assert toxicity.score(docs_of([]), toxicity.train(docs, odd)).count() == 0


def test_correlated_voters_count_less():
    votes = np.zeros((400, 3))
    gold = np.arange(400) % 4 == 0
    votes[gold & (np.arange(400) % 8 == 0)] = [1, 1, 0]  # two voters that always agree
    votes[gold & (np.arange(400) % 8 == 4), 2] = 1
    model = toxicity.fit_label_model(toxicity.with_silence(votes), gold.astype(int), toxicity.Params())
    assert model.kin[0, 1] > 0.5 and model.kin[0, 2] == 0
    assert ((model.posterior(toxicity.with_silence(votes)) > 0.5) == gold).all()


def test_zero_padded_parts():
    """Leading zeros count for nothing, however many there are."""
    for text in ("0" * 70 + "1.2.3.4", "x " + "0" * 300 + "255.0000.00.9", "1." + "0" * 90 + ".2.3"):
        begin = text.find("0") if text[0] != "1" else 0
        assert pii.plain_spans(text)["ip"] == [(begin, len(text))]
    assert pii.plain_spans("0" * 70 + "256.1.1.1")["ip"] == [] and pii.plain_spans("1" * 70 + ".1.1.1")["ip"] == []
