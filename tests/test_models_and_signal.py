"""Encoders, splits, cleaning and retrieval against NumPy and the documented examples."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.functions import arrays, text
from epochloom.operators import cleaning, embedders, encoders, retrieval, splits
from epochloom.plans import train
from epochloom.plans.preprocess import CleaningConfig, preprocess_epochs


def features(spark, n=60, d=6, dim=4, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, d)), rng.normal(size=(n, dim))
    rows = [(i, f"g{i % groups}", x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "epoch_id long, grp string, x array<double>, y array<double>"), x, y


def unit(m):
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def test_ridge_equals_normal_equations(spark):
    df, x, y = features(spark)
    model = encoders.RidgeEncoder(6, 4, 0.5).fit(df)
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y)
    assert np.allclose(model.weights, want)
    got = {r.epoch_id: r.emb for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], unit(x @ want))


@pytest.mark.parametrize("groups", [3, 30])
def test_held_out_equals_refitting_each_fold(spark, groups):
    """Three folds are larger than the feature width, thirty are smaller: both paths."""
    df, x, y = features(spark, groups=groups)
    got = {r.epoch_id: r.emb for r in encoders.held_out_embeddings(df, "grp", 6, 4, 0.5).collect()}
    for g in range(groups):
        test = np.arange(len(x)) % groups == g
        w = np.linalg.solve(x[~test].T @ x[~test] + 0.5 * np.eye(6), x[~test].T @ y[~test])
        assert np.allclose([got[i] for i in np.flatnonzero(test)], unit(x[test] @ w))


def test_mlp_step_equals_numpy(spark):
    df, x, y = features(spark)
    enc = encoders.MlpEncoder(6, 4, hidden=5, ridge=1e-3, epochs=3, lr=0.1)
    model = enc.fit(df)
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    m = enc._start(spark, mean, sd)
    w1, b1, w2, b2 = m.w1, m.b1, m.w2, m.b2
    z0 = (x - mean) / sd
    for _ in range(3):
        z = z0 @ w1 + b1
        h = np.maximum(z, 0)
        g = 2 / len(x) * (h @ w2 + b2 - y)
        gz = (g @ w2.T) * (z > 0)
        w1, b1, w2, b2 = (
            w1 - 0.1 * (z0.T @ gz + 2e-3 * w1), b1 - 0.1 * gz.sum(0), w2 - 0.1 * (h.T @ g + 2e-3 * w2), b2 - 0.1 * g.sum(0)
        )
    assert np.allclose(model.w1, w1) and np.allclose(model.b2, b2)
    again = encoders.MlpModel.from_rows(model.to_rows(spark, "m"))
    assert np.allclose(again.w2, model.w2)


def test_operating_k_cases(spark):
    df = spark.createDataFrame([(3,), (1,), (20,), (0,)], "n int")
    assert [r[0] for r in df.select(retrieval.operating_k(F.col("n"))).collect()] == [2, 1, 5, 1]


def test_vocabulary_blocks_do_not_change_the_top(spark):
    rng = np.random.default_rng(4)
    vocab = spark.createDataFrame([(i, f"w{i}", rng.normal(size=8).round(1).tolist()) for i in range(57)], "pos long, surface string, vec array<double>")
    ep = spark.createDataFrame([(i, rng.normal(size=8).round(1).tolist()) for i in range(30)], "epoch_id long, emb array<double>")
    rows = lambda b: sorted((r.epoch_id, r.rank, r.surface) for r in retrieval.top_anchors(ep, vocab, 5, block=b).collect())
    assert rows(1000) == rows(10)
    labelled = ep.withColumn("label", F.concat(F.lit("W"), (F.col("epoch_id") % 60).cast("string")))
    ranks = lambda b: sorted((r.epoch_id, r.gold_rank or 0) for r in retrieval.gold_ranks(labelled, vocab, block=b).collect())
    assert ranks(1000) == ranks(10)


def test_block_product_keeps_repeated_ids_and_ties(spark):
    """Equal vectors all over the vocabulary and one id on every row, against a plain sort."""
    rng = np.random.default_rng(5)
    words = rng.integers(-1, 2, (300, 4)).astype(float)
    vocab = spark.createDataFrame([(i, f"w{i}", words[i].tolist()) for i in range(300)], "pos long, surface string, vec array<double>").repartition(7)
    vectors = rng.integers(-1, 2, (40, 4)).astype(float)
    ep = spark.createDataFrame([(1, i, vectors[i].tolist()) for i in range(40)], "epoch_id long, row_no long, emb array<double>").repartition(3)
    want = sorted(tuple(sorted(range(300), key=lambda c: (-(words[c] @ v), c))[:7]) for v in vectors)
    for block in (1000, 50, 11):
        got = {}
        top = retrieval.top_anchors(ep.withColumn("epoch_id", F.col("row_no")), vocab, 7, block=block)
        for r in top.orderBy("rank").collect():
            got.setdefault(r.epoch_id, []).append(r.pos)
        assert sorted(map(tuple, got.values())) == want
        assert retrieval.top_anchors(ep, vocab, 7, block=block).count() == 40 * 7
    labelled = ep.withColumn("label", F.concat(F.lit("W"), F.col("row_no").cast("string")))
    place = [int(((words @ v > words[i] @ v) | ((words @ v == words[i] @ v) & (np.arange(300) < i))).sum()) + 1 for i, v in enumerate(vectors)]
    for block in (1000, 50):
        got = retrieval.gold_ranks(labelled, vocab, block=block)
        assert got.columns == ["epoch_id", "row_no", "label", "gold_rank"]
        assert [r.gold_rank for r in got.orderBy("row_no").collect()] == place


def test_block_product_plan_does_not_grow(spark):
    """Ten times the blocks run in as many stages, and no vocabulary row comes to the driver."""
    vocab = spark.range(4_000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("surface"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vec"))
    ep = spark.range(50).select(F.col("id").alias("epoch_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("emb"))

    def exchanges(block):
        top = retrieval.top_anchors(ep, vocab, 3, block=block)
        assert {r.pos for r in top.collect()} == {3999, 3998, 3997}
        return top._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges(1_000) == exchanges(100)


def test_equal_scores_follow_vocabulary_order(spark):
    vocab = spark.createDataFrame([(2, "b", [1.0]), (1, "a", [1.0]), (3, "c", [2.0])], "pos long, surface string, vec array<double>")
    ep = spark.createDataFrame([(0, [1.0])], "epoch_id long, emb array<double>")
    assert [r.surface for r in retrieval.top_anchors(ep, vocab, 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_splits_need_groups(spark):
    df = spark.createDataFrame([(i, "s0", "one") for i in range(4)], "epoch_id int, subject_id string, session_id string")
    with pytest.raises(splits.SplitError):
        splits.require_folds(splits.group_folds(df, "loso"), "loso")
    with pytest.raises(splits.SplitError):
        splits.random_split(df, "epoch_id")


def test_block_split_two_and_two(spark):
    rows = [(0, "s", 1, 0.0, 2.0), (1, "s", 1, 5.0, 7.0), (2, "s", 10, 20.0, 22.0), (3, "s", 10, 30.0, 32.0)]
    df = spark.createDataFrame(rows, "epoch_id int, subject_id string, segment int, onset double, offset_s double")
    tr, te = splits.stimulus_block(df)
    assert (tr.count(), te.count()) == (2, 2)


def epoch_rows(spark, x):
    return spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "epoch_id int, eeg array<array<double>>")


def test_amplitude_mask_example(spark):
    x = np.random.default_rng(0).normal(size=(4, 8, 100)) * 5
    x[2, 0, 10], x[2, 0, 20] = 1000, -1000
    rows = preprocess_epochs(epoch_rows(spark, x), CleaningConfig()).orderBy("epoch_id").collect()
    assert [r.mask_keep for r in rows] == [True, True, False, True]


def test_cleaning_equals_numpy_and_the_column_forms(spark):
    x = np.random.default_rng(1).normal(size=(5, 4, 50))
    cfg = CleaningConfig(200.0, 2.0, 40.0)
    got = np.array([r.eeg for r in preprocess_epochs(epoch_rows(spark, x), cfg).orderBy("epoch_id").collect()])
    want = cleaning.brick_wall(x, 2.0, 40.0, 200.0)
    want = want - want.mean(1, keepdims=True)
    want = want - want.mean(2, keepdims=True)
    want = want - want[:, :, :10].mean(2, keepdims=True)
    assert np.allclose(got, want)
    steps = arrays.baseline(arrays.demean(arrays.average_reference("eeg")))
    plain = preprocess_epochs(epoch_rows(spark, x), CleaningConfig(apply_bandpass=False))
    a = np.array([r.eeg for r in plain.orderBy("epoch_id").collect()])
    b = np.array([r.e for r in epoch_rows(spark, x).orderBy("epoch_id").select(steps.alias("e")).collect()])
    assert np.allclose(a, b)


def test_component_removal_equals_svd(spark):
    x = np.random.default_rng(2).normal(size=(6, 4, 80))
    x[:, 1] += np.random.default_rng(3).laplace(size=(6, 80)) * 9
    got = np.array([r.eeg for r in cleaning.remove_components(epoch_rows(spark, x)).orderBy("epoch_id").collect()])
    flat = x.transpose(0, 2, 1).reshape(-1, 4)
    u, s, vt = np.linalg.svd(flat, full_matrices=False)
    comp = (u * s).T
    c = comp - comp.mean(1, keepdims=True)
    k = np.abs((c ** 4).mean(1) / ((c ** 2).mean(1) + 1e-8) ** 2 - 3)
    s[np.argmax(k)] = 0
    assert np.allclose(got, ((u * s) @ vt).reshape(6, 80, 4).transpose(0, 2, 1))


def test_block_mean_edges(spark):
    for times, bins in ((7, 3), (3, 7), (201, 64), (64, 64)):
        v = np.random.default_rng(times).normal(size=times)
        df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
        got = df.select(arrays.block_mean("v", bins)).head()[0]
        edge = [i * times // bins for i in range(bins + 1)]
        assert np.allclose(got, [v[edge[i]:max(edge[i] + 1, edge[i + 1])].mean() for i in range(bins)])


def test_hash_embedding_formula(spark):
    import hashlib

    got = spark.createDataFrame([("  Living Room ",)], "s string").select(text.hash_embedding("s", 40)).head()[0]
    raw = np.frombuffer(hashlib.sha256(b"living room").digest(), dtype=np.uint8).astype(float)
    raw = (np.tile(raw, 2)[:40] - 128) / 64
    assert np.allclose(got, raw / (np.linalg.norm(raw) + 1e-8))


def test_char_grams_of_short_and_long_words(spark):
    got = spark.createDataFrame([("Hi  abc",)], "s string").select(text.char_grams("s")).head()[0]
    assert sorted(got) == sorted([" hi", "hi ", " hi ", " ab", "abc", "bc ", " abc", "abc ", " abc "])


def test_fold_local_terms_equal_refitting(spark):
    rows = [(i, f"f{i % 3}", f"w{i % 7} w{i % 4} common") for i in range(30)]
    df = spark.createDataFrame(rows, "i int, fold string, t string")
    got = {(r.fold, r.term): (r.idx, round(r.idf, 9)) for r in embedders.fold_terms(df, "i", "t", "fold", 5).collect()}
    want = {}
    for f in ("f0", "f1", "f2"):
        fitted = embedders.top_terms(embedders.document_frequency(df.where(F.col("fold") != f), "i", "t"), 5)
        want |= {(f, r.term): (r.idx, round(r.idf, 9)) for r in fitted.collect()}
    assert got == want


def test_fold_local_terms_broadcast_no_more_than_they_keep(spark):
    """Folds that hold nearly all terms, or share none: as refitting, and no side grows with a fold's terms."""
    rows = [(i, "big", f"only{i} w{i % 50} common") for i in range(900)] + [(1000 + i, f"f{i % 2}", f"w{i % 9} solo{i} common") for i in range(60)]
    df = spark.createDataFrame([*rows, (2000, "empty", ""), (2001, None, "w1 w2")], "i int, fold string, t string")
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    got = {(r.fold, r.term): (r.idx, r.tf_train, r.df_train, round(r.idf, 9)) for r in embedders.fold_terms(df, "i", "t", "fold", 70).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sent = []
    for i in range(seen, store.executionsList().size()):
        run = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                rows_out = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                sent += [int(v.get().replace(",", "")) for v in rows_out if v.isDefined()]
    assert sent and max(sent) <= 4 * 70
    want = {}
    for f in ("big", "f0", "f1", "empty"):
        kept = df.where(F.col("fold").isNull() | (F.col("fold") != f))
        fitted = embedders.top_terms(embedders.document_frequency(kept, "i", "t"), 70)
        want |= {(f, r.term): (r.idx, r.tf_total, r.df, round(r.idf, 9)) for r in fitted.collect()}
    assert got == want


def test_fold_local_terms_count_a_repeated_key_once(spark):
    """Rows of one key and fold are one document, as SQL groups them; of another fold they aren't."""
    rows = [(1, "a", "x y"), (1, "a", "x z"), (1, "b", "x"), (2, "b", "x y"), (3, "c", "q"), (None, "b", "y"), (None, "b", "y")]
    got = {(r.fold, r.term): (r.tf_train, r.df_train, r.n_train) for r in embedders.fold_terms(
        spark.createDataFrame(rows, "i int, fold string, t string"), "i", "t", "fold", 50).collect()}
    assert got[("c", "x")] == (4, 3, 6) and got[("c", "y")] == (4, 3, 6) and got[("a", "x")] == (2, 2, 5) and got[("b", "x")] == (2, 1, 3)


def test_structured_epochs_beat_the_controls(spark):
    rng = np.random.default_rng(5)
    base = {k: rng.normal(size=16) for k in range(5)}
    rows = [(i, (base[i % 5] + 0.1 * rng.normal(size=16)).tolist(), f"label {i % 5}", f"s{i % 4}", f"s{i % 4}:{i % 2}") for i in range(80)]
    df = spark.createDataFrame(rows, "epoch_id long, x array<double>, label string, subject_id string, session_id string")
    reports, model = train.train_report(df, train.TrainConfig(width=16, dim=32, ridge=0.1))
    for r in reports.collect():
        assert r.gate_pass and r.top1 > 0.9 and r.n_folds >= 4
    assert model.weights.shape == (16, 32)
    local = train.fold_local_report(df, train.TrainConfig(width=16, dim=16, ridge=0.1)).head()
    assert local.top1 > 0.9 and local.n_folds == 4


def test_components_of_many_channels(spark):
    import numpy as np

    from epochloom.operators import cleaning

    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=(128, 16)).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "epoch_id int, eeg array<array<double>>")
    basis = cleaning.component_basis(df)
    assert basis.shape == (128, 128) and np.allclose(basis.T @ basis, np.eye(128), atol=1e-6)


def test_wide_weights_load_whole(spark):
    import numpy as np

    from epochloom.operators.encoders import RidgeModel

    model = RidgeModel(np.arange(10_000.0).reshape(5_000, 2))
    rows = model.to_rows(spark, "m")
    assert (RidgeModel.from_rows(rows).weights == model.weights).all()
    with pytest.raises(ValueError):
        RidgeModel.from_rows(rows.where("row <> 17"))


def fold_rows(spark, n=60, width=6, dim=3):
    rng = np.random.default_rng(21)
    x, y = rng.normal(size=(n, width)) * 3 + 5, rng.normal(size=(n, dim))
    rows = [(i, f"s{i % 4}", x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "epoch_id long, subject_id string, x array<double>, y array<double>").repartition(3)


def test_folds_fitted_together_equal_single_fits(spark):
    """All folds in one pass a step, and in several slices of folds, against a fit for each fold."""
    df = fold_rows(spark)
    folds = df.select(F.col("subject_id").alias("fold")).distinct()
    mlp = encoders.MlpEncoder(6, 3, hidden=5, epochs=6, lr=0.05)
    want = {}
    for name in ("s0", "s1", "s2", "s3"):
        model = mlp.fit(df.where(F.col("subject_id") != name))
        want |= {r.epoch_id: r.emb for r in model.transform(df.where(F.col("subject_id") == name)).collect()}
    for size in (encoders.FOLD_BYTES, 1_000):
        got = {r.epoch_id: r.emb for r in encoders.refit_embeddings(df, folds, "subject_id", mlp, fold_bytes=size).collect()}
        assert got.keys() == want.keys()
        assert max(np.abs(np.array(got[i]) - want[i]).max() for i in got) < 1e-9


def test_wide_ridge_needs_no_square_matrix(spark):
    df = fold_rows(spark, 40, 30, 2)
    rows = df.orderBy("epoch_id").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    want = np.linalg.solve(x.T @ x + 0.7 * np.eye(30), x.T @ y)
    assert np.abs(encoders.conjugate_ridge(df, 30, 2, 0.7) - want).max() < 1e-8
    wide = spark.createDataFrame([(np.random.default_rng(i).normal(size=20_000).tolist(), [float(i)]) for i in range(5)], "x array<double>, y array<double>")
    model = encoders.RidgeEncoder(20_000, 1, 2.0).fit(wide)
    xs = np.array([np.random.default_rng(i).normal(size=20_000) for i in range(5)])
    dual = xs.T @ np.linalg.solve(xs @ xs.T + 2.0 * np.eye(5), np.arange(5.0)[:, None])
    assert np.abs(model.weights - dual).max() < 1e-10


def test_wide_sums_equal_the_plain_ones(spark, monkeypatch):
    df = fold_rows(spark)
    lines = lambda group: {(r.grp, r.row): r.vec for r in encoders.gram(df, 6, 3, group).collect()}
    plain = [lines(None), lines("subject_id")]
    monkeypatch.setattr(encoders, "MAX_FEATURES", 5)
    monkeypatch.setattr(encoders, "LINES", 4)
    for one, two in zip(plain, [lines(None), lines("subject_id")]):
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k]) for k in one)


def test_drawn_units_are_the_normalised_draws(spark):
    from epochloom.functions.hashed import gaussian_units, gaussian_vector

    keys = spark.createDataFrame([(None,), (1,), (2**40,), (-3,)], "k long")
    for dim in (1, 8, 13):
        got = keys.select("k", gaussian_units(F.col("k"), dim, "s:1").alias("a"), arrays.l2_normalise(gaussian_vector(F.col("k"), dim, "s:1")).alias("b")).collect()
        assert all(len(r["a"]) == dim and max(abs(x - y) for x, y in zip(r["a"], r["b"])) < 1e-12 for r in got)
    plan = retrieval.random_unit(keys, "k", 8, "s:1")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sha2" not in plan


def test_numbering_of_some_users_is_that_of_all(spark):
    from bindings import views as v

    sf = "/root/testdata/sf0.001"
    users = spark.createDataFrame([(1,), (7,), (8,)], "user_id long")
    some = v.indexed_events(spark, sf, users).select("recording_id", "event_id", "sample_idx").collect()
    every = v.indexed_events(spark, sf).where("recording_id IN (1, 7, 8)").select("recording_id", "event_id", "sample_idx").collect()
    assert sorted(some) == sorted(every) and some
