"""Train-and-evaluate jobs: grouped folds, controls, gate and the final fit."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from epochloom.functions.hashed import order_hash
from epochloom.functions.scale import array_sum, attach_row, ranked, small_side
from epochloom.operators import embedders, encoders, retrieval, splits
from epochloom.operators.embedders import HashEmbedder
from epochloom.session import written

CONTROLS = ("shuffled_label_top5", "temporal_shuffle_top5", "gaussian_noise_top5", "no_eeg_lm_only_top5")


@dataclass(frozen=True)
class TrainConfig:
    width: int
    dim: int = 64
    ridge: float = 1.0
    top_k: int = 5
    encoder: str = "ridge"
    hidden: int = 64
    steps: int = 120
    lr: float = 1e-3


def with_targets(df: DataFrame, vocab: DataFrame, label: str = "label") -> DataFrame:
    """Each epoch with the embedding of its label; labels are embedded once each."""
    table = vocab.select(F.lower("surface").alias("_key"), F.col("vec").alias("y"))
    return df.withColumn("_key", F.lower(label)).join(small_side(table), "_key", "inner").drop("_key")


def evaluate(
    encoded: DataFrame, vocab: DataFrame | None, cfg: TrainConfig, fold: str = "fold", seed: str = "1",
    n_labels: int | None = None, ranker: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per fold: hit rates of the signal and of the four controls.

    Signal and controls differ only in embedding or label, so each is one narrow
    scoring pass followed by one aggregate.
    """
    n_labels = vocab.count() if n_labels is None else n_labels
    k = 1 if n_labels <= 1 else min(cfg.top_k, n_labels - 1)
    # every arm reads the encoded epochs; they are written once
    keep = written(encoded.select("epoch_id", fold, "label", "emb"), "encoded")
    shuffled = _shuffled_in_folds(keep, fold, seed)
    noise = lambda s: retrieval.random_unit(keep, "epoch_id", cfg.dim, s)
    arms = {
        "real": keep, "shuffled_label_top5": shuffled,
        "temporal_shuffle_top5": noise(f"temporal:{seed}"), "gaussian_noise_top5": noise(f"gaussian:{seed}"),
    }
    merged = None
    for arm, rows in arms.items():
        part = rows.select("epoch_id", F.struct(F.col(fold).alias("fold"), F.lit(arm).alias("arm")).alias("tag"), "label", "emb")
        merged = part if merged is None else merged.unionByName(part)
    ranks = ranker(merged) if ranker else retrieval.gold_ranks(merged, vocab)
    rates = ranks.select("tag.fold", "tag.arm", "gold_rank").groupBy("fold", "arm").agg(
        F.avg(F.when(F.col("gold_rank") <= 1, 1.0).otherwise(0.0)).alias("top1"),
        F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0)).alias("topk"),
        F.avg(F.when(F.col("gold_rank") <= 25, 1.0).otherwise(0.0)).alias("top25"),
        F.count(F.lit(1)).alias("n_test"),
    )
    only = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return rates.groupBy("fold").agg(
        only("real", "top1").alias("top1"), only("real", "topk").alias("top5"), only("real", "top25").alias("top25"),
        only("real", "n_test").alias("n_test"), *[only(c, "topk").alias(c) for c in CONTROLS[:3]],
    ).withColumn(CONTROLS[3], F.lit(min(k / n_labels, 1.0) if n_labels else 0.0))


def _shuffled_in_folds(df: DataFrame, fold: str, seed: str) -> DataFrame:
    """Labels permuted inside each fold."""
    rows = ranked(df, [fold], ["epoch_id"], "_i")
    donors = ranked(
        df.select(fold, F.col("label").alias("_donor"), order_hash(F.col("epoch_id"), seed).alias("_h")), [fold], ["_h"], "_i"
    ).select(fold, "_i", "_donor")
    return rows.join(donors, [fold, "_i"], "inner").select("epoch_id", fold, F.col("_donor").alias("label"), "emb")


def fold_mean(reports: DataFrame, strategy: str) -> DataFrame:
    """Mean of every metric over the folds, and the gate."""
    means = reports.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("top1").alias("top1"), F.avg("top5").alias("top5"),
        F.avg("top25").alias("top25"), *[F.avg(c).alias(c) for c in CONTROLS],
    )
    gate = retrieval.passes(F.col("top5"), [F.col(c) for c in CONTROLS])
    return means.select(
        F.lit(strategy).alias("strategy"), "*", (gate & (F.col("n_folds") > 0)).alias("gate_pass"),
        F.when(F.col("n_folds") == 0, F.lit("no folds")).alias("skipped"),
    )


def grouped_report(df: DataFrame, strategy: str, vocab: DataFrame, cfg: TrainConfig, holdout: str | None = None) -> DataFrame:
    """Report of one grouped strategy; every fold is scored by one all-fold pass."""
    folds = splits.group_folds(df, strategy, holdout)
    splits.require_folds(folds, strategy)
    key = splits.GROUP_COLUMNS[strategy]
    ready = with_targets(df, vocab)
    if cfg.encoder == "ridge":
        encoded = encoders.held_out_embeddings(ready, key, cfg.width, cfg.dim, cfg.ridge).withColumnRenamed("grp", "fold")
    else:
        encoded = encoders.refit_embeddings(ready, folds, key, make_encoder(cfg)).withColumnRenamed("grp", "fold")
    labelled = encoded.join(df.select("epoch_id", "label"), "epoch_id", "inner")
    if holdout:
        labelled = labelled.join(small_side(folds.select("fold")), "fold", "left_semi")
    return fold_mean(evaluate(labelled, vocab, cfg), strategy)


def make_encoder(cfg: TrainConfig):
    if cfg.encoder == "mlp":
        return encoders.encoder("mlp", width=cfg.width, dim=cfg.dim, hidden=cfg.hidden, ridge=cfg.ridge, epochs=cfg.steps, lr=cfg.lr)
    return encoders.encoder(cfg.encoder, width=cfg.width, dim=cfg.dim, ridge=cfg.ridge)


def train_report(df: DataFrame, cfg: TrainConfig, embedder=None, pos: str = "epoch_id"):
    """Cross-session and leave-one-subject-out reports, then the model fitted on all rows.

    ``df`` holds ``epoch_id, x, label, session_id, subject_id``.
    """
    vocab = retrieval.label_vocab(df, "label", pos, embedder or HashEmbedder(cfg.dim)).persist()
    reports = grouped_report(df, "cross_session", vocab, cfg).unionByName(grouped_report(df, "loso", vocab, cfg))
    model = make_encoder(cfg).fit(with_targets(df, vocab))
    return reports, model


def block_report(df: DataFrame, cfg: TrainConfig, held_segments=splits.HELD_SEGMENTS, buffer_s: float = splits.BUFFER_SECONDS) -> DataFrame:
    """Stimulus-block report with the text embedder fitted on the training labels only."""
    train, test = splits.stimulus_block(df, held_segments, buffer_s)
    corpus = train.select(F.col("epoch_id").alias("key"), F.col("label").alias("surface"))
    embedder = embedders.TfidfEmbedder(cfg.dim).fit(corpus)
    vocab = retrieval.label_vocab(df, "label", "epoch_id", embedder).persist()
    model = make_encoder(cfg).fit(with_targets(train, vocab))
    encoded = model.transform(test).withColumn("fold", F.lit("stimulus_block"))
    report = fold_mean(evaluate(encoded, vocab, cfg), "stimulus_block")
    counts = lambda rows, side: rows.agg(
        F.count(F.lit(1)).alias(f"n_{side}_epochs"), F.count_distinct("label").alias(f"n_{side}_labels")
    )
    return attach_row(attach_row(report, counts(train, "train")), counts(test, "test"))


def fold_targets(df: DataFrame, key: str, dim: int) -> DataFrame:
    """``(fold, pos, label, vec)``: every label under the embedder fitted on each fold's training rows."""
    corpus = df.select("epoch_id", "label", F.col(key).alias("fold"))
    terms = embedders.fold_terms(corpus, "epoch_id", "label", "fold", dim)
    labels = df.groupBy("label").agg(F.min("epoch_id").alias("pos"))
    names = splits.require_folds(splits.group_folds(df, splits_name(key)), splits_name(key)).select("fold")
    listed = names.agg(F.array_sort(F.collect_list("fold")).alias("folds"))
    surfaces = attach_row(labels, listed).withColumn("fold", F.explode("folds")).drop("folds")
    return embedders.fold_embeddings(surfaces, "pos", "label", terms, "fold", dim)


def splits_name(key: str) -> str:
    return {column: name for name, column in splits.GROUP_COLUMNS.items()}[key]


def fold_local_embeddings(df: DataFrame, key: str, targets: DataFrame, cfg: TrainConfig) -> DataFrame:
    """Held-out embeddings whose training targets differ by fold, without refitting scans.

    Features are the same in every fold, so its ``X'X`` is the overall one less the
    group's own. Its ``X'Y`` needs only ``X`` summed per label and per (group, label).
    """
    width, dim = cfg.width, cfg.dim
    rows = df.select("epoch_id", F.col(key).cast("string").alias("grp"), "label", "x")
    zero = rows.withColumn("y", F.array_repeat(F.lit(0.0).cast("double"), dim))
    xx, _ = encoders.collect_gram(encoders.gram(zero, width, dim), width, dim)
    own = encoders.gram(zero, width, dim, "grp")
    held = array_sum(rows, ["grp", "label"], "x", "sx_held")
    total = array_sum(held, ["label"], "sx_held", "sx")
    crossed = (
        targets.select(F.col("fold").alias("grp"), "label", F.col("vec").alias("y"))
        .join(total, "label", "inner").join(held, ["grp", "label"], "left")
        .withColumn("x", F.when(F.col("sx_held").isNull(), F.col("sx")).otherwise(
            F.zip_with("sx", "sx_held", lambda a, b: a - b)
        ))
    )
    cross = encoders.gram(crossed, width, dim, "grp")
    shared = df.sparkSession.sparkContext.broadcast(xx)

    def solve(mine: pd.DataFrame, targets_of: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(targets_of):
            return pd.DataFrame({"grp": [], "w": []})
        left = shared.value - encoders.matrix(mine.sort_values("row")["vec"])[:, :width]
        right = encoders.matrix(targets_of.sort_values("row")["vec"])[:, width:]
        w = encoders.solve_ridge(left, right, cfg.ridge)
        return pd.DataFrame({"grp": [mine["grp"].iloc[0]], "w": [list(w.ravel())]})

    weights = own.groupBy("grp").cogroup(cross.groupBy("grp")).applyInPandas(solve, "grp string, w array<double>")
    return encoders.encode_by_group(rows, weights, width, dim)


def _rank_in_fold(dim: int):
    def rank(rows: pd.DataFrame, vocab: pd.DataFrame) -> pd.DataFrame:
        out = rows[["epoch_id", "tag"]].copy()
        if not len(rows) or not len(vocab):
            out["gold_rank"] = pd.Series([None] * len(rows), dtype="Int64")
            return out
        vectors, pos = encoders.matrix(vocab["vec"]), vocab["pos"].to_numpy()
        at = {label.lower(): i for i, label in reversed(list(enumerate(vocab["surface"])))}
        scores = encoders.matrix(rows["emb"]) @ vectors.T
        found = np.array([at.get(label.lower(), -1) for label in rows["label"]])
        own = scores[np.arange(len(rows)), np.maximum(found, 0)][:, None]
        ahead = (scores > own + retrieval.TIE) | ((np.abs(scores - own) <= retrieval.TIE) & (pos[None, :] < pos[found][:, None]))
        out["gold_rank"] = pd.Series(np.where(found >= 0, ahead.sum(axis=1) + 1, -1), index=out.index).astype("Int64").replace(-1, pd.NA)
        return out

    return rank


def fold_gold_ranks(merged: DataFrame, targets: DataFrame, dim: int) -> DataFrame:
    """Gold ranks where every fold has its own label vectors; rows come in bounded chunks."""
    sizes = merged.groupBy("tag.fold").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(encoders.CHUNK_ROWS)).cast("int")
    rows = merged.withColumn("fold", F.col("tag.fold")).join(sizes, "fold", "inner").withColumn(
        "chunk", F.pmod(F.xxhash64("epoch_id", "tag.arm"), parts).cast("int")
    ).drop("n")
    vocab = targets.select("fold", F.col("label").alias("surface"), "pos", "vec").join(sizes, "fold", "inner").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("n")
    kind = merged.schema["epoch_id"].dataType.simpleString()
    return rows.groupBy("fold", "chunk").cogroup(vocab.groupBy("fold", "chunk")).applyInPandas(
        _rank_in_fold(dim), f"epoch_id {kind}, tag struct<fold:string,arm:string>, gold_rank bigint"
    )


def fold_local_report(df: DataFrame, cfg: TrainConfig, strategy: str = "loso") -> DataFrame:
    """Grouped report whose text embedder is fitted anew on each fold's training labels."""
    key = splits.GROUP_COLUMNS[strategy]
    targets = fold_targets(df, key, cfg.dim).persist()
    n_labels = df.agg(F.count_distinct("label")).head()[0]
    encoded = fold_local_embeddings(df, key, targets, cfg).join(
        df.select("epoch_id", "label"), "epoch_id", "inner"
    ).withColumnRenamed("grp", "fold")
    ranker = lambda merged: fold_gold_ranks(merged, targets, cfg.dim)
    return fold_mean(evaluate(encoded, None, cfg, n_labels=n_labels, ranker=ranker), f"{strategy}_same_stimulus")


def headline(reports: DataFrame) -> DataFrame:
    """The stimulus-block report unless it was skipped, else leave-one-subject-out; gates are joined."""
    both = reports.agg(F.bool_and("gate_pass").alias("combined_gate"))
    order = F.when(F.col("strategy") == "stimulus_block", 0).otherwise(1)
    best = reports.where(F.col("skipped").isNull()).orderBy(order, "strategy").limit(1)
    return attach_row(best, both)


def gate_column(topk: str = "top5") -> Column:
    return retrieval.passes(F.col(topk), [F.col(c) for c in CONTROLS])


def run_lineage(df: DataFrame, reports: DataFrame, source: str, digest: Column) -> DataFrame:
    """One JSON row that ties a run to its data: sizes, subject counts, folds and gate."""
    counts = df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    subjects = counts.agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n").alias("n_epochs"), F.min("n").alias("min_epochs"), F.max("n").alias("max_epochs"))
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col("n_folds")))
    evaluation = reports.agg(
        pick("cross_session").alias("cross_session_folds"), pick("loso").alias("loso_folds"),
        F.bool_and("gate_pass").alias("gate_pass"),
    )
    return attach_row(subjects, evaluation).select(F.to_json(F.struct(
        F.struct(F.lit(source).alias("source"), "n_epochs", "n_subjects", "min_epochs", "max_epochs", digest.alias("source_sha256")).alias("dataset"),
        F.struct("cross_session_folds", "loso_folds", "gate_pass").alias("evaluation"),
        F.lit(1).alias("version"),
    )).alias("lineage"))
