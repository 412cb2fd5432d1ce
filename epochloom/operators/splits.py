"""Leakage-safe splits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from epochloom.functions.hashed import order_hash
from epochloom.functions.scale import attach_row, prefix_max, ranked

# The id column each strategy holds out, the held-out segments.
GROUP_COLUMNS = {"cross_session": "session_id", "loso": "subject_id", "stimulus_identity": "stimulus_id"}
HELD_SEGMENTS = (10, 11, 12)
BUFFER_SECONDS = 1.0


class SplitError(ValueError):
    """A split would leak or cannot be formed."""


def group_folds(df: DataFrame, strategy: str, holdout: str | None = None) -> DataFrame:
    """One row per fold with its test and train sizes; a fold is its held-out group.

    The epoch table is never multiplied: a row is in the test set of the fold named
    by its own group and in the training set of all the others.
    """
    if strategy not in GROUP_COLUMNS:
        raise SplitError(f"unknown split strategy {strategy}")
    key = GROUP_COLUMNS[strategy]
    sizes = df.groupBy(F.col(key).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    total = sizes.agg(F.sum("n_test").alias("_t"), F.count(F.lit(1)).alias("_g"))
    folds = attach_row(sizes, total).withColumn("n_train", F.col("_t") - F.col("n_test"))
    folds = folds.where("_g >= 2").drop("_t", "_g")
    if strategy == "loso" and holdout:
        chosen = folds.where(F.col("fold") == holdout)
        return folds if chosen.isEmpty() else chosen
    return folds


def require_folds(folds: DataFrame, strategy: str) -> DataFrame:
    if folds.isEmpty():
        raise SplitError(f"{strategy} needs at least two groups; a random split is banned")
    return folds


def expand_folds(df: DataFrame, epoch_id: str, key: str, max_folds: int = 10_000) -> DataFrame:
    """Explicit ``(fold, epoch_id, is_test)`` rows, built by giving each epoch the fold list.

    This form is epochs x folds by definition; the implicit form above is the default.
    """
    names = [r[0] for r in df.select(key).distinct().orderBy(key).limit(max_folds + 1).collect()]
    if len(names) > max_folds:
        raise SplitError("too many folds to expand; use the implicit form")
    folds = F.array(*[F.lit(n) for n in names])
    return df.select(epoch_id, key, F.explode(folds).alias("fold")).select(
        "fold", epoch_id, (F.col(key) == F.col("fold")).alias("is_test")
    )


def without_overlap(
    train: DataFrame, held: DataFrame, subject: str = "subject_id", onset: str = "onset",
    offset: str = "offset_s", buffer_s: float = BUFFER_SECONDS,
) -> DataFrame:
    """Training rows whose buffered window overlaps no held-out window of the subject.

    A window overlaps some held one exactly when, among the held windows that start
    before its buffered end, the latest end lies after its buffered start. That is a
    running maximum in time order, so no pair of windows is formed.
    """
    probe = train.withColumn("_until", F.col(offset) + F.lit(buffer_s))
    base = held.select(subject, F.col(onset).alias("_held_on"), F.col(offset).alias("_held_off"))
    scanned = prefix_max(probe, base, [subject], "_until", "_held_on", "_held_off", "_latest", inclusive=False)
    overlaps = F.coalesce(F.col("_latest") > F.col(onset) - F.lit(buffer_s), F.lit(False))
    return scanned.where(~overlaps).drop("_until", "_latest")


def stimulus_block(
    df: DataFrame, held_segments: Sequence[int] = HELD_SEGMENTS, buffer_s: float = BUFFER_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the stimulus-block protocol."""
    is_held = F.col("segment").isin(*[int(s) for s in held_segments])
    test = df.where(is_held)
    return without_overlap(df.where(~is_held), test, buffer_s=buffer_s), test


def random_split(df: DataFrame, epoch_id: str, allow: bool = False, train_share: float = 0.8, seed: str = "split") -> DataFrame:
    """80/20 split by a hash order of the ids; banned unless asked for."""
    if not allow:
        raise SplitError("random-epoch split is banned; group ids are required")
    keyed = df.withColumn("_h", order_hash(F.col(epoch_id), seed))
    numbered = ranked(keyed, [], ["_h", epoch_id], "_rn")
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(train_share)).alias("_cut"))
    return attach_row(numbered, total).withColumn(
        "is_test", F.col("_rn") > F.col("_cut")
    ).drop("_h", "_rn", "_cut")


def designated_holdout(df: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Train and validation rows of a corpus that names its own holdout."""
    return df.where(F.col(split) == "train"), df.where(F.col(split) == "validation")


def shared_stimuli(train: DataFrame, test: DataFrame, column: str = "stimulus_id") -> DataFrame:
    """Stimuli on both sides; empty for a leakage-free split."""
    return train.select(column).intersect(test.select(column))


def groups_per_row_warning(df: DataFrame, key: str, share: float = 0.9) -> bool:
    """True when nearly every row is its own group, so folds are leave-one-out."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("g")).head()
    return row["n"] > 0 and row["g"] >= share * row["n"]
