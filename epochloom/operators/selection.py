"""Deterministic row selection: budgets, round robin, ordinals, caps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from epochloom.functions.scale import join_keys, ranked


def round_robin(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows when every group in turn gives its next row.

    A row past position ``n`` of its group can never be reached, so the per-group
    number is cut at ``n`` before the shuffle.
    """
    if n < 1:
        raise ValueError("the selection size must be positive")
    w = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
        .orderBy("position", *groups).limit(n)
    )


def shard_budget(
    df: DataFrame, shard: str, order: str, max_rows: int, n_shards: int | None = None
) -> DataFrame:
    """An equal budget per shard, remainder not redistributed, under a global cap."""
    n_shards = n_shards or df.select(F.count_distinct(shard)).head()[0]
    budget = max(1, max_rows // max(1, n_shards))
    w = Window.partitionBy(shard).orderBy(order)
    return (
        df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget).drop("_n")
        .orderBy(shard, order).limit(max_rows)
    )


def strided_budget(df: DataFrame, groups: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """Rows ``int(k * (n / budget))`` of each group, or all of a group that fits.

    The step is computed in floating point and truncated, exactly as the budget rule
    is written; row ``i`` is wanted when some ``k`` lands on it, and such a ``k`` can
    only be one of three neighbours of ``i / step``.
    """
    if budget < 1:
        return df
    groups = list(groups)
    numbered = ranked(df, groups, list(order), "_rn")
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_keys(numbered, sizes, groups).withColumn("_i", F.col("_rn") - 1)
    step = F.col("_n").cast("double") / F.lit(float(budget))
    guess = F.floor(F.col("_i") / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        k = (guess + F.lit(shift)).cast("long")
        hit = hit | ((k >= 0) & (k < budget) & ((k.cast("double") * step).cast("long") == F.col("_i")))
    return joined.where((F.col("_n") <= budget) | hit).drop("_rn", "_n", "_i")


def first_groups(
    df: DataFrame, subject: str, session: str, max_subjects: int | None, max_sessions: int | None
) -> DataFrame:
    """First subjects by name and the first sessions of each; ranked on the distinct pairs."""
    pairs = df.select(subject, session).distinct()
    # one row per subject, not per epoch
    subjects = pairs.select(subject).distinct()
    if max_subjects is not None:
        subjects = subjects.orderBy(subject).limit(max_subjects)
    chosen = pairs.join(subjects, subject, "left_semi")
    if max_sessions is not None:
        w = Window.partitionBy(subject).orderBy(session)
        chosen = chosen.withColumn("_s", F.row_number().over(w)).where(F.col("_s") <= max_sessions).drop("_s")
    return df.join(chosen, [subject, session], "left_semi")


def ordinals(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "trial_index") -> DataFrame:
    """0-based trial number inside its run."""
    return ranked(df, list(groups), list(order), out).withColumn(out, F.col(out) - 1)


def batch_numbers(df: DataFrame, groups: Sequence[str], path: str, size: int = 32) -> DataFrame:
    """Batch id ``batch-<i / size>`` over the byte order of the paths."""
    if size < 1:
        raise ValueError("batch_size must be positive")
    numbered = ranked(df, list(groups), [path], "_rn")
    return numbered.withColumn(
        "batch_id", F.concat(F.lit("batch-"), F.floor((F.col("_rn") - 1) / F.lit(size)).cast("string"))
    ).drop("_rn")


def first_occurrence(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def capped(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
