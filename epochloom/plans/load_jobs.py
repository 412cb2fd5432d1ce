"""Load jobs: from source tables to pooled, labelled epochs."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epochloom import schemas
from epochloom.functions import arrays, paths
from epochloom.operators import cleaning, epoching, selection
from epochloom.plans.preprocess import CleaningConfig, preprocess_epochs
from epochloom.sources.readers import ContractError, usable_epochs

LOADER_CLEANING = CleaningConfig(apply_bandpass=False, bad_epoch_threshold_uv=800.0, use_rejection=True, use_components=True)


def nested_job(
    raw: DataFrame, *, label_field: str = "topic", relevant_only: bool = False, n_times: int = 64,
    max_rows: int | None = None, n_shards: int | None = None,
) -> DataFrame:
    """Nested-epoch load: filters, per-shard budget if one is asked for, temporal pooling, shard sessions."""
    rows = usable_epochs(raw, label_field, relevant_only)
    if max_rows is not None:
        rows = selection.shard_budget(rows, "shard", "row_index", max_rows, n_shards)
    subject = F.coalesce(F.nullif(F.col("participant"), F.lit("")), F.lit("unknown"))
    return rows.select(
        F.concat_ws(":", "shard", "row_index").alias("epoch_id"), subject.alias("subject_id"),
        F.concat(subject, F.lit(":"), F.col("shard")).alias("session_id"), "label", "shard", "row_index",
        arrays.pool_time("eeg", n_times).alias("eeg"),
    )


def sample_violations(samples: DataFrame, labels: Sequence[str] = schemas.SAMPLE_LABELS) -> DataFrame:
    """Sample rows that break the row contract: keys and a label of the closed set."""
    bad = F.col("patient").isNull() | F.col("epoch").isNull() | F.col("time").isNull()
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    return samples.withColumn("reason", F.when(bad, F.lit("key")).when(~label.isin(*labels), F.lit("label"))).where(
        F.col("reason").isNotNull()
    )


def windowed_job(
    samples: DataFrame, channels: Sequence[str] = schemas.SAMPLE_CHANNELS, *,
    expected: int = schemas.SAMPLES_PER_EPOCH, step: float = 1.0 / schemas.SAMPLE_RATE_HZ,
    labels: Sequence[str] = schemas.SAMPLE_LABELS, max_epochs: int | None = None,
    max_subjects: int | None = None, n_times: int = 64, n_channels: int = 32, strict: bool = True,
) -> DataFrame:
    """Windowed-sample load: contract, assembly, round-robin selection, pooling.

    ``strict`` refuses the whole table on the first broken group; otherwise broken
    groups are left out.
    """
    if strict and not sample_violations(samples, labels).isEmpty():
        raise ContractError("sample rows hold an invalid patient, epoch, time, or label")
    keys = ["patient", "epoch"]
    clean = samples.withColumn("label", F.lower(F.trim("label")))
    contract = epoching.sample_contract(clean, keys, "time", "label", expected=expected, step=step)
    if strict:
        worst = epoching.first_offender(contract, keys).head()
        if worst is not None:
            raise ContractError(f"{worst['reason']} contract is invalid for {(worst['patient'], worst['epoch'])}")
    good = contract.where(F.col("reason").isNull()).select(*keys)
    if max_subjects is not None:
        first = good.select("patient").distinct().orderBy("patient").limit(max_subjects)
        good = good.join(first, "patient", "left_semi")
    if max_epochs is not None:
        # chosen by key before any sample is assembled
        good = selection.round_robin(good, ["patient"], ["epoch"], max_epochs).select(*keys)
    epochs = epoching.assemble(clean.join(good, keys, "left_semi"), keys, "time", channels, expected)
    subject = paths.numbered("sub-", "patient", 2)
    return epochs.select(
        F.concat_ws(":", "patient", "epoch").alias("epoch_id"), subject.alias("subject_id"),
        F.concat(subject, F.lit(":"), paths.numbered("epoch-", "epoch", 3)).alias("session_id"),
        F.col("label").alias("stimulus_id"), "label", "patient", "epoch",
        arrays.pool_time(arrays.pool_channels("eeg", n_channels), n_times).alias("eeg"),
    )


def _clean_and_pool(
    epochs: DataFrame, epoch_id: str, n_channels: int, n_times: int, cfg: CleaningConfig | None,
    guard: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    pooled = epochs.withColumn("eeg", arrays.pool_channels("eeg", n_channels))
    if cfg is not None:
        pooled = guard(preprocess_epochs(pooled, cfg, epoch_id))
    return pooled.withColumn("eeg", arrays.pool_time("eeg", n_times))


def continuous_job(
    signal: DataFrame, recordings: DataFrame, markers: DataFrame, *, key: str = "recording_id",
    marker_id: str = "marker_id", fs: float, epoch_sec: float = 0.8, per_recording: int | None = None,
    n_channels: int = 32, n_times: int = 64, cfg: CleaningConfig | None = LOADER_CLEANING, max_epochs: int | None = None,
) -> DataFrame:
    """Marker-locked load of continuous recordings."""
    usable = epoching.usable_markers(markers)
    if per_recording is not None:
        usable = selection.strided_budget(usable, [key], ["onset", marker_id], per_recording)
    bounds = epoching.windows(usable, "onset", F.lit(fs), F.lit(int(epoch_sec * fs)))
    inside = epoching.drop_outside(bounds, recordings, key)
    width = max(1, int(epoch_sec * fs))
    epochs = epoching.cut_epochs(signal, inside, key, marker_id, bucket=4 * width)
    out = _clean_and_pool(
        epochs, marker_id, n_channels, n_times, cfg, lambda df: cleaning.guarded_mask(df, "mask_keep")
    )
    return out if max_epochs is None else selection.capped(out, [key, marker_id], max_epochs)


def paired_job(
    signal: DataFrame, recordings: DataFrame, markers: DataFrame, label_rows: DataFrame, *,
    key: str = "recording_id", marker_id: str = "marker_id", fs: float, epoch_tmin: float = 0.0,
    epoch_sec: float = 5.0, n_channels: int = 32, n_times: int = 64, cfg: CleaningConfig | None = LOADER_CLEANING,
) -> DataFrame:
    """Annotation-locked load: the i-th annotation of a run takes the i-th label row."""
    paired = epoching.positional_join(markers, label_rows, key, ["onset", marker_id], ["label_no"])
    width = int(round(epoch_sec * fs))
    bounds = epoching.windows(paired, "onset", F.lit(fs), F.lit(width), tmin=epoch_tmin, rounded=True)
    inside = epoching.drop_outside(bounds, recordings, key)
    epochs = epoching.cut_epochs(signal, inside, key, marker_id, bucket=4 * max(1, width))
    masked = lambda df: df.where("mask_keep")
    return _clean_and_pool(epochs, marker_id, n_channels, n_times, cfg, masked)


def sentence_job(
    signal: DataFrame, recordings: DataFrame, words: DataFrame, spec: DataFrame, *,
    key: str = "subject_id", fs: float = 500.0, tmin: float = -0.2, max_epoch_sec: float = 5.0,
    n_channels: int = 32, n_times: int = 64, cfg: CleaningConfig | None = LOADER_CLEANING,
) -> DataFrame:
    """Sentence-locked load: spans of the specified sentences, padded to one width."""
    spans = epoching.sentence_windows(words, [key, "sentence_id"], "onset", "duration", "segment", max_epoch_sec)
    wanted = epoching.attach_sentences(spans, spec)
    bounds = epoching.windows(
        wanted.withColumn("epoch_id", F.concat_ws(":", key, "sentence_id")), "onset", F.lit(fs), None,
        tmin=tmin, stop_at=F.least(F.col("offset_s"), F.col("onset") + F.lit(max_epoch_sec)), rounded=True,
    )
    inside = epoching.drop_outside(bounds, recordings, key)
    width = int(round((max_epoch_sec - tmin) * fs))
    epochs = epoching.cut_epochs(signal, inside, key, "epoch_id", bucket=2 * max(1, width), pad_to=width)
    epochs = epochs.withColumn("label", F.col("text")).withColumn(
        "stimulus_id", paths.numbered("segment:", "segment", 2)
    ).withColumn("session_id", F.concat(F.col(key), F.lit(":run-01")))
    guard = lambda df: cleaning.guarded_mask(df, "mask_keep", relative=True)
    return _clean_and_pool(epochs, "epoch_id", n_channels, n_times, cfg, guard)


def coded_job(
    epochs: DataFrame, label: Column, *, epoch_id: str = "epoch_id", n_channels: int = 32, n_times: int = 64,
    scale: float = 1.0, cfg: CleaningConfig | None = None, max_epochs: int | None = None,
) -> DataFrame:
    """Pre-epoched load: labels decoded from codes or classes, unmapped rows dropped.

    The keep mask is a column of the epoch row, so labels and data cannot part.
    """
    rows = epochs.withColumn("label", label).where(F.coalesce("label", F.lit("")) != "")
    if scale != 1.0:
        rows = rows.withColumn("eeg", arrays.scale("eeg", scale))
    out = _clean_and_pool(rows, epoch_id, n_channels, n_times, cfg, lambda df: df.where("mask_keep"))
    return out if max_epochs is None else selection.capped(out, [epoch_id], max_epochs)
