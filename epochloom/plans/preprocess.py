"""The fixed-order cleaning job."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epochloom.operators.cleaning import CleaningConfig, amplitude_mask, clean_signal, rejection, remove_components
from epochloom.session import cut_lineage


def preprocess_epochs(df: DataFrame, cfg: CleaningConfig, epoch_id: str = "epoch_id") -> DataFrame:
    """Cleaned epochs with a ``mask_keep`` column; rows are never dropped.

    Filter, reference, demeaning and baseline share one pass. The amplitude mask reads
    the raw input; rejection and component removal read the cleaned signal.
    """
    raw_ok = amplitude_mask("eeg", cfg.bad_epoch_threshold_uv)
    out = clean_signal(df.withColumn("mask_keep", raw_ok), cfg, "eeg", "eeg")
    if cfg.use_rejection or cfg.use_components:
        # several passes read the cleaned epochs; they are written once
        out = cut_lineage(out)
    if cfg.use_rejection:
        verdict = rejection(out, epoch_id, "eeg", cfg.scope_cols).select(epoch_id, F.col("keep").alias("_keep"))
        out = out.join(verdict, epoch_id, "inner").withColumn("mask_keep", F.col("mask_keep") & F.col("_keep")).drop("_keep")
    if cfg.use_components:
        out = remove_components(out, "eeg", "eeg", cfg.n_components)
    return out


__all__ = ["CleaningConfig", "preprocess_epochs"]
