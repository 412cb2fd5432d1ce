"""Streaming form of the audit rules."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from epochloom import schemas
from epochloom.operators import audit


def normalised(stream: DataFrame, raw_id: str = "correlation_id", event_key: str = "event_id") -> DataFrame:
    """Allowlisted events with a safe id; release events lose their path for its digest.

    Stateless, so the same code serves batches.
    """
    safe = stream.withColumn("correlation_id", audit.correlation_id(raw_id, F.col(event_key)))
    release = F.col("event_type").startswith("dataset_")
    hashed = F.when(release, F.sha2(F.col("path").cast("binary"), 256))
    shown = F.when(~release, F.col("path"))
    return audit.allowlisted(safe.withColumn("path_hash", hashed).withColumn("path", shown), schemas.AUDIT_FIELDS)


def tumbling(
    stream: DataFrame, at: str, keys: Sequence[str], width: str, threshold: int, delay: str,
    id_column: str = "correlation_id",
) -> DataFrame:
    """Tumbling alerts in append mode: a window is judged once the watermark has passed it.

    Ids are counted per window first, so the state holds one small row per id.
    """
    marked = stream.withWatermark(at, delay)
    per_id = marked.groupBy(F.window(at, width), *keys, id_column).agg(F.count(F.lit(1)).alias("c"))
    return per_id.groupBy("window", *keys).agg(
        F.sum("c").alias("n"), F.count(id_column).alias("n_ids")
    ).where(F.col("n") > threshold).select(
        F.col("window.start").alias("window_start"), *keys, "n", "n_ids", F.lit("high").alias("severity")
    )


def sliding(
    stream: DataFrame, at: str, keys: Sequence[str], width: str, slide: str, threshold: int, delay: str
) -> DataFrame:
    """Sliding alerts: the streaming approach to a trailing window, one verdict per slide."""
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > threshold).select(F.col("window.start").alias("window_start"), *keys, "n")


def repeated_mfa_failures(stream: DataFrame, at: str = "timestamp", width: str = "5 minutes", threshold: int = 4, delay: str = "5 minutes") -> DataFrame:
    return tumbling(stream.where(F.col("event_type") == "mfa_verification_failed"), at, ["tenant_id", "user_sub"], width, threshold, delay)


def unauthorised_bursts(stream: DataFrame, at: str = "timestamp", width: str = "5 minutes", threshold: int = 20, delay: str = "5 minutes") -> DataFrame:
    chosen = stream.where((F.col("event_type") == "api_request") & (F.col("status") == 401))
    return tumbling(chosen, at, ["src_ip", "user_sub"], width, threshold, delay)


def release_failures(stream: DataFrame, at: str = "timestamp", width: str = "15 minutes", threshold: int = 2, delay: str = "15 minutes") -> DataFrame:
    chosen = stream.where(F.col("event_type").isin(*audit.RELEASE_FAILURES))
    return tumbling(chosen, at, ["user_sub", "dataset_id", "event_type"], width, threshold, delay)
