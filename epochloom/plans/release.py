"""Release planning and verification jobs."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from epochloom.operators import release, selection


@dataclass
class ReleasePlan:
    files: DataFrame
    excluded: DataFrame
    totals: DataFrame
    digests: DataFrame
    batches: DataFrame


def plan(families: DataFrame, listing: DataFrame, inventory: DataFrame, family: str, batch_size: int = 32) -> ReleasePlan:
    """Approved families with their kept files, exclusions, totals, digests and batches.

    ``listing`` holds ``(family, path, kind, seq)``; ``inventory`` ``(family, path, size_bytes, sha256)``.
    """
    approved = release.governance_decision(families).where("can_upload").select(family)
    scoped = release.scope(listing.join(approved, family, "left_semi"), family, "path", "kind")
    kept = scoped.where(F.col("reason").isNull()).select(family, "path_posix")
    files = kept.join(inventory.withColumnRenamed("path", "path_posix"), [family, "path_posix"], "inner").withColumnRenamed("path_posix", "path")
    return ReleasePlan(
        files, scoped.where(F.col("reason").isNotNull()).select(family, F.col("path_posix").alias("path"), "reason"),
        release.totals(files, family), release.scope_digest(kept, family),
        selection.batch_numbers(files, [family], "path", batch_size),
    )


def resume(
    batches: DataFrame, manifest_digests: DataFrame, state: DataFrame, remote: DataFrame, family: str
) -> DataFrame:
    """Batches to send again, given the checkpoint and the remote listing."""
    tagged = batches.join(manifest_digests.select(family, "manifest_sha256"), family, "inner")
    return release.pending_batches(tagged, state, remote, family)


def verify(planned: DataFrame, observed: DataFrame, remote: DataFrame, family: str) -> DataFrame:
    """Every finding of a release check: changed sources and remote differences."""
    local = release.reconcile(planned, observed, (family, "path")).select(family, "path", F.lit("source").alias("side"), "reason")
    far = release.listing_mismatch(planned, remote, (family, "path")).select(family, "path", F.lit("remote").alias("side"), "reason")
    return local.unionByName(far)


def verdict(findings: DataFrame, planned: DataFrame, family: str) -> DataFrame:
    """Verified or failed per family."""
    bad = findings.groupBy(family).agg(F.count(F.lit(1)).alias("n_findings"))
    return release.totals(planned, family).join(bad, family, "left").select(
        family, "file_count", F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.when(F.col("n_findings").isNull(), F.lit("verified")).otherwise(F.lit("failed")).alias("verification_status"),
    )
