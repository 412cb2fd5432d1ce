"""Audit events: normalisation and the batch form of the detection rules."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from epochloom import schemas
from epochloom.functions.scale import join_keys, prefix_max, trailing_count

RELEASE_FAILURES = (
    "dataset_release_verification_failed",
    "dataset_inventory_reconciliation_failed",
    "dataset_upload_blocked",
)
# Limits of the rate limiter and of the attempt lockout.
RATE_LIMIT = 60
RATE_WINDOW_S = 60
LOCKOUT_ATTEMPTS = 5
LOCKOUT_WINDOW_S = 300
IP_PATTERN = (
    r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!\z)|\z)){4}\z|"
    r"^(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*\z)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|"
    r"(?!.*::.*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)\z"
)


def allowlisted(events: DataFrame, fields: Sequence[str] = schemas.AUDIT_FIELDS) -> DataFrame:
    """Only the allowed fields; hash lists keep text entries of at most 64 characters."""
    out = events.select(*[c for c in fields if c in events.columns])
    if "batch_prompt_hashes" in out.columns:
        out = out.withColumn("batch_prompt_hashes", bounded_hashes("batch_prompt_hashes"))
    return out


def bounded_hashes(column: str) -> Column:
    return F.transform(F.filter(column, lambda v: v.isNotNull()), lambda v: F.substring(v, 1, 64))


def release_events(events: DataFrame) -> DataFrame:
    """Release events: a path becomes its digest and is never kept itself."""
    hashed = F.sha2(F.col("path").cast("binary"), 256)
    given = F.col("path_hash") if "path_hash" in events.columns else F.lit(None).cast("string")
    return allowlisted(events.withColumn("path_hash", F.coalesce(hashed, given)), schemas.RELEASE_FIELDS)


def event_json(events: DataFrame, fields: Sequence[str]) -> Column:
    """Compact JSON of an event without its empty fields."""
    return F.to_json(F.struct(*[F.col(c) for c in fields if c in events.columns]))


def correlation_id(raw: str, event_key: Column) -> Column:
    """A safe id is kept, an unsafe one stripped, and one that cannot be saved replaced.

    The replacement is derived from the event, so a replay gives the same id.
    """
    value = F.coalesce(F.col(raw), F.lit(""))
    fresh = F.substring(F.sha2(event_key.cast("string").cast("binary"), 256), 1, 32)
    trimmed = F.substring(F.trim(value), 1, 64)
    stripped = F.substring(F.regexp_replace(trimmed, "[^A-Za-z0-9_-]", ""), 1, 64)
    return (
        F.when((value == "") | value.rlike(r"\p{Cntrl}"), fresh)
        .when(trimmed.rlike(r"^[A-Za-z0-9_-]{8,64}\z"), trimmed)
        .when(F.length(stripped) >= 8, stripped)
        .otherwise(fresh)
    )


def owned(events: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Rows whose owner and tenant are an entitled pair."""
    return events.join(entitlements, ["user_sub", "tenant_id"], "left_semi")


def tumbling_alerts(
    events: DataFrame, at: str, keys: Sequence[str], width: str, threshold: int,
    id_column: str = "correlation_id",
) -> DataFrame:
    """Windows of a key with more than ``threshold`` events and how many ids they hold.

    Counts are combined before the shuffle; ids are de-duplicated first, so the set of
    a flood is counted without being collected.
    """
    slot = F.window(F.col(at), width)
    per_id = events.groupBy(slot.alias("w"), *keys, id_column).agg(F.count(F.lit(1)).alias("c"))
    return per_id.groupBy("w", *keys).agg(
        F.sum("c").alias("n"), F.count(id_column).alias("n_ids")
    ).where(F.col("n") > threshold).select(
        F.col("w.start").alias("window_start"), *keys, "n", "n_ids"
    ).withColumn("severity", F.lit("high"))


def alert_ids(events: DataFrame, alerts: DataFrame, at: str, keys: Sequence[str], width: str, id_column: str = "correlation_id") -> DataFrame:
    """The distinct event ids behind each alert, one row each."""
    tagged = events.withColumn("window_start", F.window(F.col(at), width)["start"])
    return tagged.join(alerts.select("window_start", *keys), ["window_start", *keys], "left_semi").select(
        "window_start", *keys, id_column
    ).distinct()


def trailing_alerts(events: DataFrame, at: str, key: str, width_s: int, threshold: int) -> DataFrame:
    """Events whose key has more than ``threshold`` events in the trailing window."""
    micros = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    counted = trailing_count(micros, [key], "_us", width_s * 1_000_000, "n")
    return counted.where(F.col("n") > threshold).drop("_us")


def client_key(peer: str, forwarded: str, trusted: Sequence[str]) -> Column:
    """The forwarded address from a trusted peer when it is a valid one, else the peer."""
    first = F.trim(F.element_at(F.split(F.coalesce(F.col(forwarded), F.lit("")), ","), 1))
    peer_key = F.coalesce(F.col(peer), F.lit("unknown"))
    return F.when(peer_key.isin(*trusted) & first.rlike(IP_PATTERN), F.lower(first)).otherwise(peer_key)


def fixed_limit(events: DataFrame, key: str, at: str, event_id: str, limit: int, width_s: int = RATE_WINDOW_S) -> DataFrame:
    """Fixed buckets: every hit counts, the first ``limit`` of a bucket pass.

    Only the bucket's ``limit``-th hit is needed, so a flooded bucket is cut to that
    many rows before the shuffle and all hits are compared with it.
    """
    rows = events.withColumn("_slot", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(width_s * 1_000_000)))
    w = Window.partitionBy(key, "_slot").orderBy(at, event_id)
    last = rows.select(key, "_slot", at, event_id).withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= limit
    ).groupBy(key, "_slot").agg(F.max(F.struct(at, event_id)).alias("_last"))
    return join_keys(rows, last, [key, "_slot"]).withColumn(
        "allowed", F.struct(at, event_id) <= F.col("_last")
    ).drop("_slot", "_last")


def busy_runs(
    events: DataFrame, key: str, at_us: str, counts: Column, width_us: int, limit: int
) -> DataFrame:
    """Slots where a limit can be reached, joined into runs that need ordered replay.

    A slot is calm when it and the slot before it count at most ``limit``: nothing can
    be refused there. Runs of the other slots, each led by one calm slot that gives
    their starting state, are independent of each other.
    """
    slot = F.floor(F.col(at_us) / F.lit(width_us)).cast("long")
    per_slot = events.groupBy(key, slot.alias("slot")).agg(F.sum(counts.cast("long")).alias("n"))
    w = Window.partitionBy(key).orderBy("slot")
    before = F.when(F.lag("slot").over(w) == F.col("slot") - 1, F.lag("n").over(w)).otherwise(0)
    busy = per_slot.withColumn("busy", (F.col("n") + before) > limit).where("busy")
    starts = F.when(F.lag("slot").over(w) == F.col("slot") - 1, 0).otherwise(1)
    runs = busy.withColumn("run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = runs.groupBy(key, "run").agg((F.min("slot") - 1).alias("slot")).withColumn("own", F.lit(False))
    return runs.select(key, "run", "slot", F.lit(True).alias("own")).unionByName(lead.select(key, "run", "slot", "own"))


def _replay_limit(limit: int, width_us: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            allowed = []
            for k, run, at in zip(batch["key"], batch["run"], batch["at"]):
                if (k, run) != current:
                    current, log = (k, run), deque()
                while log and at - log[0] >= width_us:
                    log.popleft()
                ok = len(log) < limit
                if ok:
                    log.append(at)
                allowed.append(ok)
            yield pd.DataFrame({"event_id": batch["event_id"], "own": batch["own"], "allowed": allowed})

    return replay


def sliding_limit(
    events: DataFrame, key: str, at: str, event_id: str, limit: int = RATE_LIMIT, width_s: int = RATE_WINDOW_S
) -> DataFrame:
    """Sliding log: a hit passes while fewer than ``limit`` accepted hits are in the window.

    Hits outside busy runs all pass and are not replayed. A busy run streams through
    one task in time order with at most ``limit`` timestamps in memory.
    """
    width_us = width_s * 1_000_000
    rows = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    runs = busy_runs(rows, key, "_us", F.lit(1), width_us, limit)
    tagged = rows.withColumn("slot", F.floor(F.col("_us") / F.lit(width_us)).cast("long"))
    replay = tagged.join(runs, [key, "slot"], "inner").select(
        F.col(key).cast("string").alias("key"), "run", F.col("_us").alias("at"), F.col(event_id).alias("event_id"), "own"
    )
    kind = events.schema[event_id].dataType.simpleString()
    verdict = (
        replay.repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id")
        .mapInPandas(_replay_limit(limit, width_us), f"event_id {kind}, own boolean, allowed boolean")
        .where("own").select(F.col("event_id").alias(event_id), "allowed")
    )
    return events.join(verdict, event_id, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def _replay_lockout(attempts: int, width_us: int):
    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for batch in batches:
            outcome = []
            for k, run, at, ok in zip(batch["key"], batch["run"], batch["at"], batch["ok"]):
                if (k, run) != current:
                    current, log = (k, run), deque()
                while log and at - log[0] >= width_us:
                    log.popleft()
                if len(log) >= attempts:
                    outcome.append("locked")
                elif ok:
                    log.clear()
                    outcome.append("verified")
                else:
                    log.append(at)
                    outcome.append("failed")
            yield pd.DataFrame({"event_id": batch["event_id"], "own": batch["own"], "outcome": outcome})

    return replay


def lockout(
    attempts: DataFrame, key: str, at: str, event_id: str, succeeded: str,
    limit: int = LOCKOUT_ATTEMPTS, width_s: int = LOCKOUT_WINDOW_S,
) -> DataFrame:
    """Attempt outcomes: five failures in the window lock, a success clears.

    A slot whose failures, with those of the slot before, stay below the limit can
    lock nothing and needs no replay.
    """
    width_us = width_s * 1_000_000
    rows = attempts.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    failed = F.when(F.col(succeeded), 0).otherwise(1)
    runs = busy_runs(rows, key, "_us", failed, width_us, limit - 1)
    tagged = rows.withColumn("slot", F.floor(F.col("_us") / F.lit(width_us)).cast("long"))
    replay = tagged.join(runs, [key, "slot"], "inner").select(
        F.col(key).cast("string").alias("key"), "run", F.col("_us").alias("at"),
        F.col(event_id).alias("event_id"), "own", F.col(succeeded).alias("ok"),
    )
    kind = attempts.schema[event_id].dataType.simpleString()
    verdict = (
        replay.repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id")
        .mapInPandas(_replay_lockout(limit, width_us), f"event_id {kind}, own boolean, outcome string")
        .where("own").select(F.col("event_id").alias(event_id), "outcome")
    )
    calm = F.when(F.col(succeeded), F.lit("verified")).otherwise(F.lit("failed"))
    return attempts.join(verdict, event_id, "left").withColumn("outcome", F.coalesce("outcome", calm))


def revoked_tokens(events: DataFrame, revocations: DataFrame, token: str, at: str) -> DataFrame:
    """Events with whether their token was revoked at that time; no token counts as revoked.

    The latest expiry among the revocations made so far decides, so no pair of event
    and revocation is formed.
    """
    named = F.coalesce(F.col(token), F.lit("")) != ""
    have = events.where(named)
    scanned = prefix_max(have, revocations, [token], at, "revoked_at", "exp", "_exp", inclusive=True)
    judged = scanned.withColumn("revoked", F.coalesce(F.col("_exp") > F.col(at), F.lit(False))).drop("_exp")
    return judged.unionByName(events.where(~named).withColumn("revoked", F.lit(True)))
