"""Audit rules in batch and as streams, limits, revocation and streaming decode."""
from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.joins import revocations
from bindings.registry import CTES, query
from epochloom.functions import arrays
from epochloom.operators import audit, encoders
from epochloom.session import new_folder
from epochloom.sources import sinks
from epochloom.streaming import decode as stream_decode
from epochloom.streaming import detections, limits
from epochloom.streaming.runtime import drain, drain_arrivals, drain_batches, parquet_stream, table_stream


def stamp(col: str = "window_start") -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return v.audit_of(table_stream(spark, sf, "events.parquet", schema))


def late_arrivals(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The events as arrivals of twelve days in which rows come up to three days out of order, then a closing row.

    The closing row is an attempt long after all events. The watermark thus passes every event, and never the
    closing row itself.
    """
    dealt = new_folder(spark, "dealt")
    events = v.table(spark, sf, "events")
    date = F.floor(F.unix_timestamp("ts") / 86_400)
    day = date + F.col("event_id") % 4
    first, last, end = events.agg(F.min(date), F.max(day), F.max("ts")).first()
    if first is None:
        return [events]
    events.withColumn("_part", F.floor((day - F.lit(first)) / 12)).write.partitionBy("_part").parquet(dealt)
    rows = spark.read.schema(events.withColumn("_part", F.lit(0)).schema).parquet(dealt)
    closing = spark.createDataFrame([(-1, end + timedelta(days=400), -1, "click", 0.0, '{"k": 1}')], events.schema)
    return [rows.where(F.col("_part") == n).drop("_part") for n in range((last - first) // 12 + 1)] + [closing]


def late(spark: SparkSession, sf: str, judged: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``judged`` makes of the arriving audit events, restarted from its checkpoint at each arrival."""
    folder = new_folder(spark, "arriving")
    schema = v.table(spark, sf, "events").schema
    stream = lambda: judged(v.audit_of(parquet_stream(spark, folder, "*.parquet", schema)))
    return drain_arrivals(stream, late_arrivals(spark, sf), folder, label)


LATE = "4 days"

# the sliding log and the lockout, one event of every key a step
CTES["v_limited"] = """
WITH RECURSIVE e AS (SELECT user_sub, event_id, timestamp, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY user_sub ORDER BY timestamp, event_id) AS rn FROM v_audit),
r AS (SELECT user_sub, rn, event_id, timestamp, true AS allowed, [us] AS log FROM e WHERE rn = 1 UNION ALL
  SELECT user_sub, rn, event_id, timestamp, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, us) ELSE f END FROM (
    SELECT e.*, list_filter(r.log, lambda x: e.us - x < 172800000000) AS f FROM r JOIN e ON e.user_sub = r.user_sub AND e.rn = r.rn + 1))
SELECT event_id, timestamp, allowed FROM r"""
CTES["v_locked"] = """
WITH RECURSIVE e AS (SELECT user_sub, event_id, timestamp, event_type = 'mfa_verification_succeeded' AS ok, epoch_us(timestamp) AS us,
    row_number() OVER (PARTITION BY user_sub ORDER BY timestamp, event_id) AS rn FROM v_audit WHERE starts_with(event_type, 'mfa_')),
r AS (SELECT user_sub, rn, event_id, timestamp, CASE WHEN ok THEN 'verified' ELSE 'failed' END AS outcome, CASE WHEN ok THEN []::BIGINT[] ELSE [us] END AS log FROM e WHERE rn = 1 UNION ALL
  SELECT user_sub, rn, event_id, timestamp, CASE WHEN len(f) >= 2 THEN 'locked' WHEN ok THEN 'verified' ELSE 'failed' END,
    CASE WHEN len(f) >= 2 THEN f WHEN ok THEN []::BIGINT[] ELSE list_append(f, us) END FROM (
    SELECT e.*, list_filter(r.log, lambda x: e.us - x < 432000000000) AS f FROM r JOIN e ON e.user_sub = r.user_sub AND e.rn = r.rn + 1))
SELECT event_id, timestamp, outcome FROM r"""

R01_SQL = """
SELECT event_id, event_type, CASE WHEN length(c) >= 8 THEN c ELSE substr(sha256(event_id::VARCHAR), 1, 32) END AS correlation_id,
  CASE WHEN starts_with(event_type, 'dataset_') THEN '-' ELSE path END AS path, CASE WHEN starts_with(event_type, 'dataset_') THEN sha256(path) ELSE '-' END AS path_hash
FROM (SELECT *, replace(correlation_id, ' ', '') AS c FROM v_audit)"""


def normal_rows(events: DataFrame) -> DataFrame:
    return detections.normalised(events.withColumn("reason", F.col("event_id").cast("string")))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("reason").cast("long").alias("event_id"), "event_type", "correlation_id",
        F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("path_hash", F.lit("-")).alias("path_hash"),
    )


@query("r01_audit_normalise", R01_SQL)
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return shown(normal_rows(v.audit(spark, sf)))


@query("r01_audit_normalise_stream", R01_SQL)
def r01_stream(spark: SparkSession, sf: str) -> DataFrame:
    return shown(drain(normal_rows(event_stream(spark, sf)), "normalised"))


@query("s20_audit_sink", R01_SQL)
def s20(spark: SparkSession, sf: str) -> DataFrame:
    """The normalised stream written batch by batch, with a dead-letter folder beside it."""
    folder = new_folder(spark, "audit")
    rows = normal_rows(event_stream(spark, sf))
    drain_batches(rows, "audit", lambda batch, n: sinks.append_audit(batch, n, f"{folder}/events", f"{folder}/dead"))
    return shown(spark.read.schema(rows.schema).option("recursiveFileLookup", True).json(f"{folder}/events"))


@query("s20_dead_letters", """
SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'missing:event_type' WHEN event_id % 11 = 5 THEN 'missing:timestamp' ELSE 'written' END AS route FROM v_audit""")
def s20_dead(spark: SparkSession, sf: str) -> DataFrame:
    """Events without a type or time end among the dead letters, row by row; the rest of their batch is written."""
    folder = new_folder(spark, "audit")
    holed = event_stream(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 7 != 3, F.col("event_type"))).withColumn(
        "timestamp", F.when(F.col("event_id") % 11 != 5, F.col("timestamp"))
    )
    rows = normal_rows(holed)
    drain_batches(rows, "audit", lambda batch, n: sinks.append_audit(batch, n, f"{folder}/events", f"{folder}/dead"))
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{folder}/{name}")
    written = read("events", rows.schema).select(F.col("reason").cast("long").alias("event_id"), F.lit("written").alias("route"))
    dead = read("dead", "reason string, error string").select(F.col("reason").cast("long").alias("event_id"), F.col("error").alias("route"))
    return written.unionByName(dead)


RULES = {
    "r02_repeated_mfa_failures": ("event_type = 'mfa_verification_failed'", ["tenant_id", "user_sub"], "1 day", 1),
    "r03_unauthorised_bursts": ("event_type = 'api_request' AND status = 401", ["src_ip", "user_sub"], "5 days", 2),
    "r04_release_failures": (
        "event_type IN ('dataset_release_verification_failed', 'dataset_inventory_reconciliation_failed', 'dataset_upload_blocked')",
        ["user_sub", "dataset_id", "event_type"], "5 days", 3,
    ),
}
STREAMS = {
    "r02_repeated_mfa_failures": detections.repeated_mfa_failures,
    "r03_unauthorised_bursts": detections.unauthorised_bursts,
    "r04_release_failures": detections.release_failures,
}


def rule_sql(name: str, closed: bool) -> str:
    where, keys, width, threshold = RULES[name]
    listed = ", ".join(keys)
    end = f"AND w + INTERVAL '{width}' <= (SELECT max(timestamp) - INTERVAL '1 day' FROM v_audit WHERE {where})" if closed else ""
    return (
        f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, {listed}, n, n_ids, 'high' AS severity FROM ("
        f"SELECT time_bucket(INTERVAL '{width}', timestamp, TIMESTAMP '1970-01-01') AS w, {listed}, count(*) AS n, count(DISTINCT correlation_id) AS n_ids "
        f"FROM v_audit WHERE {where} GROUP BY ALL) WHERE n > {threshold} {end}"
    )


def register_rule(name: str) -> None:
    where, keys, width, threshold = RULES[name]

    @query(name, rule_sql(name, False))
    def batch(spark: SparkSession, sf: str) -> DataFrame:
        rows = audit.tumbling_alerts(v.audit(spark, sf).where(where), "timestamp", keys, width, threshold)
        return rows.withColumn("window_start", stamp())

    @query(f"{name}_stream", rule_sql(name, True))
    def stream(spark: SparkSession, sf: str) -> DataFrame:
        """Append mode gives the windows the final watermark has passed."""
        rows = STREAMS[name](event_stream(spark, sf), width=width, threshold=threshold, delay="1 day")
        return drain(rows, name).withColumn("window_start", stamp())


for _name in RULES:
    register_rule(_name)


@query("r02_alert_ids", f"""
SELECT strftime(time_bucket(INTERVAL '1 day', a.timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, a.tenant_id, a.user_sub, a.correlation_id FROM v_audit a
JOIN ({rule_sql('r02_repeated_mfa_failures', False)}) x ON x.window_start = strftime(time_bucket(INTERVAL '1 day', a.timestamp, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AND x.tenant_id = a.tenant_id AND x.user_sub = a.user_sub
WHERE a.event_type = 'mfa_verification_failed'""")
def r02_ids(spark: SparkSession, sf: str) -> DataFrame:
    where, keys, width, threshold = RULES["r02_repeated_mfa_failures"]
    events = v.audit(spark, sf).where(where)
    alerts = audit.tumbling_alerts(events, "timestamp", keys, width, threshold)
    return audit.alert_ids(events, alerts, "timestamp", keys, width).withColumn("window_start", stamp())


TRAILING = {"mfa": (RULES["r02_repeated_mfa_failures"][0], 2, 2), "unauthorised": (RULES["r03_unauthorised_bursts"][0], 5, 2), "release": (RULES["r04_release_failures"][0], 3, 4)}


@query("r05_trailing_rules", " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_sub ORDER BY timestamp RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) AS n FROM v_audit WHERE {where}) WHERE n > {limit}"
    for rule, (where, days, limit) in TRAILING.items()))
def r05(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for rule, (where, days, limit) in TRAILING.items():
        rows = audit.trailing_alerts(v.audit(spark, sf).where(where), "timestamp", "user_sub", days * 86_400, limit)
        part = rows.select(F.lit(rule).alias("rule"), "event_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("r05_sliding_stream", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, user_sub, n FROM (
  SELECT s, user_sub, count(*) AS n FROM (SELECT user_sub, time_bucket(INTERVAL '1 day', timestamp, TIMESTAMP '1970-01-01') - to_days(i::INT) AS s FROM v_audit, range(0, 3) r(i) WHERE event_type = 'mfa_verification_failed') GROUP BY 1, 2)
WHERE n > 2 AND s + INTERVAL 3 DAY <= (SELECT max(timestamp) - INTERVAL '1 day' FROM v_audit WHERE event_type = 'mfa_verification_failed')""")
def r05_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).where("event_type = 'mfa_verification_failed'")
    return drain(detections.sliding(rows, "timestamp", ["user_sub"], "3 days", "1 day", 2, "1 day"), "sliding").withColumn("window_start", stamp())


LIMIT, LIMIT_S = 3, 2 * 86_400


@query("r06_fixed_rate_limit", """
SELECT event_id, row_number() OVER (PARTITION BY user_sub, floor(epoch(timestamp) / 172800) ORDER BY timestamp, event_id) <= 3 AS allowed FROM v_audit""")
def r06_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return audit.fixed_limit(v.audit(spark, sf), "user_sub", "timestamp", "event_id", LIMIT, LIMIT_S).select("event_id", "allowed")


@query("r06_sliding_rate_limit", "SELECT event_id, allowed FROM v_limited")
def r06_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return audit.sliding_limit(v.audit(spark, sf), "user_sub", "timestamp", "event_id", LIMIT, LIMIT_S).select("event_id", "allowed")


@query("r06_sliding_rate_limit_stream", "SELECT event_id, CASE WHEN allowed THEN 'allowed' ELSE 'limited' END AS outcome FROM v_limited")
def r06_stream(spark: SparkSession, sf: str) -> DataFrame:
    judged = lambda rows: limits.sliding_limit_stream(rows, "user_sub", "timestamp", "event_id", LIMIT, LIMIT_S, LATE)
    return late(spark, sf, judged, "limited")


def attempts(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").startswith("mfa_")).withColumn("ok", F.col("event_type") == "mfa_verification_succeeded")


@query("r07_attempt_lockout", "SELECT event_id, outcome FROM v_locked")
def r07(spark: SparkSession, sf: str) -> DataFrame:
    return audit.lockout(attempts(v.audit(spark, sf)), "user_sub", "timestamp", "event_id", "ok", 2, 5 * 86_400).select("event_id", "outcome")


@query("r07_attempt_lockout_stream", "SELECT event_id, outcome FROM v_locked")
def r07_stream(spark: SparkSession, sf: str) -> DataFrame:
    judged = lambda rows: limits.lockout_stream(attempts(rows), "user_sub", "timestamp", "event_id", "ok", 2, 5 * 86_400, LATE)
    return late(spark, sf, judged, "lockout")


@query("r08_revoked_use_stream", """
SELECT event_id, CASE WHEN k = 0 THEN true ELSE EXISTS (SELECT 1 FROM v_revocations r WHERE r.token_id = a.token_id AND r.revoked_at <= a.timestamp AND a.timestamp < r.exp) END AS revoked
FROM v_audit a""")
def r08(spark: SparkSession, sf: str) -> DataFrame:
    """Late events and revocations; every event says whether its token was revoked, one without a token is."""

    def judged(rows: DataFrame) -> DataFrame:
        events = rows.withColumn("token_id", F.when(F.col("k") != 0, F.col("token_id")))
        return limits.revoked_stream(events, revocations(rows), "token_id", "timestamp", "event_id", LATE)

    return late(spark, sf, judged, "revoked")


CTES["v_peers"] = """
SELECT event_id, src_ip AS peer, CASE k % 4 WHEN 0 THEN '203.0.113.' || k || ', 10.9.9.9' WHEN 1 THEN '999.1.1.' || k WHEN 2 THEN '2001:db8::' || k ELSE '' END AS forwarded, k FROM v_audit"""


@query("r09_client_key", """
SELECT event_id, CASE WHEN starts_with(peer, '10.0.0.') AND k % 4 IN (0, 2) THEN trim(string_split(forwarded, ',')[1]) ELSE peer END AS client FROM v_peers""")
def r09(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    fwd = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("203.0.113."), k, F.lit(", 10.9.9.9"))).when(F.col("k") % 4 == 1, F.concat(F.lit("999.1.1."), k))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("2001:db8::"), k)).otherwise("")
    )
    rows = v.audit(spark, sf).select("event_id", F.col("src_ip").alias("peer"), fwd.alias("forwarded"))
    return rows.select("event_id", audit.client_key("peer", "forwarded", [f"10.0.0.{n}" for n in range(250)]).alias("client"))


@query("r10_streaming_anchors", """
SELECT epoch_id, rank, surface, round(dot, 6) AS dot FROM (SELECT e.epoch_id, surface, dot, row_number() OVER (PARTITION BY e.epoch_id ORDER BY dot DESC, pos)::INT AS rank FROM (
  SELECT m.epoch_id, surface, pos, list_dot_product(m.emb, vec) AS dot FROM (SELECT epoch_id, list(round_x ORDER BY i) AS emb FROM (
    SELECT epoch_id, i, x / (sqrt(sum(x * x) OVER (PARTITION BY epoch_id)) + 1e-8) AS round_x FROM n_raw) GROUP BY 1) m, g_vocab) e) WHERE rank <= 5""")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving vectors as epochs, encoded by the untrained projection and given their anchors."""
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    arriving = table_stream(spark, sf, "embeddings.parquet", schema).select(
        F.col("vec_id").alias("epoch_id"), arrays.reshape("embedding", 8, 8).alias("eeg")
    )
    model = encoders.random_projection(spark, v.WIDTH, 64)
    rows = stream_decode.anchors_stream(arriving, model, v.vocabulary(spark, sf), v.WIDTH)
    out = drain(rows, "anchors")
    return out.select("epoch_id", "rank", "surface", v.r6(F.col("score") * 2 - 1).alias("dot"))


@query("r10_streaming_decode")
def r10_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches through the whole decode job."""
    schema = spark.read.parquet(f"{sf}/embeddings.parquet").schema
    arriving = table_stream(spark, sf, "embeddings.parquet", schema).select(
        F.col("vec_id").alias("epoch_id"), arrays.reshape("embedding", 8, 8).alias("eeg")
    )
    onto = v.ontology(spark, sf)
    folder = new_folder(spark, "decoded")
    job = stream_decode.decode_batch(encoders.random_projection(spark, v.WIDTH, 64), v.vocabulary(spark, sf, onto), onto, v.WIDTH, folder)
    drain_batches(arriving, "decode", job)
    return spark.read.parquet(f"{folder}/decoded").select("epoch_id", "prompt_hash", "text", "anchor_count")


