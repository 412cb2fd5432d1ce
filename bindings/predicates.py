"""Projections, filters and predicates."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.registry import CTES, query
from bindings.scans import advisories_of, page_paths
from epochloom.functions import arrays, paths
from epochloom.operators import audit, epoching, graph, release, supply
from epochloom.plans import decode
from epochloom.plans.load_jobs import sample_violations
from epochloom.sources.readers import label_with_fallback

CTES["v_fields"] = """
SELECT doc_id, CASE WHEN quality = 1 THEN lang WHEN quality = 0 THEN '  ' END AS topic, source AS selected_topic,
  CASE WHEN coalesce(toxic, 0) = 0 THEN '  ' || upper(lang) || '-Word ' END AS word FROM documents LEFT JOIN labels USING (doc_id)"""


def fields(spark: SparkSession, sf: str) -> DataFrame:
    lab = v.table(spark, sf, "labels")
    return v.table(spark, sf, "documents").join(lab, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, "  ").alias("topic"),
        F.col("source").alias("selected_topic"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, F.concat(F.lit("  "), F.upper("lang"), F.lit("-Word "))).alias("word"),
    )


@query("p01_label_fallback", """
SELECT * FROM (SELECT doc_id, coalesce(nullif(lower(trim(topic)), ''), nullif(lower(trim(word)), ''), nullif(lower(trim(topic)), '')) AS label FROM v_fields)
WHERE label IS NOT NULL""")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return fields(spark, sf).select("doc_id", label_with_fallback("topic").alias("label")).where(F.col("label").isNotNull())


@query("p02_relevance_filter", "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 1")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    return rows.where(F.coalesce("quality", F.lit(0)) == 1).select("doc_id", "lang")


CTES["v_broken"] = """
SELECT epoch_id, CASE segment WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN [eeg[1], eeg[2][1:3]] WHEN 3 THEN [[]::FLOAT[]] ELSE eeg END AS eeg, segment FROM v_epochs"""


def broken_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs of four labels given a missing, empty, ragged or time-less shape."""
    seg = F.col("segment")
    none = F.lit(None).cast("array<array<float>>")
    bad = (
        F.when(seg == 0, none).when(seg == 1, F.array().cast("array<array<float>>"))
        .when(seg == 2, F.array(F.col("eeg")[0], F.slice(F.col("eeg")[1], 1, 3)))
        .when(seg == 3, F.array(F.array().cast("array<float>"))).otherwise(F.col("eeg"))
    )
    return v.epochs(spark, sf).select("epoch_id", bad.alias("eeg"), "segment")


@query("p03_valid_shape", "SELECT epoch_id FROM v_broken WHERE segment > 3")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    return broken_epochs(spark, sf).where(arrays.is_epoch("eeg")).select("epoch_id")


@query("p04_marker_label", """
SELECT event_id, label FROM (SELECT event_id, coalesce(nullif(CASE WHEN event_type <> 'view' THEN event_type END, ''), nullif(v, ''), 'event') AS label, v
  FROM (SELECT event_id, event_type, CASE WHEN (props->>'$.k')::INT > 90 THEN '65480' WHEN (props->>'$.k')::INT > 40 THEN props->>'$.k' END AS v FROM events))
WHERE label NOT IN ('65480', '65481', 'event_65480', 'event_65481') AND coalesce(v, '') NOT IN ('65480', '65481', 'event_65480', 'event_65481')""")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = v.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("trial_type"),
        F.when(k > 90, "65480").when(k > 40, k.cast("string")).alias("value"),
    )
    return epoching.usable_markers(rows).select("event_id", "label")


CODE_LABELS = {31: "up", 32: "down", 33: "right", 34: "left"}


@query("p05_event_code_map", """
SELECT event_id, (['up', 'down', 'right', 'left'])[(props->>'$.k')::INT - 30] AS label FROM events WHERE (props->>'$.k')::INT BETWEEN 31 AND 34""")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    code = F.get_json_object("props", "$.k").cast("int")
    return v.table(spark, sf, "events").select("event_id", epoching.code_label(code, CODE_LABELS).alias("label")).where(F.col("label").isNotNull())


@query("p06_one_hot_label", """
SELECT epoch_id, CASE WHEN i < 4 THEN (['helpme', 'hello', 'stop', 'yes'])[i + 1] ELSE (['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'])[i + 1] END AS label
FROM (SELECT epoch_id, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS i FROM v_epochs)""")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Help Me", "Hello", "STOP", "yes")])
    label = epoching.one_hot_label(F.slice("embedding", 1, 8), names, "abcdefgh")
    return v.epochs(spark, sf).select("epoch_id", label.alias("label"))


@query("p07_identity_derivation", """
SELECT o_orderkey, 'sub-' || repeat('0', greatest(0, 2 - length(o_custkey::VARCHAR))) || o_custkey AS subject_id,
  'sub-' || repeat('0', greatest(0, 2 - length(o_custkey::VARCHAR))) || o_custkey || ':epoch-' || repeat('0', greatest(0, 3 - length(o_orderkey::VARCHAR))) || o_orderkey AS session_id,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderkey::INT END::VARCHAR AS run FROM orders""")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    subject = paths.numbered("sub-", "o_custkey", 2)
    name = F.concat(F.lit("sub-02"), F.when(F.col("o_orderstatus") == "F", "_rest_").otherwise(
        F.concat(F.lit("_run-00"), F.col("o_orderkey").cast("string"), F.lit("_"))), F.lit("eeg.edf"))
    return v.table(spark, sf, "orders").select(
        "o_orderkey", subject.alias("subject_id"),
        F.concat(subject, F.lit(":"), paths.numbered("epoch-", "o_orderkey", 3)).alias("session_id"),
        paths.run_number(name).cast("string").alias("run"),
    )


@query("p08_unit_scale", v.sql_long(
    "SELECT epoch_id, list_transform(eeg, lambda r: list_transform(r, lambda x: x::DOUBLE * 1e6)) AS eeg FROM v_epochs", "epoch_id"))
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return v.long_form(v.epochs(spark, sf).select("epoch_id", arrays.scale("eeg", 1e6).alias("eeg")), "epoch_id")


@query("p09_input_contract", """
SELECT epoch_id, CASE WHEN segment IN (0, 4) THEN 'exactly-one-input' WHEN segment IN (1, 2, 3) THEN 'shape'
  WHEN segment = 5 THEN 'not-finite' WHEN segment = 6 THEN 'dimensions' ELSE 'ok' END AS reason FROM v_epochs""")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    """Missing, empty, ragged, time-less, doubly given, non-finite and oversized requests."""
    seg = F.col("segment")
    nan = F.transform("eeg", lambda r: F.transform(r, lambda _: F.lit(float("nan")).cast("float")))
    wide = F.flatten(F.array_repeat(F.col("eeg"), 9))
    rows = broken_epochs(spark, sf).withColumn("eeg", F.when(seg == 5, nan).when(seg == 6, wide).otherwise(F.col("eeg")))
    given = F.when(seg == 4, F.array(F.struct(F.lit("x").alias("surface"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))))
    rows = rows.withColumn("anchors", given)
    return rows.select("epoch_id", F.coalesce(decode.input_violation("eeg", "anchors"), F.lit("ok")).alias("reason"))


@query("p10_sample_contract", """
SELECT patient, epoch, round(time, 6) AS time, CASE WHEN patient IS NULL THEN 'key' ELSE 'label' END AS reason, count(*) AS n
FROM v_samples WHERE patient IS NULL OR label NOT IN ('left', 'right') GROUP BY ALL""")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    bad = sample_violations(v.samples(spark, sf), ("left", "right"))
    return bad.groupBy("patient", "epoch", v.r6("time").alias("time"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("p11_extension_allowlist", r"""
SELECT page_id, path, len(ext) = 1 AND list_contains(['.bdf', '.edf', '.fif', '.parquet', '.npy', '.npz', '.csv'], coalesce(ext[1], '')) AS ok FROM (
  SELECT page_id, path, regexp_extract_all(regexp_replace(string_split(lower(path), '/')[-1], '^\.+', ''), '\.[^.]*') AS ext FROM (
    SELECT page_id, regexp_replace(path, '[/?#].*', '') || (['.edf', '.csv.exe', '.CSV', '', '.npy'])[page_id % 5 + 1] AS path FROM (
      SELECT page_id, replace(replace(replace(url, 'http://', ''), 'https://', ''), '.', '_') AS path FROM pages)))""")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.replace(F.replace(F.replace("url", F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), F.lit("."), F.lit("_"))
    suffix = F.get(F.array(*[F.lit(s) for s in (".edf", ".csv.exe", ".CSV", "", ".npy")]), (F.col("page_id") % 5).cast("int"))
    rows = v.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace(bare, "[/?#].*", ""), suffix).alias("path"))
    return rows.select("page_id", "path", F.coalesce(paths.has_allowed_extension("path"), F.lit(False)).alias("ok"))


@query("p12_path_traversal", """
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'traversal' WHEN 2 THEN 'traversal' WHEN 3 THEN 'traversal' WHEN 4 THEN 'encoded-traversal' ELSE 'ok' END AS reason FROM pages""")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    """Plain, backslash, encoded and many-times encoded parent segments put into page paths."""
    heads = ("", "a/../", "a\\..\\", "%2e%2e/", "%252525252e%252525252e%252525252f", "a..b/")
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 6).cast("int"))
    rows = page_paths(spark, sf).select("page_id", F.concat(head, F.col("path")).alias("path"))
    return rows.select("page_id", F.coalesce(paths.traversal_reason("path"), F.lit("ok")).alias("reason"))


@query("p13_audit_allowlist", """
SELECT event_id, '{"event_type":"' || event_type || '","correlation_id":"' || correlation_id || '","user_sub":"' || user_sub
  || '","dataset_id":"' || dataset_id || '","path_hash":"' || sha256(path) || '"}' AS body FROM v_audit WHERE starts_with(event_type, 'dataset_')""")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.audit(spark, sf).where(F.col("event_type").startswith("dataset_")).withColumn("reason", F.lit(None).cast("string"))
    kept = audit.release_events(rows.withColumn("secret", F.lit("x")))
    shown = [c for c in kept.columns if c != "timestamp"]
    packed = rows.select("event_id", "correlation_id").join(kept, "correlation_id")
    return packed.select("event_id", audit.event_json(packed, [c for c in ("event_type", "correlation_id", "user_sub", "dataset_id", "path_hash", "reason") if c in shown]).alias("body"))


@query("p14_hash_list_bound", """
SELECT doc_id, pos, h FROM (SELECT doc_id, unnest(range(0, 2))::INT AS pos, unnest([substr(sha256(text) || sha256(lang), 1, 64), lang]) AS h FROM documents)""")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    hashes = F.array(F.concat(F.sha2(F.col("text").cast("binary"), 256), F.sha2(F.col("lang").cast("binary"), 256)), F.lit(None).cast("string"), F.col("lang"))
    rows = v.table(spark, sf, "documents").select("doc_id", hashes.alias("hashes"))
    return rows.select("doc_id", F.posexplode(audit.bounded_hashes("hashes")).alias("pos", "h"))


@query("p15_correlation_id", r"""
SELECT event_id, CASE WHEN raw = '' OR regexp_matches(raw, '[\x00-\x1f\x7f]') THEN fresh
  WHEN regexp_full_match(substr(trim(raw), 1, 64), '[A-Za-z0-9_-]{8,64}') THEN substr(trim(raw), 1, 64)
  WHEN length(clean) >= 8 THEN clean ELSE fresh END AS correlation_id FROM (
  SELECT event_id, raw, substr(sha256(event_id::VARCHAR), 1, 32) AS fresh, regexp_replace(substr(trim(raw), 1, 64), '[^A-Za-z0-9_-]', '', 'g') AS clean FROM (
    SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN 'bad' || chr(10) || 'line-12345' WHEN 'click' THEN 'request-' || event_id ELSE 'corr ' || event_id END AS raw FROM events))""")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id").cast("string")
    raw = (
        F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "bad\nline-12345")
        .when(F.col("event_type") == "click", F.concat(F.lit("request-"), eid)).otherwise(F.concat(F.lit("corr "), eid))
    )
    rows = v.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", audit.correlation_id("raw", F.col("event_id")).alias("correlation_id"))


REVISION_SQL = "CASE lang WHEN 'en' THEN substr(sha256(text), 1, 40) WHEN 'de' THEN 'Main' WHEN 'fr' THEN '' ELSE 'v1' END"


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    rev = (
        F.when(F.col("lang") == "en", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 40))
        .when(F.col("lang") == "de", "Main").when(F.col("lang") == "fr", "").otherwise("v1")
    )
    return v.table(spark, sf, "documents").select("doc_id", "lang", "source", rev.alias("revision"))


@query("p16_immutable_revision", f"""
SELECT doc_id, r <> '' AND lower(r) NOT IN ('main', 'master', 'latest', 'head', 'default') AS pinned,
  regexp_full_match(lower(r), '[0-9a-f]{{40}}') AND lower(r) NOT IN ('main', 'master', 'latest', 'head', 'default') AS commit
FROM (SELECT doc_id, {REVISION_SQL} AS r FROM documents)""")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    return revisions(spark, sf).select(
        "doc_id", release.immutable_revision("revision").alias("pinned"),
        release.immutable_revision("revision", F.lit(True)).alias("commit"),
    )


@query("p17_secret_scan", """
SELECT doc_id, key_path, reason FROM (
  SELECT doc_id, '/text' AS key_path, CASE WHEN contains(text, 'BEGIN PRIVATE KEY') OR contains(text, 'BEGIN RSA PRIVATE KEY') OR contains(text, 'BEGIN OPENSSH PRIVATE KEY') THEN 'private-key'
    WHEN starts_with(text, '/') OR starts_with(text, chr(92)) OR regexp_matches(text, '^[A-Za-z]:') THEN 'absolute-path' END AS reason FROM documents
  UNION ALL SELECT doc_id, '/inner/' || CASE lang WHEN 'de' THEN 'hub_token' ELSE 'note' END, CASE WHEN lang = 'de' THEN 'secret-key' END FROM documents
  UNION ALL SELECT doc_id, '/inner/list/1', CASE WHEN lang = 'fr' THEN 'absolute-path' END FROM documents)
WHERE reason IS NOT NULL""")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents")
    inner = lambda name: F.to_json(F.struct(
        F.col("text"), F.struct(
            F.col("source").alias(name), F.array(F.lit("x"), F.when(F.col("lang") == "fr", "/data/root").otherwise("data")).alias("list")
        ).alias("inner"),
    ))
    body = F.when(F.col("lang") == "de", inner("hub_token")).otherwise(inner("note"))
    strings = release.config_strings(docs.select("doc_id", body.alias("json")), "doc_id", "json")
    return release.secret_violations(strings, "doc_id")


@query("p18_record_contract", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'es' THEN 'path' END, CASE WHEN size_bytes < 500 THEN 'size' END,
  CASE WHEN lang = 'fr' THEN 'sha256' END, CASE WHEN lang = 'de' THEN 'provider' END], lambda x: x IS NOT NULL), ',') AS violations FROM v_files""")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    rows = v.files(spark, sf).select(
        "doc_id", F.when(lang == "es", F.concat(F.lit("a/../"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("size_bytes") < 500, -1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(lang == "fr", F.substring("sha256", 1, 63)).otherwise(F.upper("sha256")).alias("sha256"),
        F.when(lang == "de", "ftp").otherwise("local").alias("provider"),
    )
    return release.record_violations(rows).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("p19_ownership_filter", """
SELECT event_id, user_sub FROM v_audit WHERE (user_sub, tenant_id) IN (SELECT 'user-' || c_custkey, 'tenant-' || (c_nationkey % 7) FROM customer)""")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    entitled = v.table(spark, sf, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_sub"),
        F.concat(F.lit("tenant-"), (F.col("c_nationkey") % 7).cast("string")).alias("tenant_id"),
    )
    return audit.owned(v.audit(spark, sf), entitled).select("event_id", "user_sub")


@query("p20_anchor_threshold", """
SELECT epoch_id, surface, round(score, 6) AS score, rank, CASE WHEN rank = 2 AND score >= 5.5e-1 THEN 'provenance' ELSE 'ok' END AS verdict
FROM v_anchors WHERE score >= 5.5e-1""")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    """The second anchor of every epoch loses its signal provenance."""
    rows = v.anchors(spark, sf).withColumn("provenance", F.when(F.col("rank") == 2, F.array(F.lit("kg:x"))).otherwise(
        F.concat("provenance", F.array(F.lit("kg:x")))))
    kept = graph.usable_anchors(rows, 0.55).withColumn("verdict", F.lit("ok"))
    broken = rows.withColumn("verdict", graph.anchor_violations(0.55)).where(F.col("verdict").isNotNull())
    columns = ["epoch_id", "surface", v.r6("score").alias("score"), "rank", "verdict"]
    return kept.select(*columns).unionByName(broken.select(*columns))


@query("p21_unresolved_advisories", """
SELECT doc_id, upper(severity) = 'CRITICAL' AS critical, kev AS exploited FROM v_cve
WHERE lower(coalesce(status, 'open')) NOT IN ('remediated', 'resolved', 'closed', 'accepted') AND (upper(severity) = 'CRITICAL' OR kev)""")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    return supply.unresolved(advisories_of(spark, sf)).select("doc_id", "critical", "exploited")
