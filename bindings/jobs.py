"""Composite jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.joins import batched, conversation_words, remote, upload_state
from bindings.predicates import CODE_LABELS
from bindings.registry import CTES, query
from bindings.scalars import governed
from bindings.scans import advisory_folder, sharded
from epochloom.functions.scale import attach_row
from epochloom.operators import encoders, epoching, release
from epochloom.operators.selection import strided_budget
from epochloom.plans import advisory_gate, decode, load_jobs, named_loads, train
from epochloom.plans import release as release_plan
from epochloom.plans.preprocess import CleaningConfig, preprocess_epochs
from epochloom.session import new_folder
from epochloom.sources import catalog, datasets, formats


@query("c01_preprocess_epochs")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    cfg = CleaningConfig(100.0, 10.0, 45.0, bad_epoch_threshold_uv=0.55, use_rejection=True, use_components=True, scope_cols=("subject_id",))
    return v.long_form(preprocess_epochs(v.epochs(spark, sf).select("epoch_id", "subject_id", "eeg"), cfg), "epoch_id", "mask_keep")


@query("c01_preprocess_mask_and_signal", v.sql_long("""
SELECT epoch_id, keep, list(list(d ORDER BY t) ORDER BY ch) AS eeg FROM (SELECT epoch_id, ch, keep, list(x - b ORDER BY t) AS d, 0 AS t FROM (
  SELECT *, first_value(x) OVER (PARTITION BY epoch_id, ch ORDER BY t) AS b FROM (
    SELECT *, r - avg(r) OVER (PARTITION BY epoch_id, ch) AS x FROM (
      SELECT epoch_id, ch, t, v - avg(v) OVER (PARTITION BY epoch_id, t) AS r, max(v) OVER (PARTITION BY epoch_id) - min(v) OVER (PARTITION BY epoch_id) < 55e-2 AS keep FROM v_long)))
  GROUP BY epoch_id, ch, keep) GROUP BY epoch_id, keep""", "epoch_id, keep AS mask_keep").replace("list(list(d ORDER BY t) ORDER BY ch)", "list(d ORDER BY ch)"))
def c01_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Reference, demeaning, baseline and the raw amplitude mask, without the solver steps."""
    cfg = CleaningConfig(apply_bandpass=False, bad_epoch_threshold_uv=0.55)
    return v.long_form(preprocess_epochs(v.epochs(spark, sf).select("epoch_id", "eeg"), cfg), "epoch_id", "mask_keep")


@query("c02_windowed_load", """
SELECT patient || ':' || epoch AS epoch_id, 'sub-' || repeat('0', greatest(0, 2 - length(patient::VARCHAR))) || patient AS subject_id, label, ch::INT AS ch, t::INT AS t, round(list_avg(list_transform(
    [s[t * 2 + 1], s[t * 2 + 2]], lambda r: CASE WHEN ch = 0 THEN (r.quantity + r.price) / 2e0 ELSE (r.discount + r.tax) / 2e0 END)), 9) AS v FROM (
  SELECT patient, epoch, min(label) AS label, list({'quantity': quantity::FLOAT::DOUBLE, 'price': price::FLOAT::DOUBLE, 'discount': discount::FLOAT::DOUBLE, 'tax': tax::FLOAT::DOUBLE} ORDER BY time) AS s FROM v_samples
  WHERE (patient, epoch) IN (SELECT (patient, epoch) FROM v_contract WHERE reason IS NULL) GROUP BY 1, 2),
  range(0, 2) rc(ch), range(0, 2) rt(t)""")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of four evenly spaced, singly labelled samples of all patients, pooled to 2 x 2."""
    rows = load_jobs.windowed_job(
        v.samples(spark, sf), v.SAMPLE_CHANNELS, expected=v.SAMPLE_EXPECTED, step=0.004, n_times=2, n_channels=2, strict=False
    )
    return v.long_form(rows, "epoch_id", "subject_id", "label", digits=9)


@query("c02_windowed_source_checks", """
SELECT count(*) AS n_epochs, count(DISTINCT patient) AS n_subjects FROM (SELECT patient, epoch FROM v_contract WHERE reason IS NULL)""")
def c02_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_jobs.windowed_job(v.samples(spark, sf), v.SAMPLE_CHANNELS, expected=v.SAMPLE_EXPECTED, step=0.004, n_times=2, n_channels=2, strict=False)
    return rows.agg(F.count(F.lit(1)).alias("n_epochs"), F.count_distinct(F.split("epoch_id", ":")[0]).alias("n_subjects"))


@query("c03_marker_locked_load", """
SELECT marker_id, label, ch::INT AS ch, t::INT AS t, round(avg(v), 6) AS v FROM (
  SELECT m.marker_id, m.trial_type AS label, s.ch, (s.sample_idx - m.start) // 2 AS t, s.v FROM (
    SELECT k.*, trunc(onset * 1e1)::BIGINT AS start, n_samples FROM v_markers k JOIN v_recordings USING (recording_id)) m
  JOIN v_signal s ON s.recording_id = m.recording_id AND s.sample_idx >= m.start AND s.sample_idx < m.start + 8 WHERE m.start + 8 <= m.n_samples) GROUP BY 1, 2, 3, 4""")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    """All markers cut from the user signals and pooled to four times, without solver steps."""
    idx = v.indexed_events(spark, sf)
    rows = load_jobs.continuous_job(v.signal(idx), v.recordings(idx), v.markers(idx), fs=v.FS, epoch_sec=0.8, n_channels=2, n_times=4, cfg=None)
    return v.long_form(rows, "marker_id", "label")


@query("c03_marker_locked_load_cleaned")
def c03_clean(spark: SparkSession, sf: str) -> DataFrame:
    idx = v.indexed_events(spark, sf)
    markers = v.markers(idx).withColumn("subject_id", F.col("recording_id").cast("string")).withColumn("session_id", F.col("subject_id"))
    rows = load_jobs.continuous_job(v.signal(idx), v.recordings(idx), markers, fs=v.FS, epoch_sec=0.8, n_channels=2, n_times=4)
    return v.long_form(rows, "marker_id", "label")


@query("c03_annotation_paired_load", """
SELECT marker_id, label, s.ch::INT AS ch, (s.sample_idx - m.start)::INT AS t, round(s.v, 6) AS v FROM (
  SELECT a.recording_id, a.marker_id, b.label, round_even(a.onset * 1e1, 0)::BIGINT AS start, n_samples FROM
    (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY onset, marker_id) AS i FROM v_markers) a
    JOIN (SELECT o_custkey AS recording_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) b USING (recording_id, i)
    JOIN v_recordings USING (recording_id)) m JOIN v_signal s ON s.recording_id = m.recording_id AND s.sample_idx >= m.start AND s.sample_idx < m.start + 5 WHERE m.start + 5 <= m.n_samples""")
def c03_paired(spark: SparkSession, sf: str) -> DataFrame:
    """Markers of a user paired with the orders of the customer of that number, by position."""
    idx = v.indexed_events(spark, sf)
    rows_of = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("label_no"))
    rows = load_jobs.paired_job(v.signal(idx), v.recordings(idx), v.markers(idx), rows_of, fs=v.FS, epoch_sec=0.5, n_channels=2, n_times=5, cfg=None)
    return v.long_form(rows, "marker_id", "label")


@query("c04_sentence_load")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as sentences over the signal of the user of that number, padded and cleaned."""
    # a recording is that of the sentence's number: the others have no sentence, and lengths need no numbering
    users = v.table(spark, sf, "conversations").select(F.col("conv_id").cast("int").cast("long").alias("user_id")).distinct()
    idx = v.indexed_events(spark, sf, users).withColumnRenamed("recording_id", "subject_id")
    signal = idx.select("subject_id", "sample_idx", F.posexplode(F.array("value", "k")).alias("ch", "v"))
    recordings = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.count(F.lit(1)).alias("n_samples"))
    words = conversation_words(spark, sf).withColumn("subject_id", F.col("sentence_id").cast("long"))
    spec = v.table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("int").alias("sentence_id")).agg(F.min_by("text", "turn").alias("text"))
    rows = load_jobs.sentence_job(signal, recordings, words, spec, fs=4.0, tmin=0.0, max_epoch_sec=4.0, n_channels=2, n_times=8)
    return v.long_form(rows.withColumn("label_hash", F.sha2(F.col("label").cast("binary"), 256)), "epoch_id", "stimulus_id", "label_hash")


@query("c05_coded_load", """
SELECT epoch_id, label, c::INT AS ch, t::INT AS t, round((eeg[c + 1][t * 2 + 1]::DOUBLE + eeg[c + 1][t * 2 + 2]::DOUBLE) / 2e0 * 1e6, 1) AS v FROM (
  SELECT epoch_id, eeg, (['up', 'down', 'right', 'left'])[segment + 1] AS label FROM v_epochs WHERE segment < 4), range(0, 8) rc(c), range(0, 4) rt(t)""")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-cut epochs by event code: four labels are mapped, the others dropped, volts made microvolts."""
    label = epoching.code_label(F.col("segment") + 31, CODE_LABELS)
    rows = load_jobs.coded_job(v.epochs(spark, sf).select("epoch_id", "segment", "eeg"), label, n_channels=8, n_times=4, scale=1e6)
    return v.long_form(rows, "epoch_id", "label").withColumn("v", F.round("v", 1))


@query("c05_nested_load", """
SELECT shard || ':' || rn AS epoch_id, label, shard, c::INT AS ch, t::INT AS t, round((eeg[c + 1][t * 2 + 1]::DOUBLE + eeg[c + 1][t * 2 + 2]::DOUBLE) / 2e0, 6) AS v FROM (
  SELECT 'train-' || lpad(segment::VARCHAR, 5, '0') AS shard, epoch_id AS rn, label, eeg FROM v_epochs), range(0, 8) rc(c), range(0, 4) rt(t)""")
def c05_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Nested epochs of all shards."""
    raw = sharded(spark, sf).select(
        F.col("label").alias("word"), F.concat(F.lit(" "), F.upper("label")).alias("topic"), F.lit("").alias("selected_topic"),
        F.col("subject_id").alias("participant"), "eeg", F.lit(1).cast("long").alias("semantic_relevance"), "shard", F.col("epoch_id").alias("row_index"),
    )
    rows = load_jobs.nested_job(raw, n_times=4)
    return v.long_form(rows.withColumn("shard", F.split("session_id", ":")[1]), "epoch_id", "label", "shard")


@query("c06_train_and_evaluate")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    reports, _ = train.train_report(v.featured(spark, sf), train.TrainConfig(width=v.WIDTH, ridge=1.0))
    return reports


@query("c07_train_block_protocol")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    cfg = train.TrainConfig(width=v.WIDTH, dim=16, ridge=1.0)
    block = train.block_report(v.featured(spark, sf), cfg, (7, 8, 9))
    loso = train.fold_local_report(v.featured(spark, sf), cfg)
    shown = ["strategy", "n_folds", "top1", "top5", "top25", *train.CONTROLS, "gate_pass", "skipped"]
    return block.select(*shown).unionByName(loso.select(*shown))


@query("c08_batch_decode")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    """Every epoch decoded by the untrained projection; results and rejects in one table."""
    onto = v.ontology(spark, sf)
    model = encoders.random_projection(spark, v.WIDTH, 64)
    good, bad = decode.decode(v.epochs(spark, sf).select("epoch_id", "eeg"), model, v.vocabulary(spark, sf, onto), onto, width=v.WIDTH)
    return good.select("epoch_id", F.lit("ok").alias("reason"), "prompt_hash", "text", "anchor_count").unionByName(
        bad.select("epoch_id", "reason", F.lit(None).cast("string").alias("prompt_hash"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("anchor_count"))
    )


@query("c08_override_decode", """
SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'vocabulary' WHEN s_suppkey % 7 = 0 THEN 'exactly-one-input' ELSE 'ok' END AS reason,
  CASE WHEN s_nationkey % 5 = 0 OR s_suppkey % 7 = 0 THEN '-' ELSE '[EEG-to-text] Anchors: NATION_' || s_nationkey || '. Subject: nation_' || s_nationkey || '.' END AS head FROM supplier""")
def c08_override(spark: SparkSession, sf: str) -> DataFrame:
    """Given anchors: a supplier's nation, an unknown surface for every fifth nation, no input at all for some."""
    onto = v.ontology(spark, sf)
    nation = F.col("s_nationkey").cast("string")
    surface = F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit("<no> "), nation)).otherwise(F.concat(F.lit("NATION_"), nation))
    given = F.array(F.struct(surface.alias("surface"), F.lit(0.9).alias("score"), F.lit(1).alias("rank")))
    none = (F.col("s_suppkey") % 7 == 0) & (F.col("s_nationkey") % 5 != 0)
    req = v.table(spark, sf, "supplier").select(
        "s_suppkey", F.lit(None).cast("array<array<float>>").alias("eeg"), F.when(~none, given).alias("anchors"),
    )
    model = encoders.random_projection(spark, v.WIDTH, 64)
    good, bad = decode.decode(req, model, v.vocabulary(spark, sf, onto), onto, "s_suppkey", width=v.WIDTH, override="anchors")
    head = F.regexp_extract("text", r"^[^.]*\. Subject: [^.]*\.", 0)
    return good.select("s_suppkey", F.lit("ok").alias("reason"), head.alias("head")).unionByName(bad.select("s_suppkey", "reason", F.lit("-").alias("head")))


def families(spark: SparkSession, sf: str) -> DataFrame:
    return governed(spark, sf).withColumn("family", F.concat(F.lit("src"), F.col("s_suppkey").cast("string")))


CTES["r_ok"] = """
SELECT 'src' || s_suppkey AS family FROM v_governed WHERE visibility IN ('public', 'private-team') AND license_status <> 'unknown' AND dua_status <> 'denied' AND custodian_status <> 'not_reviewed'
  AND deidentification_status <> 'unknown' AND trim(coalesce(approved_by, '')) <> '' AND coalesce(evidence_reference, '') <> ''"""
CTES["r_files"] = "SELECT * FROM v_files WHERE family IN (SELECT family FROM r_ok) AND lang <> 'es'"


@query("c09_release_plan", """
SELECT f.family, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_size_bytes, sha256(string_agg(path, chr(10) ORDER BY path)) AS scope_sha256, ((count(*) - 1) // 8 + 1)::BIGINT AS n_batches,
  (SELECT count(*) FROM v_files x WHERE x.family = f.family AND x.lang = 'es') AS n_excluded FROM r_files f GROUP BY f.family""")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as family files; Spanish ones are symlinks and so left out."""
    files = v.files(spark, sf)
    listing = files.select("family", "path", F.when(F.col("lang") == "es", "symlink").otherwise("file").alias("kind"), F.col("doc_id").alias("seq"))
    plan = release_plan.plan(families(spark, sf), listing, files.select("family", "path", "size_bytes", "sha256"), "family", 8)
    batches = plan.batches.groupBy("family").agg(F.count_distinct("batch_id").alias("n_batches"))
    left_out = plan.excluded.groupBy("family").agg(F.count(F.lit(1)).alias("n_excluded"))
    digests = plan.digests.select(F.col("key").alias("family"), F.col("sha256").alias("scope_sha256"))
    return plan.totals.join(digests, "family").join(batches, "family").join(left_out, "family", "left").withColumn("n_excluded", F.coalesce("n_excluded", F.lit(0)))


@query("c10_release_verify", """
SELECT p.family, count(*) AS file_count, CASE WHEN count_if(o.path IS NULL OR NOT o.readable OR o.sha256 <> p.sha256) + count_if(r.path IS NULL OR r.size_bytes <> p.size_bytes)
  + (SELECT count(*) FROM v_remote x WHERE x.family = p.family AND x.path NOT IN (SELECT path FROM v_files y WHERE y.family = p.family)) > 0 THEN 'failed' ELSE 'verified' END AS verification_status
FROM v_files p LEFT JOIN v_observed o ON o.family = p.family AND o.path = p.path LEFT JOIN v_remote r ON r.family = p.family AND r.path = p.path GROUP BY p.family""")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    files = v.files(spark, sf)
    findings = release_plan.verify(files, v.observed_files(spark, sf), remote(spark, sf), "family")
    return release_plan.verdict(findings, files, "family").select("family", "file_count", "verification_status")


@query("c10_resume_plan", """
SELECT family, batch_id, count(*) AS n_files FROM v_batched b WHERE NOT (
  EXISTS (SELECT 1 FROM v_state s WHERE s.family = b.family AND s.manifest_sha256 = b.manifest_sha256 AND s.batch_id = b.batch_id AND regexp_full_match(s.remote_revision, '[0-9a-f]{40}'))
  AND NOT EXISTS (SELECT 1 FROM v_batched x WHERE x.family = b.family AND x.batch_id = b.batch_id AND NOT EXISTS (SELECT 1 FROM v_remote r WHERE r.family = x.family AND r.path = x.path)))
GROUP BY 1, 2""")
def c10_resume(spark: SparkSession, sf: str) -> DataFrame:
    rows = batched(spark, sf)
    digests = rows.select("family", "manifest_sha256").distinct()
    return release_plan.resume(rows.drop("manifest_sha256"), digests, upload_state(rows), remote(spark, sf), "family").select("family", "batch_id", "n_files")


@query("c11_vulnerability_gate", """
SELECT count_if(o AND upper(severity) = 'CRITICAL')::BIGINT AS critical, count_if(o AND kev)::BIGINT AS exploited, count(*) AS records,
  count_if(o AND upper(severity) = 'CRITICAL') = 0 AND count_if(o AND kev) = 0 AS passes, count_if(o AND (upper(severity) = 'CRITICAL' OR kev))::BIGINT AS n_unresolved
FROM (SELECT *, lower(coalesce(status, 'open')) NOT IN ('remediated', 'resolved', 'closed', 'accepted') AS o FROM v_cve)""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    found, counts = advisory_gate.gate(spark, advisory_folder(spark, sf))
    return attach_row(counts, found.agg(F.count(F.lit(1)).alias("n_unresolved")))


@query("u03_dataset_registry", """
SELECT shard AS family, count(*) AS n_rows, sha256(string_agg(shard || '/' || epoch_id, chr(10) ORDER BY shard || '/' || epoch_id)) AS manifest_sha256 FROM (
  SELECT 'train-' || lpad(segment::VARCHAR, 5, '0') AS shard, epoch_id FROM v_epochs) GROUP BY 1""")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by name: each shard is registered, resolved and read with its lineage."""
    rows = sharded(spark, sf)
    digests = release.scope_digest(rows.select(F.col("shard").alias("family"), F.concat_ws("/", "shard", F.col("epoch_id").cast("string")).alias("path_posix")), "family")
    registry = datasets.Registry()
    registry.register("shards", lambda s: (rows, digests))
    data, lineage = registry.resolve("shards", spark)
    return data.groupBy(F.col("shard").alias("family")).agg(F.count(F.lit(1)).alias("n_rows")).join(
        lineage.select(F.col("key").alias("family"), F.col("sha256").alias("manifest_sha256")), "family"
    )


def manifest_of(spark: SparkSession, folder: str, dataset_id: str, labels: list[str], channels: int, times: int) -> DataFrame:
    """A pinned manifest of the files below a folder, from their stored bytes."""
    formats.register(spark)
    name = F.substring_index("path", folder.removeprefix("file:") + "/", -1).alias("path")
    shard = F.struct(name, "size_bytes", "sha256")
    return spark.read.format("file_digests").load(folder).agg(F.sort_array(F.collect_list(shard)).alias("shards")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit("local").alias("provider"), F.lit("r1").alias("revision"), F.lit("table").alias("format"),
        F.lit(250.0).alias("sampling_rate_hz"), F.lit(channels).alias("n_channels_source"), F.lit(times).alias("n_times_source"),
        F.array(*map(F.lit, labels)).alias("labels"), F.lit("subject").alias("subject_field"), F.lit("session").alias("session_field"), "shards",
    )


@query("u03_labelled_loads", """
SELECT 'nested' AS dataset_id, 'local' AS provider, 'r1' AS revision, 'verified' AS mode, 'nested:topic' AS source, 'nested-parquet' AS format, label,
  count(*) AS n_epochs, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_described, true AS pinned FROM v_epochs GROUP BY label
UNION ALL SELECT 'windowed', 'local', 'r1', 'verified', 'windowed:samples', 'csv-windowed', label, count(*), count(DISTINCT patient), count(*), true FROM (
  SELECT patient, epoch, min(label) AS label FROM v_samples WHERE (patient, epoch) IN (SELECT (patient, epoch) FROM v_contract WHERE reason IS NULL) GROUP BY 1, 2) GROUP BY label""")
def u03_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Two load jobs by name over written files: manifest and stored bytes are verified, epochs carry what they come from."""
    nested, sampled, pinned = (new_folder(spark, name) for name in ("nested", "windowed", "pins"))
    v.epochs(spark, sf).select(
        F.col("label").alias("word"), F.concat(F.lit(" "), F.upper("label")).alias("topic"), F.lit("").alias("selected_topic"),
        F.col("subject_id").alias("participant"), "eeg", F.lit(1).cast("long").alias("semantic_relevance"),
    ).write.parquet(nested)
    v.samples(spark, sf).write.option("header", True).csv(sampled)
    manifest_of(spark, nested, "nested", ["topic"], 8, 8).unionByName(
        manifest_of(spark, sampled, "windowed", ["left", "right", "foot"], len(v.SAMPLE_CHANNELS), v.SAMPLE_EXPECTED)
    ).write.json(pinned)
    registry = datasets.Registry()
    manifests = lambda s: catalog.manifest_documents(s, pinned, multi_line=False)
    named_loads.register(registry, "nested", named_loads.nested_load("nested:topic", n_times=4), path=nested, manifests=manifests, dataset_id="nested")
    windowed = named_loads.windowed_load("windowed:samples", v.SAMPLE_CHANNELS, expected=v.SAMPLE_EXPECTED, n_times=2, n_channels=2, strict=False)
    named_loads.register(registry, "windowed", windowed, path=sampled, manifests=manifests, dataset_id="windowed", aliases=("samples",))
    described = (F.col("metadata.label") == F.col("label")) & (F.col("metadata.subject_id") == F.col("subject_id")) & (F.col("metadata.session_id") == F.col("session_id"))

    def summary(name: str) -> DataFrame:
        rows, _ = registry.resolve(name, spark)
        keys = [F.col(f"lineage.{c}").alias(c) for c in ("dataset_id", "provider", "revision", "mode")]
        return rows.groupBy(*keys, "source", F.col("metadata.format").alias("format"), "label").agg(
            F.count(F.lit(1)).alias("n_epochs"), F.count_distinct("subject_id").alias("n_subjects"), F.count_if(described).alias("n_described"),
            F.bool_and(F.length("lineage.manifest_sha256") == 64).alias("pinned"),
        )

    return summary("nested").unionByName(summary("samples"))


@query("u04_cleaning_strategies", """
SELECT 'none' AS stages, count(*) AS n_kept FROM v_epochs UNION ALL SELECT 'mask', count(*) FROM (SELECT epoch_id FROM v_long GROUP BY 1 HAVING max(v) - min(v) < 55e-2)
UNION ALL SELECT 'mask+reject', count(*) FROM (SELECT epoch_id FROM v_long GROUP BY 1 HAVING max(v) - min(v) < 55e-2) JOIN (SELECT epoch_id, avg(CASE WHEN z > 4e0 THEN 1e0 ELSE 0e0 END) AS bad FROM v_z GROUP BY 1) USING (epoch_id) WHERE bad <= 25e-2""")
def u04(spark: SparkSession, sf: str) -> DataFrame:
    """Stages chosen by flags; nothing is filtered, so the raw signal feeds the rejection."""
    ep = v.epochs(spark, sf).select("epoch_id", "subject_id", "eeg")
    base = dict(apply_bandpass=False, reference="none", detrend=False, use_baseline=False, scope_cols=("subject_id",))
    part = lambda name, cfg: preprocess_epochs(ep, cfg).agg(F.lit(name).alias("stages"), F.count_if("mask_keep").alias("n_kept"))
    return (
        part("none", CleaningConfig(bad_epoch_threshold_uv=1e9, **base)).unionByName(part("mask", CleaningConfig(bad_epoch_threshold_uv=0.55, **base)))
        .unionByName(part("mask+reject", CleaningConfig(bad_epoch_threshold_uv=0.55, use_rejection=True, **base)))
    )


@query("u05_marker_budget_function", """
SELECT family, path FROM (SELECT family, path, row_number() OVER (PARTITION BY family ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM v_files)
WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda k: trunc(k * (n / 7e0))::BIGINT), i)""")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    """The strided budget is a plain table function: here over files instead of markers."""
    return strided_budget(v.files(spark, sf).select("family", "path"), ["family"], ["path"], 7)
