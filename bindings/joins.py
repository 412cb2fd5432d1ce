"""Joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.registry import CTES, query
from epochloom.operators import audit, epoching, release, retrieval, selection, splits
from epochloom.plans import decode

CUT_SQL = """
SELECT m.recording_id, m.marker_id, s.ch::INT AS ch, (s.sample_idx - m.start)::INT AS t, round(s.v, 6) AS v FROM (
  SELECT m.*, r.n_samples FROM ({windows}) m JOIN v_recordings r USING (recording_id)
  WHERE start >= 0 AND stop > start AND stop <= n_samples) m
JOIN v_signal s ON s.recording_id = m.recording_id AND s.sample_idx >= m.start AND s.sample_idx < m.stop"""


def cut(spark: SparkSession, sf: str, bounds, pad_to: int | None = None) -> DataFrame:
    idx = v.indexed_events(spark, sf)
    inside = epoching.drop_outside(bounds(v.markers(idx)), v.recordings(idx), "recording_id")
    ep = epoching.cut_epochs(v.signal(idx), inside, "recording_id", "marker_id", bucket=16, pad_to=pad_to)
    return v.long_form(ep, "recording_id", "marker_id")


@query("j01_event_locked_epochs", CUT_SQL.format(
    windows="SELECT *, trunc(onset * 1e1)::BIGINT AS start, trunc(onset * 1e1)::BIGINT + 8 AS stop FROM v_markers"))
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return cut(spark, sf, lambda m: epoching.windows(m, "onset", F.lit(v.FS), F.lit(8)))


@query("j02_prestimulus_padded_epochs", """
SELECT recording_id, marker_id, c::INT AS ch, t::INT AS t, round(coalesce(s.v, 0e0), 6) AS v FROM (
  SELECT m.*, n_samples FROM (SELECT *, round_even((onset - 2e-1) * 1e1, 0)::BIGINT AS start,
    round_even(least(onset + 5e-1, onset + (marker_id % 5) / 1e1 + 1e-1) * 1e1, 0)::BIGINT AS stop FROM v_markers) m JOIN v_recordings USING (recording_id)
  WHERE start >= 0 AND stop > start AND stop <= n_samples) m CROSS JOIN range(0, 2) rc(c) CROSS JOIN range(0, 7) rt(t)
LEFT JOIN v_signal s USING (recording_id) WHERE s.ch = c AND s.sample_idx = start + t AND start + t < stop
UNION ALL SELECT recording_id, marker_id, c::INT, t::INT, 0e0 FROM (
  SELECT m.*, n_samples FROM (SELECT *, round_even((onset - 2e-1) * 1e1, 0)::BIGINT AS start,
    round_even(least(onset + 5e-1, onset + (marker_id % 5) / 1e1 + 1e-1) * 1e1, 0)::BIGINT AS stop FROM v_markers) m JOIN v_recordings USING (recording_id)
  WHERE start >= 0 AND stop > start AND stop <= n_samples) m CROSS JOIN range(0, 2) rc(c) CROSS JOIN range(0, 7) rt(t) WHERE start + t >= stop""")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of different length from 0.2 s before the marker, padded to seven samples."""
    stop = F.least(F.col("onset") + 0.5, F.col("onset") + (F.col("marker_id") % 5) / F.lit(10.0) + F.lit(0.1))
    return cut(spark, sf, lambda m: epoching.windows(m, "onset", F.lit(v.FS), None, tmin=-0.2, stop_at=stop, rounded=True), pad_to=7)


@query("j03_annotation_locked_epochs", CUT_SQL.format(
    windows="SELECT *, round_even((onset + 3e-1) * 1e1, 0)::BIGINT AS start, round_even((onset + 3e-1) * 1e1, 0)::BIGINT + 5 AS stop FROM v_markers"))
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return cut(spark, sf, lambda m: epoching.windows(m, "onset", F.lit(v.FS), F.lit(5), tmin=0.3, rounded=True))


@query("j04_stem_match", """
SELECT o_orderkey, 'order-' || o_orderkey AS stem FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c, end: F.concat(F.lit("order-"), F.col(c).cast("string"), F.lit(end)).alias("name")
    rec = v.table(spark, sf, "orders").select("o_orderkey", name("o_orderkey", "_eeg.edf"))
    ev = v.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(name("l_orderkey", "_events.tsv")).distinct()
    return epoching.match_by_stem(rec, ev, "name", "_eeg\\.edf", "_events\\.tsv").select("o_orderkey", "stem")


@query("j05_positional_join", """
SELECT a.conv_id, a.i, a.turn AS marker_turn, b.turn AS label_turn FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user') a
  JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') b USING (conv_id, i)""")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    conv = v.table(spark, sf, "conversations")
    left = conv.where("role = 'user'").select("conv_id", F.col("turn").alias("marker_turn"))
    right = conv.where("role = 'assistant'").select("conv_id", F.col("turn").alias("label_turn"))
    return epoching.positional_join(left, right, "conv_id", ["marker_turn"], ["label_turn"]).select("conv_id", "i", "marker_turn", "label_turn")


@query("j06_channel_semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    present = v.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return epoching.present_channels(v.table(spark, sf, "part"), present, "p_partkey").select("p_partkey", "p_name")


def conversation_words(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as timed words of a sentence: a conversation is a sentence, its role the subject."""
    return v.table(spark, sf, "conversations").select(
        F.col("role").alias("subject_id"), F.col("conv_id").cast("int").alias("sentence_id"),
        (F.col("turn").cast("double") * 1.5).alias("onset"), (F.length("text") / F.lit(100.0)).alias("duration"),
        F.col("turn").cast("int").alias("segment"),
    )


CTES["v_words"] = """
SELECT role AS subject_id, conv_id::INT AS sentence_id, turn::DOUBLE * 15e-1 AS onset, length(text) / 1e2 AS duration, turn::INT AS segment FROM conversations"""
CTES["v_spans"] = """
SELECT subject_id, sentence_id, min(onset) AS onset, least(max(onset + duration), min(onset) + 5e0) AS offset_s,
  count(*) AS n_words, arg_min(segment, onset) AS segment FROM v_words GROUP BY 1, 2"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return epoching.sentence_windows(conversation_words(spark, sf), ["subject_id", "sentence_id"], "onset", "duration", "segment", 5.0)


@query("j07_sentence_spec", """
SELECT subject_id, sentence_id, round(offset_s, 6) AS offset_s, text, item_id AS spec_order FROM v_spans JOIN benchmark ON sentence_id = item_id""")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    spec = v.table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("sentence_id"), "text", F.col("item_id").alias("spec_order"))
    return epoching.attach_sentences(spans(spark, sf), spec).select("subject_id", "sentence_id", v.r6("offset_s").alias("offset_s"), "text", "spec_order")


BLOCK_SQL = """
SELECT e.epoch_id, 'train' AS side FROM v_epochs e WHERE segment NOT IN (7, 8, 9) AND NOT EXISTS (
  SELECT 1 FROM v_epochs h WHERE h.segment IN (7, 8, 9) AND h.subject_id = e.subject_id
    AND e.onset - 1e0 < h.offset_s AND e.offset_s + 1e0 > h.onset)
UNION ALL SELECT epoch_id, 'test' FROM v_epochs WHERE segment IN (7, 8, 9)"""


@query("j08_temporal_buffer_anti_join", f"SELECT epoch_id FROM ({BLOCK_SQL}) WHERE side = 'train'")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    ep = v.epochs(spark, sf)
    held = F.col("segment").isin(7, 8, 9)
    return splits.without_overlap(ep.where(~held), ep.where(held)).select("epoch_id")


@query("j09_fold_expansion", """
SELECT g.subject_id AS fold, e.epoch_id, e.subject_id = g.subject_id AS is_test FROM v_epochs e, (SELECT DISTINCT subject_id FROM v_epochs) g""")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    return splits.expand_folds(v.epochs(spark, sf), "epoch_id", "subject_id")


@query("j10_vocabulary_scoring", "SELECT epoch_id, surface, round(dot, 6) AS dot FROM v_top")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs scored against the vocabulary in blocks, which gives the same best anchors as one block."""
    top = retrieval.top_anchors(v.embedded(spark, sf), v.vocabulary(spark, sf), 5, block=32)
    return top.select("epoch_id", "surface", v.r6("dot").alias("dot"))


CTES["g_lookup"] = """
SELECT coalesce(s.surface, n.surface) AS surface, coalesce(s.concept_id, n.node_id) AS concept_id FROM
  (SELECT lower(surface) AS surface, arg_max(concept_id, pos) AS concept_id FROM g_syn GROUP BY 1) s
  FULL JOIN (SELECT lower(trim(label)) AS surface, arg_min(id, pos) AS node_id FROM g_nodes WHERE trim(label) <> '' GROUP BY 1) n ON s.surface = n.surface"""
CTES["g_accepted"] = """
SELECT a.epoch_id, a.rank::BIGINT AS seq, coalesce(n.id, 'text:Keyword') AS concept_id, coalesce(n.label, a.surface) AS label,
  CASE WHEN n.id IS NOT NULL THEN a.score ELSE a.score * 8e-1 END AS confidence, a.provenance
FROM v_anchors a LEFT JOIN g_lookup l ON lower(trim(a.surface)) = l.surface LEFT JOIN g_nodes n ON n.id = l.concept_id WHERE a.score >= 5e-1"""
CTES["g_touched"] = """
SELECT r.epoch_id, e.*, bool_or(r.concept_id = e.source) AS source_in, bool_or(r.concept_id = e.target) AS target_in
FROM (SELECT DISTINCT epoch_id, concept_id FROM g_accepted) r JOIN g_edges e ON r.concept_id = e.source OR r.concept_id = e.target GROUP BY ALL"""
CTES["g_merged"] = """
SELECT epoch_id, id, source, relation, target, confidence, pos, bool_or(source_in) AS source_in, bool_or(target_in) AS target_in FROM g_touched GROUP BY ALL"""
CTES["g_suggested"] = """
SELECT s.epoch_id, s.pos AS seq, s.other AS concept_id, n.label, s.confidence * 7e-1 AS confidence, 'kg:edge:' || regexp_replace(s.id, '^edge:', '') AS provenance,
  CASE relation WHEN 'INCREASES' THEN 'increase' WHEN 'DECREASES' THEN 'decrease' WHEN 'CONFLICTS_WITH' THEN 'avoid' WHEN 'PRESERVES' THEN 'preserve' ELSE 'set' END AS operator
FROM (SELECT *, CASE WHEN source_in THEN target ELSE source END AS other FROM g_merged WHERE NOT (source_in AND target_in)) s JOIN g_nodes n ON n.id = s.other
QUALIFY row_number() OVER (PARTITION BY s.epoch_id, s.other ORDER BY s.pos) = 1"""


def resolution(spark: SparkSession, sf: str) -> decode.Resolution:
    onto = v.ontology(spark, sf)
    top = retrieval.top_anchors(v.embedded(spark, sf), v.vocabulary(spark, sf, onto), 5)
    return decode.resolve(retrieval.as_anchors(top), onto, "epoch_id")


@query("j11_surface_concept_lookup", "SELECT epoch_id, seq, concept_id, label, round(confidence, 6) AS confidence FROM g_accepted")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolution(spark, sf).resolved.where("status = 'accepted'")
    return rows.select("epoch_id", "seq", "concept_id", "label", v.r6("confidence").alias("confidence"))


@query("j12_edge_expansion", "SELECT epoch_id, id, source_in, target_in FROM g_merged")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return resolution(spark, sf).edges.select("epoch_id", "id", "source_in", "target_in")


@query("j13_suggested_concepts", "SELECT epoch_id, concept_id, label, round(confidence, 6) AS confidence, provenance, operator FROM g_suggested")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolution(spark, sf).resolved.where("status = 'suggested'")
    return rows.select("epoch_id", "concept_id", "label", v.r6("confidence").alias("confidence"), F.get("provenance", F.lit(0)).alias("provenance"), "operator")


@query("j14_subgraph_nodes", """
SELECT r.epoch_id, n.id, n.type, n.pos FROM (SELECT epoch_id, concept_id FROM g_accepted UNION SELECT epoch_id, concept_id FROM g_suggested) r JOIN g_nodes n ON n.id = r.concept_id""")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    return resolution(spark, sf).nodes.select("epoch_id", "id", "type", "pos")


CTES["v_planned"] = "SELECT family, CASE WHEN size_bytes < 300 THEN '../' || path ELSE path END AS path, size_bytes, sha256, doc_id FROM v_files"


def planned(spark: SparkSession, sf: str) -> DataFrame:
    """Planned files; the smallest ones name a path outside their family."""
    return v.files(spark, sf).withColumn("path", F.when(F.col("size_bytes") < 300, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path")))


@query("j15_reconcile", """
SELECT * FROM (SELECT p.family, p.path, p.size_bytes AS expected_size_bytes, CASE WHEN starts_with(p.path, '../') THEN 'escaped' WHEN o.path IS NULL THEN 'missing'
  WHEN NOT o.readable THEN 'unreadable' WHEN o.sha256 <> p.sha256 OR o.size_bytes <> p.size_bytes THEN 'changed' END AS reason,
  CASE WHEN NOT starts_with(p.path, '../') AND o.readable AND o.sha256 <> p.sha256 THEN o.sha256 ELSE '-' END AS observed_sha256
FROM v_planned p LEFT JOIN v_observed o ON p.family = o.family AND p.path = o.path) WHERE reason IS NOT NULL""")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    rows = release.reconcile(planned(spark, sf), v.observed_files(spark, sf), ("family", "path"))
    return rows.select("family", "path", "expected_size_bytes", "reason", F.coalesce("observed_sha256", F.lit("-")).alias("observed_sha256"))


@query("j16_shard_verification", """
SELECT * FROM (SELECT p.family, p.path, CASE WHEN o.path IS NULL THEN 'missing' WHEN o.size_bytes <> p.size_bytes THEN 'size-mismatch' WHEN o.sha256 <> p.sha256 THEN 'checksum-mismatch' END AS reason
FROM v_files p LEFT JOIN v_observed o ON p.family = o.family AND p.path = o.path) WHERE reason IS NOT NULL""")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    return release.verify_shards(v.files(spark, sf), v.observed_files(spark, sf), ("family", "path")).select("family", "path", "reason")


CTES["v_remote"] = """
SELECT f.family, f.path, CASE WHEN f.lang = 'fr' THEN NULL WHEN f.lang = 'de' THEN f.size_bytes + 1 ELSE f.size_bytes END AS size_bytes
FROM v_files f JOIN v_observed o ON o.family = f.family AND o.path = f.path
UNION ALL SELECT 'src0', 'extra/' || page_id || '.html', 1 FROM pages"""


def remote(spark: SparkSession, sf: str) -> DataFrame:
    """Remote listing: found files, unknown sizes for French ones, wrong for German ones, pages unplanned."""
    seen = v.observed_files(spark, sf).select("family", "path")
    size = F.when(F.col("lang") == "fr", F.lit(None).cast("long")).when(F.col("lang") == "de", F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    rows = v.files(spark, sf).join(seen, ["family", "path"], "left_semi").select("family", "path", size.alias("size_bytes"))
    extra = v.table(spark, sf, "pages").select(F.lit("src0").alias("family"), F.concat(F.lit("extra/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit(1).cast("long").alias("size_bytes"))
    return rows.unionByName(extra)


@query("j17_remote_listing", """
SELECT * FROM (SELECT coalesce(p.family, r.family) AS family, coalesce(p.path, r.path) AS path, CASE WHEN p.path IS NULL THEN 'unplanned' WHEN r.path IS NULL THEN 'absent'
  WHEN r.size_bytes <> p.size_bytes THEN 'size' END AS reason FROM v_files p FULL JOIN v_remote r ON p.family = r.family AND p.path = r.path) WHERE reason IS NOT NULL""")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    return release.listing_mismatch(v.files(spark, sf), remote(spark, sf), ("family", "path")).select("family", "path", "reason")


CTES["v_batched"] = """
SELECT family, path, sha256(family) AS manifest_sha256, 'batch-' || ((row_number() OVER (PARTITION BY family ORDER BY path) - 1) // 8) AS batch_id FROM v_files"""
CTES["v_state"] = """
SELECT DISTINCT family, CASE WHEN family = 'src1' THEN sha256('old') ELSE manifest_sha256 END AS manifest_sha256,
  CASE WHEN family = 'src2' THEN 'main' ELSE substr(sha256(family), 1, 40) END AS remote_revision, batch_id FROM v_batched WHERE batch_id <> 'batch-0'"""


def batched(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.files(spark, sf).withColumn("manifest_sha256", F.sha2(F.col("family").cast("binary"), 256))
    return selection.batch_numbers(rows, ["family"], "path", 8).select("family", "path", "manifest_sha256", "batch_id")


def upload_state(batches: DataFrame) -> DataFrame:
    """A checkpoint: first batches unsent, one family with an old manifest, one with a moving revision."""
    fam = F.col("family")
    return batches.where("batch_id <> 'batch-0'").select(
        "family", F.when(fam == "src1", F.sha2(F.lit("old").cast("binary"), 256)).otherwise(F.col("manifest_sha256")).alias("manifest_sha256"),
        F.when(fam == "src2", "main").otherwise(F.substring(F.sha2(fam.cast("binary"), 256), 1, 40)).alias("remote_revision"), "batch_id",
    ).distinct()


@query("j18_resumable_batches", """
SELECT family, batch_id, count(*) AS n_files FROM v_batched b WHERE NOT (
  EXISTS (SELECT 1 FROM v_state s WHERE s.family = b.family AND s.manifest_sha256 = b.manifest_sha256 AND s.batch_id = b.batch_id AND regexp_full_match(s.remote_revision, '[0-9a-f]{40}'))
  AND NOT EXISTS (SELECT 1 FROM v_batched x WHERE x.family = b.family AND x.batch_id = b.batch_id AND NOT EXISTS (SELECT 1 FROM v_remote r WHERE r.family = x.family AND r.path = x.path)))
GROUP BY 1, 2""")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    rows = batched(spark, sf)
    return release.pending_batches(rows, upload_state(rows), remote(spark, sf), "family").select("family", "batch_id", "n_files")


@query("j19_protected_targets", """
WITH f AS (SELECT lower('Team/Set-' || s_nationkey) AS repo_id FROM supplier), x AS (SELECT 'team/set-' || n_nationkey AS repo_id FROM nation WHERE n_regionkey = 1)
SELECT DISTINCT repo_id, 'protected' AS reason FROM f WHERE repo_id IN (SELECT repo_id FROM x)
UNION ALL SELECT repo_id, 'duplicate' FROM f GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT 'team/canonical', 'required-exclusion-missing'""")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    fam = v.table(spark, sf, "supplier").select(F.concat(F.lit(" Team/Set-"), F.col("s_nationkey").cast("string")).alias("repo_id"))
    exc = v.table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("team/SET-"), F.col("n_nationkey").cast("string")).alias("repo_id"))
    return release.protected_targets(fam, exc, "Team/Canonical")


@query("j20_release_alignment", """
SELECT doc_id, CASE WHEN s_suppkey IS NULL THEN 'dataset' WHEN lang = 'de' THEN 'repo-id' WHEN lang = 'fr' THEN 'revision' ELSE 'ok' END AS mismatch,
  CASE WHEN lang = 'de' THEN 'other/x' ELSE coalesce('team/' || s_suppkey, '-') END AS repo_id
FROM documents LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 15) ON source = 'src' || s_suppkey""")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    rel = v.table(spark, sf, "supplier").where("s_suppkey < 15").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("team/"), F.col("s_suppkey").cast("string")).alias("repo_id"), F.lit("r1").alias("revision"),
    )
    req = v.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("dataset_id"), F.when(F.col("lang") == "de", "other/x").alias("repo_id"),
        F.when(F.col("lang") == "fr", "r0").when(F.col("lang") == "en", "r1").alias("revision"),
    )
    return release.alignment(req, rel).select("doc_id", F.coalesce("mismatch", F.lit("ok")).alias("mismatch"), F.coalesce("repo_id", F.lit("-")).alias("repo_id"))


CTES["v_revocations"] = "SELECT token_id, timestamp AS revoked_at, timestamp + INTERVAL 10 DAY AS exp FROM v_audit WHERE event_type = 'api_request'"


def revocations(au: DataFrame) -> DataFrame:
    return au.where("event_type = 'api_request'").select("token_id", F.col("timestamp").alias("revoked_at"), (F.col("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("exp"))


@query("j21_temporal_validity", """
SELECT event_id, CASE WHEN k = 0 THEN true ELSE EXISTS (SELECT 1 FROM v_revocations r WHERE r.token_id = a.token_id AND r.revoked_at <= a.timestamp AND a.timestamp < r.exp) END AS revoked FROM v_audit a""")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    au = v.audit(spark, sf)
    ev = au.withColumn("token_id", F.when(F.col("k") != 0, F.col("token_id")))
    return audit.revoked_tokens(ev, revocations(au), "token_id", "timestamp").select("event_id", "revoked")


