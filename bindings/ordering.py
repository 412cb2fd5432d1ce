"""Windows, sorts, limits and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.joins import batched
from bindings.registry import CTES, query
from bindings.scalars import listing
from bindings.scans import sharded
from epochloom.functions import paths
from epochloom.functions.scale import ranked
from epochloom.operators import audit, epoching, graph, prompt, release, selection, splits


@query("w01_cadence_check", """
SELECT patient, epoch, bad_steps FROM (SELECT patient, epoch, count(*) AS n, coalesce(count_if(abs(gap - 4e-3) > 1e-6), 0)::BIGINT AS bad_steps FROM (
  SELECT *, time - lag(time) OVER (PARTITION BY patient, epoch ORDER BY time) AS gap FROM v_samples) GROUP BY 1, 2) WHERE n <= 7 AND bad_steps > 0""")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    rows = epoching.sample_contract(v.samples(spark, sf), ["patient", "epoch"], "time", "label", expected=7, step=0.004)
    return rows.where("bad_steps > 0").select("patient", "epoch", "bad_steps")


@query("w02_overflow_rows", "SELECT patient, epoch, count(*) AS n_rows FROM v_samples GROUP BY 1, 2 HAVING count(*) > 4")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    rows = epoching.sample_contract(v.samples(spark, sf), ["patient", "epoch"], "time", "label", expected=v.SAMPLE_EXPECTED, step=0.004)
    return rows.where(F.col("n_rows") > v.SAMPLE_EXPECTED).select("patient", "epoch", "n_rows")


@query("w03_round_robin_selection", """
SELECT epoch_id, subject_id, position FROM (SELECT epoch_id, subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY epoch_id)::INT AS position FROM v_epochs)
ORDER BY position, subject_id LIMIT 100""")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return selection.round_robin(v.epochs(spark, sf), ["subject_id"], ["epoch_id"], 100).select("epoch_id", "subject_id", "position")


@query("w04_file_round_robin", """
SELECT o_orderkey, session, subject, position FROM (SELECT o_orderkey, o_orderpriority AS session, o_orderstatus AS subject,
  row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey)::INT AS position FROM orders) ORDER BY position, session, subject LIMIT 50""")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("session"), F.col("o_orderstatus").alias("subject"))
    return selection.round_robin(rows, ["session", "subject"], ["o_orderkey"], 50)


@query("w05_shard_budget", """
SELECT epoch_id, shard FROM (SELECT epoch_id, 'train-' || lpad(segment::VARCHAR, 5, '0') AS shard, row_number() OVER (PARTITION BY segment ORDER BY epoch_id) AS rn
  FROM v_epochs WHERE list_max(flatten(eeg)) < 35e-2) WHERE rn <= greatest(1, 64 // 10) ORDER BY shard, epoch_id LIMIT 64""")
def w05(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets are counted after the row filters."""
    rows = sharded(spark, sf).where(F.array_max(F.flatten("eeg")) < 0.35)
    return selection.shard_budget(rows, "shard", "epoch_id", 64, n_shards=10).select("epoch_id", "shard")


@query("w06_strided_budget", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE n <= 60 OR list_contains(list_transform(range(0, 60), lambda k: trunc(k * (n / 6e1))::BIGINT), i)""")
def w06(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return selection.strided_budget(rows, ["user_id"], ["ts", "event_id"], 60).select("user_id", "event_id")


@query("w07_first_groups", """
SELECT epoch_id, subject_id, session_id FROM v_epochs WHERE (subject_id, session_id) IN (SELECT subject_id, session_id FROM (
  SELECT subject_id, session_id, dense_rank() OVER (ORDER BY subject_id) AS s, dense_rank() OVER (PARTITION BY subject_id ORDER BY session_id) AS e FROM v_epochs) WHERE s <= 4 AND e <= 2)""")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    return selection.first_groups(v.epochs(spark, sf), "subject_id", "session_id", 4, 2).select("epoch_id", "subject_id", "session_id")


@query("w08_top_k_anchors", "SELECT epoch_id, rank, surface, round(dot, 6) AS dot FROM v_top")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    return v.top5(spark, sf).select("epoch_id", "rank", "surface", v.r6("dot").alias("dot"))


@query("w09_batch_numbers", "SELECT family, path, batch_id FROM v_batched")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    return batched(spark, sf).select("family", "path", "batch_id")


@query("w10_trial_ordinal", "SELECT recording_id AS user_id, event_id, sample_idx AS trial_index FROM v_indexed")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return selection.ordinals(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "trial_index")


@query("w11_trailing_count", """
SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_sub ORDER BY timestamp RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM v_audit) WHERE n > 4""")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return audit.trailing_alerts(v.audit(spark, sf), "timestamp", "user_sub", 86_400, 4).select("event_id", "n")


@query("t01_first_occurrence", "SELECT lower(trim(p_name)) AS surface, min(p_partkey) AS pos FROM part GROUP BY 1")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "part").select(F.lower(F.trim("p_name")).alias("surface"), F.col("p_partkey").alias("pos"))
    return selection.first_occurrence(rows, "surface", "pos")


@query("t02_byte_order", """
SELECT path, reason, row_number() OVER (ORDER BY encode(path), encode(reason), page_id) AS rn FROM (SELECT page_id, path, coalesce(reason, '-') AS reason FROM v_scope)""")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    """Every listed path numbered in byte order of path and reason."""
    rows = listing(spark, sf).select("page_id", "path", F.coalesce(paths.scope_reason("path", "kind"), F.lit("-")).alias("reason"))
    return ranked(rows, [], ["path", "reason", "page_id"], "rn").select("path", "reason", "rn")


@query("t03_top_anchor", """
SELECT e.epoch_id, coalesce(a.surface, 'unknown') AS surface, round(coalesce(a.score, 5e-1), 6) AS score FROM v_epochs e LEFT JOIN (
  SELECT epoch_id, arg_max(surface, (score, -rank)) AS surface, max(score) AS score FROM v_anchors WHERE score > 6e-1 GROUP BY 1) a USING (epoch_id)""")
def t03(spark: SparkSession, sf: str) -> DataFrame:
    """Best anchor above a score per epoch, and the default for epochs left without one."""
    top = prompt.top_anchor(v.anchors(spark, sf).where("score > 0.6"), "epoch_id")
    rows = v.epochs(spark, sf).select("epoch_id").join(top, "epoch_id", "left")
    return rows.select("epoch_id", F.coalesce("top.surface", F.lit("unknown")).alias("surface"), v.r6(F.coalesce("top.score", F.lit(0.5))).alias("score"))


@query("t04_verification_sample", "SELECT family, path, position FROM (SELECT family, path, row_number() OVER (PARTITION BY family ORDER BY path)::INT AS position FROM v_files) WHERE position <= 3")
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return release.verification_sample(v.files(spark, sf), "family").select("family", "path", "position")


@query("t05_global_cap", "SELECT epoch_id, label FROM v_epochs ORDER BY label, epoch_id LIMIT 40")
def t05(spark: SparkSession, sf: str) -> DataFrame:
    return selection.capped(v.epochs(spark, sf), ["label", "epoch_id"], 40).select("epoch_id", "label")


@query("x01_vocabulary_union", "SELECT surface, pos FROM g_raw")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    return v.vocabulary(spark, sf).select("surface", "pos")


CTES["v_names"] = "SELECT DISTINCT p_name AS surface FROM part"


@query("x02_vocabulary_subset", """
SELECT 'outside' AS kind, n.surface FROM v_names n WHERE surface NOT IN (SELECT p_name FROM part WHERE p_size < 5)
UNION ALL SELECT 'chosen', surface FROM v_names""")
def x02(spark: SparkSession, sf: str) -> DataFrame:
    """Part names against a vocabulary of the small parts' names: what is outside, and the list used then."""
    part = v.table(spark, sf, "part").select(F.col("p_name").alias("surface"), F.col("p_partkey").alias("pos"), "p_size")
    locked = selection.first_occurrence(part.where("p_size < 5"), "surface", "pos")
    outside = graph.outside_vocabulary(part, locked).select(F.lit("outside").alias("kind"), "surface")
    return outside.unionByName(graph.evaluation_vocabulary(part, locked).select(F.lit("chosen").alias("kind"), "surface"))


@query("x03_ontology_merge", """
SELECT 'node' AS kind, id, row_number() OVER (ORDER BY part, pos) - 1 AS at_pos FROM (
  SELECT id, 0 AS part, pos FROM g_nodes WHERE type <> 'Supplier' UNION ALL SELECT id, 1, pos FROM g_nodes WHERE type = 'Supplier')
UNION ALL SELECT 'edge', id, row_number() OVER (ORDER BY part, pos) - 1 FROM (
  SELECT id, 0 AS part, pos FROM g_edges WHERE id LIKE 'edge:n%' UNION ALL SELECT id, 1, pos FROM g_edges WHERE id NOT LIKE 'edge:n%')
UNION ALL SELECT 'synonym', surface, row_number() OVER (ORDER BY part, pos, surface) - 1 FROM (SELECT surface, 0 AS part, pos FROM g_syn UNION ALL SELECT surface, 1, pos FROM g_syn)""")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and nations extended by the whole graph: only suppliers and their edges are new, synonyms repeat."""
    o = v.ontology(spark, sf)
    base = (o.nodes.where("type <> 'Supplier'"), o.edges.where(F.col("id").startswith("edge:n")), o.synonyms)
    nodes, edges, syn = graph.merge_ontology(base, (o.nodes, o.edges, o.synonyms))
    number = lambda df, kind, key: ranked(df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "pos"), [], ["pos", "id"], "at_pos").select("kind", "id", (F.col("at_pos") - 1).alias("at_pos"))
    return number(nodes, "node", "id").unionByName(number(edges, "edge", "id")).unionByName(number(syn, "synonym", "surface"))


@query("x04_closed_keys", """
SELECT event_id, array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains(['schema_version', 'k'], x))), ',') AS extra FROM (
  SELECT event_id, json_keys(CASE WHEN event_type = 'error' THEN '{"zz": 1, "secret": 2, "k": 3}' ELSE props END) AS keys FROM events)""")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.when(F.col("event_type") == "error", '{"zz": 1, "secret": 2, "k": 3}').otherwise(F.col("props"))
    rows = v.table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", F.array_join(prompt.extra_keys("doc", ("schema_version", "k")), ",").alias("extra"))


@query("x06_stimulus_disjointness", """
SELECT 'block' AS split, 0::BIGINT AS n_shared UNION ALL SELECT 'subject', count(*) FROM (
  SELECT stimulus_id FROM v_epochs WHERE subject_id = 'sub-01' INTERSECT SELECT stimulus_id FROM v_epochs WHERE subject_id <> 'sub-01')""")
def x06(spark: SparkSession, sf: str) -> DataFrame:
    """The block split shares no stimulus; a subject split does."""
    ep = v.epochs(spark, sf)
    train, test = splits.stimulus_block(ep, (7, 8, 9))
    n = lambda df, name: df.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_shared"))
    one = F.col("subject_id") == "sub-01"
    return n(splits.shared_stimuli(train, test), "block").unionByName(n(splits.shared_stimuli(ep.where(~one), ep.where(one)), "subject"))
