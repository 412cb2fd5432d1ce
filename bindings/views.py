"""The given tables seen as epochs, samples, markers, files, events and a graph.

Every view has a Spark form and, under the same name, its SQL form in ``CTES``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bindings.registry import CTES
from epochloom.functions import arrays, paths
from epochloom.functions.scale import ranked, small_side
from epochloom.operators import graph, retrieval
from epochloom.operators.embedders import HashEmbedder
from epochloom.plans.decode import Ontology


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; wall-clock timestamps are read as UTC, which ``session.prepare`` sets."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def r6(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def long_form(df: DataFrame, *keys: str, column: str = "eeg", digits: int = 6) -> DataFrame:
    """``(keys, ch, t, v)`` rows of an epoch column."""
    return df.select(*keys, F.posexplode(column).alias("ch", "_r")).select(
        *keys, "ch", F.posexplode("_r").alias("t", "v")
    ).select(*keys, "ch", "t", F.round("v", digits).alias("v"))


def sql_long(source: str, keys: str, column: str = "eeg") -> str:
    """SQL twin of ``long_form`` over a relation."""
    return (
        f"SELECT {keys}, (c - 1)::INT AS ch, (t - 1)::INT AS t, round({column}[c][t]::DOUBLE, 6) AS v FROM ("
        f"SELECT *, unnest(range(1, len({column}[c]) + 1)) AS t FROM ("
        f"SELECT *, unnest(range(1, len({column}) + 1)) AS c FROM ({source})))"
    )


# --- epochs -------------------------------------------------------------------

def epochs(spark: SparkSession, sf: str) -> DataFrame:
    subject = paths.numbered("sub-", F.col("vec_id") % 9 + 1, 2)
    onset = F.col("vec_id").cast("double") * F.lit(0.5)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("epoch_id"), arrays.reshape("embedding", 8, 8).alias("eeg"), "embedding",
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"), subject.alias("subject_id"),
        F.concat(subject, paths.numbered(":ses-", F.floor(F.col("vec_id") / 9) % 4 + 1, 2)).alias("session_id"),
        paths.numbered("segment:", "label", 2).alias("stimulus_id"), F.col("label").alias("segment"),
        onset.alias("onset"), (onset + 4.0).alias("offset_s"),
    )


CTES["v_epochs"] = """
SELECT vec_id AS epoch_id, list_transform(range(0, 8), lambda c: embedding[c * 8 + 1 : c * 8 + 8]) AS eeg, embedding,
  'class_' || label AS label, 'sub-' || lpad((vec_id % 9 + 1)::VARCHAR, 2, '0') AS subject_id,
  'sub-' || lpad((vec_id % 9 + 1)::VARCHAR, 2, '0') || ':ses-' || lpad((vec_id // 9 % 4 + 1)::VARCHAR, 2, '0') AS session_id,
  'segment:' || lpad(label::VARCHAR, 2, '0') AS stimulus_id, label AS segment,
  vec_id::DOUBLE * 5e-1 AS onset, vec_id::DOUBLE * 5e-1 + 4e0 AS offset_s
FROM embeddings"""

CTES["v_long"] = """
SELECT epoch_id, c - 1 AS ch, t - 1 AS t, eeg[c][t]::DOUBLE AS v
FROM (SELECT epoch_id, eeg, unnest(range(1, 9)) AS c FROM v_epochs), range(1, 9) r(t)"""

# --- windowed samples and continuous signals ------------------------------------

SAMPLE_CHANNELS = ("quantity", "price", "discount", "tax")
SAMPLE_EXPECTED = 4


def samples(spark: SparkSession, sf: str) -> DataFrame:
    label = F.create_map(F.lit("A"), F.lit("left"), F.lit("N"), F.lit("right"), F.lit("R"), F.lit("foot"))
    return table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).cast("int").alias("patient"),
        (F.col("l_linenumber").cast("double") * 0.004).alias("time"),
        F.try_element_at(label, F.col("l_returnflag")).alias("label"), F.col("l_orderkey").cast("int").alias("epoch"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


CTES["v_samples"] = """
SELECT (l_orderkey // 100)::INT AS patient, l_linenumber::DOUBLE * 4e-3 AS time,
  CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'N' THEN 'right' WHEN 'R' THEN 'foot' END AS label,
  l_orderkey::INT AS epoch, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
FROM lineitem"""

FS = 10.0


def indexed_events(spark: SparkSession, sf: str, users: DataFrame | None = None) -> DataFrame:
    """Events of a user numbered in time order: the sample index of an irregular signal.

    With ``users`` (``user_id``), those of no other user are numbered.
    """
    given = table(spark, sf, "events")
    given = given if users is None else given.join(small_side(users), "user_id", "left_semi")
    ev = given.select(
        F.col("user_id").alias("recording_id"), "event_id", "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    return ranked(ev, ["recording_id"], ["ts", "event_id"], "sample_idx").withColumn("sample_idx", F.col("sample_idx") - 1)


def signal(indexed: DataFrame) -> DataFrame:
    return indexed.select("recording_id", "sample_idx", F.posexplode(F.array("value", "k")).alias("ch", "v"))


def recordings(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_samples"))


def markers(indexed: DataFrame) -> DataFrame:
    return indexed.where(F.col("event_type").isin("signup", "error")).select(
        "recording_id", F.col("event_id").alias("marker_id"), (F.col("sample_idx") / F.lit(FS)).alias("onset"),
        F.col("event_type").alias("trial_type"), F.lit(None).cast("string").alias("value"),
    )


CTES["v_indexed"] = """
SELECT user_id AS recording_id, event_id, ts, event_type, value, (props->>'$.k')::DOUBLE AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx FROM events"""
CTES["v_signal"] = """
SELECT recording_id, sample_idx, 0 AS ch, value AS v FROM v_indexed
UNION ALL SELECT recording_id, sample_idx, 1, k FROM v_indexed"""
CTES["v_recordings"] = "SELECT recording_id, count(*) AS n_samples FROM v_indexed GROUP BY 1"
CTES["v_markers"] = """
SELECT recording_id, event_id AS marker_id, sample_idx / 1e1 AS onset, event_type AS trial_type
FROM v_indexed WHERE event_type IN ('signup', 'error')"""

# --- audit events ----------------------------------------------------------------

EVENT_NAMES = {
    "error": "mfa_verification_failed", "signup": "dataset_upload_blocked", "purchase": "api_request",
    "view": "dataset_release_verification_failed", "click": "mfa_verification_succeeded",
}


def audit_of(ev: DataFrame) -> DataFrame:
    """Audit rows of an ``events`` table or stream."""
    name = F.create_map(*[F.lit(x) for p in EVENT_NAMES.items() for x in p])
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id").cast("string")
    return ev.select(
        "event_id", F.try_element_at(name, F.col("event_type")).alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("corr "), F.col("event_id").cast("string")).alias("correlation_id"),
        F.concat(F.lit("user-"), user).alias("user_sub"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"), F.lit("GET").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), user).alias("path"),
        F.when(k >= 50, 401).otherwise(200).alias("status"), F.round("value", 1).alias("elapsed_ms"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        paths.numbered("D", F.col("user_id") % 19 + 1, 2).alias("dataset_id"),
        F.concat(F.lit("token-"), user, F.lit("-"), k.cast("string")).alias("token_id"), k.alias("k"),
    )


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_of(table(spark, sf, "events"))


CTES["v_audit"] = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'mfa_verification_failed' WHEN 'signup' THEN 'dataset_upload_blocked'
    WHEN 'purchase' THEN 'api_request' WHEN 'view' THEN 'dataset_release_verification_failed'
    WHEN 'click' THEN 'mfa_verification_succeeded' END AS event_type,
  ts AS timestamp, 'corr ' || event_id AS correlation_id, 'user-' || user_id AS user_sub,
  'tenant-' || (user_id % 7) AS tenant_id, 'GET' AS method, '/api/' || event_type || '/' || user_id AS path,
  CASE WHEN (props->>'$.k')::INT >= 50 THEN 401 ELSE 200 END AS status, round(value, 1) AS elapsed_ms,
  '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS src_ip, 'D' || lpad((user_id % 19 + 1)::VARCHAR, 2, '0') AS dataset_id,
  'token-' || user_id || '-' || (props->>'$.k') AS token_id, (props->>'$.k')::INT AS k
FROM events"""

# --- release files -----------------------------------------------------------------

def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("family"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id", "lang",
    )


def observed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files as found later: toxic documents are gone, poor ones changed, poor German ones unreadable."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf, "documents").join(lab, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    body = F.when(poor, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.select(
        F.col("source").alias("family"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body.cast("binary"), 256).alias("sha256"),
        (~(poor & (F.col("lang") == "de"))).alias("readable"), "doc_id",
    )


CTES["v_files"] = """
SELECT source AS family, lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size_bytes,
  sha256(text) AS sha256, doc_id, lang FROM documents"""
CTES["v_observed"] = """
SELECT source AS family, lang || '/' || doc_id || '.txt' AS path,
  strlen(CASE WHEN coalesce(quality = 0, false) THEN text || 'x' ELSE text END)::BIGINT AS size_bytes,
  sha256(CASE WHEN coalesce(quality = 0, false) THEN text || 'x' ELSE text END) AS sha256,
  NOT (coalesce(quality = 0, false) AND lang = 'de') AS readable, doc_id
FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0"""

# --- graph and anchors ---------------------------------------------------------------

RELATIONS = ("INCREASES", "DECREASES", "CONFLICTS_WITH", "RELATED_TO", "PRESERVES")


def _id(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.col(name), F.lit(" "), F.lit("_")))


def ontology(spark: SparkSession, sf: str) -> Ontology:
    reg, nat, sup, part = (table(spark, sf, n) for n in ("region", "nation", "supplier", "part"))
    node = lambda df, i, kind, label, pos: df.select(i.alias("id"), F.lit(kind).alias("type"), label.alias("label"), pos.cast("long").alias("pos"))
    nodes = (
        node(reg, _id("region:", "r_name"), "Region", F.lower("r_name"), F.col("r_regionkey"))
        .unionByName(node(nat, _id("nation:", "n_name"), "Nation", F.lower("n_name"), F.col("n_nationkey") + 100))
        .unionByName(node(sup, F.concat(F.lit("supplier:S"), F.col("s_suppkey").cast("string")), "Supplier", F.col("s_name"), F.col("s_suppkey") + 1000))
    )
    names = nat.select("n_nationkey", _id("nation:", "n_name").alias("nation_id"), "n_regionkey")
    relation = F.get(F.array(*[F.lit(r) for r in RELATIONS]), F.col("n_nationkey") % 5)
    up = names.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("edge:n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("nation_id").alias("source"),
        relation.alias("relation"), _id("region:", "r_name").alias("target"),
        ((F.col("n_nationkey") % 10 + 1) / 10.0).alias("confidence"),
        F.concat(F.lit("rule:n"), F.col("n_nationkey").cast("string")).alias("provenance"), F.col("n_nationkey").cast("long").alias("pos"),
    )
    down = sup.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("edge:s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("supplier:S"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("RELATED_TO").alias("relation"),
        F.col("nation_id").alias("target"), F.lit(0.8).alias("confidence"), F.lit("rule:supply").alias("provenance"),
        (F.col("s_suppkey") + 1000).alias("pos"),
    )
    syn = part.join(names, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(
        F.col("p_name").alias("surface"), F.col("nation_id").alias("concept_id"), F.col("p_partkey").alias("pos")
    )
    return Ontology(nodes.persist(), up.unionByName(down).persist(), syn.persist(), "tables-v1")


CTES["g_nodes"] = """
SELECT 'region:' || replace(r_name, ' ', '_') AS id, 'Region' AS type, lower(r_name) AS label, r_regionkey::BIGINT AS pos FROM region
UNION ALL SELECT 'nation:' || replace(n_name, ' ', '_'), 'Nation', lower(n_name), n_nationkey + 100 FROM nation
UNION ALL SELECT 'supplier:S' || s_suppkey, 'Supplier', s_name, s_suppkey + 1000 FROM supplier"""
CTES["g_edges"] = """
SELECT 'edge:n' || n_nationkey AS id, 'nation:' || replace(n_name, ' ', '_') AS source,
  (['INCREASES', 'DECREASES', 'CONFLICTS_WITH', 'RELATED_TO', 'PRESERVES'])[n_nationkey % 5 + 1] AS relation,
  'region:' || replace(r_name, ' ', '_') AS target, (n_nationkey % 10 + 1) / 1e1 AS confidence,
  'rule:n' || n_nationkey AS provenance, n_nationkey::BIGINT AS pos
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'edge:s' || s_suppkey, 'supplier:S' || s_suppkey, 'RELATED_TO', 'nation:' || replace(n_name, ' ', '_'),
  8e-1, 'rule:supply', s_suppkey + 1000 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
CTES["g_syn"] = """
SELECT p_name AS surface, 'nation:' || replace(n_name, ' ', '_') AS concept_id, p_partkey AS pos
FROM part JOIN nation ON p_partkey % 25 = n_nationkey"""

def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Default keywords of the bound graph: the market segments, in name order."""
    return ranked(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("surface")).distinct(), [], ["surface"], "pos")


def vocabulary(spark: SparkSession, sf: str, onto: Ontology | None = None) -> DataFrame:
    """``(pos, surface, vec)`` of the bound graph's vocabulary."""
    onto = onto or ontology(spark, sf)
    seen = graph.vocabulary(keywords(spark, sf), onto.synonyms, onto.nodes)
    numbered = ranked(seen.withColumnRenamed("pos", "at"), [], ["block", "at"], "pos")
    return HashEmbedder(64).transform(numbered.select("pos", "surface"), "pos", "surface").persist()


def sql_unit(raw: str) -> str:
    return f"list_transform({raw}, lambda v: v / (sqrt(list_sum(list_transform({raw}, lambda w: w * w))) + 1e-8))"


def sql_raw_hash(surface: str, dim: int = 64) -> str:
    return (
        f"list_transform(range(0, {dim}), lambda i: (('0x' || substr(sha256(lower(trim({surface}))), "
        "(i % 32) * 2 + 1, 2))::INT - 128) / 64e0)"
    )


CTES["g_words"] = """
SELECT lower(surface) AS surface, min(spot) AS spot FROM (
  SELECT c_mktsegment AS surface, (0, row_number() OVER (ORDER BY c_mktsegment))  AS spot FROM (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT surface, (1, pos) FROM g_syn WHERE regexp_full_match(surface, '[A-Za-z0-9 _-]{1,64}')
  UNION ALL SELECT label, (2, pos) FROM g_nodes WHERE regexp_full_match(label, '[A-Za-z0-9 _-]{1,64}')) GROUP BY 1"""
CTES["g_raw"] = f"SELECT surface, row_number() OVER (ORDER BY spot) AS pos, {sql_raw_hash('surface')} AS raw FROM g_words"
CTES["g_vocab"] = f"SELECT surface, pos, {sql_unit('raw')} AS vec FROM g_raw"
CTES["v_top"] = """
SELECT * FROM (SELECT vec_id AS epoch_id, pos, surface, dot, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, pos)::INT AS rank
  FROM (SELECT vec_id, pos, surface, list_dot_product(embedding::DOUBLE[], vec) AS dot FROM embeddings, g_vocab)) WHERE rank <= 5"""
CTES["v_anchors"] = "SELECT epoch_id, surface, (dot + 1) / 2 AS score, rank, 'eeg:' || epoch_id AS provenance FROM v_top"


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Given vectors as encoded epochs."""
    return epochs(spark, sf).withColumn("emb", F.transform("embedding", lambda v: v.cast("double")))


def top5(spark: SparkSession, sf: str, vocab: DataFrame | None = None) -> DataFrame:
    vocab = vocabulary(spark, sf) if vocab is None else vocab
    return retrieval.top_anchors(embedded(spark, sf), vocab, 5)


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.as_anchors(top5(spark, sf))


# --- labels as a vocabulary --------------------------------------------------------------

def label_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.label_vocab(epochs(spark, sf), "label", "epoch_id", HashEmbedder(64)).persist()


CTES["l_raw"] = f"SELECT label AS surface, min(epoch_id) AS pos, {sql_raw_hash('label')} AS raw FROM v_epochs GROUP BY label"
CTES["l_vocab"] = f"SELECT surface, pos, {sql_unit('raw')} AS vec FROM l_raw"
CTES["l_ranked"] = """
SELECT epoch_id, label, surface, row_number() OVER (PARTITION BY epoch_id ORDER BY dot DESC, pos) AS rank FROM (
  SELECT epoch_id, label, surface, pos, list_dot_product(embedding::DOUBLE[], vec) AS dot FROM v_epochs, l_vocab)"""
CTES["l_gold"] = "SELECT e.epoch_id, e.label, e.subject_id, e.session_id, r.rank AS gold_rank FROM v_epochs e JOIN l_ranked r ON e.epoch_id = r.epoch_id AND r.label = r.surface"

WIDTH = 64


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs with flattened features."""
    return epochs(spark, sf).withColumn("x", arrays.features("eeg", WIDTH))
