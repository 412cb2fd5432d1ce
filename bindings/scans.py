"""Scans, sources and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.registry import CTES, query
from epochloom.functions import arrays, paths
from epochloom.operators import encoders, release
from epochloom.session import new_folder
from epochloom.sources import advisories, catalog, files, formats, readers, sinks


@query("s01_nested_epoch_scan", """
SELECT vec_id, label, vec_id AS row_index, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    """The table is one file or a folder of them; its rows are numbered through."""
    rows = readers.table_rows(readers.nested_epochs(spark, f"{sf}/embeddings.parquet", ["vec_id", "label", "embedding"]))
    return rows.select("vec_id", "label", "row_index", v.r6(arrays.vsum("embedding")).alias("total"))


def sharded(spark: SparkSession, sf: str) -> DataFrame:
    return v.epochs(spark, sf).withColumn("shard", paths.numbered("train-", "segment", 5))


@query("s02_shard_range", """
SELECT 'train-' || lpad(segment::VARCHAR, 5, '0') AS shard, segment::INT AS shard_no, count(*) AS n FROM v_epochs
WHERE segment >= least(7, (SELECT max(segment) FROM v_epochs)) AND segment < least(7, (SELECT max(segment) FROM v_epochs)) + 8 GROUP BY 1, 2""")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    return readers.shard_range(sharded(spark, sf), 7, 8).groupBy("shard", "shard_no").agg(F.count(F.lit(1)).alias("n"))


@query("s03_sample_csv_scan", """
SELECT patient, epoch, label, round(time, 6) AS time, round(quantity + price + discount + tax, 6) AS total FROM v_samples""")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "samples")
    v.samples(spark, sf).write.option("header", True).csv(folder)
    rows = readers.sample_csv(spark, folder, v.SAMPLE_CHANNELS)
    total = sum((F.col(c) for c in v.SAMPLE_CHANNELS[1:]), F.col(v.SAMPLE_CHANNELS[0]))
    return rows.select("patient", "epoch", "label", v.r6("time").alias("time"), v.r6(total).alias("total"))


@query("s04_numeric_epoch_scan", """
SELECT 'parquet' AS kind, count(*) AS n_rows, 64::BIGINT AS n_values, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings
UNION ALL SELECT 'csv', (SELECT count(DISTINCT segment) FROM v_epochs),
  (SELECT count(*) FROM v_epochs) * 64, round(sum(list_sum(embedding::DOUBLE[])), 4) FROM embeddings""")
def s04(spark: SparkSession, sf: str) -> DataFrame:
    """A numeric Parquet matrix, and headerless CSV epochs, one file per segment."""
    wide, lines = new_folder(spark, "matrix"), new_folder(spark, "csv")
    ep = v.epochs(spark, sf)
    ep.select(*[F.get("embedding", F.lit(i)).alias(f"c{i}") for i in range(64)]).write.parquet(wide)
    flat = ep.select("segment", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",").alias("line"))
    flat.repartition("segment").sortWithinPartitions("segment").write.partitionBy("segment").text(lines)
    a = readers.numeric_epochs(spark, wide, "parquet").agg(
        F.lit("parquet").alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.max(F.size("values")).cast("long").alias("n_values"),
        F.round(F.sum(arrays.vsum("values")), 4).alias("total"),
    )
    b = readers.numeric_epochs(spark, lines, "csv").agg(
        F.lit("csv").alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(F.flatten("eeg"))).cast("long").alias("n_values"),
        F.round(F.sum(arrays.vsum(F.flatten("eeg"))), 4).alias("total"),
    )
    return a.unionByName(b)


SUBJECTS = 5


def marker_folder(spark: SparkSession, sf: str) -> str:
    """Marker TSV files below subject and session folders, written from the events; one subject has no session folder."""
    folder = new_folder(spark, "markers")
    rows = v.markers(v.indexed_events(spark, sf)).select(
        "onset", F.lit(0.5).alias("duration"), "trial_type", F.lit("n/a").alias("value"),
        F.col("marker_id").cast("int").alias("sentence_id"), F.lit(1).alias("segment"),
        (F.col("recording_id") % SUBJECTS).alias("sub"),
    ).persist()
    for k in range(SUBJECTS):
        below = f"{folder}/sub-{k}" + (f"/ses-{k % 2}" if k else "/none")
        rows.where(F.col("sub") == k).drop("sub").write.option("header", True).option("sep", "\t").csv(below)
    rows.unpersist()
    return f"{folder}/*/*"


@query("s05_marker_tsv_scan", f"""
SELECT round(onset, 6) AS onset, trial_type, marker_id::INT AS sentence_id, 'sub-' || k AS subject_id,
  'sub-' || k || ':' || CASE WHEN k = 0 THEN 'unknown' ELSE 'ses-' || k % 2 END AS session_id FROM (SELECT *, recording_id % {SUBJECTS} AS k FROM v_markers)""")
def s05(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.marker_tsv(spark, marker_folder(spark, sf))
    return rows.select(v.r6("onset").alias("onset"), "trial_type", "sentence_id", "subject_id", "session_id")


@query("s06_channel_type_filter", "SELECT p_partkey, p_type FROM part WHERE upper(p_type) = 'ECONOMY'")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    return readers.eeg_channels(v.table(spark, sf, "part"), "p_type", "ECONOMY").select("p_partkey", "p_type")


CTES["v_paths"] = """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'data/sub-' || (page_id % 7) || '/ses-' || (page_id % 4) || '/' ELSE 'data/' END
  || CASE WHEN page_id % 2 = 0 THEN 'sub-' || (page_id % 5) || '_ses-a_task-x_' ELSE '' END
  || replace(replace(url, 'http://', ''), 'https://', '') AS path FROM pages"""


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.col("page_id")
    folder = F.when(pid % 3 == 0, F.concat(F.lit("data/sub-"), (pid % 7).cast("string"), F.lit("/ses-"), (pid % 4).cast("string"), F.lit("/"))).otherwise("data/")
    name = F.when(pid % 2 == 0, F.concat(F.lit("sub-"), (pid % 5).cast("string"), F.lit("_ses-a_task-x_"))).otherwise("")
    bare = F.replace(F.replace("url", F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return v.table(spark, sf, "pages").select("page_id", F.concat(folder, name, bare).alias("path"))


@query("s07_path_entities", """
SELECT page_id, coalesce(
    list_filter(string_split(string_split(path, '/')[-1], '_'), lambda s: starts_with(s, 'sub-'))[-1],
    list_filter(string_split(path, '/')[:-2], lambda s: starts_with(s, 'sub-'))[-1], 'unknown') AS subject_id,
  coalesce(list_filter(string_split(string_split(path, '/')[-1], '_'), lambda s: starts_with(s, 'ses-'))[-1],
    list_filter(string_split(path, '/')[:-2], lambda s: starts_with(s, 'ses-'))[-1], 'unknown') AS session_id FROM v_paths""")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    subject, session = paths.subject_session("path")
    return page_paths(spark, sf).select("page_id", subject.alias("subject_id"), session.alias("session_id"))


def protocols(spark: SparkSession, sf: str) -> DataFrame:
    """Protocol documents: one per order, its parts as subjects and its lines as sentences."""
    li = v.table(spark, sf, "lineitem")
    part = F.concat(F.lit("sub-"), F.col("l_partkey").cast("string"))
    named = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, part)))
    docs = li.groupBy(F.col("l_orderkey").cast("string").alias("protocol_id")).agg(
        F.struct(named("A").alias("primary_subjects"), named("N").alias("analyzed_yes"), named("R").alias("eeg_without_events")).alias("cohort"),
        F.struct(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("sentence_id"), F.col("l_linestatus").alias("text")))).alias("sentences")).alias("task"),
    )
    folder = new_folder(spark, "protocols")
    docs.write.json(folder)
    return readers.protocol_documents(spark, folder)


@query("s08_protocol_cohorts", """
SELECT protocol_id, subject_id, cohort, (row_number() OVER (PARTITION BY protocol_id, cohort ORDER BY subject_id) - 1)::INT AS pos FROM (
  SELECT DISTINCT l_orderkey::VARCHAR AS protocol_id, 'sub-' || l_partkey AS subject_id, 'primary' AS cohort FROM lineitem WHERE l_returnflag = 'A'
  UNION SELECT DISTINCT l_orderkey::VARCHAR, 'sub-' || l_partkey, 'events_available' FROM lineitem a
    WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = 'R'))
QUALIFY pos < 2""")
def s08(spark: SparkSession, sf: str) -> DataFrame:
    docs = protocols(spark, sf)
    seen = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("protocol_id"), F.concat(F.lit("sub-"), F.col("l_partkey").cast("string")).alias("subject_id")
    )
    a = readers.cohort_subjects(docs, "primary", first=2).withColumn("cohort", F.lit("primary"))
    b = readers.cohort_subjects(docs, "events_available", seen, first=2).withColumn("cohort", F.lit("events_available"))
    return a.unionByName(b)


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest documents: one per order, its lines as shards."""
    li = v.table(spark, sf, "lineitem")
    # lines are shuffled as they are; paths and digests, far longer, are made of them afterwards
    line = F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.coalesce(F.col("l_discount") == 0.0, F.lit(False)).alias("up"))

    def shard(x: Column) -> Column:
        key = F.concat_ws("-", *[x[c].cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")])
        path = F.concat(F.when(x["up"], "../").otherwise(""), key, F.lit(".csv"))
        return F.struct(path.alias("path"), x["l_quantity"].cast("long").alias("size_bytes"), F.sha2(key.cast("binary"), 256).alias("sha256"))

    docs = li.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), F.max("l_tax").alias("t")).select(
        "l_orderkey", F.array_sort(F.transform("lines", shard)).alias("shards"), "t"
    )
    head = docs.select(
        F.concat(F.lit("ds-"), F.col("l_orderkey").cast("string")).alias("dataset_id"), F.lit("local").alias("provider"),
        F.when(F.col("t") >= 0.08, "main").otherwise(F.concat(F.lit("rev-"), F.col("l_orderkey").cast("string"))).alias("revision"),
        F.lit("csv").alias("format"), F.lit(250.0).alias("sampling_rate_hz"), F.lit(22).alias("n_channels_source"),
        F.lit(201).alias("n_times_source"), F.array(F.lit("left"), F.lit("right")).alias("labels"),
        F.lit("patient").alias("subject_field"), F.lit("epoch").alias("session_field"), "shards",
    )
    folder = new_folder(spark, "manifests")
    # a compressed file is read by one task
    head.write.option("compression", "lz4").option("maxRecordsPerFile", 100_000).json(folder)
    return catalog.manifest_documents(spark, folder, multi_line=False)


CTES["v_shards"] = """
SELECT l_orderkey, 'ds-' || l_orderkey AS dataset_id, CASE WHEN l_discount = 0 THEN '../' ELSE '' END
  || concat_ws('-', l_orderkey, l_partkey, l_linenumber) || '.csv' AS path, trunc(l_quantity)::BIGINT AS size_bytes,
  sha256(concat_ws('-', l_orderkey, l_partkey, l_linenumber)) AS sha256, l_tax FROM lineitem"""


@query("s09_manifest_catalogue", """
SELECT s.dataset_id, (row_number() OVER (PARTITION BY s.dataset_id ORDER BY path, size_bytes, sha256) - 1)::INT AS shard_no, path, size_bytes, sha256
FROM v_shards s JOIN (SELECT dataset_id FROM v_shards GROUP BY 1 HAVING max(l_tax) < 8e-2 AND count_if(starts_with(path, '../')) = 0) g USING (dataset_id)""")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    good = catalog.manifest_violations(manifests(spark, sf)).where(F.size("violations") == 0)
    return catalog.manifest_shards(good).select("dataset_id", "shard_no", "path", "size_bytes", "sha256")


def family_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Family catalogue documents: nineteen suppliers each."""
    sup = v.table(spark, sf, "supplier")
    key = paths.numbered("D", F.col("s_suppkey") % 19 + 1, 2)
    body = F.struct(
        F.concat(F.lit("rel-"), F.col("s_suppkey").cast("string")).alias("release_id"),
        F.concat(F.when(F.col("s_acctbal") < 0, "/abs/").otherwise("fam/"), F.col("s_suppkey").cast("string")).alias("local_root"),
        F.concat(F.lit("team/set-"), F.col("s_nationkey").cast("string")).alias("repo_id"),
        F.when(F.col("s_nationkey") < 5, "full-upstream").otherwise("observed-local-package").alias("scope_status"),
        F.when(F.col("s_acctbal") > 5000, "public").otherwise("blocked").alias("visibility"),
        F.array(F.lit("https://example.org/x")).alias("provenance_references"),
        F.struct(
            F.lit("verified").alias("license_status"), F.lit("not_applicable").alias("dua_status"),
            F.when(F.col("s_nationkey") < 20, "verified").otherwise("maybe").alias("custodian_status"),
            F.lit("reviewed").alias("deidentification_status"),
        ).alias("governance"),
        F.col("s_acctbal").cast("long").alias("expected_source_files"),
    )
    return sup.groupBy(F.floor(F.col("s_suppkey") / 19).alias("doc")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, body)))).alias("json")
    )


@query("s10_family_catalogue", """
SELECT (s_suppkey // 19)::BIGINT AS doc, 'D' || lpad((s_suppkey % 19 + 1)::VARCHAR, 2, '0') AS family_key, 'huggingface' AS provider,
  array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'local_root' END,
    CASE WHEN s_suppkey % 19 = 2 AND s_nationkey < 5 THEN 'scope' END,
    CASE WHEN trunc(s_acctbal) < 0 THEN 'negative-count' END,
    CASE WHEN s_nationkey >= 20 THEN 'custodian_status' END], lambda x: x IS NOT NULL), ',') AS violations FROM supplier""")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.family_violations(catalog.family_documents(family_docs(spark, sf), "doc", "json"))
    return rows.select("doc", "family_key", "provider", F.array_join("violations", ",").alias("violations"))


@query("s11_ontology_scan", """
SELECT 'node' AS kind, source AS id, 0::BIGINT AS pos FROM g_edges WHERE id LIKE 'edge:s%'
UNION ALL SELECT 'node', target, 1 FROM g_edges WHERE id LIKE 'edge:s%' UNION ALL SELECT 'edge', id, 0 FROM g_edges WHERE id LIKE 'edge:s%'""")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """One ontology document per supplier edge: its two nodes and the edge, scanned back as tables."""
    edges = v.ontology(spark, sf).edges.where(F.col("id").startswith("edge:s"))
    node = lambda c: F.struct(F.col(c).alias("id"), F.lit("Concept").alias("type"), F.col(c).alias("label"))
    edge = F.struct("id", "source", "relation", "target", "confidence", "provenance")
    folder = new_folder(spark, "ontology")
    edges.select(
        F.lit("tables-v1").alias("ontology_version"), F.array(node("source"), node("target")).alias("nodes"), F.array(edge).alias("edges")
    ).write.json(folder)
    n, e, _ = catalog.ontology_tables(spark, folder, multi_line=False)
    return n.select(F.lit("node").alias("kind"), "id", "pos").unionByName(e.select(F.lit("edge").alias("kind"), "id", "pos"))


@query("s12_file_inventory")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """The given files hashed in the JVM, if not large, and by bounded reads of the registered format; both must agree."""
    small = files.hashed_files(spark, sf, "*.parquet")
    formats.register(spark)
    large = spark.read.format("file_digests").option("glob", "*.parquet").load(sf).select("path", F.col("sha256").alias("streamed"), F.col("size_bytes").alias("streamed_bytes"))
    return small.join(large, "path").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256",
        ((F.col("sha256") == F.col("streamed")) & (F.col("size_bytes") == F.col("streamed_bytes"))).alias("agree"),
    )


CTES["v_cve"] = """
SELECT doc_id, CASE WHEN lang = 'es' THEN 'ADV-' ELSE 'CVE-' END || '2024-' || (doc_id // 2) AS cve, source AS package,
  CASE lang WHEN 'en' THEN 'CRITICAL' WHEN 'fr' THEN 'critical' ELSE 'LOW' END AS severity,
  coalesce(toxic = 1, false) AS kev, CASE quality WHEN 1 THEN 'Remediated' WHEN 0 THEN 'open' END AS status
FROM documents LEFT JOIN labels USING (doc_id)"""


def advisories_of(spark: SparkSession, sf: str) -> DataFrame:
    lab = v.table(spark, sf, "labels")
    docs = v.table(spark, sf, "documents").join(lab, "doc_id", "left")
    return docs.select(
        "doc_id",
        F.concat(F.when(F.col("lang") == "es", "ADV-").otherwise("CVE-"), F.lit("2024-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("cve"),
        F.col("source").alias("package"),
        F.when(F.col("lang") == "en", "CRITICAL").when(F.col("lang") == "fr", "critical").otherwise("LOW").alias("severity"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("kev"),
        F.when(F.col("quality") == 1, "Remediated").when(F.col("quality") == 0, "open").alias("status"), "lang",
    )


def advisory_folder(spark: SparkSession, sf: str) -> str:
    """Both document shapes: German and French records come inside ``records``."""
    rows = advisories_of(spark, sf)
    item = F.struct("cve", "package", "severity", "kev", "status")
    nested = rows.where(F.col("lang").isin("de", "fr")).select(F.to_json(F.struct(F.array(item).alias("records"))).alias("value"))
    plain = rows.where(~F.col("lang").isin("de", "fr")).select(F.to_json(item).alias("value"))
    broken = v.table(spark, sf, "region").select(F.concat(F.lit("{not json "), "r_name").alias("value"))
    folder = new_folder(spark, "advisories")
    nested.unionByName(plain).unionByName(broken).write.text(folder)
    return folder


@query("s13_advisory_scan", "SELECT cve, package, severity, kev, coalesce(status, '-') AS status FROM v_cve")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    rows = advisories.advisory_records(spark, advisory_folder(spark, sf))
    return rows.select("cve", "package", "severity", "kev", F.coalesce("status", F.lit("-")).alias("status"))


@query("s14_source_fallback", """
SELECT 'empty' AS given, 'alternate' AS source, label, count(*) AS n FROM v_epochs GROUP BY 3
UNION ALL SELECT 'some', 'primary', label, count(*) FROM v_epochs WHERE segment % 2 = 0 GROUP BY 3""")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """The primary source where it has rows, else the alternate one."""
    ep = v.epochs(spark, sf)
    out = None
    for given, primary in (("empty", ep.where("segment < 0")), ("some", ep.where("segment % 2 = 0"))):
        rows = readers.with_fallback(primary, ep, "primary", "alternate")
        part = rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(given).alias("given"), "source", "label", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s16_report_sink", """
SELECT label, count(*) AS n, CASE WHEN count(*) > 50 THEN 'validated' ELSE 'blocked_below_control' END AS deployment_status,
  (SELECT bool_and(c > 50) FROM (SELECT count(*) AS c FROM v_epochs GROUP BY label)) AS model_written FROM v_epochs GROUP BY label""")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    report = v.epochs(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("gate_pass", F.col("n") > 50)
    folder = new_folder(spark, "report")
    weights = v.label_vocab(spark, sf)
    sinks.write_report(report, weights, folder)
    try:
        written = spark.read.schema(weights.schema).parquet(f"{folder}/weights").limit(1).count() > 0
    except Exception:  # noqa: BLE001 - no folder means no model was written
        written = False
    back = spark.read.schema("label string, n long, gate_pass boolean, deployment_status string").json(f"{folder}/report")
    return back.select("label", "n", "deployment_status", F.lit(written).alias("model_written"))


@query("s17_weight_round_trip", "SELECT surface AS model_id, (i - 1)::INT AS idx, round(vec[i], 6) AS w FROM l_vocab, range(1, 65) r(i)")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    vocab = v.label_vocab(spark, sf).select(
        F.col("surface").alias("model_id"), F.lit("w").alias("part"), F.lit(0).alias("row"), "vec"
    )
    folder = new_folder(spark, "weights")
    sinks.save_weights(vocab, folder)
    back = sinks.load_weights(spark, folder)
    return back.select("model_id", F.posexplode("vec").alias("idx", "w")).select("model_id", "idx", v.r6("w").alias("w"))


@query("s17_encoder_round_trip", """
SELECT part, row, i::INT AS i, round(CASE part WHEN 'x_mean' THEN m WHEN 'x_scale' THEN greatest(s, 1e-6) END, 6) AS x FROM (
  SELECT i - 1 AS i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) r(i) GROUP BY 1),
  (VALUES ('x_mean', 0), ('x_scale', 0)) p(part, row)
UNION ALL SELECT 'size:' || name, 0, 0, n::DOUBLE FROM (VALUES ('b1', 16), ('b2', 8), ('w1', 64 * 16), ('w2', 16 * 8), ('x_mean', 64), ('x_scale', 64)) q(name, n)""")
def s17_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """A whole encoder with its scaler, written and read back: the scaler's numbers and every matrix's size."""
    pick = F.transform(F.slice("embedding", 1, 8), lambda e: e.cast("double"))
    rows = v.table(spark, sf, "embeddings").select(F.transform("embedding", lambda e: e.cast("double")).alias("x"), pick.alias("y"))
    model = encoders.MlpEncoder(64, 8, hidden=16, epochs=2, lr=0.01).fit(rows)
    folder = new_folder(spark, "encoder")
    sinks.save_weights(model.to_rows(spark, "mlp"), folder)
    back = encoders.MlpModel.from_rows(sinks.load_weights(spark, folder, "mlp"))
    for name, part in model.parts().items():
        if not (part == back.parts()[name]).all():
            raise ValueError(f"{name} changed on its way")
    again = back.to_rows(spark, "mlp")
    cells = again.where(F.col("part").startswith("x_")).select("part", "row", F.posexplode("vec").alias("i", "x")).select("part", "row", "i", v.r6("x").alias("x"))
    sizes = again.groupBy(F.concat(F.lit("size:"), "part").alias("part")).agg(F.sum(F.size("vec")).cast("double").alias("x"))
    return cells.unionByName(sizes.select("part", F.lit(0).alias("row"), F.lit(0).alias("i"), "x"))


@query("s18_manifest_sink", """
SELECT family AS key, count(*) AS n_pieces, sha256('{"dataset_id":"' || family || '","files":[' || string_agg(
  '{"path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}', ',' ORDER BY path)
  || '],"provider":"local"}') AS sha256 FROM v_files GROUP BY family""")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    return release.manifest_json(v.files(spark, sf), "family", {"dataset_id": F.col("family"), "provider": F.lit("local")})


@query("s19_advisory_upsert", """
SELECT cve_key, package, severity, source, snapshot_date FROM (
  SELECT lower(cve) AS cve_key, package, severity, 'approved snapshot 2026-01-01' AS source, '2026-01-01' AS snapshot_date,
    row_number() OVER (PARTITION BY lower(cve) ORDER BY doc_id DESC) AS rn FROM v_cve WHERE starts_with(lower(cve), 'cve-')) WHERE rn = 1
UNION ALL SELECT lower(cve), package, severity, 'rejected', NULL FROM v_cve WHERE NOT starts_with(lower(cve), 'cve-')""")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    incoming = advisories_of(spark, sf).withColumn("source", F.lit(None).cast("string")).withColumn(
        "note", F.lit(None).cast("string")
    ).withColumn("snapshot_date", F.lit(None).cast("string"))
    current = incoming.where(F.col("lang") == "en")
    latest, rejected = advisories.upsert(current, incoming, "2026-01-01", "doc_id")
    return latest.select("cve_key", "package", "severity", "source", "snapshot_date").unionByName(
        rejected.select("cve_key", "package", "severity", F.lit("rejected").alias("source"), "snapshot_date")
    )


@query("s19_known_exploited_snapshot", "SELECT 'feed' AS source, '2026-01-01' AS snapshot_date, count(*) AS kev_count FROM v_cve WHERE kev")
def s19_kev(spark: SparkSession, sf: str) -> DataFrame:
    return advisories.known_exploited_snapshot(advisories_of(spark, sf).where("kev"), "feed", "2026-01-01")


