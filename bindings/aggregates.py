"""Aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import views as v
from bindings.joins import spans
from bindings.registry import CTES, query
from bindings.scans import advisories_of
from epochloom.functions import arrays
from epochloom.functions.scale import attach_row
from epochloom.operators import cleaning, embedders, encoders, epoching, graph, release, retrieval, supply
from epochloom.plans import train
from epochloom.sources.readers import spread

POOL_T = """list_transform(eeg, lambda r: list_transform(range(0, {n}), lambda i:
  list_avg(list_slice(r, i * len(r) // {n} + 1, greatest(i * len(r) // {n} + 1, (i + 1) * len(r) // {n}))::DOUBLE[])))"""
POOL_C = """list_transform(range(0, {n}), lambda i: list_transform(range(1, len(eeg[1]) + 1), lambda t:
  list_avg(list_transform(list_slice(eeg, i * len(eeg) // {n} + 1, greatest(i * len(eeg) // {n} + 1, (i + 1) * len(eeg) // {n})), lambda r: r[t]::DOUBLE))))"""


@query("a01_temporal_block_mean", " UNION ALL ".join(
    f"SELECT {n} AS n_times, * FROM (" + v.sql_long(f"SELECT epoch_id, {POOL_T.format(n=n)} AS eeg FROM v_epochs", "epoch_id") + ")" for n in (3, 20)))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """Pooling to fewer and to more samples than an epoch has."""
    ep = v.epochs(spark, sf)
    part = lambda n: v.long_form(ep.select("epoch_id", arrays.pool_time("eeg", n).alias("eeg")), "epoch_id").withColumn("n_times", F.lit(n))
    return part(3).unionByName(part(20))


@query("a02_spatial_mean", " UNION ALL ".join(
    f"SELECT {n} AS n_channels, * FROM (" + v.sql_long(f"SELECT epoch_id, {POOL_C.format(n=min(n, 8))} AS eeg FROM v_epochs", "epoch_id") + ")" for n in (3, 12)))
def a02(spark: SparkSession, sf: str) -> DataFrame:
    ep = v.epochs(spark, sf)
    part = lambda n: v.long_form(ep.select("epoch_id", arrays.pool_channels("eeg", n).alias("eeg")), "epoch_id").withColumn("n_channels", F.lit(n))
    return part(3).unionByName(part(12))


@query("a03_sample_assembly", """
SELECT patient, epoch, label, (i - 1)::INT AS t, round(s[i].quantity::DOUBLE, 4) AS quantity, round(s[i].price::DOUBLE, 4) AS price FROM (
  SELECT patient, epoch, min(label) AS label, list({'time': time, 'quantity': quantity::FLOAT, 'price': price::FLOAT, 'discount': discount::FLOAT, 'tax': tax::FLOAT}
    ORDER BY time, quantity::FLOAT, price::FLOAT, discount::FLOAT, tax::FLOAT) AS s FROM v_samples GROUP BY 1, 2 HAVING count(*) = 4), range(1, 5) r(i)""")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    ep = epoching.assemble(v.samples(spark, sf), ["patient", "epoch"], "time", v.SAMPLE_CHANNELS, v.SAMPLE_EXPECTED)
    rows = ep.select("patient", "epoch", "label", F.posexplode(F.arrays_zip(F.col("eeg")[0].alias("q"), F.col("eeg")[1].alias("p"))).alias("t", "z"))
    return rows.select("patient", "epoch", "label", "t", F.round(F.col("z.q").cast("double"), 4).alias("quantity"), F.round(F.col("z.p").cast("double"), 4).alias("price"))


CTES["v_contract"] = """
SELECT patient, epoch, n_rows, one_label, bad_steps, CASE WHEN n_rows > 4 OR NOT one_label OR bad_steps > 0 THEN 'time-or-label' WHEN n_rows <> 4 THEN 'incomplete' END AS reason FROM (
  SELECT patient, epoch, count(*) AS n_rows, min(label) = max(label) AS one_label,
    CASE WHEN count(*) <= 4 THEN coalesce(count_if(abs(gap - 4e-3) > 1e-6), 0)::BIGINT ELSE 0 END AS bad_steps FROM (
      SELECT *, time - lag(time) OVER (PARTITION BY patient, epoch ORDER BY time) AS gap FROM v_samples) GROUP BY 1, 2)"""


def contract(spark: SparkSession, sf: str) -> DataFrame:
    return epoching.sample_contract(v.samples(spark, sf), ["patient", "epoch"], "time", "label", expected=v.SAMPLE_EXPECTED, step=0.004)


@query("a04_completeness_contract", "SELECT patient, epoch, n_rows, one_label, bad_steps, coalesce(reason, 'ok') AS reason FROM v_contract")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return contract(spark, sf).withColumn("reason", F.coalesce("reason", F.lit("ok")))


@query("a04_first_offender", """
SELECT patient, epoch, reason, n_rows FROM v_contract WHERE reason IS NOT NULL ORDER BY reason <> 'time-or-label', patient, epoch LIMIT 1""")
def a04_first(spark: SparkSession, sf: str) -> DataFrame:
    return epoching.first_offender(contract(spark, sf), ["patient", "epoch"])


@query("a05_sentence_windows", "SELECT subject_id, sentence_id, round(onset, 6) AS onset, round(offset_s, 6) AS offset_s, n_words, segment FROM v_spans")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).select("subject_id", "sentence_id", v.r6("onset").alias("onset"), v.r6("offset_s").alias("offset_s"), "n_words", "segment")


PTP = "(list_max(flatten(eeg)) - list_min(flatten(eeg)))"


def masked(spark: SparkSession, sf: str, limit: float) -> DataFrame:
    return v.epochs(spark, sf).withColumn("keep", arrays.stored_peak_to_peak("eeg").cast("double") < limit)


@query("a06_mask_guard", f"""
SELECT 'strict' AS rule, count(*) AS n FROM v_epochs WHERE {PTP} < 6e-1 OR NOT (SELECT count_if({PTP} < 6e-1) >= 16 AND count(DISTINCT CASE WHEN {PTP} < 6e-1 THEN subject_id END) >= 2
  AND count(DISTINCT CASE WHEN {PTP} < 6e-1 THEN session_id END) >= 2 FROM v_epochs)
UNION ALL SELECT 'unmet', count(*) FROM v_epochs
UNION ALL SELECT 'relative', count(*) FROM v_epochs WHERE {PTP} < 55e-2 OR NOT (SELECT count_if({PTP} < 55e-2) >= greatest(1, least(8, count(*) // 4)) FROM v_epochs)""")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """A mask that leaves enough, one that leaves too little, and the relative rule."""
    size = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    return (
        size(cleaning.guarded_mask(masked(spark, sf, 0.6)), "strict")
        .unionByName(size(cleaning.guarded_mask(masked(spark, sf, 0.0)), "unmet"))
        .unionByName(size(cleaning.guarded_mask(masked(spark, sf, 0.55), relative=True), "relative"))
    )


def cleaned(spark: SparkSession, sf: str, fn) -> DataFrame:
    return v.long_form(v.epochs(spark, sf).select("epoch_id", fn("eeg").alias("eeg")), "epoch_id")


LONG_ROW = "SELECT epoch_id, ch::INT AS ch, t::INT AS t, round(v - {mean}, 6) AS v FROM v_long"


@query("a07_average_reference", LONG_ROW.format(mean="avg(v) OVER (PARTITION BY epoch_id, t)"))
def a07(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf, arrays.average_reference)


@query("a08_channel_demean", LONG_ROW.format(mean="avg(v) OVER (PARTITION BY epoch_id, ch)"))
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf, arrays.demean)


@query("a09_baseline", LONG_ROW.format(mean="avg(CASE WHEN t < 1 THEN v END) OVER (PARTITION BY epoch_id, ch)"))
def a09(spark: SparkSession, sf: str) -> DataFrame:
    """Eight samples have a one-sample baseline: a fifth of them, rounded down."""
    return cleaned(spark, sf, arrays.baseline)


@query("a10_amplitude_mask", "SELECT epoch_id, max(v) - min(v) < 55e-2 AS keep FROM v_long GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return v.epochs(spark, sf).select("epoch_id", cleaning.amplitude_mask("eeg", 0.55).alias("keep"))


CTES["v_ptp"] = "SELECT subject_id, epoch_id, ch, max(v) - min(v) AS ptp FROM v_long JOIN (SELECT epoch_id, subject_id FROM v_epochs) USING (epoch_id) GROUP BY 1, 2, 3"
CTES["v_dev"] = "SELECT *, abs(ptp - median(ptp) OVER (PARTITION BY subject_id, ch)) AS dev FROM v_ptp"
CTES["v_z"] = "SELECT *, dev / (14826e-4 * (median(dev) OVER (PARTITION BY subject_id, ch) + 1e-6)) AS z FROM v_dev"


@query("a11_robust_rejection", """
SELECT subject_id, epoch_id, round(bad, 6) AS bad_frac, CASE WHEN bool_or(bad <= 25e-2) OVER (PARTITION BY subject_id) THEN bad <= 25e-2
  ELSE row_number() OVER (PARTITION BY subject_id ORDER BY bad, epoch_id) <= greatest(1, count(*) OVER (PARTITION BY subject_id) // 2) END AS keep
FROM (SELECT subject_id, epoch_id, avg(CASE WHEN z > 2e0 THEN 1e0 ELSE 0e0 END) AS bad FROM v_z GROUP BY 1, 2)""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.rejection(v.epochs(spark, sf), "epoch_id", scope=["subject_id"], z_threshold=2.0)
    return rows.select("subject_id", "epoch_id", v.r6("bad_frac").alias("bad_frac"), "keep")


@query("a11_rejection_safety_net", """
SELECT subject_id, epoch_id, row_number() OVER (PARTITION BY subject_id ORDER BY bad, epoch_id) <= greatest(1, count(*) OVER (PARTITION BY subject_id) // 2) AS keep
FROM (SELECT subject_id, epoch_id, avg(CASE WHEN z > 0e0 THEN 1e0 ELSE 0e0 END) AS bad FROM v_z GROUP BY 1, 2)""")
def a11_net(spark: SparkSession, sf: str) -> DataFrame:
    """A threshold nothing can meet: the cleanest half of every subject stays."""
    rows = cleaning.rejection(v.epochs(spark, sf), "epoch_id", scope=["subject_id"], z_threshold=0.0, max_bad_fraction=-1.0)
    return rows.select("subject_id", "epoch_id", "keep")


@query("a12_feature_standardise", """
SELECT (i - 1)::INT AS idx, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(greatest(stddev_pop(embedding[i]::DOUBLE), 1e-6), 6) AS scale FROM embeddings, range(1, 65) r(i) GROUP BY i""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    stats = encoders.feature_stats(v.table(spark, sf, "embeddings"), "embedding")
    return stats.select("idx", v.r6("mean").alias("mean"), v.r6("scale").alias("scale"))


@query("a13_gram", """
SELECT (i - 1)::INT AS row, (j - 1)::INT AS col, round(CASE WHEN j <= 64 THEN sum(embedding[i]::DOUBLE * embedding[least(j, 64)]::DOUBLE) ELSE sum(embedding[i]::DOUBLE * vec[greatest(j - 64, 1)]) END, 5) AS s
FROM v_epochs JOIN l_vocab ON label = surface, range(1, 65) a(i), range(1, 129) b(j) GROUP BY i, j""")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    ready = train.with_targets(v.featured(spark, sf), v.label_vocab(spark, sf))
    lines = encoders.gram(ready, v.WIDTH, 64)
    return lines.select("row", F.posexplode("vec").alias("col", "s")).select("row", "col", F.round("s", 5).alias("s"))


@query("a14_component_removal")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return v.long_form(cleaning.remove_components(v.epochs(spark, sf).select("epoch_id", "eeg")), "epoch_id")


CTES["d_words"] = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents"
CTES["d_terms"] = """
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d_words) GROUP BY 1, 2"""
CTES["d_freq"] = """
SELECT term, sum(tf)::BIGINT AS tf_total, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM d_terms GROUP BY 1"""


@query("a15_document_frequency", "SELECT term, tf_total, df, round(idf, 6) AS idf FROM d_freq")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    freq = embedders.document_frequency(spread(v.table(spark, sf, "documents")), "doc_id", "text")
    return freq.select("term", "tf_total", "df", v.r6("idf").alias("idf"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.gold_ranks(v.embedded(spark, sf), v.label_vocab(spark, sf))


HIT = "round(avg(CASE WHEN gold_rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS {n}"
HITS = ", ".join(HIT.format(k=k, n=n) for k, n in ((1, "top1"), (5, "top5"), (25, "top25")))


@query("a16_retrieval_hit_rates", f"SELECT {HITS}, count(*) AS n_test FROM l_gold")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    rates = retrieval.hit_rates(gold(spark, sf), 5)
    return rates.select(v.r6("top1").alias("top1"), v.r6("top5").alias("top5"), v.r6("top25").alias("top25"), "n_test")


def fold_rates(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return retrieval.hit_rates(gold(spark, sf), 5, (key,))


@query("a17_fold_mean_report", """
SELECT strategy, count(*) AS n_folds, round(avg(h1), 6) AS top1, round(avg(h5), 6) AS top5 FROM (
  SELECT 'loso' AS strategy, avg((gold_rank <= 1)::INT) AS h1, avg((gold_rank <= 5)::INT) AS h5 FROM l_gold GROUP BY subject_id
  UNION ALL SELECT 'cross_session', avg((gold_rank <= 1)::INT), avg((gold_rank <= 5)::INT) FROM l_gold GROUP BY session_id) GROUP BY 1""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda key, name: fold_rates(spark, sf, key).agg(F.count(F.lit(1)).alias("n_folds"), v.r6(F.avg("top1")).alias("top1"), v.r6(F.avg("top5")).alias("top5")).withColumn("strategy", F.lit(name))
    return mean("subject_id", "loso").unionByName(mean("session_id", "cross_session"))


@query("a18_gate", """
SELECT subject_id, h5 > greatest(h1, 5e0 / (SELECT count(*) FROM l_vocab)) AS gate_pass, (SELECT bool_and(x.h5 > greatest(x.h1, 5e0 / (SELECT count(*) FROM l_vocab))) FROM
  (SELECT avg((gold_rank <= 1)::INT) AS h1, avg((gold_rank <= 5)::INT) AS h5 FROM l_gold GROUP BY subject_id) x) AS combined
FROM (SELECT subject_id, avg((gold_rank <= 1)::INT) AS h1, avg((gold_rank <= 5)::INT) AS h5 FROM l_gold GROUP BY 1)""")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 against two controls: the top-1 rate and the label prior."""
    n = v.label_vocab(spark, sf).count()
    rows = fold_rates(spark, sf, "subject_id").withColumn("prior", F.lit(min(5 / n, 1.0)))
    gated = rows.withColumn("gate_pass", retrieval.passes(F.col("top5"), [F.col("top1"), F.col("prior")]))
    both = gated.agg(F.bool_and("gate_pass").alias("combined"))
    return attach_row(gated, both).select("subject_id", "gate_pass", "combined")


@query("a19_subject_counts", "SELECT subject_id, count(*) AS n_epochs, count(DISTINCT label) AS n_labels, count(DISTINCT session_id) AS n_sessions FROM v_epochs GROUP BY 1")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return v.epochs(spark, sf).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count_distinct("label").alias("n_labels"), F.count_distinct("session_id").alias("n_sessions")
    )


@query("a20_manifest_totals", """
SELECT coalesce(f.family, d.family) AS family, coalesce(f.n, -1) AS file_count, coalesce(f.b, -1) AS total_size_bytes FROM
  (SELECT family, count(*) AS n, sum(size_bytes)::BIGINT AS b FROM v_files GROUP BY 1) f FULL JOIN
  (SELECT family, count(*) AS n, sum(size_bytes)::BIGINT AS b FROM v_observed GROUP BY 1) d ON f.family = d.family WHERE f.n IS DISTINCT FROM d.n OR f.b IS DISTINCT FROM d.b""")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    declared = release.totals(v.observed_files(spark, sf), "family").select("family", F.col("file_count").alias("declared_files"), F.col("total_size_bytes").alias("declared_bytes"))
    rows = release.totals_mismatch(v.files(spark, sf), declared, "family")
    return rows.select("family", F.coalesce("file_count", F.lit(-1)).alias("file_count"), F.coalesce("total_size_bytes", F.lit(-1)).alias("total_size_bytes"))


@query("a21_ordered_digest", "SELECT family AS key, count(*) AS n_pieces, sha256(string_agg(path, chr(10) ORDER BY path)) AS sha256 FROM v_files GROUP BY 1")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return release.scope_digest(v.files(spark, sf), "family", "path")


@query("a22_graph_contract", """
SELECT 'node' AS kind, id AS key, 'duplicate' AS rule FROM (SELECT id FROM g_nodes UNION ALL SELECT id FROM g_nodes WHERE type = 'Region') GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT 'edge', id, 'unknown-source' FROM g_edges WHERE relation = 'CONFLICTS_WITH'
UNION ALL SELECT 'edge', id, 'confidence' FROM g_edges WHERE confidence * 2 > 1
UNION ALL SELECT 'edge', id, 'provenance' FROM g_edges WHERE relation = 'PRESERVES'
UNION ALL SELECT 'synonym', surface, 'unknown-concept' FROM g_syn WHERE pos % 25 = 3""")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """The bound graph with repeated nodes, unknown ends, high confidences and lost provenance."""
    o = v.ontology(spark, sf)
    nodes = o.nodes.unionByName(o.nodes.where("type = 'Region'"))
    edges = o.edges.withColumn("source", F.when(F.col("relation") == "CONFLICTS_WITH", "nation:NOWHERE").otherwise(F.col("source"))).withColumn(
        "confidence", F.col("confidence") * 2).withColumn("provenance", F.when(F.col("relation") != "PRESERVES", F.col("provenance")))
    syn = o.synonyms.withColumn("concept_id", F.when(F.col("pos") % 25 == 3, "nation:NOWHERE").otherwise(F.col("concept_id")))
    return graph.contract_violations(nodes, edges, syn)


@query("a23_advisory_counts", """
SELECT count_if(o AND upper(severity) = 'CRITICAL')::BIGINT AS critical, count_if(o AND kev)::BIGINT AS exploited, count(*) AS records,
  count_if(o AND upper(severity) = 'CRITICAL') = 0 AND count_if(o AND kev) = 0 AS passes
FROM (SELECT *, lower(coalesce(status, 'open')) NOT IN ('remediated', 'resolved', 'closed', 'accepted') AS o FROM v_cve)""")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return supply.gate_counts(advisories_of(spark, sf))


@query("a24_quota_preflight", """
SELECT family, need AS needed_bytes, CASE WHEN need > 400000 THEN 'quota' WHEN 500000 < need + 250000 THEN 'free-space' ELSE 'ok' END AS refusal FROM (
  SELECT f.family, greatest(b, coalesce(d, 0)) AS need FROM (SELECT family, sum(size_bytes)::BIGINT AS b FROM v_files GROUP BY 1) f
  LEFT JOIN (SELECT family, sum(size_bytes)::BIGINT + 20 AS d FROM v_observed GROUP BY 1) USING (family))""")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    declared = v.observed_files(spark, sf).groupBy("family").agg((F.sum("size_bytes") + 20).alias("declared_bytes"))
    rows = release.quota_preflight(v.files(spark, sf), declared, "family", 400_000, 500_000, 250_000)
    return rows.select("family", "needed_bytes", F.coalesce("refusal", F.lit("ok")).alias("refusal"))


@query("a25_run_lineage")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    ep = v.featured(spark, sf)
    cfg = train.TrainConfig(width=v.WIDTH, ridge=1.0)
    reports, _ = train.train_report(ep, cfg)
    digest = release.scope_digest(v.files(spark, sf), "lang", "path").agg(F.max("sha256")).head()[0]
    return train.run_lineage(ep, reports, "embeddings", F.lit(digest))


