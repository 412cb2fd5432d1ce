"""Queries of the operators over the given tables and, where SQL can say it, their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epochloom.llm import bit_planes, decontaminate, katz, ns_bounds, order_minhash, packing, pii, projected_neighbours, quality, sharding, toxicity, turn_repair, url_filter
from epochloom.llm.common import documents
from epochloom.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: Host labels whose pages make up the URL list of the query.
LISTED_LABELS = ("spam-farm", "casino-win", "free-bets", "ads-track", "cheap-pills", "adult-x")

_AFTER = "coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '')"
_HOST = f"translate(regexp_extract({_AFTER}, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}')"
_PATH = f"regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1)"
_KEPT = (
    f"list_sort(list_filter(string_split(regexp_extract({_AFTER}, '^[^?#]*[?]([^#]*)', 1), '&'), "
    f"lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}')))"
)
OP1_SQL = f"""
WITH cut AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_KEPT} AS kept FROM pages),
keyed AS (SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^(www\\.|m\\.)+', ''), '(:80|:443)$', '')
  || regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key FROM cut),
listed AS (SELECT DISTINCT key FROM keyed
  WHERE key <> '' AND list_has_any(string_split(host, '.'), ['{"', '".join(LISTED_LABELS)}'])),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM keyed)
SELECT page_id, host, path, rule, l.key IS NOT NULL AS listed,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON r.key = l.key
"""


@query("op1_blocked_bloom_urls", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; listed are the URLs of hosts with a listed label."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = F.split(url_filter.host_of(F.col("url")), r"\.")
    listed = pages.filter(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS]))).select("url")
    return url_filter.judge(pages, listed)


@query("op2_weak_supervision_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op3_boosted_tree_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op4_offset_preserving_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and disguised."""
    return pii.find(documents(spark, sf_dir, "doc_id", "text"))


@query("op5_bm25_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.leaks(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op6_bit_planes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as plane-shuffled blocks and read back."""
    path = new_folder(spark, "ids")
    bit_planes.write_ids(documents(spark, sf_dir, "doc_id", "text"), path)
    return bit_planes.read_ids(spark, path, keep_ids=False)


@query("op7_karmarkar_karp_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of nearly equal bytes."""
    return sharding.assign(documents(spark, sf_dir, "doc_id", "text"))


@query("op8_projected_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query."""
    return projected_neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"))


@query("op11_katz_backoff")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by the model of those that aren't held out."""
    return katz.held_out_scores(documents(spark, sf_dir, "doc_id", "text"))


def _op12_sql(params: ns_bounds.Params = ns_bounds.Params()) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding,
  lambda x: CAST(floor({params.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {params.width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {params.width}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{params.seed}:' || vec_id), v) - 1 AS c, v AS m
  FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {params.clusters})"""]
    for r in range(params.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, min({{'d': CAST(list_sum(list_transform(list_zip(v, m),
  lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}}) AS best FROM kept, m{r} GROUP BY rid)""")
        if r < params.rounds:
            steps.append(f"""m{r + 1} AS MATERIALIZED (SELECT c, coalesce(list(mean ORDER BY i) FILTER (mean IS NOT NULL), any_value(m)) AS m
  FROM m{r} LEFT JOIN (SELECT best.c AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS mean
    FROM a{r} JOIN kept USING (rid), range(1, {params.width + 1}) t(i) GROUP BY best.c, i) USING (c) GROUP BY c)""")
    last = params.rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (rid) JOIN m{last} ON c = best.c"""


@query("op12_ns_bounds", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds."""
    return ns_bounds.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with turns dropped, emptied, cut short, repeated and given to the user, by their ids' hash."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turn_repair.report(turn_repair.repair(damaged(rows)), rows)
