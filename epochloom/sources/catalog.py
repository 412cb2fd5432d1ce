"""Catalogue documents: dataset manifests, release families and ontologies."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epochloom import schemas
from epochloom.functions import paths
from epochloom.functions.text import strip


def manifest_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pinned dataset manifests, one row per document."""
    return (
        spark.read.schema(schemas.MANIFEST).option("multiLine", multi_line)
        .option("mode", "FAILFAST").json(path)
    )


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Manifests with the list of contract rules they break."""
    remote = F.col("provider") == "huggingface"
    revision = F.lower(F.coalesce("revision", F.lit("")))
    bad_shard = F.exists("shards", lambda s: (
        paths.is_unsafe_relative(s["path"]) | s["size_bytes"].isNull() | (s["size_bytes"] < 0)
        | ~F.coalesce(F.lower(s["sha256"]).rlike(schemas.SHA256_PATTERN), F.lit(False))
    ))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        (blank("dataset_id"), "dataset_id"),
        (~F.coalesce(F.col("provider").isin("local", "huggingface"), F.lit(False)), "provider"),
        (remote & (F.coalesce("repo_id", F.lit("")) == ""), "repo_id"),
        ((revision == "") | revision.isin(*schemas.MOVING_REVISIONS), "moving-revision"),
        (remote & ~revision.rlike(schemas.COMMIT_PATTERN), "commit"),
        (~(F.coalesce("sampling_rate_hz", F.lit(0.0)) > 0), "sampling_rate_hz"),
        ((F.coalesce("n_channels_source", F.lit(0)) < 1) | (F.coalesce("n_times_source", F.lit(0)) < 1), "dimensions"),
        ((F.coalesce(F.size("labels"), F.lit(0)) < 1) | F.coalesce(F.exists("labels", lambda v: strip(v) == ""), F.lit(False)), "labels"),
        ((F.coalesce("subject_field", F.lit("")) == "") | (F.coalesce("session_field", F.lit("")) == ""), "fields"),
        (F.coalesce(F.size("shards"), F.lit(0)) < 1, "no-shards"),
        (F.coalesce(bad_shard, F.lit(False)), "shard"),
    ]
    broken = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules]),
        lambda v: v.isNotNull(),
    )
    return manifests.withColumn("violations", broken)


def manifest_shards(manifests: DataFrame) -> DataFrame:
    return manifests.select("dataset_id", "provider", "revision", F.posexplode("shards").alias("shard_no", "s")).select(
        "dataset_id", "provider", "revision", "shard_no", F.col("s.path").alias("path"),
        F.col("s.size_bytes").alias("size_bytes"), F.lower("s.sha256").alias("sha256"),
    )


def family_documents(documents: DataFrame, doc_key: str, json_column: str) -> DataFrame:
    """One row per release family of each catalogue document, in family-key order."""
    parsed = documents.select(
        doc_key, F.from_json(json_column, T.MapType(T.StringType(), schemas.FAMILY)).alias("m")
    )
    rows = parsed.select(doc_key, F.explode("m").alias("family_key", "f")).where(
        F.col("family_key").isin(*schemas.FAMILY_IDS)
    )
    out = rows.select(doc_key, "family_key", "f.*")
    return out.select(
        doc_key, "family_key",
        F.coalesce("dataset_id", "family_key").alias("dataset_id"),
        "release_id", "local_root", F.trim("repo_id").alias("repo_id"),
        F.coalesce("provider", F.lit("huggingface")).alias("provider"), "scope_status",
        F.coalesce("visibility", "governance.visibility").alias("visibility"),
        F.coalesce("governance.visibility", "visibility").alias("governance_visibility"),
        "provenance_references", "governance",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "source", "license_note")],
        "expected_source_files", "expected_source_bytes", "observed_local_files", "observed_local_bytes",
    )


def family_violations(families: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """Families with the cross-field rules they break."""
    slashes = F.size(F.split("repo_id", "/")) - 1
    negative = F.lit(False)
    for c in ("expected_source_files", "expected_source_bytes", "observed_local_files", "observed_local_bytes"):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    rules = [
        (F.col("dataset_id") != F.col("family_key"), "key"),
        (~F.coalesce(F.col("dataset_id").isin(*schemas.FAMILY_IDS), F.lit(False)), "dataset_id"),
        (strip(F.coalesce("release_id", F.lit(""))) == "", "release_id"),
        (paths.is_unsafe_relative("local_root"), "local_root"),
        ((slashes != 1) | F.col("repo_id").startswith("/") | F.col("repo_id").endswith("/") | F.contains("repo_id", F.lit("..")), "repo_id"),
        (F.lower("repo_id").isin(*[p.lower() for p in protected]) if protected else F.lit(False), "protected"),
        (F.col("visibility") != F.col("governance_visibility"), "visibility-mismatch"),
        ((F.col("dataset_id") == "D03") & (F.col("scope_status") == "full-upstream"), "scope"),
        ((F.coalesce(F.size("provenance_references"), F.lit(0)) < 1) | F.coalesce(F.exists("provenance_references", lambda v: strip(v) == ""), F.lit(False)), "provenance"),
        (negative, "negative-count"),
    ]
    rules += [
        (~F.coalesce(F.col(c).isin(*schemas.DOMAINS[c]), F.lit(False)), c)
        for c in ("provider", "scope_status", "visibility")
    ]
    rules += [
        (~F.coalesce(F.col(f"governance.{c}").isin(*schemas.DOMAINS[c]), F.lit(False)), c)
        for c in ("license_status", "dua_status", "custodian_status", "deidentification_status")
    ]
    broken = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules]),
        lambda v: v.isNotNull(),
    )
    return families.withColumn("violations", broken)


def ontology_tables(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and synonyms of ontology documents, with their order inside a document."""
    S = T.StringType()
    document = schemas.struct(
        ontology_version=S,
        nodes=T.ArrayType(schemas.struct(id=S, type=S, label=S)),
        edges=T.ArrayType(schemas.struct(
            id=S, source=S, relation=S, target=S, confidence=T.DoubleType(), provenance=S,
            qualifier=T.MapType(S, S),
        )),
        synonyms=T.ArrayType(schemas.struct(surface=S, concept_id=S)),
    )
    doc = spark.read.schema(document).option("multiLine", multi_line).json(path)

    def part(name: str) -> DataFrame:
        return doc.select(F.posexplode(name).alias("pos", "r")).select("r.*", F.col("pos").cast("long").alias("pos"))

    return part("nodes"), part("edges"), part("synonyms")
