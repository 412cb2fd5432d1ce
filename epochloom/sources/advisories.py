"""Vulnerability records: both document shapes, and the snapshot upsert."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from epochloom import schemas

_DOCUMENT = T.StructType(
    [*schemas.CVE.fields, T.StructField("records", T.ArrayType(schemas.CVE)),
     T.StructField("_corrupt", T.StringType())]
)


def advisory_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records of ``{records: [...]}`` and single-object documents; unreadable ones are skipped."""
    docs = (
        spark.read.schema(_DOCUMENT).option("multiLine", multi_line)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )
    single = F.struct(*[F.col(f.name) for f in schemas.CVE.fields])
    records = F.coalesce(
        F.col("records"),
        F.when(F.coalesce("cve", F.lit("")) != "", F.array(single)),
    )
    return (
        docs.where(F.col("_corrupt").isNull())
        .select(F.explode(records).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    )


def valid_id(column: str = "cve") -> Column:
    return F.coalesce(F.lower(column).startswith("cve-"), F.lit(False))


def upsert(current: DataFrame, incoming: DataFrame, snapshot_date: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Latest record per lower-cased id, and the incoming rows whose id is invalid.

    ``order`` numbers the incoming rows; the last one of an id wins over all others.
    """
    stamped = incoming.withColumn("cve_key", F.lower("cve"))
    rejected = stamped.where(~valid_id("cve"))
    fresh = stamped.where(valid_id("cve")).withColumn(
        "source", F.coalesce("source", F.lit(f"approved snapshot {snapshot_date}"))
    ).withColumn("snapshot_date", F.lit(snapshot_date)).withColumn("_rank", F.col(order).cast("long"))
    old = current.withColumn("cve_key", F.lower("cve")).withColumn("_rank", F.lit(-1).cast("long"))
    columns = ["cve_key", *schemas.CVE.fieldNames(), "_rank"]
    merged = old.select(*columns).unionByName(fresh.select(*columns))
    w = Window.partitionBy("cve_key").orderBy(F.desc("_rank"))
    latest = merged.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")
    return latest, rejected


def known_exploited_snapshot(catalogue: DataFrame, source: str, snapshot_date: str) -> DataFrame:
    """One row that dates and counts a known-exploited catalogue."""
    return catalogue.agg(F.count(F.lit(1)).alias("kev_count")).select(
        F.lit(source).alias("source"), F.lit(snapshot_date).alias("snapshot_date"), "kev_count"
    )
