"""Helpers that several operators share."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochloom.session import new_folder


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again.

    The written table cuts the lineage: a lost executor costs a reread, not the work before it.
    """
    return replaced(df, label, None)[0]


#: With it, a query's shuffle files go when it ends and not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that a Python task is sent at once, besides a limit of rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for the jobs that run within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replaced(df: DataFrame, label: str, old: str | None) -> tuple[DataFrame, str]:
    """As ``saved``, with the new path; the written table ``old``, which ``df`` was made from, goes."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    if old is not None:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(df.schema).parquet(path), path


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one counting as empty."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))
