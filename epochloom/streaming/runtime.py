"""Reading and draining streams."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from epochloom.session import new_folder


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream, restricted to files of one name pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table of a folder as a stream, stored as one file or as a folder of files."""
    found = spark.read.schema(schema).parquet(f"{folder}/{name}").inputFiles()
    if len(found) == 1 and found[0].endswith(f"/{name}"):
        return parquet_stream(spark, folder, name, schema)
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}")


def drain(stream: DataFrame, label: str, at: tuple[str, str] | None = None) -> DataFrame:
    """Run an append stream over everything available and read its Parquet sink back.

    ``at`` names the sink and the checkpoint of an earlier run that is taken up again.
    """
    spark = stream.sparkSession
    out, state = at or (new_folder(spark, label), new_folder(spark, f"{label}-state"))
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_arrivals(
    stream: Callable[[], DataFrame], arrivals: Iterable[DataFrame], folder: str, label: str,
) -> DataFrame:
    """Run a stream that reads ``folder`` once for each arrival, stopped in between.

    Each run takes up the checkpoint of the one before: the source's offsets, the watermark and all state. The plan
    is built anew every time, as after a restart of the driver.
    """
    out = None
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        if out is None:
            at = (new_folder(rows.sparkSession, label), new_folder(rows.sparkSession, f"{label}-state"))
        out = drain(stream(), label, at)
    return out


def drain_batches(stream: DataFrame, label: str, job) -> None:
    """Run ``job(batch, batch_id)`` over everything available."""
    state = new_folder(stream.sparkSession, f"{label}-state")
    query = (
        stream.writeStream.foreachBatch(job).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
