"""Vulnerability gate job."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochloom.operators import supply
from epochloom.sources.advisories import advisory_records


def gate(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Unresolved records and the one-row verdict of an advisory folder."""
    records = advisory_records(spark, path, multi_line)
    return supply.unresolved(records), supply.gate_counts(records)
