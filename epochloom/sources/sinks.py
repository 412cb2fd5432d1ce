"""Report, weight, manifest and audit sinks."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_report(report: DataFrame, weights: DataFrame | None, folder: str) -> None:
    """The metrics of every run; the model only when every report row passed its gate."""
    status = F.when(F.col("gate_pass"), "validated").otherwise("blocked_below_control")
    report.withColumn("deployment_status", status).write.mode("overwrite").json(f"{folder}/report")
    passed = report.agg(F.bool_and("gate_pass").alias("ok")).head()["ok"]
    if passed and weights is not None:
        weights.write.mode("overwrite").parquet(f"{folder}/weights")


def save_weights(weights: DataFrame, folder: str) -> None:
    """Weights as rows ``(model_id, part, row, vec)``: any matrix, one row per line of it."""
    weights.select("model_id", "part", "row", "vec").write.mode("overwrite").parquet(folder)


def load_weights(spark: SparkSession, folder: str, model_id: str | None = None) -> DataFrame:
    rows = spark.read.schema("model_id string, part string, row int, vec array<double>").parquet(folder)
    return rows if model_id is None else rows.where(F.col("model_id") == model_id)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; NULL fields are written as ``null``."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def _running_digest():
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        sep = b""
        tail = b""
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.key != current:
                    if state is not None:
                        state.update(tail)
                        done.append((current, count, state.hexdigest()))
                    current, state, count = row.key, hashlib.sha256(row.head.encode()), 0
                    sep, tail = row.sep.encode(), row.tail.encode()
                if row.piece is not None:
                    state.update(sep if count else b"")
                    state.update(row.piece.encode())
                    count += 1
            if done:
                yield pd.DataFrame(done, columns=["key", "n_pieces", "sha256"])
        if state is not None:
            state.update(tail)
            yield pd.DataFrame([(current, count, state.hexdigest())], columns=["key", "n_pieces", "sha256"])

    return digest


def ordered_digest(
    df: DataFrame, key: Column, order: Column, piece: Column, sep: str,
    head: Column | None = None, tail: Column | None = None,
) -> DataFrame:
    """SHA-256 of ``head + sep.join(pieces in order) + tail`` per key.

    The digest is defined over one byte sequence, so each key is read in order by
    one task; rows stream through a sort that can spill and only the hash state is
    held. No list of pieces is ever collected.
    """
    rows = df.select(
        key.cast("string").alias("key"), order.alias("ord"), piece.alias("piece"), F.lit(sep).alias("sep"),
        (F.lit("") if head is None else head).alias("head"),
        (F.lit("") if tail is None else tail).alias("tail"),
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", "ord").drop("ord")
    return ordered.mapInPandas(_running_digest(), "key string, n_pieces bigint, sha256 string")


def append_audit(
    batch: DataFrame, batch_id: int, folder: str, dead_letter: str, required: tuple[str, ...] = ("event_type", "timestamp")
) -> None:
    """Write one micro-batch of audit events; what cannot be written goes aside.

    A row without a required field goes to the dead letters with the field's name, the others are written; when the
    write itself fails, the whole batch goes aside. A batch that is run again replaces what it wrote.
    """
    missing = F.lit(None).cast("string")
    for name in reversed([c for c in required if c in batch.columns]):
        missing = F.when(F.col(name).isNull(), F.lit(f"missing:{name}")).otherwise(missing)
    rows = batch.withColumn("error", missing).persist()
    aside = lambda df: df.write.mode("overwrite").json(dead_letter_of)
    dead_letter_of = f"{dead_letter}/batch_id={batch_id}"
    try:
        bad = rows.where("error IS NOT NULL")
        if not bad.isEmpty():
            aside(bad)
        rows.where("error IS NULL").drop("error").write.mode("overwrite").json(f"{folder}/batch_id={batch_id}")
    except Exception as error:  # noqa: BLE001 - telemetry must not stop the pipeline
        aside(rows.withColumn("error", F.coalesce("error", F.lit(type(error).__name__))))
    finally:
        rows.unpersist()
