"""Decoding arriving epochs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epochloom.functions import arrays
from epochloom.operators import retrieval
from epochloom.plans import decode as batch_decode


def anchors_stream(stream: DataFrame, model, vocab: DataFrame, width: int, k: int = 5, request: str = "epoch_id") -> DataFrame:
    """Top anchors of arriving epochs: a stateless plan, so it scales with its partitions."""
    good = stream.where(batch_decode.input_violation("eeg").isNull())
    encoded = model.transform(good.withColumn("x", arrays.features("eeg", width)))
    return retrieval.as_anchors(retrieval.top_anchors(encoded, vocab, k, request))


def decode_batch(model, vocab: DataFrame, ontology, width: int, folder: str, request: str = "epoch_id"):
    """A micro-batch job that decodes and writes results and rejects, once per batch id."""

    def job(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        good, bad = batch_decode.decode(rows, model, vocab, ontology, request, width=width)
        flat = good.select(request, "prompt_hash", "text", "anchor_count", F.to_json("prompt").alias("prompt"))
        flat.write.mode("overwrite").parquet(f"{folder}/decoded/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{folder}/rejected/batch_id={batch_id}")
        rows.unpersist()

    return job
