"""Bounded samples of labelled documents, shared by the classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochloom.llm.common import text_of


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int) -> DataFrame:
    """At most about ``most`` rows ``text, label`` of documents that aren't held out.

    Beyond ``most`` labelled ids the ids are thinned by their hash, so the sample doesn't depend on the
    partitioning. The thinned label table has at most about ``most`` rows and is broadcast; no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).filter(
        "_id is not null and label in (0, 1)"
    ).filter(~held_out(F.col("_id"), parts, part)).groupBy("_id").agg(F.min("label").alias("label"))
    count = known.count()
    if count > most:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / count))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    return texts.join(F.broadcast(known), "_id").select("text", "label")
