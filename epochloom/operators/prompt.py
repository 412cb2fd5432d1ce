"""Structured prompts: compile, validate, hash and render, one row per request."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epochloom.functions import arrays
from epochloom.functions.arrays import Col, _c
from epochloom.operators.graph import anchor_violations

# Closed sets, patterns and limits of the prompt contract.
CONCEPT_PATTERN = r"^[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9_-]+\z"
MODALITIES = ("image", "text", "music", "video", "3d")
STATUSES = ("accepted", "suggested", "rejected", "unknown")
OPERATORS = ("set", "increase", "decrease", "preserve", "avoid")
TOP_KEYS = ("schema_version", "modality", "intent", "subject", "attributes", "constraints", "kg")
MAX_PROMPT_BYTES = 65_536
MAX_OUTPUT_CHARS = 4_000
MAX_ANCHORS = 20
DEFAULT_PROVENANCE = "eeg:epoch_unknown"


def top_anchor(anchors: DataFrame, request: str, seq: str = "rank") -> DataFrame:
    """Best score per request, the earlier anchor on a tie."""
    best = F.max_by(F.struct("surface", "score", "provenance"), F.struct(F.col("score"), -F.col(seq)))
    return anchors.groupBy(request).agg(best.alias("top"))


def oversized_requests(
    resolved: DataFrame, edges: DataFrame, request: str, limit: int = MAX_PROMPT_BYTES
) -> DataFrame:
    """Requests whose attributes and conflicts alone pass the size policy.

    Found by summing lengths, so such a prompt is refused without being collected. As in the prompt, accepted
    rows of the subject's own concept don't count.
    """
    subject = resolved.where(F.col("status") == "accepted").groupBy(request).agg(
        F.min(F.struct("seq", "concept_id")).getField("concept_id").alias("_subject")
    )
    own = (F.col("status") == "accepted") & F.col("concept_id").eqNullSafe(F.col("_subject"))
    attribute = F.octet_length(F.to_json(F.struct("concept_id", "operator", "label", "provenance")))
    sizes = resolved.join(subject, request, "left").where(~F.coalesce(own, F.lit(False))).select(request, attribute.cast("long").alias("_b")).unionByName(
        edges.where(F.col("relation") == "CONFLICTS_WITH").select(
            request, F.octet_length("target").cast("long").alias("_b")
        )
    )
    return sizes.groupBy(request).agg(F.sum("_b").alias("bytes")).where(F.col("bytes") > limit)


def request_summary(anchors: DataFrame, request: str) -> DataFrame:
    """Everything one pass over the anchors gives a request: best anchor, surfaces,
    provenance, count, subgraph id and the first broken anchor rule."""
    packed = anchors.groupBy(request).agg(*summary_aggregates())
    return summary_of(packed, request)


def summary_aggregates() -> list[Column]:
    best = F.max_by(F.struct("surface", "score", "provenance"), F.struct(F.col("score"), -F.col("rank")))
    listed = F.sort_array(F.collect_list(F.struct("rank", "surface", "provenance")))
    return [best.alias("top"), listed.alias("_a"), F.min(anchor_violations()).alias("anchor_error")]


def summary_of(packed: DataFrame, request: str, *more: str) -> DataFrame:
    surfaces = F.transform("_a", lambda a: a["surface"])
    joined = F.array_join(F.array_sort(F.transform("_a", lambda a: F.coalesce(a["surface"], F.lit("")))), "|")
    subgraph = F.concat(F.lit("sg:"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 8))
    return packed.select(
        request, "top", surfaces.alias("surfaces"), F.size("_a").alias("anchor_count"), "anchor_error",
        subgraph.alias("subgraph_id"),
        F.concat(F.flatten(F.transform("_a", lambda a: a["provenance"])), F.array(F.concat(F.lit("kg:"), subgraph))).alias("provenance"), *more,
    )


def compile_prompts(
    summary: DataFrame, resolved: DataFrame, edges: DataFrame, request: str, *, ontology_version: str,
    modality: Column | None = None, intent_value: str = "decode", subject_fallback: str = "text:Topic",
) -> DataFrame:
    """The request summary with one prompt struct added.

    Intent comes from the best score, the subject from the first accepted concept in
    anchor order; accepted rows of the subject's concept are left out of the attributes.
    """
    ordered = resolved.groupBy(request).agg(F.sort_array(F.collect_list(item_of())).alias("items"))
    conflicts = edges.where(F.col("relation") == "CONFLICTS_WITH").groupBy(request).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "target"))),
            lambda e: F.concat(F.lit("avoid "), e["target"]),
        ).alias("forbidden")
    )
    rows = summary.join(ordered, request, "left").join(conflicts, request, "left")
    return prompts_of(
        rows, summary.columns, ontology_version=ontology_version, modality=modality, intent_value=intent_value, subject_fallback=subject_fallback
    )


def item_of(row: Callable[[str], Column] = F.col) -> Column:
    """A resolved concept as an item; items sort in prompt order, accepted ones first."""
    names = ("seq", "concept_id", "operator", "label", "confidence", "status", "provenance")
    return F.struct((row("status") != "accepted").alias("late"), *[row(n).alias(n) for n in names])


def attribute_bytes(items: Column, forbidden: Column) -> Column:
    """As ``oversized_requests`` counts: items but for accepted ones of the subject, and conflicts."""
    subject = F.get(F.filter(items, lambda i: i["status"] == "accepted"), F.lit(0))["concept_id"]
    size = lambda i: F.octet_length(F.to_json(F.struct(i["concept_id"], i["operator"], i["label"], i["provenance"]))).cast("long")
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0).cast("long")))
    others = arrays.bound(subject, lambda own: F.filter(items, lambda i: ~F.coalesce((i["status"] == "accepted") & (i["concept_id"] == own), F.lit(False))))
    return F.coalesce(total(F.transform(others, size)), F.lit(0)) + F.coalesce(
        total(F.transform(forbidden, lambda t: F.octet_length(t).cast("long"))), F.lit(0)
    )


def prompts_of(
    rows: DataFrame, keep: Sequence[str], *, ontology_version: str, modality: Column | None = None,
    intent_value: str = "decode", subject_fallback: str = "text:Topic",
) -> DataFrame:
    """The columns ``keep`` and the prompt of rows that hold ``top``, ``subgraph_id``, sorted ``items`` and ``forbidden``."""
    first = F.try_element_at(F.filter("items", lambda i: i["status"] == "accepted"), F.lit(1))
    fallback = F.struct(
        F.lit(subject_fallback).alias("concept_id"), F.lit("topic").alias("label"),
        F.lit(0.5).cast("double").alias("confidence"), F.array(F.lit("kg:fallback")).alias("provenance"),
    )
    found = F.struct(
        F.col("_first.concept_id").alias("concept_id"), F.col("_first.label").alias("label"),
        F.col("_first.confidence").alias("confidence"), F.col("_first.provenance").alias("provenance"),
    )
    rows = rows.withColumn("_first", first).withColumn(
        "subject", F.when(F.col("_first").isNotNull(), found).otherwise(fallback)
    )
    attributes = F.transform(
        F.filter("items", lambda i: ~((i["concept_id"] == F.col("subject.concept_id")) & (i["status"] == "accepted"))),
        lambda i: F.struct(
            F.when(F.contains(i["concept_id"], F.lit(":")), i["concept_id"]).otherwise(F.lit("text:Keyword")).alias("concept_id"),
            i["operator"].alias("operator"), i["label"].alias("value"), i["confidence"].alias("confidence"),
            i["status"].alias("status"), i["provenance"].alias("provenance"),
        ),
    )
    empty_text = F.array().cast("array<string>")
    empty_items = F.array().cast(
        "array<struct<concept_id:string,operator:string,value:string,confidence:double,status:string,provenance:array<string>>>"
    )
    prompt = F.struct(
        F.lit("1.0").alias("schema_version"), (modality if modality is not None else F.lit("text")).alias("modality"),
        F.struct(
            F.lit(intent_value).alias("value"), F.coalesce("top.score", F.lit(0.5)).alias("confidence"),
            F.coalesce("top.provenance", F.array(F.lit(DEFAULT_PROVENANCE))).alias("provenance"),
        ).alias("intent"),
        F.col("subject"), F.coalesce(attributes, empty_items).alias("attributes"),
        F.struct(empty_text.alias("required"), F.coalesce("forbidden", empty_text).alias("forbidden")).alias("constraints"),
        F.struct(F.lit(ontology_version).alias("ontology_version"), F.coalesce("subgraph_id", F.lit("")).alias("subgraph_id")).alias("kg"),
    )
    return rows.select(*keep, prompt.alias("prompt"))


def _grounded(block: Column) -> Column:
    """Confidence in [0, 1] and a provenance list without empty entries."""
    ok = block["confidence"].between(0.0, 1.0) & ~F.isnan(block["confidence"])
    listed = (F.size(block["provenance"]) > 0) & F.forall(block["provenance"], lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(ok & listed, F.lit(False))


def prompt_errors(prompt: Col = "prompt", limit: int = 8) -> Column:
    """Broken rules of a typed prompt, the first ``limit`` of them."""
    p = _c(prompt)
    concept = lambda c: F.coalesce(c.rlike(CONCEPT_PATTERN), F.lit(False))
    attribute_ok = lambda a: (
        concept(a["concept_id"]) & F.coalesce(a["operator"].isin(*OPERATORS), F.lit(False))
        & F.coalesce(a["status"].isin(*STATUSES), F.lit(False)) & _grounded(a)
    )
    rules = [
        (F.coalesce(p["schema_version"] == "1.0", F.lit(False)), "schema_version"),
        (F.coalesce(p["modality"].isin(*MODALITIES), F.lit(False)), "modality"),
        (_grounded(p["intent"]) & F.coalesce(p["intent"]["value"] != "", F.lit(False)), "intent"),
        (_grounded(p["subject"]) & F.coalesce(p["subject"]["label"] != "", F.lit(False)), "subject"),
        (concept(p["subject"]["concept_id"]), "subject.concept_id"),
        (p["attributes"].isNotNull() & F.forall(p["attributes"], attribute_ok), "attributes"),
        (p["constraints"]["required"].isNotNull() & p["constraints"]["forbidden"].isNotNull(), "constraints"),
        (F.coalesce((p["kg"]["ontology_version"] != "") & (p["kg"]["subgraph_id"] != ""), F.lit(False)), "kg"),
    ]
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules]), lambda v: v.isNotNull()
    )
    return F.slice(broken, 1, limit)


def extra_keys(document: Col, allowed: tuple[str, ...] = TOP_KEYS) -> Column:
    """Top-level keys of a JSON text outside the closed set, sorted."""
    keys = F.coalesce(F.json_object_keys(_c(document)), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))


def canonical(prompt: Col = "prompt") -> Column:
    """Compact JSON with sorted keys at every level."""
    p = _c(prompt)
    grounded = lambda b, names: F.struct(*[b[n].alias(n) for n in sorted(names)])
    return F.to_json(F.struct(
        F.transform(p["attributes"], lambda a: grounded(a, ["concept_id", "operator", "value", "confidence", "status", "provenance"])).alias("attributes"),
        F.struct(p["constraints"]["forbidden"].alias("forbidden"), p["constraints"]["required"].alias("required")).alias("constraints"),
        grounded(p["intent"], ["value", "confidence", "provenance"]).alias("intent"),
        F.struct(p["kg"]["ontology_version"].alias("ontology_version"), p["kg"]["subgraph_id"].alias("subgraph_id")).alias("kg"),
        p["modality"].alias("modality"), p["schema_version"].alias("schema_version"),
        grounded(p["subject"], ["concept_id", "label", "confidence", "provenance"]).alias("subject"),
    ))


def prompt_hash(prompt: Col = "prompt") -> Column:
    return F.sha2(canonical(prompt).cast("binary"), 256)


def within_size(prompt: Col = "prompt", limit: int = MAX_PROMPT_BYTES) -> Column:
    return F.octet_length(canonical(prompt)) <= limit


def summary_text(prompt: Col, surfaces: Col, limit: int = MAX_OUTPUT_CHARS) -> Column:
    """Local summary: anchors and subject, with suggested items marked apart."""
    p, s = _c(prompt), _c(surfaces)
    suggested = F.transform(
        F.filter(p["attributes"], lambda a: a["status"] == "suggested"),
        lambda a: F.coalesce(F.nullif(a["value"], F.lit("")), a["concept_id"]),
    )
    listed = F.when(F.coalesce(F.size(s), F.lit(0)) > 0, F.array_join(s, ", ")).otherwise(F.lit("(none)"))
    head = F.concat(F.lit("[EEG-to-text] Anchors: "), listed, F.lit(". Subject: "), p["subject"]["label"], F.lit("."))
    tail = F.when(
        F.size(suggested) > 0,
        F.concat(F.lit(" KG suggestions (not EEG-read): "), F.array_join(suggested, ", "), F.lit(".")),
    ).otherwise(F.lit(""))
    return F.substring(F.concat(head, tail), 1, limit)
