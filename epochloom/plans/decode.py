"""Decode job: epochs or given anchors to validated prompts and text, one row per request."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from epochloom.functions import arrays
from epochloom.functions.scale import small_side
from epochloom.operators import graph, prompt, retrieval
from epochloom.session import written

MAX_CHANNELS, MAX_TIMES = 64, 2500


@dataclass
class Ontology:
    nodes: DataFrame
    edges: DataFrame
    synonyms: DataFrame
    version: str


def input_violation(signal: str = "eeg", override: str | None = None) -> Column:
    """The first broken rule of a decode request, NULL for a good one."""
    has_signal = F.col(signal).isNotNull()
    has_override = F.lit(False) if override is None else F.col(override).isNotNull()
    sizes_ok = (F.size(signal) <= MAX_CHANNELS) & (F.size(F.get(F.col(signal), F.lit(0))) <= MAX_TIMES)
    finite = F.forall(signal, lambda r: F.forall(r, lambda v: (
        v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    )))
    many = F.lit(False) if override is None else F.size(override) > prompt.MAX_ANCHORS
    return (
        F.when(has_signal == has_override, F.lit("exactly-one-input"))
        .when(has_signal & ~arrays.is_epoch(signal), F.lit("shape"))
        .when(has_signal & ~sizes_ok, F.lit("dimensions"))
        .when(has_signal & ~finite, F.lit("not-finite"))
        .when(many, F.lit("too-many-anchors"))
    )


def override_anchors(requests: DataFrame, vocab: DataFrame, request: str, override: str) -> tuple[DataFrame, DataFrame]:
    """Given anchors in anchor form, and the requests with one outside the vocabulary."""
    rows = requests.where(F.col(override).isNotNull()).select(request, F.posexplode(override).alias("_p", "a")).select(
        request, F.col("a.surface").alias("raw"), F.col("a.score").cast("double").alias("score"), F.col("a.rank").cast("int").alias("rank")
    )
    good, bad = graph.in_vocabulary(rows, "raw", vocab)
    refused = bad.select(request).distinct()
    anchors = good.join(refused, request, "left_anti").select(
        request, F.concat(F.lit("anchor:"), F.replace("clean", F.lit(" "), F.lit("_"))).alias("anchor_id"),
        F.col("clean").alias("surface"), "score", "rank", F.array(F.lit("eeg:epoch_override")).alias("provenance"),
    )
    return anchors, refused


@dataclass
class Resolution:
    resolved: DataFrame
    edges: DataFrame
    nodes: DataFrame


def resolve(anchors: DataFrame, ontology: Ontology, request: str, threshold: float = graph.THRESHOLD) -> Resolution:
    """Accepted and suggested concepts, touched edges and subgraph nodes of every request."""
    usable = graph.usable_anchors(anchors, threshold)
    accepted = graph.accepted_concepts(usable, ontology.nodes, ontology.synonyms, request, "rank")
    edges = graph.touched_edges(accepted, ontology.edges, request)
    suggested = graph.suggested_concepts(accepted, ontology.edges, ontology.nodes, request)
    return Resolution(accepted.unionByName(suggested.drop("node")), edges, graph.subgraph_nodes(accepted, suggested, ontology.nodes, request))


def prompts_from_anchors(
    requests: DataFrame, anchors: DataFrame, ontology: Ontology, request: str, modality: Column | None = None
) -> DataFrame:
    """Prompt, hash, text, provenance and status per request; bad rows carry their reason, those refused for size no prompt.

    A request's anchors meet once, in one row; its concepts are joined to the concepts' lists, which are bounded, and
    its items stay in that row. A request that meets a hub is refused for its size without the hub's edges.
    """
    lookup = graph.concept_lookup(ontology.nodes, ontology.synonyms)
    hit = graph.accepted_columns(anchors, lookup)
    packed = anchors_once(hit, request)
    summary = prompt.summary_of(packed, request, "accepted", "concepts")
    lists = small_side(graph.neighbour_lists(ontology.edges, ontology.nodes, prompt.MAX_PROMPT_BYTES))
    # the row itself goes with its first concept only
    payload = F.struct(*summary.columns)
    parted = summary.select(F.col(request), F.col("concepts"), F.posexplode_outer("concepts").alias("_at", "concept"), payload.alias("_row")).select(
        request, "concept", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_row")).alias("_row")
    )
    # prompts are heavy for their bytes, by which adaptive execution would put them into one task
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parted.join(lists, "concept", "left").repartition(parts, request).groupBy(request).agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.flatten(F.collect_list("near")).alias("near"),
        F.flatten(F.collect_list("conflicts")).alias("conflicts"), F.coalesce(F.bool_or("heavy"), F.lit(False)).alias("heavy"),
    )
    grown = met.select(
        request, *[F.col(f"_row.{c}").alias(c) for c in summary.columns if c != request], "heavy",
        graph.suggestions_of(F.col("near"), F.col("_row.concepts")).alias("suggested"),
        F.transform(F.array_sort(F.array_distinct("conflicts")), lambda c: c["target"]).alias("against"),
    ).withColumn("items", F.array_sort(F.concat("accepted", "suggested")))
    size = prompt.attribute_bytes(F.col("items"), F.col("against"))
    grown = grown.withColumn("oversized", F.col("heavy") | (size > prompt.MAX_PROMPT_BYTES))
    kept = lambda c: F.when(~F.col("oversized") & (F.size(c) > 0), F.col(c))
    grown = grown.withColumn("items", kept("items")).withColumn("against", kept("against"))
    rows = requests.select(request).repartition(parts, request).join(grown.hint("merge"), request, "left").withColumn(
        "forbidden", F.transform("against", lambda t: F.concat(F.lit("avoid "), t))
    )
    keep = [request, *[c for c in summary.columns if c not in (request, "accepted", "concepts")], "oversized"]
    made = prompt.prompts_of(rows, keep, ontology_version=ontology.version, modality=modality)
    made = made.withColumn("_errors", prompt.prompt_errors("prompt")).withColumn("_canonical", prompt.canonical("prompt"))
    errors = F.col("_errors")
    status = (
        F.when(F.col("anchor_error").isNotNull(), F.concat(F.lit("anchor:"), F.col("anchor_error")))
        .when(F.coalesce("oversized", F.lit(False)) | (F.octet_length("_canonical") > prompt.MAX_PROMPT_BYTES), F.lit("prompt-size"))
        .when(F.size(errors) > 0, F.concat(F.lit("schema:"), F.array_join(errors, ",")))
        .otherwise(F.lit("ok"))
    )
    # a prompt refused for its size was never made whole: nothing of it may be taken for a result
    shown = lambda c: F.when(F.col("status") != "prompt-size", c)
    return made.withColumn("status", status).select(
        request, "status", shown(F.col("prompt")).alias("prompt"), shown(F.sha2(F.col("_canonical").cast("binary"), 256)).alias("prompt_hash"),
        shown(prompt.summary_text("prompt", "surfaces")).alias("text"), "provenance",
        F.coalesce("anchor_count", F.lit(0)).cast("int").alias("anchor_count"),
        F.lit("local_template").alias("provider_status"),
    )


def compiled_prompts(
    requests: DataFrame, anchors: DataFrame, ontology: Ontology, request: str, modality: Column | None = None, chars: int | None = None
) -> DataFrame:
    """``request, prompt, text, provenance``: every prompt whole, whatever its size; no policy is applied and none is refused.

    With ``chars`` a prompt holds its first suggestions only, but all that a text of so many characters shows.
    """
    hit = graph.accepted_columns(anchors, graph.concept_lookup(ontology.nodes, ontology.synonyms))
    summary = written(prompt.summary_of(anchors_once(hit, request), request, "accepted", "concepts"), "summary")
    used = written(summary.select(F.explode("concepts").alias("concept")).distinct(), "concepts")
    lists = graph.whole_lists(ontology.edges, ontology.nodes, used, chars)
    # prompts are heavy for their bytes, by which adaptive execution would put them into one task
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.select(request).repartition(parts, request).join(summary.repartition(parts, request).hint("merge"), request, "left")
    met = graph.meet_lists(rows, lists, request)
    concepts = F.coalesce("concepts", F.array().cast("array<string>"))
    rows = met.select(
        *summary.columns, F.transform(F.array_sort(F.array_distinct("conflicts")), lambda c: F.concat(F.lit("avoid "), c["target"])).alias("forbidden"),
        F.sort_array(F.concat(F.coalesce("accepted", F.array().cast(summary.schema["accepted"].dataType)), "alone", graph.rivals_of(F.col("rivals"), concepts))).alias("items"),
    )
    made = prompt.prompts_of(rows, [request, "surfaces", "provenance"], ontology_version=ontology.version, modality=modality)
    return made.select(request, "prompt", prompt.summary_text("prompt", "surfaces").alias("text"), "provenance")


def anchors_once(hit: DataFrame, request: str) -> DataFrame:
    """All of a request's anchors in one row: the summary parts, accepted items and distinct concepts."""
    item = F.when(F.col("usable"), prompt.item_of(lambda c: F.col("read" if c == "provenance" else c)))
    return hit.groupBy(request).agg(
        *prompt.summary_aggregates(), F.collect_list(item).alias("accepted"),
        F.collect_set(F.when(F.col("usable"), F.col("concept_id"))).alias("concepts"),
    )


def decode(
    requests: DataFrame, model, vocab: DataFrame, ontology: Ontology, request: str = "epoch_id", *,
    width: int, signal: str = "eeg", override: str | None = None, top_k: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Decoded requests of any number, and the rejected ones with their reason."""
    checked = requests.withColumn("_reason", input_violation(signal, override))
    good = checked.where(F.col("_reason").isNull())
    encoded = model.transform(
        good.where(F.col(signal).isNotNull()).withColumn("x", arrays.features(signal, width))
    )
    top = retrieval.top_anchors(encoded, vocab, min(top_k, prompt.MAX_ANCHORS), request)
    anchors = retrieval.as_anchors(top).withColumnRenamed("epoch_id", request)
    rejected = checked.where(F.col("_reason").isNotNull()).select(request, F.col("_reason").alias("reason"))
    if override is not None:
        given, refused = override_anchors(good, vocab, request, override)
        anchors = anchors.unionByName(given.select(*anchors.columns))
        rejected = rejected.unionByName(refused.withColumn("reason", F.lit("vocabulary")))
    accepted = good.join(rejected.select(request), request, "left_anti")
    # results and rejects both read the finished rows; they are written once
    rows = written(prompts_from_anchors(accepted, anchors, ontology, request), "prompts")
    bad = rows.where(F.col("status") != "ok").select(request, F.col("status").alias("reason"))
    return rows.where(F.col("status") == "ok"), rejected.unionByName(bad)
