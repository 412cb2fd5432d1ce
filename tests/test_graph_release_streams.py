"""Graph, prompt, release and stream examples."""
from __future__ import annotations

import hashlib
import json
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row, functions as F

import __spark_entry__ as entry
from bindings import scans, views as v
from bindings.streams import LATE, LIMIT, LIMIT_S, late
from epochloom import schemas
from epochloom.functions import paths, text
from epochloom.operators import audit, graph, prompt, release, supply
from epochloom.plans import decode
from epochloom.session import new_folder, prepare
from epochloom.sources import advisories, catalog, datasets, readers, sinks
from epochloom.streaming import limits
from epochloom.streaming.runtime import drain
from tests.harness import TABLES, compare, duck


@pytest.fixture(scope="module")
def onto(spark):
    nodes = [("d:Window", "Object", "window"), ("d:Light", "Attribute", "natural light"), ("d:Density", "Attribute", "decoration density"),
             ("d:Minimal", "Style", "minimal"), ("text:Keyword", "Concept", "keyword"), ("d:Bad", "Object", "<script>")]
    edges = [("edge:wl", "d:Window", "INCREASES", "d:Light", 1.0, "rule:1"), ("edge:md", "d:Minimal", "CONFLICTS_WITH", "d:Density", 0.9, "rule:2")]
    syn = [("airy", "d:Window"), ("airy", "d:Light"), ("new\nline", "d:Light")]
    add = lambda rows: [(*r, i) for i, r in enumerate(rows)]
    return decode.Ontology(
        spark.createDataFrame(add(nodes), "id string, type string, label string, pos long"),
        spark.createDataFrame(add(edges), "id string, source string, relation string, target string, confidence double, provenance string, pos long"),
        spark.createDataFrame(add(syn), "surface string, concept_id string, pos long"), "v1",
    )


def anchor_rows(spark, rows):
    return spark.createDataFrame(rows, "request int, anchor_id string, surface string, score double, rank int, provenance array<string>")


def test_accepted_and_suggested(spark, onto):
    anchors = anchor_rows(spark, [
        (1, "a", "Window", 0.9, 1, ["eeg:1", "kg:x"]), (1, "a", "unheard", 0.8, 2, ["eeg:1"]), (1, "a", "window", 0.4, 3, ["eeg:1"]),
        (2, "a", "minimal", 0.7, 1, ["eeg:2"]), (3, "a", "window", 0.9, 1, ["kg:only"]), (4, "a", "airy", 0.6, 1, ["eeg:4"]),
    ])
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "request int")
    rows = {r.request: r for r in decode.prompts_from_anchors(ids, anchors, onto, "request").collect()}
    one = rows[1].prompt
    assert one.subject.concept_id == "d:Window" and one.intent.confidence == 0.9
    assert [(a.concept_id, a.operator, a.status, round(a.confidence, 3)) for a in one.attributes] == [
        ("text:Keyword", "set", "accepted", 0.64), ("d:Light", "increase", "suggested", 0.7)]
    assert one.attributes[1].provenance == ["kg:edge:wl"] and one.subject.provenance == ["eeg:1"]
    assert rows[2].prompt.constraints.forbidden == ["avoid d:Density"]
    assert rows[3].status == "anchor:provenance" and rows[4].prompt.subject.concept_id == "d:Light"
    assert rows[5].prompt.subject.concept_id == "text:Topic" and rows[5].status.startswith("schema:")
    assert "KG suggestions (not EEG-read): natural light." in rows[1].text
    plain = json.loads(spark.createDataFrame([rows[1].prompt], rows_schema(one)).select(prompt.canonical(F.struct("*"))).head()[0])
    assert hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == rows[1].prompt_hash


def test_suggestions_sort_their_neighbours_once(spark):
    n = 6_000
    near = F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.struct(
        F.concat(F.lit("c:"), (i % n).cast("string")).alias("other"), (2 * n - i).cast("long").alias("pos"), i.cast("string").alias("id"),
        F.lit("SETS").alias("relation"), F.lit(0.5).alias("confidence"), F.lit("x").alias("label"),
    ))
    start = time.time()
    items = F.array_sort(graph.suggestions_of(F.col("near"), F.array(F.lit("c:0"))))
    row = spark.range(1).select(near.alias("near")).select(items.alias("i")).select("i", prompt.attribute_bytes(F.col("i"), F.array().cast("array<string>")).alias("b")).head()
    assert len(row.i) == n - 1 and {int(x.provenance[0].split(":")[-1]) // n for x in row.i} == {1} and row.b > 0
    assert time.time() - start < 20  # the list is not sorted anew for every neighbour


def rows_schema(row: Row):
    from pyspark.sql.types import _infer_schema

    return _infer_schema(row)


def test_oversized_prompt_is_refused_without_collecting(spark, onto):
    many = onto.edges.limit(0).unionByName(spark.range(3000).select(
        F.concat(F.lit("edge:x"), "id").alias("id"), F.lit("d:Window").alias("source"), F.lit("RELATED_TO").alias("relation"),
        F.concat(F.lit("d:n"), "id").alias("target"), F.lit(0.5).alias("confidence"), F.lit("r").alias("provenance"), F.col("id").alias("pos")))
    nodes = onto.nodes.unionByName(spark.range(3000).select(F.concat(F.lit("d:n"), "id").alias("id"), F.lit("O").alias("type"), F.concat(F.lit("name "), "id").alias("label"), (F.col("id") + 100).alias("pos")))
    hub = decode.Ontology(nodes, many, onto.synonyms, "v1")
    rows = decode.prompts_from_anchors(spark.createDataFrame([(1,)], "request int"), anchor_rows(spark, [(1, "a", "window", 0.9, 1, ["eeg:1"])]), hub, "request")
    assert rows.head().status == "prompt-size"


def test_vocabulary_drops_bad_surfaces(spark, onto):
    words = {r.surface for r in graph.vocabulary(spark.createDataFrame([("Open", 0)], "surface string, pos long"), onto.synonyms, onto.nodes).collect()}
    assert {"open", "airy", "window"} <= words and not any("script" in w or "\n" in w for w in words)


def test_text_extension_merges_by_id(spark, onto):
    base = (onto.nodes, onto.edges.withColumn("qualifier", F.lit(None).cast("map<string,string>")), onto.synonyms)
    nodes, edges, syn = graph.merge_ontology(base, graph.text_extension(spark))
    assert (nodes.count(), edges.count(), syn.count()) == (6 + 4, 2 + 2, 3 + 4)
    assert [r.id for r in nodes.orderBy("pos").collect()][-4:] == ["text:Topic", "text:Intent", "text:Reading", "text:InnerRecall"]
    words = graph.vocabulary(graph.default_keywords(spark), syn, nodes)
    assert {"living room", "topic", "inner recall"} <= {r.surface for r in words.collect()}


def test_graph_contract_is_clean(onto):
    assert graph.contract_violations(onto.nodes, onto.edges, onto.synonyms).isEmpty()


def test_scope_reasons(spark):
    rows = [("a/.git/x", "file"), ("a/b.edf", "file"), ("download_it.sh", "file"), ("a/report.md", "file"), ("reports", "dir"), ("l", "symlink"), ("p", "other"), ("a/../b", "file")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, k string").select(paths.scope_reason("p", "k")).collect()]
    assert got == ["git", None, "downloader-script", "report", "report", "symlink", "non-regular", "parent-traversal"]


def test_paths_and_entities(spark):
    df = spark.createDataFrame([("d/sub-01/ses-02/sub-03_task-x.tsv",), ("x/plain.csv",)], "p string")
    subject, session = paths.subject_session("p")
    assert [tuple(r) for r in df.select(subject, session).collect()] == [("sub-03", "ses-02"), ("unknown", "unknown")]
    names = spark.createDataFrame([("a.npy",), ("a.npy.exe",), (".csv",), ("b.EDF",), ("c",)], "p string")
    assert [r[0] for r in names.select(F.coalesce(paths.has_allowed_extension("p"), F.lit(False))).collect()] == [True, False, False, True, False]


def test_digest_streams_equal_hashlib(spark):
    rows = [(f"f{i % 3}", f"p/{i:04d}.edf") for i in range(500)]
    got = {r.key: r.sha256 for r in release.scope_digest(spark.createDataFrame(rows, "family string, path_posix string"), "family").collect()}
    for f in ("f0", "f1", "f2"):
        assert got[f] == hashlib.sha256("\n".join(sorted(p for k, p in rows if k == f)).encode()).hexdigest()


def test_governance_blocks_by_default(spark):
    row = ("public", "verified", "verified", "verified", "reviewed", "me", "doc")
    names = "visibility, license_status, dua_status, custodian_status, deidentification_status, approved_by, evidence_reference".split(", ")
    rows = [row] + [tuple("unknown" if j == i else x for j, x in enumerate(row)) for i in range(1, 5)] + [(*row[:5], " ", "doc"), ("blocked", *row[1:])]
    got = release.governance_decision(spark.createDataFrame(rows, names)).collect()
    assert [r.can_upload for r in got] == [True] + [False] * 6 and got[6].blocking_reason == "visibility"


def test_sample_csv_contract(spark, tmp_path):
    from epochloom.plans.load_jobs import windowed_job

    channels = schemas.SAMPLE_CHANNELS
    def write(name, step, head=None):
        lines = [",".join(head or ["patient", "time", "label", "epoch", *channels])]
        for p in range(1, 5):
            for e in range(2):
                lines += [",".join([str(p), f"{i * step:.6f}", ["left", "right", "foot", "tongue"][(p + e) % 4], str(e), *["1.5"] * 22]) for i in range(201)]
        (tmp_path / name).write_text("﻿" + "\n".join(lines), encoding="utf-8")
        return str(tmp_path / name)

    good = windowed_job(readers.sample_csv(spark, write("good.csv", 0.004)), max_epochs=6, n_times=32, n_channels=8)
    rows = good.collect()
    assert len(rows) == 6 and len(rows[0].eeg) == 8 and len(rows[0].eeg[0]) == 32
    assert {r.subject_id for r in rows} == {"sub-01", "sub-02", "sub-03", "sub-04"}
    with pytest.raises(readers.ContractError):
        windowed_job(readers.sample_csv(spark, write("bad.csv", 0.005)))
    with pytest.raises(readers.ContractError):
        readers.sample_csv(spark, write("short.csv", 0.004, ["patient", "time", "label", "epoch", *["x"] * 22]))


def test_manifest_rules(spark, tmp_path):
    base = dict(dataset_id="d", provider="local", repo_id=None, revision="r1", format="csv", sampling_rate_hz=250.0, n_channels_source=22, n_times_source=201,
                labels=["a"], subject_field="p", session_field="e", shards=[dict(path="x.csv", size_bytes=1, sha256="a" * 64)])
    docs = [base, {**base, "revision": "Main"}, {**base, "provider": "huggingface"}, {**base, "shards": [dict(path="../x", size_bytes=1, sha256="a" * 64)]}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(d) for d in docs))
    got = [r.violations for r in catalog.manifest_violations(catalog.manifest_documents(spark, str(tmp_path / "m.json"), multi_line=False)).collect()]
    assert got == [[], ["moving-revision"], ["repo_id", "commit"], ["shard"]]


def test_advisory_gate_fails_on_open_critical(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cve": "CVE-1", "severity": "CRITICAL", "kev": false, "status": "open"}')
    (tmp_path / "b.json").write_text('{"records": [{"cve": "CVE-2", "severity": "LOW", "kev": true, "status": "remediated"}]}')
    (tmp_path / "c.json").write_text("{broken")
    rows = advisories.advisory_records(spark, str(tmp_path), multi_line=True)
    got = supply.gate_counts(rows).head()
    assert (got.critical, got.exploited, got.records, got.passes) == (1, 0, 2, False)


def test_registry_fails_closed(spark):
    reg = datasets.Registry()
    reg.declare_absent("later")
    with pytest.raises(FileNotFoundError):
        reg.resolve("later", spark)
    with pytest.raises(ValueError):
        reg.resolve("never", spark)


def test_release_event_keeps_no_path(spark):
    row = spark.createDataFrame([("dataset_upload_blocked", "/x/y", "s")], "event_type string, path string, secret string")
    got = audit.release_events(row).head().asDict()
    assert got == {"event_type": "dataset_upload_blocked", "path_hash": hashlib.sha256(b"/x/y").hexdigest()}


def test_report_sink_writes_a_model_only_behind_the_gate(spark):
    weights = spark.createDataFrame([("m", "w", 0, [1.0])], "model_id string, part string, row int, vec array<double>")
    for ok in (True, False):
        folder = new_folder(spark, "report")
        sinks.write_report(spark.createDataFrame([("loso", ok)], "strategy string, gate_pass boolean"), weights, folder)
        if ok:
            assert spark.read.parquet(f"{folder}/weights").count() == 1
        else:
            with pytest.raises(Exception):
                spark.read.parquet(f"{folder}/weights")


def test_restarted_streams_equal_the_batch_form(spark, sf):
    """Rows come out of order over several runs, each taken up from the checkpoint; every event gets its batch verdict."""
    prepare(spark)
    batch = audit.sliding_limit(v.audit(spark, sf), "user_sub", "timestamp", "event_id", LIMIT, LIMIT_S)
    judged = lambda rows: limits.sliding_limit_stream(rows, "user_sub", "timestamp", "event_id", LIMIT, LIMIT_S, LATE)
    stream = late(spark, sf, judged, "t")
    assert sorted((r.event_id, r.allowed) for r in batch.collect()) == sorted((r.event_id, r.outcome == "allowed") for r in stream.collect())


def test_late_arrivals_take_every_event(spark, sf, tmp_path):
    events = v.table(spark, sf, "events")
    first = events.agg(F.min("ts")).first()[0]
    longer = F.timestamp_micros(F.unix_micros(F.lit(first)) + (F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 4)
    for name, ts in (("given", F.col("ts")), ("longer", longer)):  # 30 and 120 days
        events.withColumn("ts", ts).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = late(spark, f"{tmp_path}/{name}", lambda rows: rows.select("event_id"), f"late_{name}")
        assert sorted(r.event_id for r in got.collect()) == [-1] + sorted(r.event_id for r in events.select("event_id").collect())


def test_dead_letters_row_by_row_and_as_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "event_type string, n int")
    sinks.append_audit(rows, 0, f"{tmp_path}/events", f"{tmp_path}/dead")
    sinks.append_audit(rows, 0, f"{tmp_path}/events", f"{tmp_path}/dead")  # run again: the same rows once
    read = lambda name: sorted((r.n, getattr(r, "error", None)) for r in spark.read.option("recursiveFileLookup", True).json(f"{tmp_path}/{name}").collect())
    assert read("events") == [(1, None), (3, None)] and read("dead") == [(2, "missing:event_type")]
    (tmp_path / "blocked").write_text("not a folder")
    sinks.append_audit(rows, 1, f"{tmp_path}/blocked", f"{tmp_path}/dead1")
    assert [n for n, _ in read("dead1")] == [1, 2, 3]


def test_a_hub_is_refused_without_its_edges(spark):
    """A concept with very many neighbours has no list; requests that meet it are refused, others keep theirs."""
    hub = spark.range(30_000).select(
        F.concat(F.lit("edge:h"), F.col("id").cast("string")).alias("id"), F.col("id").alias("pos"), F.lit("a:hub").alias("source"), F.lit("RELATED_TO").alias("relation"),
        F.concat(F.lit("a:n"), F.col("id").cast("string")).alias("target"), F.lit(0.5).alias("confidence"),
    ).unionByName(spark.createDataFrame([("edge:s", 30_000, "a:small", "INCREASES", "a:n1", 0.8)], "id string, pos long, source string, relation string, target string, confidence double"))
    names = hub.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = names.select("id", F.lit("Concept").alias("type"), F.regexp_replace("id", "^a:", "").alias("label"), F.xxhash64("id").alias("pos"))
    lists = {r.concept: r for r in graph.neighbour_lists(hub, nodes, 65_536).where("concept IN ('a:hub', 'a:small', 'a:n1')").collect()}
    assert lists["a:hub"].heavy and lists["a:hub"].near is None
    assert [e.other for e in lists["a:small"].near] == ["a:n1"] and sorted(e.other for e in lists["a:n1"].near) == ["a:hub", "a:small"]
    onto = decode.Ontology(nodes, hub, spark.createDataFrame([], "surface string, concept_id string, pos long"), "v")
    requests = spark.range(2_000).select(F.col("id").cast("int").alias("request"))
    anchors = requests.select(
        "request", F.lit("anchor").alias("anchor_id"), F.when(F.col("request") % 2 == 0, "hub").otherwise("small").alias("surface"),
        F.lit(0.9).alias("score"), F.lit(1).alias("rank"), F.array(F.lit("eeg:1")).alias("provenance"),
    )
    got = decode.prompts_from_anchors(requests, anchors, onto, "request").groupBy((F.col("request") % 2).alias("k"), "status").count().collect()
    assert {(r.k, r.status, r["count"]) for r in got} == {(0, "prompt-size", 1_000), (1, "ok", 1_000)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_prompts_of_hubs_are_compiled_whole(spark, monkeypatch, broadcast):
    """Every suggestion of a hub is in the prompt, its text is that of the whole prompt, and a refused prompt shows nothing."""
    if not broadcast:
        monkeypatch.setattr(graph, "fits", lambda df: False)
    hubs = spark.range(6_000).select(
        F.concat(F.lit("edge:h"), F.col("id").cast("string")).alias("id"), F.col("id").alias("pos"), F.concat(F.lit("a:hub"), (F.col("id") % 2).cast("string")).alias("source"),
        F.when(F.col("id") < 2, "CONFLICTS_WITH").otherwise("INCREASES").alias("relation"), F.concat(F.lit("a:n"), F.floor(F.col("id") / 3).cast("string")).alias("target"), F.lit(0.5).alias("confidence"),
    ).unionByName(spark.createDataFrame([("edge:x", 9_000, "a:hub1", "PRESERVES", "a:hub0", 0.8)], "id string, pos long, source string, relation string, target string, confidence double"))
    names = [r.id for r in hubs.select(F.explode(F.array("source", "target")).alias("id")).distinct().collect()]
    nodes = spark.createDataFrame([(n, "C", n[2:], k) for k, n in enumerate(names)], "id string, type string, label string, pos long")
    onto = decode.Ontology(nodes, hubs, spark.createDataFrame([], "surface string, concept_id string, pos long"), "v")
    given = [(1, ["hub0", "hub1"]), (2, ["hub1"]), (3, ["unknown", "hub0", "n7"])]
    requests = spark.createDataFrame([(1,), (2,), (3,), (4,)], "request int")
    anchors = anchor_rows(spark, [(r, "anchor", s, 0.9 - k / 10, k + 1, ["eeg:1"]) for r, surfaces in given for k, s in enumerate(surfaces)])
    rows = {r.request: r for r in decode.compiled_prompts(requests, anchors, onto, "request").collect()}
    edges = sorted(hubs.collect(), key=lambda e: e.pos)
    for request, surfaces in given:
        own, seen = {f"a:{s}" for s in surfaces}, {}
        for e in edges:
            if (e.source in own) != (e.target in own):
                seen.setdefault(e.target if e.source in own else e.source, e.id)
        got = [(a.concept_id, a.provenance[0]) for a in rows[request].prompt.attributes if a.status == "suggested"]
        assert got == [(c, f"kg:{i}") for c, i in seen.items()] and len(got) > 1_500
        assert rows[request].text.startswith(f"[EEG-to-text] Anchors: {', '.join(surfaces)}. Subject: {surfaces[0]}. KG suggestions (not EEG-read): {next(iter(seen))[2:]}, ")
    assert rows[1].prompt.constraints.forbidden == ["avoid a:n0", "avoid a:n0"] and rows[4].prompt.subject.concept_id == "text:Topic"
    short = decode.compiled_prompts(requests, anchors, onto, "request", chars=prompt.MAX_OUTPUT_CHARS).collect()
    assert {r.request: r.text for r in short} == {k: r.text for k, r in rows.items()} and all(len(r.text) == 4_000 for r in short if r.request < 4)
    assert all(len(r.prompt.attributes) < 1_500 for r in short)
    refused = [r for r in decode.prompts_from_anchors(requests, anchors, onto, "request").collect() if r.status == "prompt-size"]
    assert sorted(r.request for r in refused) == [1, 2, 3] and {(r.prompt, r.prompt_hash, r.text) for r in refused} == {(None, None, None)}


def test_configuration_is_walked_to_any_depth(spark):
    """Members of nested documents in one pass, held against a walk in Python."""
    deep = "leaf"
    for _ in range(12):
        deep = {"d": [deep, 1]}
    docs = [
        {"a": {"b": {"c": "x"}, "e": {}}, "l": [], "n": None, "t": True}, deep, ["[{", {"q\"}]": "\\\\ ]}\""}, [[["y"]]]], [], {},
    ]
    texts = [json.dumps(d) for d in docs] + ["{broken", "[" * 400, None, "3", '"s"', ""]

    def walk(value, path=""):
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for name, inner in items:
            yield (f"{path}/{name}", name if isinstance(value, dict) else None, inner if isinstance(inner, str) else None)
            yield from walk(inner, f"{path}/{name}")

    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    found = release.config_strings(df, "k", "j")
    got = sorted((r.k, r.key_path, r.name or "", r.value if r.kind == "STRING" else None) for r in found.collect())
    want = sorted((k, path, name or "", value) for k, d in enumerate(docs) for path, name, value in walk(d))
    assert got == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert release.config_strings(df.where("k > 4"), "k", "j").count() == 0


@pytest.fixture(scope="module")
def folder_tables(spark, sf, tmp_path_factory):
    """The given tables with the embeddings as a folder of three files, in the order of their ids."""
    out = tmp_path_factory.mktemp("folders")
    for name in TABLES:
        if name != "embeddings":
            (out / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    rows = pq.read_table(f"{sf}/embeddings.parquet").slice(0, 90)
    (out / "embeddings.parquet").mkdir()
    for part in range(3):
        pq.write_table(rows.slice(part * 30, 30), out / "embeddings.parquet" / f"part-{part}.parquet")
    return str(out)


def test_mask_guard_takes_differences_of_floats(spark, sf, tmp_path):
    """Peak-to-peak values that lie below a limit and, as floats, above it."""
    rng = np.random.default_rng(4)
    rows = np.zeros((40, 64), dtype=np.float32)
    for k, limit in enumerate(0.6 if k % 2 else 0.55 for k in range(40)):
        top = rng.uniform(0.2, 0.4, 200_000).astype(np.float32)
        for off in range(-3, 4):
            low = (top.astype(float) - limit).astype(np.float32) + np.float32(off) * np.float32(2e-8)
            at = np.flatnonzero((top.astype(float) - low < limit) & ((top - low).astype(float) >= limit))
            if len(at):
                rows[k, :2] = top[at[0]], low[at[0]]
                break
    assert (rows.any(axis=1)).sum() > 16
    for name in TABLES:
        if name != "embeddings":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    pq.write_table(pa.table({
        "vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([k % 10 for k in range(40)], pa.int32()),
    }), tmp_path / "embeddings.parquet")
    name = "a06_mask_guard"
    assert compare(spark, duck(str(tmp_path)), str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["s01_nested_epoch_scan", "r10_streaming_anchors"])
def test_a_table_may_be_a_folder(spark, folder_tables, name):
    con = duck(folder_tables)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder_tables}/embeddings.parquet/*.parquet'")
    fn, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare(spark, con, folder_tables, fn, sql) is None


def test_streaming_decode_of_a_folder(spark, folder_tables):
    assert entry.queries()["r10_streaming_decode"](spark, folder_tables).count() == 90


@pytest.mark.parametrize("broadcast", [True, False])
def test_touched_edges_and_suggestions_are_not_grouped_again(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(graph, "fits", lambda df: False)
        monkeypatch.setattr(graph, "LINKS_A_KEY", 3)
    pairs = [(f"h:{k % 3}", f"s:{k}") for k in range(40)] + [("s:1", "h:0"), ("h:0", "h:1"), ("h:2", "h:2"), ("h:0", "s:1")]
    edges = [(f"edge:{i}", a, "SETS", b, 0.5, "r", i) for i, (a, b) in enumerate(pairs)]
    nodes = [(n, "T", n.upper(), i) for i, n in enumerate(sorted({x for p in pairs for x in p}))]
    edges_df = spark.createDataFrame(edges, "id string, source string, relation string, target string, confidence double, provenance string, pos long")
    nodes_df = spark.createDataFrame(nodes, "id string, type string, label string, pos long")
    sets = {1: {"h:0", "h:1"}, 2: {"s:1", "h:0"}, 3: {"h:2"}, 4: {"none"}}
    accepted = spark.createDataFrame([(r, c) for r, cs in sets.items() for c in cs] * 2, "request int, concept_id string")
    touched = graph.touched_edges(accepted, edges_df, "request")
    got = sorted((r.request, r.id, r.source_in, r.target_in) for r in touched.collect())
    assert got == sorted((r, e[0], e[1] in cs, e[3] in cs) for r, cs in sets.items() for e in edges if e[1] in cs or e[3] in cs)
    want = {}
    for r, cs in sets.items():
        for e in edges:
            if (e[1] in cs) != (e[3] in cs):
                want.setdefault((r, e[3] if e[1] in cs else e[1]), e[0])
    suggested = graph.suggested_concepts(accepted, edges_df, nodes_df, "request")
    assert sorted((r.request, r.concept_id, r.provenance[0], r.node.label) for r in suggested.collect()) == sorted(
        (r, c, f"kg:{i}", c.upper()) for (r, c), i in want.items())
    assert "hashpartitioning(request" not in touched._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]


def test_touched_edges_and_suggestions_are_made_by_all_tasks(spark):
    """Requests are few bytes, what they touch is not: adaptive execution must not put them into one task."""
    edges = spark.range(300).select(
        F.concat(F.lit("edge:"), F.col("id").cast("string")).alias("id"), F.lit("h:0").alias("source"), F.lit("SETS").alias("relation"),
        F.concat(F.lit("s:"), F.col("id").cast("string")).alias("target"), F.lit(0.5).alias("confidence"), F.lit("r").alias("provenance"), F.col("id").alias("pos"))
    nodes = edges.select(F.col("target").alias("id"), F.lit("T").alias("type"), F.col("target").alias("label"), "pos")
    accepted = spark.range(400).select(F.xxhash64("id").alias("request"), F.lit("h:0").alias("concept_id"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (graph.touched_edges(accepted, edges, "request"), graph.suggested_concepts(accepted, edges, nodes, "request")):
        made = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(made) >= tasks > 1 and sum(r["count"] for r in made) == 400 * 300


def test_keys_of_one_state_are_judged_apart(spark, sf, monkeypatch):
    monkeypatch.setattr(limits, "BUCKETS", 1)
    name = "r07_attempt_lockout_stream"
    assert compare(spark, duck(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_a_surface_is_read_only_as_far_as_it_goes(spark):
    """As dropping, trimming and cutting the whole text would give, in time that its length doesn't change."""
    rng = random.Random(3)
    some = ["", " ", "<>", "a" * 64 + "  ", "a" * 63 + " ", "a" * 63 + "  b", " " * 70 + "a", "a" * 64 + "<>  é", "é\n" * 90 + "a b", "x" * 200, None]
    some += ["".join(rng.choice("ab  <é\n\U0001F600_-") for _ in range(rng.randrange(150))) for _ in range(400)]
    whole = F.substring(F.trim(F.regexp_replace("s", text.SURFACE_DROP, "")), 1, 64)
    df = spark.createDataFrame(list(enumerate(some)), "i int, s string")
    rows = df.select("s", text.sanitise_surface("s").alias("got"), whole.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == []
    long = spark.range(2_000, numPartitions=1).select(F.repeat(F.lit("ab, c. "), 30_000).alias("s"))
    start = time.time()
    long.select(text.sanitise_surface("s").alias("c")).agg(F.sum(F.length("c"))).collect()
    assert time.time() - start < 10


def test_hashed_texts_are_dealt_over_the_tasks(spark, sf):
    """One split of a small table gives forty numbers a row."""
    scan = v.table(spark, sf, "part").rdd.getNumPartitions()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scan < tasks
    assert entry.queries()["f01_hash_text_embedding"](spark, sf).rdd.getNumPartitions() == tasks


def test_manifest_lines_are_shuffled_before_their_digests_are_made(spark, sf, tmp_path, monkeypatch):
    """The documents are written packed, and the shuffle below them carries no digest."""
    monkeypatch.setattr(scans, "new_folder", lambda _, label: str(tmp_path / label))
    docs = scans.manifests(spark, sf)
    lines = docs.select(F.sum(F.size("shards"))).head()[0]
    assert lines == v.table(spark, sf, "lineitem").count()
    plain = docs.select(F.sum(F.length(F.to_json(F.struct(*docs.columns))))).head()[0]
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 0.7 * plain
