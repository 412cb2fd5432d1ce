"""Fixed schemas and closed value sets."""
from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EEG = T.ArrayType(T.ArrayType(T.FloatType()))

RELEASE_LINEAGE = struct(
    release_id=S, scope_status=S, manifest_signature_status=S, governance_status=S, file_count=L, total_size_bytes=L
)
LINEAGE = T.StructType(
    struct(dataset_id=S, revision=S, manifest_sha256=S, provider=S, mode=S).fields + RELEASE_LINEAGE.fields
)

NESTED_EPOCHS = struct(
    word=S, topic=S, selected_topic=S, participant=S, eeg=EEG, semantic_relevance=L
)

# The channel columns of the windowed-sample CSV, in file order.
SAMPLE_CHANNELS = (
    "EEG-Fz", "EEG-0", "EEG-1", "EEG-2", "EEG-3", "EEG-4", "EEG-5", "EEG-C3",
    "EEG-6", "EEG-Cz", "EEG-7", "EEG-C4", "EEG-8", "EEG-9", "EEG-10", "EEG-11",
    "EEG-12", "EEG-13", "EEG-14", "EEG-Pz", "EEG-15", "EEG-16",
)
SAMPLE_LABELS = ("left", "right", "foot", "tongue")
SAMPLE_RATE_HZ = 250.0
SAMPLES_PER_EPOCH = 201

MARKERS = struct(onset=D, duration=D, trial_type=S, value=S, sentence_id=I, segment=I)
CHANNELS = struct(name=S, type=S)

SHARD = struct(path=S, size_bytes=L, sha256=S)
MANIFEST = struct(
    dataset_id=S, provider=S, repo_id=S, revision=S, format=S, sampling_rate_hz=D,
    n_channels_source=I, n_times_source=I, labels=T.ArrayType(S), subject_field=S,
    session_field=S, shards=T.ArrayType(SHARD),
)

GOVERNANCE = struct(
    visibility=S, license_status=S, dua_status=S, custodian_status=S,
    deidentification_status=S, approved_by=S, evidence_reference=S,
)
FAMILY = struct(
    dataset_id=S, release_id=S, local_root=S, repo_id=S, provider=S, scope_status=S,
    visibility=S, provenance_references=T.ArrayType(S), governance=GOVERNANCE, name=S,
    source=S, license_note=S, expected_source_files=L, expected_source_bytes=L,
    observed_local_files=L, observed_local_bytes=L,
)

# Closed sets and patterns of the release contracts.
FAMILY_IDS = tuple(f"D{n:02d}" for n in range(1, 20))
MOVING_REVISIONS = ("main", "master", "latest", "head", "default")
SHA256_PATTERN = r"^[0-9a-f]{64}\z"
COMMIT_PATTERN = r"^[0-9a-f]{40}\z"
DOMAINS = {
    "visibility": ("public", "private-team", "blocked"),
    "license_status": ("verified", "other", "unknown", "denied", "not_reviewed"),
    "dua_status": ("verified", "not_applicable", "unknown", "denied", "not_reviewed"),
    "custodian_status": ("verified", "unknown", "denied", "not_reviewed"),
    "deidentification_status": ("reviewed", "not_reviewed", "unknown", "denied"),
    "scope_status": ("observed-local-package", "full-upstream", "blocked"),
    "provider": ("huggingface", "local"),
    "manifest_signature_status": (
        "unsigned", "signed", "verified", "missing", "mismatched", "untrusted"
    ),
    "verification_status": ("pending", "verified", "failed", "incomplete"),
}
BLOCKING_STATUS = ("unknown", "denied", "not_reviewed")
FORBIDDEN_KEYS = (
    "hf_token", "token", "access_token", "private_key", "secret", "password", "api_key"
)
KEY_HEADERS = ("BEGIN PRIVATE KEY", "BEGIN RSA PRIVATE KEY", "BEGIN OPENSSH PRIVATE KEY")

NODES = struct(id=S, type=S, label=S, pos=L)
EDGES = struct(
    id=S, source=S, relation=S, target=S, confidence=D, provenance=S,
    qualifier=T.MapType(S, S), pos=L,
)
SYNONYMS = struct(surface=S, concept_id=S, pos=L)

CVE = struct(
    cve=S, package=S, severity=S, kev=B, status=S, source=S, note=S, snapshot_date=S
)

# The fields of an audit event.
AUDIT = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("event_type", S), ("timestamp", T.TimestampType()), ("correlation_id", S),
        ("user_sub", S), ("tenant_id", S), ("method", S), ("path", S), ("status", I),
        ("elapsed_ms", D), ("src_ip", S), ("anchor_count", I), ("ontology_version", S),
        ("prompt_hash", S), ("prompt_hash_alg", S), ("provider", S), ("model", S),
        ("provider_status", S), ("data_egress", B), ("batch_size", I),
        ("batch_prompt_hashes", T.ArrayType(S)), ("dataset_id", S), ("release_id", S),
        ("manifest_sha256", S), ("path_hash", S), ("mode", S), ("result", S),
        ("reason", S), ("count", L), ("total_size_bytes", L),
    )
])
AUDIT_FIELDS = tuple(f.name for f in AUDIT.fields)
# Fields a release event may keep.
RELEASE_FIELDS = (
    "event_type", "timestamp", "correlation_id", "user_sub", "dataset_id", "release_id",
    "manifest_sha256", "path_hash", "provider", "mode", "result", "reason", "count",
    "total_size_bytes",
)
