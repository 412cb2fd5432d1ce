"""Release inventory: scope, reconcile, batches, resume, totals and governance."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from epochloom import schemas
from epochloom.functions import paths, text
from epochloom.functions.scale import small_side
from epochloom.sources.sinks import canonical_json, ordered_digest

VERIFY_SAMPLE = 3


def scope(listing: DataFrame, family: str, path: str, kind: str) -> DataFrame:
    """Every listed path with its exclusion reason; a repeated kept path is a duplicate.

    ``listing`` may carry ``seq``, the listing order that decides which copy stays.
    """
    tagged = listing.withColumn("path_posix", paths.posix(path)).withColumn("reason", paths.scope_reason(path, kind))
    kept = tagged.where(F.col("reason").isNull() & (F.col(kind) == "file"))
    rest = tagged.where(F.col("reason").isNotNull())
    firsts = kept.groupBy(family, "path_posix").agg(F.min("seq").alias("_first"))
    marked = kept.join(firsts, [family, "path_posix"], "inner").withColumn(
        "reason", F.when(F.col("seq") > F.col("_first"), F.lit("duplicate"))
    ).drop("_first")
    return marked.unionByName(rest)


def scope_digest(kept: DataFrame, family: str, path: str = "path_posix") -> DataFrame:
    """Digest of the newline-joined kept paths in byte order, per family."""
    return ordered_digest(kept, F.col(family), F.col(path), F.col(path), "\n")


def totals(files: DataFrame, family: str) -> DataFrame:
    return files.groupBy(family).agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes")
    )


def totals_mismatch(files: DataFrame, declared: DataFrame, family: str) -> DataFrame:
    """Families whose declared file count or byte total differs from the listed files."""
    have = totals(files, family)
    return declared.join(have, family, "full_outer").where(
        ~F.col("file_count").eqNullSafe(F.col("declared_files"))
        | ~F.col("total_size_bytes").eqNullSafe(F.col("declared_bytes"))
    )


def manifest_json(files: DataFrame, family: str, fields: dict[str, Column]) -> DataFrame:
    """Digest of each family's canonical manifest JSON without building the document.

    Keys sort before and after ``files`` as text, so head, file records and tail are
    streamed into the hash in order.
    """
    before = {k: v for k, v in fields.items() if k < "files"}
    after = {k: v for k, v in fields.items() if k > "files"}
    record = canonical_json({"path": F.col("path"), "sha256": F.lower("sha256"), "size_bytes": F.col("size_bytes")})
    inner = lambda part: F.regexp_replace(canonical_json(part), r"^\{|\}\z", "") if part else F.lit("")
    head = F.concat(F.lit("{"), inner(before), F.lit("," if before else ""), F.lit('"files":['))
    tail = F.concat(F.lit("]"), F.lit("," if after else ""), inner(after), F.lit("}"))
    return ordered_digest(files, F.col(family), F.col("path"), record, ",", head, tail)


def reconcile(planned: DataFrame, observed: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Planned files that no longer match, with the reason and what was observed.

    ``observed`` has ``size_bytes``, ``sha256`` and ``readable`` per file.
    """
    seen = observed.select(
        *key, F.col("size_bytes").alias("observed_size_bytes"), F.lower("sha256").alias("observed_sha256"),
        "readable", F.lit(True).alias("_seen"),
    )
    escaped = paths.is_absolute("path") | F.array_contains(paths.parts("path"), "..") | (paths.normalise("path") == "")
    reason = (
        F.when(escaped, F.lit("escaped"))
        .when(F.col("_seen").isNull(), F.lit("missing"))
        .when(~F.coalesce("readable", F.lit(False)), F.lit("unreadable"))
        .when(
            (F.col("observed_size_bytes") != F.col("size_bytes"))
            | (F.col("observed_sha256") != F.lower("sha256")), F.lit("changed"),
        )
    )
    joined = planned.join(seen, list(key), "left").withColumn("reason", reason)
    changed = F.col("reason") == "changed"
    return joined.where(F.col("reason").isNotNull()).select(
        *key, F.col("size_bytes").alias("expected_size_bytes"), F.lower("sha256").alias("expected_sha256"),
        F.when(changed, F.col("observed_size_bytes")).alias("observed_size_bytes"),
        F.when(changed, F.col("observed_sha256")).alias("observed_sha256"), "reason",
    )


def verify_shards(shards: DataFrame, observed: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Manifest shards that are missing or differ by size or, then, by checksum."""
    seen = observed.select(*key, F.col("size_bytes").alias("_size"), F.lower("sha256").alias("_sha"), F.lit(True).alias("_seen"))
    reason = (
        F.when(F.col("_seen").isNull(), F.lit("missing"))
        .when(F.col("_size") != F.col("size_bytes"), F.lit("size-mismatch"))
        .when(F.col("_sha") != F.lower("sha256"), F.lit("checksum-mismatch"))
    )
    return shards.join(seen, list(key), "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_size", "_sha", "_seen")


def listing_mismatch(planned: DataFrame, remote: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Paths on one side only, and paths whose known sizes differ."""
    a = planned.select(*key, F.col("size_bytes").alias("planned_size"), F.lit(True).alias("_p"))
    b = remote.select(*key, F.col("size_bytes").alias("remote_size"), F.lit(True).alias("_r"))
    reason = (
        F.when(F.col("_p").isNull(), F.lit("unplanned"))
        .when(F.col("_r").isNull(), F.lit("absent"))
        .when(F.col("remote_size").isNotNull() & (F.col("remote_size") != F.col("planned_size")), F.lit("size"))
    )
    return a.join(b, list(key), "full_outer").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_p", "_r")


def pending_batches(batched: DataFrame, state: DataFrame, listing: DataFrame, family: str) -> DataFrame:
    """Batches still to send: not in a current checkpoint, or with a file absent remotely.

    ``batched`` holds ``(family, manifest_sha256, batch_id, path)``; ``state`` holds
    ``(family, manifest_sha256, remote_revision, batch_id)``, one row per done batch.
    """
    done = state.where(F.lower("remote_revision").rlike(schemas.COMMIT_PATTERN)).select(
        family, "manifest_sha256", "batch_id"
    ).distinct()
    absent = batched.join(listing.select(family, "path").distinct(), [family, "path"], "left_anti").select(
        family, "batch_id"
    ).distinct()
    batches = batched.groupBy(family, "manifest_sha256", "batch_id").agg(F.count(F.lit(1)).alias("n_files"))
    confirmed = batches.join(done, [family, "manifest_sha256", "batch_id"], "left_semi").join(
        absent, [family, "batch_id"], "left_anti"
    ).select(family, "batch_id")
    return batches.join(confirmed, [family, "batch_id"], "left_anti")


def verification_sample(files: DataFrame, family: str, n: int = VERIFY_SAMPLE) -> DataFrame:
    """First ``n`` files of each family in path order."""
    w = Window.partitionBy(family).orderBy("path")
    return files.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def immutable_revision(revision: str | Column, commit: Column | None = None, allow_empty: bool = False) -> Column:
    """A pinned revision: no moving name, and a commit digest where one is asked for."""
    raw = F.coalesce(F.col(revision) if isinstance(revision, str) else revision, F.lit(""))
    low = F.lower(raw)
    pinned = (low != "") & ~low.isin(*schemas.MOVING_REVISIONS)
    if commit is not None:
        pinned = pinned & (~commit | low.rlike(schemas.COMMIT_PATTERN))
    return ((low == "") | pinned) if allow_empty else pinned


def record_violations(df: DataFrame) -> DataFrame:
    """File records with the rules they break: path, size, digest and closed sets."""
    rules = [
        (paths.is_unsafe_relative("path"), "path"),
        (F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "size"),
        (~F.coalesce(F.lower("sha256").rlike(schemas.SHA256_PATTERN), F.lit(False)), "sha256"),
    ]
    rules += [
        (~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), c)
        for c, allowed in schemas.DOMAINS.items() if c in df.columns
    ]
    broken = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules]), lambda v: v.isNotNull()
    )
    return df.withColumn("violations", broken)


def protected_targets(families: DataFrame, exclusions: DataFrame, required: str, repo: str = "repo_id") -> DataFrame:
    """Repositories that break the exclusion rules, with the reason."""
    key = lambda df: df.withColumn("_key", F.lower(F.trim(F.col(repo))))
    fam, exc = key(families), key(exclusions)
    hits = fam.join(small_side(exc.select("_key").distinct()), "_key", "left_semi").select("_key", F.lit("protected").alias("reason"))
    twice = fam.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", F.lit("duplicate").alias("reason"))
    want = exc.agg(F.max(F.when(F.col("_key") == required.lower(), 1).otherwise(0)).alias("ok")).where(
        F.coalesce("ok", F.lit(0)) == 0
    ).select(F.lit(required.lower()).alias("_key"), F.lit("required-exclusion-missing").alias("reason"))
    return hits.distinct().unionByName(twice).unionByName(want).withColumnRenamed("_key", repo)


def alignment(requests: DataFrame, releases: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Requested repository and revision against the verified release; blanks take its values."""
    rel = releases.select(key, F.col("repo_id").alias("_repo"), F.col("revision").alias("_rev"))
    joined = requests.join(rel, key, "left")
    reason = (
        F.when(F.col("_repo").isNull(), F.lit("dataset"))
        .when(F.col("repo_id").isNotNull() & (F.col("repo_id") != F.col("_repo")), F.lit("repo-id"))
        .when(F.col("revision").isNotNull() & ~F.col("revision").eqNullSafe(F.coalesce("_rev", F.lit(""))), F.lit("revision"))
    )
    return joined.withColumn("mismatch", reason).withColumn("repo_id", F.coalesce("repo_id", "_repo")).withColumn(
        "revision", F.coalesce("revision", F.nullif("_rev", F.lit("")))
    ).drop("_repo", "_rev")


def quota_preflight(shards: DataFrame, declared: DataFrame, family: str, max_cache: int | None, free: int | None, min_free: int | None) -> DataFrame:
    """Bytes a family would need and whether the quota or the free space refuses it."""
    size = shards.groupBy(family).agg(F.sum("size_bytes").alias("shard_bytes"))
    need = size.join(declared, family, "left").withColumn(
        "needed_bytes", F.greatest(F.col("shard_bytes"), F.coalesce("declared_bytes", F.lit(0)))
    )
    reason = F.lit(None).cast("string")
    if free is not None and min_free is not None:
        reason = F.when(F.lit(free) < F.col("needed_bytes") + F.lit(min_free), F.lit("free-space")).otherwise(reason)
    if max_cache is not None:
        reason = F.when(F.col("needed_bytes") > F.lit(max_cache), F.lit("quota")).otherwise(reason)
    return need.withColumn("refusal", reason)


def governance_decision(df: DataFrame) -> DataFrame:
    """First blocking reason and whether the family may be published."""
    listed = lambda c, allowed: F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    blank = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(~listed("visibility", ("public", "private-team")), F.lit("visibility"))
    for status in ("license_status", "dua_status", "custodian_status", "deidentification_status"):
        reason = reason.when(listed(status, schemas.BLOCKING_STATUS), F.lit(status))
    reason = reason.when(blank("approved_by"), F.lit("approved_by")).when(blank("evidence_reference"), F.lit("evidence_reference"))
    return df.withColumn("blocking_reason", reason).withColumn("can_upload", F.col("blocking_reason").isNull())


def approved(families: DataFrame, order: str) -> DataFrame:
    return governance_decision(families).where("can_upload").orderBy(order)


def nesting(json_column: str) -> Column:
    """Depth of the brackets of a JSON text, those inside its strings left out."""
    bare = F.regexp_replace(F.regexp_replace(json_column, r"(?s)\\.", ""), r'"[^"]*+"', "")
    signs = F.split(F.regexp_replace(bare, r"[^\[\]{}]++", ""), "")
    turn = lambda state, sign: F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0) + state["now"]
    return F.aggregate(
        signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda state, sign: F.struct(turn(state, sign).alias("now"), F.greatest(state["most"], turn(state, sign)).alias("most")),
        lambda state: state["most"],
    )


def config_strings(df: DataFrame, key: str, json_column: str) -> DataFrame:
    """Every ``(key_path, name, value, kind)`` of a nested JSON document, at any depth.

    A document is parsed once and walked in one pass without a shuffle: at each level a container gives itself and its
    members, all other rows go through. The greatest depth of the table is found first. Texts that are no JSON, NULL,
    and documents that are a bare value give no rows.
    """
    tvf = df.sparkSession.tvf
    parsed = F.try_parse_json(json_column)
    depth = df.where(parsed.isNotNull()).agg(F.max(nesting(json_column))).first()[0] or 0
    text = F.lit(None).cast("string")
    rows = df.select(
        key, F.lit("").alias("key_path"), text.alias("name"), text.alias("value"), text.alias("kind"), parsed.alias("v"), F.lit(True).alias("_open"),
    )
    for level in range(depth):
        if level:
            both = F.when(F.col("v").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            rows = rows.withColumn("_open", F.explode(both))
        inside = tvf.variant_explode_outer(F.when(F.col("_open"), F.col("v")).outer()).toDF("_pos", "_key", "_value")
        kind = F.schema_of_variant("_value")
        member = lambda new, old: F.when(F.col("_open"), new).otherwise(F.col(old)).alias(old)
        rows = rows.lateralJoin(inside).where(~F.col("_open") | F.col("_pos").isNotNull()).select(
            key, member(F.concat("key_path", F.lit("/"), F.coalesce("_key", F.col("_pos").cast("string"))), "key_path"),
            member(F.col("_key"), "name"), member(F.try_variant_get("_value", "$", "string"), "value"), member(kind, "kind"),
            F.when(F.col("_open") & (kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.col("_value")).alias("v"),
        )
    return (rows if depth else rows.where(F.lit(False))).select(key, "key_path", "name", "value", "kind")


def secret_violations(strings: DataFrame, key: str) -> DataFrame:
    """Forbidden keys, private-key headers and absolute paths in nested configuration."""
    name = F.lower(F.coalesce("name", F.lit("")))
    is_text = F.col("kind") == "STRING"
    header = F.lit(False)
    for mark in schemas.KEY_HEADERS:
        header = header | F.contains("value", F.lit(mark))
    reason = (
        F.when(name.isin(*schemas.FORBIDDEN_KEYS) | name.endswith("_token"), F.lit("secret-key"))
        .when(is_text & header, F.lit("private-key"))
        .when(is_text & paths.is_absolute("value"), F.lit("absolute-path"))
    )
    return strings.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(key, "key_path", "reason")


def lineage_struct(**fields: Column) -> Column:
    """Lineage as JSON; unset optional fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
