"""Load jobs by dataset name: labelled epochs that carry source, metadata and lineage."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epochloom import schemas
from epochloom.plans import load_jobs
from epochloom.sources import catalog, datasets, formats, readers
from epochloom.sources.readers import ContractError

CARRIED = ("source", "metadata", "lineage")


@dataclass(frozen=True)
class NamedLoad:
    """How a dataset is read, pooled and described.

    ``read`` gives the raw rows of a path, ``build`` its labelled epochs, and ``metadata`` the columns (of the epochs,
    or constants) that describe one epoch.
    """

    source: str
    read: Callable[[SparkSession, str], DataFrame]
    build: Callable[[DataFrame], DataFrame]
    metadata: Mapping[str, Column] = field(default_factory=dict)


def labelled(rows: DataFrame, source: str, metadata: Mapping[str, Column], lineage: Column) -> DataFrame:
    """Rows with their source, a struct of metadata and the lineage of their dataset; no shuffle.

    Rows that have a column of such a name already are refused.
    """
    taken = [c for c in CARRIED if c in rows.columns]
    if taken:
        raise ContractError(f"epochs hold {', '.join(taken)} already")
    described = F.struct(*[column.alias(name) for name, column in metadata.items()])
    return rows.withColumns({"source": F.lit(source), "metadata": described, "lineage": lineage})


def pinned_manifest(manifests: DataFrame, dataset_id: str, provider: str) -> DataFrame:
    """The one sound manifest of a dataset, with its digest; none, several or a broken one are refused.

    The digest is taken over the manifest as one line of JSON, fields in the order of the schema, NULLs left out.
    """
    known = manifests.where((F.col("dataset_id") == dataset_id) & (F.col("provider") == provider))
    line = F.to_json(F.struct(*schemas.MANIFEST.fieldNames()))
    one = catalog.manifest_violations(known).withColumn("manifest_sha256", F.sha2(line, 256))
    head = one.select("violations").limit(2).collect()
    if len(head) != 1:
        raise FileNotFoundError(f"dataset {dataset_id} of {provider} has {'no' if not head else 'more than one'} manifest")
    if head[0].violations:
        raise ContractError(f"manifest of {dataset_id} breaks: {', '.join(head[0].violations)}")
    return one.drop("violations")


def lineage_row(manifest: DataFrame, mode: str, release: Mapping[str, object] | None = None) -> DataFrame:
    """One row of lineage: the identity of a manifest, and of a release where one is given."""
    unknown = set(release or {}) - set(schemas.RELEASE_LINEAGE.fieldNames())
    if unknown:
        raise ValueError(f"unknown release fields: {', '.join(sorted(unknown))}")
    of_release = [
        F.lit((release or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in schemas.RELEASE_LINEAGE.fields
    ]
    return manifest.select("dataset_id", "revision", "manifest_sha256", "provider", F.lit(mode).alias("mode"), *of_release)


def shard_faults(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Shards whose stored bytes differ from the manifest: absent, unlisted, or of another size or digest.

    Shard paths are relative to the folder. Every byte of the folder is read once.
    """
    formats.register(spark)
    stored = spark.read.format("file_digests").load(path)
    base = path.removeprefix("file:").rstrip("/") + "/"
    stored = stored.select(
        F.substring_index("path", base, -1).alias("path"), F.col("size_bytes").alias("stored_bytes"), F.col("sha256").alias("stored_sha256")
    )
    listed = catalog.manifest_shards(manifest).select("path", "size_bytes", "sha256")
    fault = (
        F.when(F.col("stored_sha256").isNull(), "absent").when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("size_bytes") != F.col("stored_bytes"), "size").when(F.col("sha256") != F.col("stored_sha256"), "digest")
    )
    return listed.join(stored, "path", "full").select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def register(
    registry: datasets.Registry, name: str, load: NamedLoad, *, path: str, manifests: Callable[[SparkSession], DataFrame],
    dataset_id: str, provider: str = "local", mode: str = "verified", verify: bool = True,
    release: Mapping[str, object] | None = None, aliases: Sequence[str] = (),
) -> None:
    """Register a load under a name; resolving it checks the manifest and the stored shards first.

    ``resolve`` gives the labelled epochs and the one row of lineage. With ``verify`` a shard that differs refuses
    the dataset; without it only the manifest is checked.
    """

    def factory(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        manifest = pinned_manifest(manifests(spark), dataset_id, provider)
        if verify:
            worst = shard_faults(spark, manifest, path).orderBy("path").head()
            if worst is not None:
                raise ContractError(f"shard {worst['path']} of {dataset_id}: {worst['fault']}")
        lineage = lineage_row(manifest, mode, release)
        values = lineage.head()
        stamp = F.struct(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in lineage.schema.fields])
        epochs = load.build(load.read(spark, path))
        return labelled(epochs, load.source, load.metadata, stamp), lineage

    registry.register(name, factory)
    for alias in aliases:
        registry.register(alias, factory)


def nested_load(source: str, *, glob: str = "*.parquet", label_field: str = "topic", relevant_only: bool = False, n_times: int = 64) -> NamedLoad:
    """Nested-epoch Parquet."""
    return NamedLoad(
        source, lambda spark, path: readers.nested_epochs(spark, path, glob=glob),
        lambda raw: load_jobs.nested_job(raw, label_field=label_field, relevant_only=relevant_only, n_times=n_times),
        {c: F.col(c) for c in ("subject_id", "session_id", "label", "shard", "row_index")} | {"format": F.lit("nested-parquet")},
    )


def windowed_load(
    source: str, channels: Sequence[str] = schemas.SAMPLE_CHANNELS, *, expected: int = schemas.SAMPLES_PER_EPOCH,
    rate_hz: float = schemas.SAMPLE_RATE_HZ, n_times: int = 64, n_channels: int = 32, strict: bool = True,
) -> NamedLoad:
    """Wide CSV of windowed samples."""
    return NamedLoad(
        source, lambda spark, path: readers.sample_csv(spark, path, channels),
        lambda rows: load_jobs.windowed_job(
            rows, channels, expected=expected, step=1.0 / rate_hz, n_times=n_times, n_channels=n_channels, strict=strict
        ),
        {c: F.col(c) for c in ("subject_id", "session_id", "patient", "epoch", "label")} | {
            "sfreq_hz": F.lit(rate_hz), "format": F.lit("csv-windowed"),
            "n_times_native": F.lit(expected), "n_channels_native": F.lit(len(channels)),
        },
    )
