"""File digests as a format, and loads by name with manifest, shards and lineage."""
from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from epochloom.plans import named_loads
from epochloom.sources import datasets, files, formats
from epochloom.sources.readers import ContractError


def digests(spark, path, **options):
    formats.register(spark)
    return spark.read.format("file_digests").options(**options).load(str(path))


@pytest.fixture
def folder(tmp_path):
    below = tmp_path / "data"
    (below / "sub 1").mkdir(parents=True)
    (below / "a%20b.csv").write_bytes(b"x" * 10)
    (below / "empty.csv").write_bytes(b"")
    (below / "sub 1" / "z.gz").write_bytes(gzip.compress(b"stored, not unpacked"))
    (below / "_SUCCESS").write_bytes(b"left out")
    (below / ".hidden").mkdir()
    (below / ".hidden" / "c.csv").write_bytes(b"left out")
    return below


def test_digests_of_stored_bytes(spark, folder):
    got = {r.path: (r.size_bytes, r.sha256) for r in digests(spark, folder).collect()}
    assert got == {
        f"file:{p}": (len(p.read_bytes()), hashlib.sha256(p.read_bytes()).hexdigest())
        for p in (folder / "a%20b.csv", folder / "empty.csv", folder / "sub 1" / "z.gz")
    }
    # Spark's own readers leave out empty files
    assert {r.path for r in files.hashed_files(spark, str(folder)).collect()} == {p for p, (size, _) in got.items() if size}
    assert digests(spark, folder, recursive="false", glob="*.csv").count() == 2
    assert digests(spark, folder / "a%20b.csv").collect()[0].size_bytes == 10


def test_filters_reach_the_listing(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, Not, StringEndsWith

    reader = formats.FileDigestReader({"path": str(folder), "taskBytes": "12"})
    other = [EqualTo(("sha256",), "x"), Not(EqualTo(("path",), "x"))]
    assert list(reader.pushFilters([IsNotNull(("path",)), GreaterThan(("size_bytes",), 0), StringEndsWith(("path",), ".csv"), *other])) == other
    assert reader.listing() == [(f"file:{folder}/a%20b.csv", 10)]
    whole = formats.FileDigestReader({"path": str(folder), "taskBytes": "12"})
    packs = [p.paths for p in whole.partitions()]
    assert [len(p) for p in packs] == [2, 1] and sum(packs, ()) == tuple(p for p, _ in whole.listing())


def test_filtered_scan_gives_the_filtered_rows(spark, folder):
    rows = digests(spark, folder)
    assert rows.where("size_bytes BETWEEN 1 AND 10").select(F.substring_index("path", "/", -1)).collect()[0][0] == "a%20b.csv"
    assert rows.where(F.col("sha256") == hashlib.sha256(b"").hexdigest()).count() == 1


def test_absent_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert digests(spark, tmp_path / "none").collect() == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        digests(spark, tmp_path / "absent").collect()
    listed = spark.createDataFrame([(f"{tmp_path}/absent",)], "path string")
    assert files.hashed_large_files(listed, 1, missing="null").collect()[0].sha256 is None
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.hashed_large_files(listed, 1).collect()
    with pytest.raises(ValueError):
        files.digest(f"{tmp_path}/absent", chunk=0)


@pytest.fixture
def dataset(spark, tmp_path):
    """Two subjects' nested epochs, and their manifest with one change applied to a shard where asked for."""
    path = f"{tmp_path}/epochs"
    rows = [("w", "Cats", "", "s1", [[1.0, 3.0]], 1), ("w", "dogs", "", None, [[5.0, 7.0]], 1)]
    spark.createDataFrame(
        rows, "word string, topic string, selected_topic string, participant string, eeg array<array<float>>, semantic_relevance long"
    ).coalesce(1).write.parquet(path)

    def manifests(session, change=lambda shard: shard, copies=1):
        base = f"{path}/"
        shards = [
            {"path": r.path.split(base)[1], "size_bytes": r.size_bytes, "sha256": r.sha256} for r in digests(session, path).collect()
        ]
        doc = dict(
            dataset_id="pets", provider="local", repo_id=None, revision="r1", format="parquet", sampling_rate_hz=250.0, n_channels_source=1,
            n_times_source=2, labels=["cats", "dogs"], subject_field="participant", session_field="shard", shards=[change(dict(s)) for s in shards],
        )
        from epochloom import schemas

        return session.createDataFrame([doc] * copies, schemas.MANIFEST)

    return path, manifests


def resolved(spark, dataset, **options):
    path, manifests = dataset
    change = options.pop("change", lambda s: s)
    copies = options.pop("copies", 1)
    registry = datasets.Registry()
    named_loads.register(
        registry, "pets", named_loads.nested_load("nested:pets", n_times=1), path=path, dataset_id=options.pop("dataset_id", "pets"),
        manifests=lambda s: manifests(s, change, copies), aliases=("animals",), **options,
    )
    return registry.resolve("animals", spark)


def test_epochs_carry_source_metadata_and_lineage(spark, dataset):
    rows, lineage = resolved(spark, dataset, release={"release_id": "rel-1", "file_count": 1})
    got = {r.label: r for r in rows.collect()}
    assert set(got) == {"cats", "dogs"} and {r.source for r in got.values()} == {"nested:pets"}
    one = lineage.collect()
    assert len(one) == 1 and all(r.lineage.asDict() == one[0].asDict() for r in got.values())
    assert (one[0].dataset_id, one[0].revision, one[0].mode, one[0].release_id, one[0].file_count, one[0].scope_status) == ("pets", "r1", "verified", "rel-1", 1, None)
    assert len(one[0].manifest_sha256) == 64
    dog = got["dogs"]
    assert dog.metadata.subject_id == "unknown" and dog.metadata.row_index == 1 and dog.metadata.shard.endswith(".parquet") and dog.eeg == [[6.0]]


@pytest.mark.parametrize("key, value, fault", [("size_bytes", 1, "size"), ("sha256", "0" * 64, "digest"), ("path", "gone.parquet", "absent|unlisted")])
def test_a_shard_that_differs_refuses_the_dataset(spark, dataset, key, value, fault):
    with pytest.raises(ContractError, match=fault):
        resolved(spark, dataset, change=lambda s: s | {key: value})
    rows, _ = resolved(spark, dataset, change=lambda s: s | {key: value}, verify=False)
    assert rows.count() == 2


def test_only_one_sound_manifest_is_taken(spark, dataset):
    with pytest.raises(FileNotFoundError, match="no manifest"):
        resolved(spark, dataset, dataset_id="others")
    with pytest.raises(FileNotFoundError, match="more than one"):
        resolved(spark, dataset, copies=2)
    with pytest.raises(ContractError, match="shard"):
        resolved(spark, dataset, change=lambda s: s | {"path": "../up"})
    with pytest.raises(ValueError, match="unknown release fields"):
        resolved(spark, dataset, release={"owner": "x"})


def test_names_are_not_taken_twice(spark, dataset):
    rows, _ = resolved(spark, dataset)
    with pytest.raises(ContractError, match="source, metadata, lineage"):
        named_loads.labelled(rows, "again", {}, F.lit(1))


def test_large_files_are_hashed_without_a_row_of_their_content(spark, tmp_path):
    """One side of the size is read as rows, the other by bounded reads; together they are all files."""
    sizes = {"a b%20.bin": 10, "b.bin": 1_000, "c.bin": 1_001, "d.bin": 3_000_000}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(name.encode() * size)
    want = {name: (len(name) * size, hashlib.sha256(name.encode() * size).hexdigest()) for name, size in sizes.items()}
    for bound in (1, 5_000, files.ROW_BYTES):
        rows = files.hashed_files(spark, str(tmp_path), row_bytes=bound).collect()
        assert {r.path.rsplit("/", 1)[-1]: (r.size_bytes, r.sha256) for r in rows} == want
        assert len(rows) == len(sizes)
