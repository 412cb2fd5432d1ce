"""File-content inventory: size and SHA-256."""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 1024 * 1024
#: Bytes of a file that one row holds at most, as many as a task of Spark's readers takes by default.
ROW_BYTES = 128 * 1024 * 1024


def hashed_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Files of a folder, hashed inside the JVM as one row up to ``row_bytes``; Spark leaves out empty files.

    Larger files are listed without their content and hashed by bounded reads, so no task holds one.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(path)
    small = listed.where(F.col("length") <= row_bytes).select(
        "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )
    return small.unionByName(hashed_large_files(listed.where(F.col("length") > row_bytes)))


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path or URI, the path within it, and the path as Spark's readers write it.

    Names are taken as they are: a percent sign is not decoded.
    """
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/(.*)", path, re.DOTALL)
    if found is None or found[1] == "file":
        inner = "/" + found[2].lstrip("/") if found else path
        return fs.LocalFileSystem(), inner, f"file:{inner}"
    host, _, rest = found[2].removeprefix("/").partition("/")
    store, inner = fs.FileSystem.from_uri(f"{found[1]}://{host}/{quote(rest)}")
    return store, inner, path


def digest(path: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Size and SHA-256 of one file on any store, by bounded reads of its stored bytes."""
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    store, inner, _ = located(path)
    sha, size = hashlib.sha256(), 0
    with store.open_input_stream(inner, compression=None) as stream:
        while piece := stream.read(chunk):
            sha.update(piece)
            size += len(piece)
    return size, sha.hexdigest()


def streamed_hash(batches: Iterator[pd.DataFrame], missing: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            try:
                out.append((path, *digest(path)))
            except FileNotFoundError:
                if missing == "fail":
                    raise
                out.append((path, None, None))
        yield pd.DataFrame(out, columns=["path", "size_bytes", "sha256"]).astype({"size_bytes": "Int64"})


def hashed_large_files(paths: DataFrame, partitions: int | None = None, missing: str = "fail") -> DataFrame:
    """Named files of any size on any store, one bounded buffer per task.

    A file that is absent fails the job, or gives NULLs with ``missing="null"``; one that cannot be read always fails.
    """
    if missing not in ("fail", "null"):
        raise ValueError("missing must be fail or null")
    listed = paths.select("path")
    listed = listed.repartition(partitions, "path") if partitions else listed.repartition("path")
    hashed = functools.partial(streamed_hash, missing=missing)
    return listed.mapInPandas(hashed, "path string, size_bytes bigint, sha256 string")
