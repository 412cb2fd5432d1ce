"""Session, checkpoint folder and write-folder helpers."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, made once for a session."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"), ("spark.sql.streaming.stateStore.providerClass", STATE_STORE),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Send the packages below ``root`` to the workers, once for an application.

    Python functions are pickled by module name, so a worker must be able to import the modules, whatever its
    working folder is.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "epochloom_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top in ("epochloom", "bindings", "corpus_pipeline.py"):
            for here, _, names in os.walk(os.path.join(root, top)) if not top.endswith(".py") else [(root, [], [top])]:
                for name in names:
                    if name.endswith(".py") and os.path.exists(os.path.join(here, name)):
                        out.write(os.path.join(here, name), os.path.relpath(os.path.join(here, name), root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def local_session(cpus: int | str = 8, app: str = "epochloom") -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EPOCHLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a machine-local folder, which is then set for the whole session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses the cut plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table below the shared folder: worked out once, where a checkpoint works its last stage out twice."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
