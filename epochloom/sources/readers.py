"""Scans of epochs, samples, markers and protocol documents."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from epochloom import schemas
from epochloom.functions import arrays, paths, text
from epochloom.functions.scale import attach_row, small_side


_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


class ContractError(ValueError):
    """Input breaks a fixed contract."""


def require_columns(df: DataFrame, wanted: Sequence[str], what: str) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ContractError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan of fewer splits than there are threads, dealt out over them.

    For work that is heavy per row; a large table has more splits and is left alone.
    """
    threads = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= threads else scan.repartition(threads)


def nested_epochs(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, glob: str | None = None
) -> DataFrame:
    """Nested-epoch Parquet scan: only the wanted columns, with file and row provenance."""
    wanted = list(columns or schemas.NESTED_EPOCHS.fieldNames())
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = require_columns(reader.parquet(path), wanted, "epoch Parquet")
    return raw.select(
        *wanted,
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def table_rows(epochs: DataFrame) -> DataFrame:
    """``row_index`` counted through all shards in name order instead of within each."""
    # one row per file, not per epoch
    sizes = epochs.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return epochs.join(F.broadcast(sizes.select("shard", ahead.alias("_ahead"))), "shard").withColumn(
        "row_index", F.col("row_index") + F.col("_ahead")
    ).drop("_ahead")


def shard_range(df: DataFrame, start: int, max_shards: int) -> DataFrame:
    """Rows of ``max_shards`` shards from ``start`` in name order; a late start means the last one."""
    names = df.select("shard").distinct()
    # the shard list is one row per file, not per epoch
    order = names.withColumn("shard_no", F.row_number().over(Window.orderBy("shard")) - 1)
    last = order.agg(F.max("shard_no").alias("_last"))
    chosen = (
        attach_row(order, last)
        .withColumn("_start", F.least(F.lit(start), F.col("_last")))
        .where((F.col("shard_no") >= F.col("_start")) & (F.col("shard_no") < F.col("_start") + max_shards))
        .select("shard", "shard_no")
    )
    return df.join(small_side(chosen), "shard", "inner")


def sample_csv(
    spark: SparkSession, path: str, channels: Sequence[str] = schemas.SAMPLE_CHANNELS
) -> DataFrame:
    """Wide windowed-sample CSV; a value that does not parse fails the read.

    The header may hold its columns in any order but must name all wanted ones, and
    every file must carry the same header. Hadoop's line reader drops a byte-order mark.
    """
    header = spark.read.option("header", True).csv(path)
    kinds = {"patient": "int", "time": "double", "label": "string", "epoch": "int"}
    kinds |= {c: "double" for c in channels}
    require_columns(header, list(kinds), "sample CSV")
    wide = T.StructType([
        T.StructField(c, _KINDS[kinds.get(c, "string")]) for c in header.columns
    ])
    rows = (
        spark.read.schema(wide).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path)
    )
    return rows.select(*[F.col(f"`{c}`") for c in kinds])


def numeric_epochs(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Epochs by file format: a numeric Parquet table or a headerless numeric CSV per epoch.

    A one-line CSV is a single channel; each further line is one more channel.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        return raw.select(
            F.col("_metadata.file_path").alias("epoch_key"),
            F.col("_metadata.row_index").alias("row_index"),
            F.array(*[F.col(f"`{c}`").cast("double") for c in raw.columns]).alias("values"),
        )
    if fmt != "csv":
        raise ContractError("Unsupported epoch format")
    # one file is one epoch of at most the policy size, so a whole file is one row
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("epoch_key"), "value"
    )
    lines = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    return files.select("epoch_key", F.transform(lines, lambda line: F.transform(
        F.split(line, ","), lambda v: F.trim(v).cast("double")
    )).alias("eeg"))


def marker_tsv(spark: SparkSession, path: str, schema: T.StructType = schemas.MARKERS) -> DataFrame:
    """Marker TSV rows with subject, subject-qualified session and file name."""
    rows = (
        spark.read.schema(schema).option("sep", "\t").option("header", True)
        .option("mode", "FAILFAST").option("nullValue", "n/a").csv(path)
    )
    source = F.col("_metadata.file_path")
    subject, session = paths.subject_session(source)
    return rows.select(
        *schema.fieldNames(), subject.alias("subject_id"),
        F.concat_ws(":", subject, session).alias("session_id"),
        F.col("_metadata.file_name").alias("source_file"),
    )


def channel_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.CHANNELS).option("sep", "\t").option("header", True).csv(path)
    return eeg_channels(rows, "type")


def eeg_channels(df: DataFrame, type_column: str, kind: str = "EEG") -> DataFrame:
    return df.where(F.upper(F.coalesce(F.col(type_column), F.lit(""))) == kind)


PROTOCOL = schemas.struct(
    protocol_id=T.StringType(),
    cohort=schemas.struct(
        primary_subjects=T.ArrayType(T.StringType()),
        analyzed_yes=T.ArrayType(T.StringType()),
        eeg_without_events=T.ArrayType(T.StringType()),
    ),
    task=schemas.struct(sentences=T.ArrayType(schemas.struct(sentence_id=T.IntegerType(), text=T.StringType()))),
)


def protocol_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(PROTOCOL).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def cohort_subjects(
    protocols: DataFrame, cohort: str, observed: DataFrame | None = None, first: int | None = None
) -> DataFrame:
    """Subjects of a locked cohort in document order.

    ``events_available`` is the observed subjects without the excluded ones, by name.
    """
    named = {"primary": "primary_subjects", "analyzed": "analyzed_yes"}
    if cohort in named:
        out = protocols.select(
            "protocol_id", F.posexplode(f"cohort.{named[cohort]}").alias("pos", "subject_id")
        )
    elif cohort == "events_available":
        if observed is None:
            raise ContractError("events_available needs the observed subjects")
        excluded = protocols.select(
            "protocol_id", F.explode("cohort.eeg_without_events").alias("subject_id")
        )
        kept = observed.select("protocol_id", "subject_id").distinct().join(
            excluded, ["protocol_id", "subject_id"], "left_anti"
        )
        out = kept.withColumn(
            "pos", F.row_number().over(Window.partitionBy("protocol_id").orderBy("subject_id")) - 1
        )
    else:
        raise ContractError("cohort must be primary, analyzed, or events_available")
    return out if first is None else out.where(F.col("pos") < first)


def protocol_sentences(protocols: DataFrame, first: int | None = None) -> DataFrame:
    out = protocols.select("protocol_id", F.posexplode("task.sentences").alias("pos", "s")).select(
        "protocol_id", "pos", F.col("s.sentence_id").alias("sentence_id"), F.col("s.text").alias("text")
    )
    return out if first is None else out.where(F.col("pos") < first)


def with_fallback(primary: DataFrame, alternate: DataFrame, primary_name: str, alternate_name: str) -> DataFrame:
    """The primary table, or the alternate when it is empty, tagged with its name."""
    if primary.isEmpty():
        return alternate.withColumn("source", F.lit(alternate_name))
    return primary.withColumn("source", F.lit(primary_name))


def label_with_fallback(field: str, word: str = "word", topic: str = "topic", selected: str = "selected_topic") -> Column:
    """Chosen label field, else the word, else the topic; NULL when all are blank."""
    columns = {"topic": topic, "selected_topic": selected, "word": word}
    if field not in columns:
        raise ContractError("label_field must be topic, selected_topic, or word")
    key = lambda c: text.non_empty(text.text_key(c))
    return F.coalesce(key(columns[field]), key(word), key(topic))


def usable_epochs(df: DataFrame, label_field: str, relevant_only: bool = False) -> DataFrame:
    """Valid epochs with their normalised label; invalid shapes and blank labels are dropped."""
    out = df
    if relevant_only:
        out = out.where(F.coalesce(F.col("semantic_relevance"), F.lit(0)) == 1)
    out = out.where(arrays.is_epoch("eeg"))
    return out.withColumn("label", label_with_fallback(label_field)).where(F.col("label").isNotNull())
