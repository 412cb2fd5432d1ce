"""Cutting continuous signals into epochs, and assembling windowed samples."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from epochloom.functions import arrays, text
from epochloom.functions.scale import ranked

# Marker codes of recording boundaries.
SKIP_CODES = ("65480", "65481", "event_65480", "event_65481")


def marker_label(trial_type: str = "trial_type", value: str = "value") -> Column:
    return F.coalesce(text.non_empty(trial_type), text.non_empty(value), F.lit("event"))


def usable_markers(df: DataFrame, trial_type: str = "trial_type", value: str = "value") -> DataFrame:
    """Markers with their label; boundary codes in label or value are dropped."""
    label = marker_label(trial_type, value)
    return df.withColumn("label", label).where(
        ~F.col("label").isin(*SKIP_CODES) & ~F.coalesce(F.col(value), F.lit("")).isin(*SKIP_CODES)
    )


def code_label(code: Column, table: dict[int, str]) -> Column:
    """Label of an event code; NULL for a code outside the table."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), code.cast("int"))


def one_hot_label(y: Column, names: Column, defaults: Sequence[str]) -> Column:
    """Class name of the largest entry; a position outside the names uses the default list."""
    at = arrays.argmax_index(y)
    fallback = F.array(*[F.lit(d) for d in defaults])
    name = F.when((at >= 0) & (at < F.size(names)), F.get(names, at)).otherwise(F.get(fallback, at))
    return F.replace(F.lower(name), F.lit(" "), F.lit(""))


def windows(
    markers: DataFrame, onset: str, fs: Column, width: Column | None = None, *,
    tmin: float = 0.0, stop_at: Column | None = None, rounded: bool = False,
) -> DataFrame:
    """Sample bounds ``[start, stop)`` of each marker, by truncation or by half-even rounding."""
    to_index = (lambda c: F.bround(c, 0).cast("long")) if rounded else (lambda c: c.cast("long"))
    start = to_index((F.col(onset) + F.lit(tmin)) * fs)
    stop = start + width if stop_at is None else to_index(stop_at * fs)
    return markers.withColumn("start", start).withColumn("stop", stop)


def drop_outside(markers: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """Windows that lie whole inside their recording of ``n_samples`` samples."""
    return markers.join(recordings.select(key, "n_samples"), key, "inner").where(
        (F.col("start") >= 0) & (F.col("stop") > F.col("start")) & (F.col("stop") <= F.col("n_samples"))
    )


def cut_epochs(
    signal: DataFrame, markers: DataFrame, key: str, marker_id: str, *,
    bucket: int, pad_to: int | None = None,
) -> DataFrame:
    """Interval join of markers to samples, one row per marker with a channel-major epoch.

    Both sides carry a sample-range bucket as an equi-join key, so a long recording
    is spread over its buckets and only samples near a marker are matched. ``signal``
    holds ``(key, ch, sample_idx, v)``; ``markers`` holds ``start`` and ``stop``.
    """
    bucket_of = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    wanted = markers.select(key, marker_id, "start", "stop").withColumn(
        "_bucket", F.explode(F.sequence(bucket_of(F.col("start")), bucket_of(F.col("stop") - 1)))
    )
    samples = signal.select(key, "ch", "sample_idx", "v").withColumn("_bucket", bucket_of(F.col("sample_idx")))
    hit = samples.join(wanted, [key, "_bucket"], "inner").where(
        (F.col("sample_idx") >= F.col("start")) & (F.col("sample_idx") < F.col("stop"))
    )
    # one shuffle by marker serves both steps; a channel is bounded by the window width
    rows = hit.repartition(key, marker_id).groupBy(key, marker_id, "ch").agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", "v"))).alias("s")
    ).select(key, marker_id, "ch", F.transform("s", lambda p: p["v"]).alias("row"))
    epochs = rows.groupBy(key, marker_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ch", "row"))), lambda p: p["row"]).alias("eeg")
    )
    if pad_to is not None:
        epochs = epochs.withColumn("eeg", arrays.fit_epoch_width("eeg", pad_to))
    return epochs.join(markers, [key, marker_id], "inner")


def match_by_stem(
    recordings: DataFrame, events: DataFrame, name: str, recording_suffix: str, event_suffix: str
) -> DataFrame:
    """Recordings with their event file of the same name stem; others are skipped."""
    left = recordings.withColumn("stem", F.regexp_replace(F.col(name), recording_suffix + r"\z", ""))
    right = events.select(
        F.col(name).alias("event_name"), F.regexp_replace(F.col(name), event_suffix + r"\z", "").alias("stem")
    )
    return left.join(right, "stem", "inner")


def positional_join(
    left: DataFrame, right: DataFrame, run: str, left_order: Sequence[str],
    right_order: Sequence[str],
) -> DataFrame:
    """The i-th left row of a run with its i-th right row; the surplus is dropped."""
    a = ranked(left, [run], list(left_order), "i")
    b = ranked(right, [run], list(right_order), "i")
    return a.join(b, [run, "i"], "inner")


def present_channels(described: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Described channels that the recording has; their own order column is kept."""
    return described.join(present.select(name), name, "left_semi")


def assemble(
    samples: DataFrame, keys: Sequence[str], time: str, channels: Sequence[str], expected: int
) -> DataFrame:
    """Complete sample groups as channel-major epochs in time order.

    Groups of another size are left to the contract check, so a collected group
    never holds more than ``expected`` rows.
    """
    keys = list(keys)
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    complete = samples.join(sizes.where(F.col("_n") == expected).select(*keys), keys, "inner")
    ordered = complete.groupBy(*keys).agg(
        F.min("label").alias("label"),
        F.sort_array(F.collect_list(F.struct(
            F.col(time).alias("t"), *[F.col(f"`{c}`").cast("float").alias(f"c{i}") for i, c in enumerate(channels)]
        ))).alias("_s"),
    )
    row_of = lambda field: F.transform("_s", lambda p: p[field])
    rows = [row_of(f"c{i}") for i in range(len(channels))]
    return ordered.select(*keys, "label", F.array(*rows).alias("eeg"))


def sample_contract(
    samples: DataFrame, keys: Sequence[str], time: str, label: str, *,
    expected: int, step: float, tolerance: float = 1e-6,
) -> DataFrame:
    """Per group: row count, label count, cadence breaks and the reason it fails, if any.

    Cadence is read in time order inside groups no larger than ``expected``; larger
    groups already fail by their count, so no window spans an unbounded group.
    """
    keys = list(keys)
    sizes = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(label).alias("_lo"), F.max(label).alias("_hi")
    )
    small = samples.join(sizes.where(F.col("n_rows") <= expected).select(*keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = small.withColumn("_gap", F.col(time) - F.lag(time).over(w)).groupBy(*keys).agg(
        F.count_if(F.abs(F.col("_gap") - F.lit(step)) > tolerance).alias("bad_steps")
    )
    reason = (
        F.when((F.col("n_rows") > expected) | (F.col("_lo") != F.col("_hi")) | (F.coalesce("bad_steps", F.lit(0)) > 0), "time-or-label")
        .when(F.col("n_rows") != expected, "incomplete")
    )
    return sizes.join(gaps, keys, "left").select(
        *keys, "n_rows", (F.col("_lo") == F.col("_hi")).alias("one_label"),
        F.coalesce("bad_steps", F.lit(0)).cast("long").alias("bad_steps"), reason.alias("reason"),
    )


def first_offender(contract: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lowest failing group; time and label errors come before count errors."""
    order = F.struct((F.col("reason") != "time-or-label").alias("late"), *[F.col(k) for k in keys])
    return contract.where(F.col("reason").isNotNull()).agg(
        F.min_by(F.struct(*keys, "reason", "n_rows"), order).alias("o")
    ).where(F.col("o").isNotNull()).select("o.*")


def sentence_windows(
    words: DataFrame, keys: Sequence[str], onset: str, duration: str, segment: str, max_sec: float
) -> DataFrame:
    """Span, word count and first segment of each sentence, capped at ``max_sec``."""
    out = words.groupBy(*keys).agg(
        F.min(onset).alias("onset"), F.max(F.col(onset) + F.col(duration)).alias("_end"),
        F.count(F.lit(1)).alias("n_words"), F.min_by(segment, onset).alias("segment"),
    )
    return out.withColumn("offset_s", F.least("_end", F.col("onset") + F.lit(max_sec))).drop("_end")


def attach_sentences(windows_df: DataFrame, spec: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Windows of the specified sentences with text and spec order; others are skipped."""
    return windows_df.join(spec, key, "inner")
