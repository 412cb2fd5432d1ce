"""Building blocks that keep hot keys and large sides out of a single task.

Windows over an unbounded group are split by value buckets of the order column:
bucket totals are aggregated first, carried forward per key, and added back to
the rows. Cut points come from a bounded, deterministic sample.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SAMPLE_PER_BUCKET = 48
SMALL_ROWS = 10_000
MAX_BUCKETS = 1024
#: Rows of one slot of a trailing window that one task may sort.
SLOT_ROWS = 1_000_000


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, as a sum of fixed sizes and measured lengths."""
    col = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.greatest(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 32
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most ``max_rows`` rows and ``max_bytes`` bytes; reads no more than needed."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(f"`{field.name}`", field.dataType)
    got = df.limit(max_rows + 1).select(width.cast("long").alias("w")).agg(F.count("w").alias("n"), F.sum("w").alias("b")).first()
    return got["n"] <= max_rows and (got["b"] or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; a larger side joins by shuffle under AQE."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the key columns of ``left`` stay."""
    keys = list(keys)
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # without keys a total has one row
    renamed = right.select(*[F.col(c).alias(f"_same_{c}" if c in keys else c) for c in right.columns])
    cond = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_same_{k}"])
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_same_{k}" for k in keys])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(one_row), F.lit(True))


def n_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, parts))


def cut_points(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> list[tuple] | None:
    """Sorted, distinct cut tuples from the rows with the smallest key hashes.

    The hash sample is a uniform one and does not depend on the partitioning, so
    two readings of the same table always give the same buckets. NULL when the
    sample is the whole table, which then is small enough for one plain window.
    """
    buckets = buckets or n_buckets(df)
    limit = max(buckets * SAMPLE_PER_BUCKET, SMALL_ROWS)
    first = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(limit)
    # one row: a collected limit would bring ``limit`` rows of every partition to the driver
    picked = first.agg(F.collect_list(F.struct(*order)).alias("rows")).first()["rows"]
    if len(picked) < limit:
        return None
    values = sorted({tuple(row) for row in picked if all(item is not None for item in row)})
    if len(values) <= 1:
        return []
    step = len(values) / buckets
    return sorted({values[int(i * step)] for i in range(1, buckets)})


def _below(order: Sequence[str], cut: tuple) -> Column:
    """Lexicographic ``order < cut``; like a window, NULL comes before every value."""
    test = F.lit(False)
    for name, value in reversed(list(zip(order, cut))):
        test = F.col(name).isNull() | (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return test


def bucket_of(order: Sequence[str], cuts: list[tuple]) -> Column:
    """Bucket number, monotone in ``order``; a binary search written as nested CASE."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_below(order, cuts[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(cuts)).cast("int")


def _carry(totals: DataFrame, keys: Sequence[str], agg: Column, out: str) -> DataFrame:
    """Running aggregate of all earlier buckets, per key (one row per key and bucket)."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.withColumn(out, agg.over(w))


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
    buckets: int | None = None,
) -> DataFrame:
    """1-based row number per key in ``order`` without one task per key.

    ``order`` must be unique inside a key. With no keys the numbering is global.
    """
    keys = list(keys)
    cuts = cut_points(df, order, buckets)
    if cuts is None:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    tagged = df.withColumn("_bucket", bucket_of(order, cuts))
    totals = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _carry(totals, keys, F.sum("_n"), "_offset").select(*keys, "_bucket", "_offset")
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_local", F.row_number().over(w))
    cond = [numbered["_bucket"] == offsets["_bucket"]]
    cond += [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    joined = numbered.join(offsets, cond, "inner")
    return joined.select(
        *[numbered[c] for c in df.columns],
        (F.coalesce(offsets["_offset"], F.lit(0)) + numbered["_local"]).cast("long").alias(out),
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact midpoint median per key by two counting passes.

    Pass one counts values per bucket; pass two keeps only the buckets that hold
    the middle ranks and runs over their distinct values.
    """
    keys = list(keys)
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = cut_points(rows, [value]) or []
    tagged = counts.withColumn("_bucket", bucket_of([value], cuts))
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    carried = _carry(totals, keys, F.sum("_n"), "_before")
    size = totals.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    wanted = (
        join_keys(carried, size, keys)
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .withColumn("_lo", F.floor((F.col("_size") + 1) / 2))
        .withColumn("_hi", F.floor((F.col("_size") + 2) / 2))
        .where("(_lo > _before AND _lo <= _before + _n) OR (_hi > _before AND _hi <= _before + _n)")
        .select(*keys, "_bucket", "_before", "_lo", "_hi")
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy(value)
    picked = (
        join_keys(tagged, wanted, [*keys, "_bucket"])
        .withColumn("_top", F.col("_before") + F.sum("_n").over(w))
        .withColumn("_bottom", F.col("_top") - F.col("_n"))
    )
    inside = lambda rank: (F.col(rank) > F.col("_bottom")) & (F.col(rank) <= F.col("_top"))
    return picked.groupBy(*keys).agg(
        ((F.max(F.when(inside("_lo"), F.col(value))) + F.max(F.when(inside("_hi"), F.col(value)))) / 2)
        .alias(out)
    )


def prefix_max(
    probe: DataFrame, base: DataFrame, keys: Sequence[str], probe_at: str,
    base_at: str, base_value: str, out: str, inclusive: bool,
) -> DataFrame:
    """Add to each probe row the largest base value whose time is before its own.

    Both sides are merged and scanned in time order, so no pair of rows is ever
    formed; a hot key is cut into time buckets whose maxima are carried forward.
    A base row without a time is before nothing, and nothing is before a probe without one.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in probe.columns]).alias("_row")
    value_type = base.schema[base_value].dataType
    side_p = probe.select(
        *keys, F.col(probe_at).alias("_at"), F.lit(1 if inclusive else 0).alias("_side"),
        F.lit(None).cast(value_type).alias("_value"), payload,
    )
    row_type = side_p.schema["_row"].dataType
    side_b = base.where(F.col(base_at).isNotNull()).select(
        *keys, F.col(base_at).alias("_at"), F.lit(0 if inclusive else 1).alias("_side"),
        F.col(base_value).alias("_value"), F.lit(None).cast(row_type).alias("_row"),
    )
    both = side_p.unionByName(side_b)
    cuts = cut_points(both, ["_at"]) or []
    both = both.withColumn("_bucket", bucket_of(["_at"], cuts))
    totals = both.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_m"))
    carried = _carry(totals, keys, F.max("_m"), "_carry").select(*keys, "_bucket", "_carry")
    w = (
        Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = both.withColumn("_run", F.max("_value").over(w)).where(F.col("_row").isNotNull())
    joined = join_keys(scanned, carried, [*keys, "_bucket"])
    return joined.select("_row.*", F.greatest("_run", "_carry").alias(out))


def trailing_count(
    df: DataFrame, keys: Sequence[str], at_us: str, width_us: int, out: str, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Rows of the same key in ``[t - width, t]``.

    Slots are as wide as the window, so a row can only count into its own slot and the next one, and a window for each slot
    does. Where a slot holds more than ``slot_rows`` rows, its window would be too much for one task: then each count is the
    difference of two prefix counts, taken over buckets of the time that are carried forward. A row without a time counts
    the rows of its key without one.
    """
    keys = list(keys)
    slot = F.floor(F.col(at_us) / F.lit(width_us))
    most = df.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most > slot_rows:
        return _trailing_ranks(df, keys, at_us, width_us, out)
    copies = df.withColumn(
        "_copy",
        F.explode(F.array(
            F.struct(slot.alias("slot"), F.lit(True).alias("own")),
            F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")),
        )),
    )
    w = (
        Window.partitionBy(*keys, "_copy.slot").orderBy(at_us).rangeBetween(-width_us, 0)
    )
    counted = copies.withColumn(out, F.count(F.lit(1)).over(w))
    # rows without a time stand in one slot twice
    whole = F.when(F.col(at_us).isNull(), F.floor(F.col(out) / 2)).otherwise(F.col(out)).cast("long")
    return counted.where("_copy.own").withColumn(out, whole).drop("_copy")


def _trailing_ranks(df: DataFrame, keys: Sequence[str], at_us: str, width_us: int, out: str) -> DataFrame:
    """As ``trailing_count``, without a task that holds a slot.

    Equal (key, time) rows are one row with their number, so a burst in one instant is one row; two marks for each of
    these, one before all rows at ``t - width`` and one after all rows at ``t``, read the running number.
    """
    keys = list(keys)
    points = df.groupBy(*keys, at_us).agg(F.count(F.lit(1)).alias("_n"))
    timed = points.where(F.col(at_us).isNotNull())
    row = lambda at, side, n, sign: F.struct(at.alias("at"), F.lit(side).alias("side"), n.cast("long").alias("n"), F.lit(sign).alias("sign"))
    t = F.col(at_us)
    marks = timed.select(*keys, t.alias("_t"), F.explode(F.array(
        row(t - width_us, 0, F.lit(0), -1), row(t, 1, F.col("_n"), 0), row(t, 2, F.lit(0), 1),
    )).alias("_m")).select(*keys, "_t", "_m.*")
    cuts = cut_points(marks, ["at"]) or []
    marks = marks.withColumn("_bucket", bucket_of(["at"], cuts))
    totals = marks.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_s"))
    carried = _carry(totals, keys, F.sum("_s"), "_before").select(*keys, "_bucket", "_before")
    w = Window.partitionBy(*keys, "_bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = marks.withColumn("_run", F.sum("n").over(w)).where("sign <> 0")
    read = join_keys(running, carried, [*keys, "_bucket"]).groupBy(*keys, F.col("_t").alias(at_us)).agg(
        F.sum(F.col("sign") * (F.col("_run") + F.coalesce("_before", F.lit(0)))).cast("long").alias(out)
    )
    untimed = points.where(F.col(at_us).isNull()).select(*keys, at_us, F.col("_n").cast("long").alias(out))
    return join_keys(df, read.unionByName(untimed), [*keys, at_us])


def array_sum(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Element-wise sum of equal-length double arrays, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(out)
    )
