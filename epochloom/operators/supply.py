"""Supply chain: dependency lines, components and the vulnerability gate."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochloom.functions import text

# Statuses that settle an advisory.
RESOLVED = ("remediated", "resolved", "closed", "accepted")


def unresolved(df: DataFrame) -> DataFrame:
    """Open advisories that are critical or known to be exploited."""
    status = F.lower(F.coalesce("status", F.lit("open")))
    flagged = df.withColumn("critical", F.upper(F.coalesce("severity", F.lit(""))) == "CRITICAL").withColumn(
        "exploited", F.coalesce("kev", F.lit(False))
    )
    return flagged.where(~status.isin(*RESOLVED) & (F.col("critical") | F.col("exploited")))


def gate_counts(df: DataFrame) -> DataFrame:
    """Unresolved critical, unresolved exploited and total counts, with the verdict."""
    open_ = ~F.lower(F.coalesce("status", F.lit("open"))).isin(*RESOLVED)
    return df.agg(
        F.count_if(open_ & (F.upper(F.coalesce("severity", F.lit(""))) == "CRITICAL")).alias("critical"),
        F.count_if(open_ & F.coalesce("kev", F.lit(False))).alias("exploited"),
        F.count(F.lit(1)).alias("records"),
    ).withColumn("passes", (F.col("critical") == 0) & (F.col("exploited") == 0))


def frozen_components(lines: DataFrame, line: str) -> DataFrame:
    """``name==version`` lines; comments, editable installs and URL lines are skipped."""
    raw = text.strip(line)
    parsed = lines.withColumn("_l", raw).where(
        (F.col("_l") != "") & ~F.col("_l").startswith("#") & ~F.col("_l").startswith("-e ")
        & ~F.contains("_l", F.lit(" @ ")) & F.contains("_l", F.lit("=="))
    )
    name = text.strip(F.element_at(F.split(F.substring_index("_l", "==", 1), r"\["), 1))
    version = text.strip(F.substring(F.col("_l"), F.instr("_l", "==") + 2, F.length("_l")))
    return parsed.withColumn("name", name).withColumn("version", version).where(
        (F.col("name") != "") & (F.col("version") != "")
    ).drop("_l")


def declared_components(lines: DataFrame, line: str) -> DataFrame:
    """Declared requirements: quotes and commas trimmed, ``declared`` without a pin."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(text.strip(line), "^,+|,+\\z", ""), '^"+|"+\\z', ""), "^'+|'+\\z", "")
    parsed = lines.withColumn("_l", raw).where((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    name = text.strip(F.element_at(F.split("_l", r"==|>=|\["), 1))
    pin = F.element_at(F.split("_l", "=="), 2)
    version = F.when(F.contains("_l", F.lit("==")), F.element_at(F.split(text.strip(pin), ","), 1)).otherwise(F.lit("declared"))
    return parsed.withColumn("name", name).withColumn("version", version).where(F.col("name") != "").drop("_l")


def purl(name: str = "name", version: str = "version") -> Column:
    return F.concat(F.lit("pkg:pypi/"), F.lower(name), F.lit("@"), F.col(version))
