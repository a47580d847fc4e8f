"""Partitions by a hash, their histograms and offsets; sorted runs and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import hashing


def partition(df: DataFrame, pid: Column, parts: int) -> DataFrame:
    """df with pid, dealt out so that a partition's rows are together. One shuffle."""
    return df.withColumn("pid", pid).repartition(parts, "pid")


def by_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Ranges of keys, each sorted."""
    return df.repartitionByRange(parts, key).sortWithinPartitions(key)


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def histogram(df: DataFrame, *pids: Column) -> DataFrame:
    """(pid[, pid2, ...], n): counts are summed in each task before the shuffle."""
    names = ["pid", *[f"pid{i}" for i in range(2, len(pids) + 1)]]
    return df.groupBy(*[p.alias(n) for p, n in zip(pids, names)]).agg(F.count(F.lit(1)).alias("n"))


def offsets(counts: DataFrame) -> DataFrame:
    """(pid, n, begin): where each partition begins. counts has a row for each partition, so one task sums them."""
    order = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("pid", "n", (F.sum("n").over(order) - F.col("n")).alias("begin"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The rows of all runs (a bag union), sorted by key and payload; ranges are sorted on their own."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("key", "payload")


def concatenate(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def two_pass(df: DataFrame, key: str, buckets: int, passes: int, parts: int) -> DataFrame:
    """df with pid1, pid2, ... of every pass and pid, all of them in one number. Rows go to their last partition at once: one shuffle
    does what passes of writing and reading would."""
    found = hashing.modulo_passes(key, buckets, passes)
    bits = hashing.log2_of(buckets)
    share = [bits // passes + (i < bits % passes) for i in range(passes)]
    pid = F.lit(0).cast("long")
    for own, width in zip(found, share):
        pid = F.shiftleft(pid, width).bitwiseOR(own)
    return df.select("*", *[c.alias(f"pid{i + 1}") for i, c in enumerate(found)], pid.alias("pid")).repartition(parts, "pid")


def descents(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(rows, descents) of df as `order` has it: neighbours whose second key is smaller. 0 means sorted; null keys don't count.

    `order` must tell all rows apart. Ranges of it are judged each for itself, then their edges: one row for each range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.select(F.col(key).alias("key"), F.struct(*order).alias("at")).repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    inner = own.withColumn("before", F.lag("key").over(Window.partitionBy("part").orderBy("at")))
    ranges = inner.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("key") < F.col("before")).cast("long")).alias("d"),
        F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.min("at").alias("at"),
    )
    crossed = ranges.withColumn("before", F.lag("last").over(Window.orderBy("at")))
    steps = F.coalesce(F.sum("d"), F.lit(0)) + F.coalesce(F.sum((F.col("first") < F.col("before")).cast("long")), F.lit(0))
    return crossed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), steps.alias("descents"))
