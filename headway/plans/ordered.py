"""Exact order statistics without sorting a whole group in one task.

Equal values are counted first. A coarse bucket, monotone in the value, then splits each group:
counts per bucket give the running total before the bucket, and only rows inside one bucket are
sorted together. The number of buckets is bounded whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.session import materialise


def magnitude_bucket(value: Column) -> Column:
    """Coarse bucket of a number, monotone in it, with at most some 130,000 different values.

    Never null, so that both readers of the counts have the same plan and share its shuffle.
    """
    steps = F.floor(F.log2(F.lit(1.0) + F.abs(value)) * 64)
    bucket = F.when(F.isnan(value), 1 << 20).when(value < 0, -steps - 1).otherwise(steps)
    return F.coalesce(bucket, F.lit(0).cast("long"))


def running_counts(freq: DataFrame, keys: Sequence[str], bucket: str, order: str,
                   count: str) -> DataFrame:
    """Add ``_before`` (rows of the group sorted ahead of this value) and ``_total``."""
    one_bucket = Window.partitionBy(*keys, bucket)
    up_to_here = one_bucket.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = freq.withColumns({
        "_local": F.sum(count).over(up_to_here) - F.col(count),
        "_in_bucket": F.sum(count).over(one_bucket)})

    # One row per bucket; only these are walked across the whole group.
    group = Window.partitionBy(*keys)
    buckets_so_far = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    offsets = local.where(F.col("_local") == 0).select(
        *keys, bucket,
        (F.sum("_in_bucket").over(buckets_so_far) - F.col("_in_bucket")).alias("_ahead"),
        F.sum("_in_bucket").over(group).alias("_total"))
    return (local.join(offsets, [*keys, bucket])
            .withColumn("_before", F.col("_ahead") + F.col("_local"))
            .drop("_ahead", "_local", "_in_bucket"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median (mean of the two middle values) of ``value`` per group; nulls do not count."""
    freq = (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_bucket", magnitude_bucket(F.col(value))))
    ranked = running_counts(freq, keys, "_bucket", value, "_n")
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))

    middle = ranked.where(holds(low) | holds(high))
    return middle.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2)
        .alias(name))


def ordinal_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """0, 1, 2, ... for the distinct values of a column in sorted order.

    The values are dealt to ranges whose borders Spark samples, so a common beginning does no harm. Each
    range is numbered by itself; what lies before it is a sum over one row per range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(parts, column) \
        .select(column, F.spark_partition_id().alias("_range"))
    # Written, so that both readers see the same ranges.
    ranges = materialise(ranges, "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_range", (F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranges.withColumn("_inside", inside).join(ahead, "_range").select(
        column, (F.col("_ahead") + F.col("_inside")).cast("int").alias(name))
