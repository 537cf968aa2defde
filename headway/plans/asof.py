"""As-of join: for every row, the newest value of the same key that was known by then.

A sort per key would put a busy key into one task. Both sides therefore meet inside (key, time bin);
what earlier bins ended with is carried over a table with one row per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from headway.functions import times

BIN_S = 300
SPREAD = 1024


def newest_before(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str,
                  bin_s: int = BIN_S) -> DataFrame:
    """``left`` with ``name``: the newest ``value`` of ``right`` with an equal key and no later time.

    Of values at one time the greatest counts; a null value is none. Every left row stays, copies
    too; one without a key or a time, or with nothing before it, gets null. Both sides need ``key`` and ``ts``.
    """
    known = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    known = known.select(key, ts, F.struct(F.col(ts).alias("at"), F.col(value).alias("value")).alias("_value"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SPREAD))
    # Rows without a key find nothing; they are dealt evenly.
    both = (left.withColumn("_row", F.lit(True))
            .unionByName(known.withColumn("_row", F.lit(False)), allowMissingColumns=True)
            .withColumn("_bin", F.when(F.col(key).isNull() | F.col(ts).isNull(), spread)
                        .otherwise(times.bucket_number(F.col(ts), bin_s))))
    so_far = (Window.partitionBy(key, "_bin").orderBy(ts, "_row", "_value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = (both.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
            .groupBy(key, "_bin").agg(F.max("_value").alias("_end"))
            .select(key, "_bin", F.last("_end", True).over(earlier).alias("_earlier")))
    inside = both.withColumn("_inside", F.last("_value", True).over(so_far)).where("_row")
    best = F.when(F.col(ts).isNotNull(), F.coalesce("_inside", "_earlier"))
    return (inside.join(ends, [key, "_bin"], "left")
            .select(*left.columns, best["value"].alias(name)))
