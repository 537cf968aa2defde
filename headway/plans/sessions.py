"""Gap sessions of a batch, safe for a key that holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from headway.functions.times import MICROS


def gap_sessions(df: DataFrame, key: str, member: str, ts: str, gap_s: int) -> DataFrame:
    """One row per (key, session, member): sessions end when nothing came for ``gap_s`` seconds.

    Two events inside one slot of the gap's width always share a session, so rows are first
    reduced to (first, last) per slot. Only slots, never raw rows, are walked in order.
    """
    gap = F.expr(f"INTERVAL '{gap_s}' SECOND")
    # Never null, so that both readers of the members have the same plan and share its shuffle.
    slot = F.coalesce(F.floor(F.unix_micros(F.col(ts)) / F.lit(gap_s * MICROS)),
                      F.lit(0).cast("long"))
    slotted = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_slot", slot)
    members = slotted.groupBy(key, "_slot", member).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
    slots = members.groupBy(key, "_slot").agg(
        F.min("_first").alias("_begin"), F.max("_last").alias("_end"),
        F.sum("_n").alias("_rows"))

    in_order = Window.partitionBy(key).orderBy("_slot")
    previous = F.lag("_end").over(in_order)
    opens = F.when(previous.isNull() | (F.col("_begin") > previous + gap), F.col("_begin"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = (slots.withColumn("_opens", opens)
             .withColumn("session_start", F.last("_opens", ignorenulls=True).over(so_far)))
    session = Window.partitionBy(key, "session_start")
    slots = slots.select(
        key, "_slot", "session_start",
        (F.max("_end").over(session) + gap).alias("session_end"),
        F.sum("_rows").over(session).alias("session_observations"))

    return (members.join(slots, [key, "_slot"])
            .groupBy(key, "session_start", "session_end", "session_observations", member)
            .agg(F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
                 F.sum("_n").alias("observations")))
