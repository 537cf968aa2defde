"""Checks and summaries of the static schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headway import schemas
from headway.functions import geo
from headway.functions.numbers import blank_to_null


def canonical_types(df: DataFrame, table: str) -> DataFrame:
    """Text columns cast to the table's types, value by value.

    A value that does not fit becomes null and counts in ``_cast_errors``; other columns stay.
    """
    errors: Column = F.lit(0)
    casts = {}
    for field in schemas.STATIC_TABLES.get(table, schemas.struct()):
        if field.name not in df.columns:
            continue
        text = blank_to_null(F.col(field.name))
        typed = text if field.dataType.simpleString() == "string" else F.trim(text).try_cast(field.dataType)
        errors = errors + F.when(text.isNotNull() & typed.isNull(), 1).otherwise(0)
        casts[field.name] = typed
    return df.withColumns({"_cast_errors": errors, **casts})


def outside_box(stops: DataFrame, box: geo.Box = geo.STOPS_BOX) -> DataFrame:
    return stops.where(~geo.in_box(F.col("stop_lat"), F.col("stop_lon"), box))


def box_summary(stops: DataFrame, box: geo.Box = geo.STOPS_BOX, shown: int = 10) -> DataFrame:
    """Per feed: how many stops lie outside, and the first few of their ids.

    ``shown`` only limits the ids listed; the count covers every violation.
    """
    bad = outside_box(stops, box).select("_feed_name", "stop_id")
    first = Window.partitionBy("_feed_name").orderBy("stop_id")
    listed = (bad.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= shown)
              .groupBy("_feed_name")
              .agg(F.array_join(F.sort_array(F.collect_list("stop_id")), ",").alias("stop_ids")))
    counts = bad.groupBy("_feed_name").agg(F.count(F.lit(1)).alias("violations"))
    return counts.join(listed, "_feed_name")


def box_findings(feeds: DataFrame, brought: DataFrame, stops: DataFrame, box: geo.Box = geo.STOPS_BOX) -> DataFrame:
    """(feed_name, finding) for each of ``feeds`` without a stops table, or with stops outside the box.

    ``brought`` has the (feed_name, table_name) that arrived; a feed in order has no row.
    """
    have = brought.where(F.col("table_name") == "stops").select("feed_name").distinct()
    outside = box_summary(stops, box).select(
        F.col("_feed_name").alias("feed_name"),
        F.concat(F.col("violations").cast("string"), F.lit(" stops outside the box: "), "stop_ids").alias("finding"))
    known = feeds.select("feed_name").distinct()
    none = known.join(have, "feed_name", "left_anti").select("feed_name", F.lit("stops table missing").alias("finding"))
    return none.unionByName(known.join(outside, "feed_name"))


def names(spark: SparkSession, tables: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tables], "table_name string")


def missing_tables(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested tables a feed does not bring (both sides: feed_name, table_name)."""
    return requested.join(available, requested.columns, "left_anti")


def known_tables(available: DataFrame, known: DataFrame) -> DataFrame:
    return available.join(known, known.columns, "left_semi")


def table_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feed_name", "table_name").agg(F.count(F.lit(1)).alias("row_count"))


def with_load_metadata(df: DataFrame, feed_name: Column, ingestion_date: Column) -> DataFrame:
    return df.withColumns({"_feed_name": feed_name, "_ingestion_date": ingestion_date})


def with_checksum(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("checksum", F.md5(F.col(content)))


def feed_log_rows(loads: DataFrame) -> DataFrame:
    """Log rows from (feed_name, ingestion_date, checksum, rows_loaded); stamped when appended."""
    return loads.select(
        "feed_name", F.col("ingestion_date").cast("date").alias("ingestion_date"), "checksum",
        F.col("rows_loaded").cast("int").alias("rows_loaded"),
        F.when(F.col("rows_loaded") > 0, "success").otherwise("empty").alias("status"))


def changed_feeds(downloads: DataFrame, feed_log: DataFrame) -> DataFrame:
    """Downloads whose checksum was never logged for that feed."""
    seen = feed_log.select("feed_name", "checksum").distinct()
    return downloads.join(seen, ["feed_name", "checksum"], "left_anti")
