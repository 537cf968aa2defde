"""The daily schedule load: all tables of all feeds, staged, checked and published together or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headway import schemas
from headway.operators import quality, schedule
from headway.sinks import lake, published
from headway.sources import static_feed

TABLES = (*schemas.STATIC_TABLES, *schemas.UNTYPED_STATIC_TABLES)
DATE = "_ingestion_date"
FEED = "_feed_name"  # Feeds are many: they share the files of a date.


def _schema(table: str) -> T.StructType:
    fields = schemas.STATIC_TABLES.get(table, schemas.struct()).fields
    return T.StructType([T.StructField(FEED, T.StringType()), *fields,
                         T.StructField("_other", T.MapType(T.StringType(), T.StringType())),
                         T.StructField("_cast_errors", T.IntegerType()), T.StructField(DATE, T.StringType())])


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A schedule table of all dates, as it is published."""
    _, content = published.in_force(spark, root)
    return published.dated(spark, root, table, _schema(table), content.get("dates", {}), DATE)


def run(spark: SparkSession, archive_rows: DataFrame, root: str, ingestion_date: str, log_folder: str | None = None,
        run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Load the archives of one date: the check report and the findings on stops.

    Every archive is opened once. A failed expectation raises before anything is published, so readers
    keep the tables they had; a repeated load of a date replaces it. Findings do not stop a load.
    """
    run_id = run_id or uuid.uuid4().hex
    number, before = published.in_force(spark, root)
    opened = static_feed.unpacked(archive_rows, TABLES)
    tables = {}
    for table in TABLES:
        rows = static_feed.typed(opened, table).withColumn(DATE, F.lit(ingestion_date))
        published.write_run(rows.select(*_schema(table).names), root, table, run_id, (DATE,), (FEED,))
        tables[table] = published.read_run(spark, root, table, run_id, _schema(table))
    report = quality.report(tables["stops"], "stops", quality.stop_checks()).unionByName(
        quality.report(tables["routes"], "routes", quality.route_checks()))
    quality.require(report)
    published.publish(spark, root, number, {"dates": before.get("dates", {}) | {ingestion_date: run_id}})
    brought = static_feed.brought(opened)
    if log_folder is not None:
        loaded = schedule.table_counts(opened.where("record IS NOT NULL")).groupBy("feed_name").agg(
            F.sum("row_count").alias("rows_loaded"))
        sums = schedule.with_checksum(archive_rows).select("feed_name", "checksum")
        lake.append_feed_log(schedule.feed_log_rows(
            sums.join(loaded, "feed_name", "left").withColumns({
                "ingestion_date": F.lit(ingestion_date), "rows_loaded": F.coalesce("rows_loaded", F.lit(0))})), log_folder)
    return report, schedule.box_findings(archive_rows.select("feed_name"), brought, tables["stops"])
