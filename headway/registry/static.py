"""Schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway import adapters, schemas
from headway.operators import quality, schedule
from headway.plans import static_load
from headway.registry.base import query, sql, subquery
from headway.session import materialise, work_dir
from headway.sinks import lake as lake_sinks
from headway.sources import static_feed

TABLES = tuple(schemas.STATIC_TABLES)
KNOWN = TABLES + schemas.UNTYPED_STATIC_TABLES


def customer(spark, sf_dir):
    return adapters.table(spark, sf_dir, "customer")


def stops(spark, sf_dir):
    return adapters.stops(customer(spark, sf_dir))


def archives(spark, sf_dir):
    return adapters.schedule_archives(customer(spark, sf_dir))


def values(names: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS t(table_name)"


subquery("schedule_feeds", "", """
    SELECT DISTINCT 'feed-' || c_nationkey || '-' || (c_custkey // 5000) AS feed_name,
      c_nationkey % 2 = 0 AS has_routes FROM customer""")

subquery("schedule_members", "schedule_feeds", """
    SELECT feed_name, 'stops' AS table_name FROM schedule_feeds
    UNION ALL SELECT feed_name, 'feed_info' FROM schedule_feeds
    UNION ALL SELECT feed_name, 'routes' FROM schedule_feeds WHERE has_routes""")


@query("gtfs_tables", sql("typed_stops", """
    SELECT feed_name, stop_id, stop_name, stop_lat, stop_lon, location_type, cast_errors
    FROM typed_stops"""))
def gtfs_tables(spark, sf_dir):
    rows = static_feed.typed(static_feed.records(archives(spark, sf_dir)), "stops")
    return rows.select(F.col("_feed_name").alias("feed_name"), "stop_id", "stop_name", "stop_lat",
                       "stop_lon", "location_type", F.col("_cast_errors").alias("cast_errors"))


@query("gtfs_typed", sql("typed_stops", """
    SELECT stop_id, stop_name, stop_lat, stop_lon, location_type, cast_errors FROM typed_stops"""))
def gtfs_typed(spark, sf_dir):
    typed = schedule.canonical_types(adapters.stops_text(customer(spark, sf_dir)), "stops")
    return typed.withColumnRenamed("_cast_errors", "cast_errors")


@query("gtfs_missing_tables", sql("schedule_feeds schedule_members", f"""
    SELECT f.feed_name, t.table_name FROM schedule_feeds f, {values(TABLES)}
    EXCEPT SELECT feed_name, table_name FROM schedule_members"""))
def gtfs_missing_tables(spark, sf_dir):
    return static_feed.missing(archives(spark, sf_dir), TABLES)


@query("gtfs_known_tables", sql("schedule_members", f"""
    SELECT feed_name, table_name FROM schedule_members
    WHERE table_name IN (SELECT table_name FROM {values(KNOWN)})"""))
def gtfs_known_tables(spark, sf_dir):
    available = static_feed.members(archives(spark, sf_dir))
    return schedule.known_tables(available, schedule.names(spark, list(KNOWN)))


@query("gtfs_table_counts", sql("typed_stops schedule_feeds", """
    SELECT feed_name, 'stops' AS table_name, count(*) AS row_count FROM typed_stops GROUP BY ALL
    UNION ALL SELECT feed_name, 'routes', 2 FROM schedule_feeds WHERE has_routes"""))
def gtfs_table_counts(spark, sf_dir):
    return schedule.table_counts(static_feed.records(archives(spark, sf_dir)))


OUTSIDE = "NOT (stop_lat BETWEEN 12.6e0 AND 13.3e0 AND stop_lon BETWEEN 77.2e0 AND 77.9e0)"


# The gated load: a first day whose archives hold only stops in bounds, and a second day that must be stopped.

IN_BOUNDS = "(stop_lat BETWEEN 12.6e0 AND 13.3e0 OR stop_lat IS NULL)"


def in_bounds(spark, sf_dir):
    rows = customer(spark, sf_dir)
    lat = adapters.stops(rows).select(F.substring("stop_id", 2, 20).cast("long").alias("c_custkey"), "stop_lat")
    good = lat.where(F.col("stop_lat").between(12.6, 13.3) | (F.col("c_custkey") % 50 == 0))  # Unreadable ones pass.
    return rows.join(good.select("c_custkey"), "c_custkey", "left_semi")


def two_days(spark, sf_dir, root, log):
    first = adapters.schedule_archives(in_bounds(spark, sf_dir))
    out = static_load.run(spark, materialise(first, "archives"), root, "2024-01-29", log)
    try:
        static_load.run(spark, materialise(archives(spark, sf_dir), "archives"), root, "2024-01-30", log)
    except quality.ExpectationFailed as error:
        return out, str(error)
    raise AssertionError("the second day holds stops out of bounds")


@query("static_load", sql("typed_stops", f"""
    SELECT 'stops' AS table_name, feed_name, '2024-01-29' AS ingestion_date, stop_id AS id, stop_lat, cast_errors
    FROM typed_stops WHERE {IN_BOUNDS}
    UNION ALL SELECT 'routes', feed_name, '2024-01-29', id, NULL, 0
    FROM (SELECT DISTINCT feed_name FROM typed_stops WHERE {IN_BOUNDS}
      AND cast(string_split(feed_name, '-')[2] AS integer) % 2 = 0), (VALUES ('R1'), ('R2')) AS t(id)"""))
def static_load_query(spark, sf_dir):
    root, log = work_dir(spark, "static"), work_dir(spark, "log")
    two_days(spark, sf_dir, root, log)
    stops_, routes_ = (static_load.read(spark, root, t) for t in ("stops", "routes"))
    return stops_.select(F.lit("stops").alias("table_name"), "_feed_name", "_ingestion_date", F.col("stop_id").alias("id"),
                         "stop_lat", "_cast_errors").unionByName(
        routes_.select(F.lit("routes").alias("table_name"), "_feed_name", "_ingestion_date",
                       F.col("route_id").alias("id"), F.lit(None).cast("double").alias("stop_lat"), "_cast_errors")) \
        .withColumnsRenamed({"_feed_name": "feed_name", "_ingestion_date": "ingestion_date", "_cast_errors": "cast_errors"})


@query("static_load_log", sql("typed_stops", f"""
    SELECT feed_name, date '2024-01-29' AS ingestion_date, 'success' AS status, cast(count(*)
      + CASE WHEN cast(string_split(feed_name, '-')[2] AS integer) % 2 = 0 THEN 2 ELSE 0 END AS integer) AS rows_loaded,
      (SELECT 'stops.stop_lat between: ' || count(*) || ' rows' FROM typed_stops WHERE NOT {IN_BOUNDS}) AS stopped_by
    FROM typed_stops WHERE {IN_BOUNDS} GROUP BY feed_name"""))
def static_load_log(spark, sf_dir):
    """What the log holds after both days, with the failed check that stopped the second."""
    root, log = work_dir(spark, "static"), work_dir(spark, "log")
    _, stopped_by = two_days(spark, sf_dir, root, log)
    return spark.read.parquet(log).select("feed_name", "ingestion_date", "status", "rows_loaded",
                                          F.lit(stopped_by).alias("stopped_by"))


@query("static_findings", sql("typed_stops", f"""
    SELECT feed_name, count(*) || ' stops outside the box: '
      || array_to_string(list_slice(list(stop_id ORDER BY stop_id), 1, 10), ',') AS finding
    FROM typed_stops WHERE NOT (stop_lat BETWEEN 12.6e0 AND 13.3e0 AND stop_lon BETWEEN 77.2e0 AND 77.9e0)
    GROUP BY feed_name
    UNION ALL SELECT 'feed-' || r_name, 'stops table missing' FROM region"""))
def static_findings(spark, sf_dir):
    """Feeds named after regions are expected as well, but bring nothing."""
    rows = materialise(archives(spark, sf_dir), "archives")
    opened = static_feed.unpacked(rows)
    expected = rows.select("feed_name").unionByName(adapters.table(spark, sf_dir, "region").select(
        F.concat(F.lit("feed-"), "r_name").alias("feed_name")))
    return schedule.box_findings(expected, static_feed.brought(opened), static_feed.typed(opened, "stops"))


@query("stops_out_of_bbox", sql("stops", f"SELECT * FROM stops WHERE {OUTSIDE}"))
def stops_out_of_bbox(spark, sf_dir):
    return schedule.outside_box(stops(spark, sf_dir))


@query("stops_bbox_summary", sql("typed_stops", f"""
    SELECT feed_name, count(*) AS violations,
      array_to_string(list_slice(list(stop_id ORDER BY stop_id), 1, 10), ',') AS stop_ids
    FROM typed_stops WHERE {OUTSIDE} GROUP BY feed_name"""))
def stops_bbox_summary(spark, sf_dir):
    typed = schedule.canonical_types(adapters.schedule_rows(customer(spark, sf_dir)), "stops")
    found = schedule.box_summary(typed.withColumnRenamed("feed_name", "_feed_name"))
    return found.withColumnRenamed("_feed_name", "feed_name")


@query("dq_stop_bounds", sql("stops route_list", """
    SELECT 'stops' AS table_name, 'stop_lat' AS column_name, 'between' AS check_name,
      count(*) FILTER (stop_lat < 12.6e0 OR stop_lat > 13.3e0) AS failures FROM stops
    UNION ALL SELECT 'stops', 'stop_id', 'not_null', count(*) FILTER (stop_id IS NULL) FROM stops
    UNION ALL SELECT 'routes', 'route_id', 'not_null', count(*) FILTER (route_id IS NULL)
    FROM route_list"""))
def dq_stop_bounds(spark, sf_dir):
    routes = adapters.routes(adapters.table(spark, sf_dir, "nation"))
    return (quality.report(stops(spark, sf_dir), "stops", quality.stop_checks())
            .unionByName(quality.report(routes, "routes", quality.route_checks())))


@query("bronze_static_metadata", sql("typed_stops", """
    SELECT stop_id, stop_lat, feed_name, '2024-01-30' AS ingestion_date FROM typed_stops"""))
def bronze_static_metadata(spark, sf_dir):
    """Loaded twice, as a retry does; the second load replaces the first."""
    typed = schedule.canonical_types(adapters.schedule_rows(customer(spark, sf_dir)), "stops")
    loaded = schedule.with_load_metadata(typed, F.col("feed_name"), F.lit("2024-01-30"))
    rows = loaded.select("stop_id", "stop_lat", "_feed_name", "_ingestion_date")
    folder = work_dir(spark, "bronze-static")
    for _ in range(2):
        lake_sinks.load_static(rows, folder)
    return spark.read.schema(rows.schema).parquet(folder).withColumnsRenamed(
        {"_feed_name": "feed_name", "_ingestion_date": "ingestion_date"})


# Feed log over the documents table: every document is a delivered file.

subquery("deliveries", "", """
    SELECT source || '/' || doc_id AS feed_name, md5(text) AS checksum,
      cast(len(string_split(text, chr(10))) AS integer) AS rows_loaded, doc_id, n_chars
    FROM documents""")


def deliveries(spark, sf_dir):
    files = adapters.table(spark, sf_dir, "documents")
    return schedule.with_checksum(files, "text").select(
        F.concat("source", F.lit("/"), F.col("doc_id")).alias("feed_name"), "checksum",
        F.size(F.split("text", "\n")).alias("rows_loaded"), "doc_id", "n_chars", "text")


@query("feed_checksum", sql("deliveries", "SELECT feed_name, checksum FROM deliveries"))
def feed_checksum(spark, sf_dir):
    return deliveries(spark, sf_dir).select("feed_name", "checksum")


@query("feed_log", sql("deliveries", """
    SELECT feed_name, date '2024-01-30' AS ingestion_date, checksum, rows_loaded,
      CASE WHEN rows_loaded > 0 THEN 'success' ELSE 'empty' END AS status FROM deliveries"""))
def feed_log(spark, sf_dir):
    loads = deliveries(spark, sf_dir).withColumn("ingestion_date", F.to_date(F.lit("2024-01-30")))
    folder = work_dir(spark, "feed-log")
    lake_sinks.append_feed_log(schedule.feed_log_rows(loads), folder)
    return spark.read.parquet(folder).drop("created_at")


@query("changed_feeds", sql("deliveries", """
    SELECT feed_name, checksum FROM deliveries WHERE n_chars % 7 = 0 OR doc_id % 11 = 0"""))
def changed_feeds(spark, sf_dir):
    """The log knows an older text of some files and nothing of others."""
    files = deliveries(spark, sf_dir)
    older = F.when(F.col("n_chars") % 7 == 0, F.md5(F.concat("text", F.lit(" ")))).otherwise(
        F.col("checksum"))
    log = files.where(F.col("doc_id") % 11 != 0).select("feed_name", older.alias("checksum"))
    return schedule.changed_feeds(files.select("feed_name", "checksum"), log)
