"""Realtime messages: Kafka or JSON files, nested feeds, flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from headway import schemas
from headway.functions import times
from headway.functions.numbers import blank_to_null

WATERMARK = "60 seconds"

# Transport

def kafka_options(servers: str, topics: str | list[str], starting: str = "latest",
                  **more: str) -> dict[str, str]:
    """Options of the Kafka source; several topics make one subscription.

    Every streaming query keeps its own offsets in its checkpoint, so each is its own consumer. A
    query fails when offsets have aged out, unless the caller sets ``failOnDataLoss``.
    """
    names = topics if isinstance(topics, str) else ",".join(topics)
    return {"kafka.bootstrap.servers": servers, "subscribe": names, "startingOffsets": starting,
            "failOnDataLoss": "true", **more}


def kafka_stream(spark: SparkSession, servers: str, topics: str | list[str],
                 starting: str = "latest", **more: str) -> DataFrame:
    """Raw messages (key, value as text). Needs Spark's Kafka package on the classpath."""
    reader = spark.readStream.format("kafka").options(
        **kafka_options(servers, topics, starting, **more))
    return reader.load().select(F.col("key").cast("string").alias("key"),
                                F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Raw messages from a folder of text files, one JSON document per line."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def file_batch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder)


# Parsing

def parse(raw: DataFrame, schema: T.StructType, key: str = "entity_id") -> DataFrame:
    """JSON text to typed columns.

    Unreadable messages come out without a key and are dropped; unknown members are ignored.
    """
    # As a generator the parsed message is built once; a plain column would be parsed again for
    # the filter, which Catalyst moves below the projection.
    message = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return raw.select(F.inline_outer(F.array(message))).where(F.col(key).isNotNull())


def with_event_time(df: DataFrame, epoch: str, unit: str = "s") -> DataFrame:
    return df.withColumn("event_ts", times.event_time(F.col(epoch), unit))


def parse_positions(raw: DataFrame, unit: str = "s") -> DataFrame:
    """Position messages with event time and partition date."""
    rows = with_event_time(parse(raw, schemas.POSITION_MESSAGE), "timestamp", unit)
    return rows.withColumn("ingestion_date", times.partition_date(F.col("event_ts")))


def parse_trip_updates(raw: DataFrame, unit: str = "s") -> DataFrame:
    """Trip-update messages exploded to one row per predicted stop."""
    return explode_stops(parse(raw, schemas.TRIP_UPDATE_MESSAGE), unit)


def explode_stops(messages: DataFrame, unit: str = "s") -> DataFrame:
    rows = messages.select("*", F.explode("stop_time_updates").alias("_s"))
    rows = rows.select(
        "entity_id", "feed", "trip_id", "route_id", "vehicle_id", "_s.stop_sequence", "_s.stop_id",
        "_s.arrival_delay", "_s.departure_delay", "feed_timestamp")
    return with_event_time(rows, "feed_timestamp", unit)


def watermarked(df: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return df.withWatermark("event_ts", delay)


def once(df: DataFrame, key: str = "entity_id", delay: str = WATERMARK) -> DataFrame:
    """Each message of a stream once: repeats go, and so do messages that come behind the watermark.

    How many came late is in the query's progress (``runner.late_rows``). State holds the ids of the
    last ``delay`` of event time.
    """
    return watermarked(df, delay).dropDuplicatesWithinWatermark([key])


def with_vehicle(df: DataFrame) -> DataFrame:
    return df.where(blank_to_null(F.col("vehicle_id")).isNotNull())


# Nested feeds

def flatten_vehicles(feeds: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Vehicle entities of feed messages as flat position messages."""
    rows = _entities(feeds, "vehicle_positions", ingested_at).where(F.col("e.vehicle").isNotNull())
    v = F.col("e.vehicle")
    return rows.select(
        *_base_columns(),
        blank_to_null(v["vehicle"]["id"]).alias("vehicle_id"), v["vehicle"]["label"].alias("label"),
        blank_to_null(v["trip"]["trip_id"]).alias("trip_id"),
        blank_to_null(v["trip"]["route_id"]).alias("route_id"),
        v["position"]["latitude"].alias("latitude"), v["position"]["longitude"].alias("longitude"),
        v["position"]["bearing"].alias("bearing"), v["position"]["speed"].alias("speed_mps"),
        v["current_stop_sequence"].alias("current_stop_sequence"),
        v["current_status"].alias("current_status"),
        v["occupancy_status"].alias("occupancy_status"), v["timestamp"].alias("timestamp"))


def flatten_trip_updates(feeds: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Trip-update entities of feed messages; the stops stay an array."""
    rows = _entities(feeds, "trip_updates", ingested_at).where(F.col("e.trip_update").isNotNull())
    t = F.col("e.trip_update")
    stops = F.transform(t["stop_time_update"], lambda s: F.struct(
        s["stop_sequence"].alias("stop_sequence"), s["stop_id"].alias("stop_id"),
        s["arrival"]["delay"].alias("arrival_delay"),
        s["departure"]["delay"].alias("departure_delay")))
    return rows.select(
        *_base_columns(), blank_to_null(t["trip"]["trip_id"]).alias("trip_id"),
        blank_to_null(t["trip"]["route_id"]).alias("route_id"),
        blank_to_null(t["vehicle"]["id"]).alias("vehicle_id"), stops.alias("stop_time_updates"))


def _entities(feeds: DataFrame, feed_type: str, ingested_at: Column | None) -> DataFrame:
    stamp = F.unix_seconds(F.current_timestamp()) if ingested_at is None else ingested_at
    return feeds.select("feed", F.lit(feed_type).alias("feed_type"),
                        F.col("header.timestamp").alias("feed_timestamp"),
                        stamp.cast("long").alias("ingested_at"),
                        # The callers drop null entities; the outer form infers no extra filter.
                        F.explode_outer("entity").alias("e"))


def _base_columns() -> list[Column]:
    return [F.col("e.id").alias("entity_id"), *[F.col(c) for c in
            ("feed", "feed_type", "feed_timestamp", "ingested_at")]]
