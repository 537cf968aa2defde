"""Profiles of the lake and map-style views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions import times
from headway.functions.numbers import percent_of, round_mean, round_to
from headway.operators import clean
from headway.plans import asof, nearest

SAMPLE_COLUMNS = ("vehicle_id", "route_id", "lat", "lon", "speed_mps", "current_status", "feed",
                  "event_ts")


def filtered(bronze: DataFrame, date_filter: str | None = None,
             feed_filter: str | None = None) -> DataFrame:
    """Optional filters on the lake's partition columns."""
    if date_filter:
        bronze = bronze.where(F.col("ingestion_date") == date_filter)
    if feed_filter:
        bronze = bronze.where(F.col("feed") == feed_filter)
    return bronze


def profile(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("feed", "ingestion_date").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        round_mean(F.avg("speed_mps"), 2).alias("avg_speed_mps"),
        F.min("event_ts").alias("earliest"), F.max("event_ts").alias("latest"))


def profile_order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("ingestion_date").desc(), "feed")


def totals(bronze: DataFrame) -> DataFrame:
    """One row over everything.

    Rows are first reduced to the distinct (feed, route, vehicle) combinations, so the three
    distinct counts never multiply the raw rows.
    """
    combos = bronze.groupBy("feed", "route_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("event_ts").alias("_first"),
        F.max("event_ts").alias("_last"))
    return combos.agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("total_rows"),
        F.count_distinct("vehicle_id").alias("total_vehicles"),
        F.count_distinct("feed").alias("feeds"),
        F.count_distinct("route_id").alias("unique_routes"),
        F.min("_first").alias("pipeline_start"), F.max("_last").alias("pipeline_latest"))


def newest_sample(bronze: DataFrame, limit: int = 10) -> DataFrame:
    newest = bronze.orderBy(F.col("event_ts").desc(), F.col("entity_id")).limit(limit)
    return newest.select(
        "vehicle_id", "route_id", round_to(F.col("latitude"), 4).alias("lat"),
        round_to(F.col("longitude"), 4).alias("lon"),
        round_to(F.col("speed_mps"), 1).alias("speed_mps"), "current_status", "feed", "event_ts")


def message_counts(messages: DataFrame) -> DataFrame:
    """Entities per feed, kind and poll."""
    return messages.groupBy("feed", "feed_type", "feed_timestamp").agg(
        F.count(F.lit(1)).alias("messages"))


def enriched_positions(positions: DataFrame, updates: DataFrame, bunched: DataFrame) -> DataFrame:
    """Positions with the delay their trip had at that time and a bunching flag.

    ``bunched`` lists (vehicle_id, event_ts) once each.
    """
    delayed = asof.newest_before(positions, updates, "trip_id", "event_ts", "arrival_delay",
                                 "delay_seconds")
    flags = bunched.withColumn("_bunched", F.lit(True))
    return (delayed.join(flags, ["vehicle_id", "event_ts"], "left")
            .withColumn("is_bunching", F.coalesce("_bunched", F.lit(False)))
            .drop("_bunched"))


def replay_frames(silver: DataFrame, step_s: int, day: date | None = None) -> DataFrame:
    """Frames of a replay: the newest position per vehicle and time step."""
    if day is not None:
        silver = silver.where(F.col("ingestion_date") == day.isoformat())
    frames = silver.withColumn("frame_start", times.bucket_start(F.col("event_ts"), step_s))
    order = [F.col("event_ts"), F.col("ingested_at"), F.col("entity_id")]
    return clean.newest_per(frames, ["vehicle_id", "frame_start"], order)


def route_summary(routes: DataFrame, gold: DataFrame) -> DataFrame:
    """Every route with the indicators of its newest day."""
    newest = clean.newest_per(gold, ["route_id"], [F.col("ingestion_date"), F.col("feed")])
    return routes.join(newest, "route_id", "left")


def route_deviation(positions: DataFrame, shapes: DataFrame, threshold_m: float = 200.0,
                    cell_m: float = 800.0) -> DataFrame:
    """Distance of each position to the nearest point of its route's shape, at any distance.

    Without a route, a shape or coordinates, distance and flag are null.
    """
    here = positions.select("entity_id", "event_ts", "route_id", "vehicle_id", "latitude", "longitude")
    points = shapes.select("route_id", F.col("shape_pt_lat").alias("_lat"),
                           F.col("shape_pt_lon").alias("_lon")).distinct()
    best = round_to(F.min("_distance"), 3).alias("distance_m")
    found = nearest.nearest(here, points, best, ("route_id",), cell_m=cell_m)
    return here.join(found, ["route_id", "latitude", "longitude"], "left").select(
        "entity_id", "route_id", "vehicle_id", "event_ts", "distance_m",
        (F.col("distance_m") > threshold_m).alias("is_deviation"))


def nearest_stop(positions: DataFrame, stops: DataFrame, cell_m: float = 800.0) -> DataFrame:
    """The nearest stop of every position, at any distance; the smaller id wins a tie.

    Each place is searched once, and stops of one place count once. Without coordinates or stops, both
    results are null.
    """
    here = positions.select("entity_id", "event_ts", "latitude", "longitude")
    points = stops.groupBy(F.col("stop_lat").alias("_lat"), F.col("stop_lon").alias("_lon")).agg(
        F.min("stop_id").alias("stop_id"))
    rank = F.min(F.struct(round_to(F.col("_distance"), 3).alias("d"), F.col("stop_id").alias("s"))).alias("_best")
    found = nearest.nearest(here, points, rank, cell_m=cell_m)
    return here.join(found, ["latitude", "longitude"], "left").select(
        "entity_id", "event_ts", F.col("_best.s").alias("stop_id"), F.col("_best.d").alias("distance_m"))


def congestion_grid(silver: DataFrame, cell_deg: float = 0.005) -> DataFrame:
    """Rows, mean speed and stationary share per map cell and hour."""
    def cell(name: str) -> Column:
        return F.floor(F.col(name) / F.lit(cell_deg))
    return silver.groupBy(cell("latitude").alias("cell_lat"), cell("longitude").alias("cell_lon"),
                          "hour_of_day").agg(
        F.count(F.lit(1)).alias("observations"),
        round_mean(F.avg("speed_mps"), 2).alias("avg_speed_mps"),
        percent_of(F.col("speed_category") == "STATIONARY").alias("stationary_pct"))
