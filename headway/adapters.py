"""Transit-shaped views over the test tables (events, customer, nation, documents).

Projections only, so each view works on a batch and on a streaming DataFrame alike.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE_POINTS = {"namma_metro": (28.65, 77.10), "bmtc": (12.95, 77.55)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def _with_k(events: DataFrame) -> DataFrame:
    """The only number in the JSON column."""
    return events.withColumn("_k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def _k() -> Column:
    return F.col("_k")


def _metro(owner: Column) -> Column:
    return (owner % 3) == 0


def _feed(owner: Column) -> Column:
    return F.when(_metro(owner), "namma_metro").otherwise("bmtc")


def _base(owner: Column, axis: int) -> Column:
    return (F.when(_metro(owner), BASE_POINTS["namma_metro"][axis])
            .otherwise(BASE_POINTS["bmtc"][axis]))


def _vehicle_id() -> Column:
    return F.concat(F.lit("V"), F.col("user_id"))


def _route_id() -> Column:
    return F.when(_k() % 17 != 0, F.concat(F.lit("R"), F.col("user_id") % 12))


def _trip_id() -> Column:
    return F.concat(F.lit("T"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))


def _latitude() -> Column:
    step = F.when(_k() >= 95, 0.02).otherwise(0.0001)
    return _base(F.col("user_id"), 0) + (_k() - 50) * step


def _longitude() -> Column:
    return _base(F.col("user_id"), 1) + ((F.col("event_id") % 100) - 50) * F.lit(0.0001)


def _speed() -> Column:
    return F.when(_k() % 23 != 0, F.col("value") / 10)


def _epoch(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def positions(events: DataFrame) -> DataFrame:
    """Vehicle positions with the lake's thirteen columns."""
    return _with_k(events).select(
        F.col("event_id").cast("string").alias("entity_id"),
        _vehicle_id().alias("vehicle_id"),
        _route_id().alias("route_id"),
        _trip_id().alias("trip_id"),
        _latitude().alias("latitude"),
        _longitude().alias("longitude"),
        (_k() * F.lit(3.6)).alias("bearing"),
        _speed().alias("speed_mps"),
        F.col("event_type").alias("current_status"),
        _feed(F.col("user_id")).alias("feed"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("ingestion_date"),
        F.col("event_id").alias("ingested_at"),
    )


def trip_updates(events: DataFrame) -> DataFrame:
    """Flat trip updates, one row per predicted stop."""
    return _with_k(events).select(
        _trip_id().alias("trip_id"),
        _route_id().alias("route_id"),
        _vehicle_id().alias("vehicle_id"),
        F.concat(F.lit("S"), _k()).alias("stop_id"),
        (F.floor("value") * 10 - 300).cast("int").alias("arrival_delay"),
        F.col("ts").cast("timestamp").alias("event_ts"),
    )


def feed_messages(events: DataFrame) -> DataFrame:
    """Nested feed messages: a vehicle entity, a trip-update entity and one of another kind."""
    delay = (F.floor("value") * 10 - 300).cast("int")
    vehicle = F.struct(
        F.when(_k() % 13 != 0, F.struct(
            _trip_id().alias("trip_id"),
            F.coalesce(_route_id(), F.lit("")).alias("route_id"))).alias("trip"),
        F.struct(
            F.when(_k() % 19 != 0, _vehicle_id()).otherwise("").alias("id"),
            F.concat(F.lit("label "), F.col("user_id")).alias("label")).alias("vehicle"),
        F.struct(
            _latitude().alias("latitude"), _longitude().alias("longitude"),
            (_k() * F.lit(3.6)).alias("bearing"),
            F.coalesce(_speed(), F.lit(0.0)).alias("speed")).alias("position"),
        _k().alias("current_stop_sequence"),
        F.col("event_type").alias("current_status"),
        F.when(_k() % 2 == 0, "MANY_SEATS_AVAILABLE").alias("occupancy_status"),
        _epoch().alias("timestamp"),
    )
    no_vehicle = F.lit(None).cast(
        "struct<trip:struct<trip_id:string,route_id:string>,vehicle:struct<id:string,label:string>,"
        "position:struct<latitude:double,longitude:double,bearing:double,speed:double>,"
        "current_stop_sequence:int,current_status:string,occupancy_status:string,timestamp:bigint>")

    def event(seconds: Column) -> Column:
        return F.struct(seconds.alias("delay"))

    update = F.struct(
        F.struct(_trip_id().alias("trip_id"),
                 F.coalesce(_route_id(), F.lit("")).alias("route_id")).alias("trip"),
        F.when(_k() % 5 != 0, F.struct(_vehicle_id().alias("id"))).alias("vehicle"),
        F.array(
            F.struct(F.lit(1).alias("stop_sequence"),
                     F.concat(F.lit("S"), _k()).alias("stop_id"),
                     F.when(_k() % 7 != 0, event(delay)).alias("arrival"),
                     F.when(_k() % 11 != 0, event(delay + 30)).alias("departure")),
            F.struct(F.lit(2).alias("stop_sequence"),
                     F.concat(F.lit("S"), _k() + 1).alias("stop_id"),
                     event(delay + 60).alias("arrival"),
                     F.lit(None).cast("struct<delay:int>").alias("departure")),
        ).alias("stop_time_update"),
    )
    no_update = F.lit(None).cast(
        "struct<trip:struct<trip_id:string,route_id:string>,vehicle:struct<id:string>,"
        "stop_time_update:array<struct<stop_sequence:int,stop_id:string,"
        "arrival:struct<delay:int>,departure:struct<delay:int>>>>")
    number = F.col("event_id").cast("string")

    def entity(suffix: str, vehicle_part: Column, update_part: Column) -> Column:
        return F.struct(F.concat(number, F.lit(suffix)).alias("id"),
                        vehicle_part.alias("vehicle"), update_part.alias("trip_update"))

    return _with_k(events).select(
        _feed(F.col("user_id")).alias("feed"),
        F.struct(_epoch().alias("timestamp")).alias("header"),
        F.array(entity("", vehicle, no_update),
                entity("-u", no_vehicle, update),
                entity("-a", no_vehicle, no_update)).alias("entity"),
        F.col("event_id").alias("ingested_at"),
    )


def _stop_columns() -> list[Column]:
    number = F.col("c_custkey")
    return [F.concat(F.lit("S"), number).alias("stop_id"), F.col("c_name").alias("stop_name"),
            (F.lit(12.9716) + (number % 400 - 200) * F.lit(0.002)).alias("stop_lat"),
            (F.lit(77.5946) + (number % 300 - 150) * F.lit(0.002)).alias("stop_lon")]


def stops(customer: DataFrame) -> DataFrame:
    return customer.select(*_stop_columns())


def stops_text(customer: DataFrame, *more: Column) -> DataFrame:
    """Stops as a schedule file carries them: text, some latitudes unreadable."""
    number = F.col("c_custkey")
    stop_id, name, lat, lon = _stop_columns()
    return customer.select(
        stop_id, name,
        F.when(number % 50 == 0, "bad").otherwise(lat.cast("string")).alias("stop_lat"),
        lon.cast("string").alias("stop_lon"),
        (number % 2).cast("string").alias("location_type"), *more)


def routes(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.concat(F.lit("R"), F.col("n_nationkey")).alias("route_id"),
        F.col("n_name").alias("route_long_name"),
        F.col("n_regionkey").cast("string").alias("agency_id"),
    )


def shapes(nation: DataFrame) -> DataFrame:
    """A straight line of twenty points per route around the base point of its feed."""
    number = F.col("n_nationkey")
    return (nation.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(19))))
            .select(
                F.concat(F.lit("R"), number).alias("route_id"),
                (_base(number, 0) + (F.col("step") - 10) * F.lit(0.0005)).alias("shape_pt_lat"),
                (_base(number, 1) + (F.col("step") - 10) * (number - 5) * F.lit(0.0001))
                .alias("shape_pt_lon"),
                F.col("step").cast("long").alias("shape_pt_sequence")))


def schedule_rows(customer: DataFrame) -> DataFrame:
    """Schedule stops as text, dealt to feeds of at most 5,000 stops."""
    feed = F.concat(F.lit("feed-"), F.col("c_nationkey"), F.lit("-"),
                    F.floor(F.col("c_custkey") / 5000))
    return stops_text(customer, feed.alias("feed_name"), F.col("c_nationkey"))


def schedule_archives(customer: DataFrame) -> DataFrame:
    """(feed_name, content): one small ZIP per feed, some without routes, with header blanks."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["stop_name", "stop_id", "stop_lat", "stop_lon", "location_type"]
        text = rows[columns].to_csv(index=False).replace("stop_lon,", "stop_lon ,", 1)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("stops.txt", "\ufeff" + text)
            archive.writestr("feed_info.txt", "feed_version\n1\n")
            if rows["c_nationkey"].iloc[0] % 2 == 0:
                archive.writestr("routes.txt", "route_id,route_short_name\nR1,One\nR2,Two\n")
        return pd.DataFrame({"feed_name": [rows["feed_name"].iloc[0]],
                             "content": [buffer.getvalue()]})

    return schedule_rows(customer).groupBy("feed_name").applyInPandas(
        pack, "feed_name string, content binary")
