"""Column layouts of the messages and tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B, TS = (T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(),
                     T.BooleanType(), T.TimestampType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


MESSAGE_BASE = dict(entity_id=S, feed=S, feed_type=S, feed_timestamp=L, ingested_at=L)

POSITION_MESSAGE = struct(
    **MESSAGE_BASE, vehicle_id=S, label=S, trip_id=S, route_id=S, latitude=D, longitude=D,
    bearing=D, speed_mps=D, current_stop_sequence=I, current_status=S, occupancy_status=S,
    timestamp=L)

STOP_UPDATE = struct(stop_sequence=I, stop_id=S, arrival_delay=I, departure_delay=I)

TRIP_UPDATE_MESSAGE = struct(
    **MESSAGE_BASE, trip_id=S, route_id=S, vehicle_id=S, stop_time_updates=T.ArrayType(STOP_UPDATE))

DELAY_EVENT = struct(trip_id=S, route_id=S, vehicle_id=S, delay_sec=I, alert_type=S, event_ts=TS)

BUNCHING_ALERT = struct(route_id=S, vehicle_id_a=S, vehicle_id_b=S, distance_m=D,
                        window_start=TS, window_end=TS)

BRONZE_POSITION = struct(
    entity_id=S, vehicle_id=S, route_id=S, trip_id=S, latitude=D, longitude=D, bearing=D,
    speed_mps=D, current_status=S, feed=S, event_ts=TS, ingestion_date=S, ingested_at=L)

API_POSITION = struct(
    vehicle_id=S, route_id=S, trip_id=S, latitude=D, longitude=D, bearing=D, speed_mps=D,
    current_status=S, feed=S, timestamp=L, eta_seconds=I, delay_seconds=I, is_bunching=B)

FEED_LOG = struct(feed_name=S, ingestion_date=T.DateType(), checksum=S, rows_loaded=I, status=S,
                  created_at=TS)

MODEL_RECORD = struct(model_name=S, version=S, stage=S, artifact_uri=S, updated_at=TS)

# The schedule tables and their column types.
STATIC_TABLES: dict[str, T.StructType] = {
    "agency": struct(agency_id=S, agency_name=S, agency_url=S, agency_timezone=S, agency_lang=S),
    "routes": struct(route_id=S, agency_id=S, route_short_name=S, route_long_name=S, route_type=L,
                     route_color=S, route_text_color=S),
    "trips": struct(route_id=S, service_id=S, trip_id=S, trip_headsign=S, direction_id=L,
                    shape_id=S),
    "stops": struct(stop_id=S, stop_name=S, stop_lat=D, stop_lon=D, location_type=L,
                    parent_station=S),
    "stop_times": struct(trip_id=S, arrival_time=S, departure_time=S, stop_id=S, stop_sequence=L,
                         pickup_type=L, drop_off_type=L),
    "calendar": struct(service_id=S, monday=L, tuesday=L, wednesday=L, thursday=L, friday=L,
                       saturday=L, sunday=L, start_date=S, end_date=S),
    "calendar_dates": struct(service_id=S, date=S, exception_type=L),
    "shapes": struct(shape_id=S, shape_pt_lat=D, shape_pt_lon=D, shape_pt_sequence=L),
}

# Loaded into the lake as text, without a column layout of its own.
UNTYPED_STATIC_TABLES = ("fare_attributes",)
