"""Streaming queries: the events table read as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway import adapters, schemas
from headway.operators import alerts, clean
from headway.registry import realtime
from headway.registry.base import query, rnd, sql, subquery
from headway.registry.realtime import ROUNDED_PAIRS, rounded
from headway.session import materialise, work_dir
from headway.sinks import lake, messages as message_sinks
from headway.sources import lake as lake_source, messages
from headway.streaming import jobs, presence, runner

# Windows that the final watermark, 60 seconds behind the newest event, has closed.
CLOSED = "epoch_ms((SELECT max(ts) FROM events)) - 60000"


def events(spark, sf_dir):
    return adapters.table_stream(spark, sf_dir, "events")


def positions(spark, sf_dir):
    return adapters.positions(events(spark, sf_dir))


@query("stream_bronze", sql("bronze", "SELECT * FROM bronze"))
def stream_bronze(spark, sf_dir):
    base = work_dir(spark, "bronze")
    writer = lake.bronze_sink(positions(spark, sf_dir), f"{base}/data", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return lake_source.bronze(spark, f"{base}/data")


@query("stream_delay_alerts", sql("delays", "SELECT * FROM delays"))
def stream_delay_alerts(spark, sf_dir):
    updates = adapters.trip_updates(events(spark, sf_dir))
    return runner.to_table(jobs.delay_alerts(positions(spark, sf_dir), updates), "delays")


@query("stream_bunching_alerts", sql("pairs", ROUNDED_PAIRS + "pairs"))
def stream_bunching_alerts(spark, sf_dir):
    found = jobs.bunching_alerts(positions(spark, sf_dir), positions(spark, sf_dir))
    return rounded(runner.to_table(found, "bunching"))


@query("stream_alerts_by_measured_load", sql("delays pairs", f"""
    SELECT 'delay' AS kind, route_id, vehicle_id, event_ts, cast(delay_sec AS double) AS measure FROM delays
    UNION ALL SELECT 'bunching', route_id, vehicle_id_a, window_start, {rnd('distance_m', 3)} FROM pairs"""))
def stream_alerts_by_measured_load(spark, sf_dir):
    """Both alert joins with slices for the busiest trips and routes, measured on the table and taken small."""
    history = adapters.positions(adapters.table(spark, sf_dir, "events"))
    trips = materialise(alerts.delay_slices(history, rows_per_slice=1), "trip-slices")
    routes = materialise(alerts.bunching_slices(history, rows_per_slice=2), "route-slices")
    late = runner.to_table(jobs.delay_alerts(
        arriving(spark, sf_dir), adapters.trip_updates(events(spark, sf_dir)), trips), "delays")
    near = rounded(runner.to_table(jobs.bunching_alerts(
        positions(spark, sf_dir), positions(spark, sf_dir), routes), "bunching"))
    return late.select(F.lit("delay").alias("kind"), "route_id", "vehicle_id", "event_ts",
                       F.col("delay_sec").cast("double").alias("measure")).unionByName(near.select(
        F.lit("bunching").alias("kind"), "route_id", F.col("vehicle_id_a").alias("vehicle_id"),
        F.col("window_start").alias("event_ts"), F.col("distance_m").alias("measure")))


@query("stream_dedup", sql("kept", f"""
    SELECT * FROM kept WHERE
      epoch_ms(time_bucket(interval '30 seconds', event_ts)) + 30000 <= {CLOSED}"""))
def stream_dedup(spark, sf_dir):
    return runner.to_table(jobs.dedup(positions(spark, sf_dir)), "dedup")


#: Deliveries of the streams whose state expires.
BATCHES = 5
WIDE_LIFETIME_S = 6 * 3600


def arriving(spark, sf_dir):
    """Positions in several batches by time, as a feed delivers them."""
    return runner.arrivals(adapters.positions(adapters.table(spark, sf_dir, "events")), "event_ts", BATCHES, "arriving")


@query("stream_latest_state", sql("latest", "SELECT * FROM latest"))
def stream_latest_state(spark, sf_dir):
    told = runner.to_versions(jobs.latest_state(arriving(spark, sf_dir)), "latest")
    newest = clean.newest_per(told, ["vehicle_id"], [F.col(c) for c in presence.NEWEST])
    return newest.drop("version", "first_seen", "expires_at", "alive")


def vehicle_sessions(gap_s: int) -> str:
    return f"""SELECT *, sum(opens) OVER (PARTITION BY vehicle_id ORDER BY event_ts, ingested_at
          ROWS UNBOUNDED PRECEDING) AS session_no
        FROM (SELECT *, CASE WHEN event_ts <= lag(event_ts) OVER (
                PARTITION BY vehicle_id ORDER BY event_ts, ingested_at)
                + interval '{gap_s} seconds' THEN 0 ELSE 1 END AS opens FROM positions)"""


@query("stream_expired_state", sql("positions", f"""
    SELECT entity_id, vehicle_id, route_id, event_ts, expires_at
    FROM (SELECT *, max(event_ts) OVER (PARTITION BY vehicle_id, session_no)
            + interval '90 seconds' AS expires_at FROM ({vehicle_sessions(90)})
          QUALIFY row_number() OVER (PARTITION BY vehicle_id, session_no
            ORDER BY ingested_at DESC) = 1)
    WHERE epoch_ms(expires_at) <= {CLOSED}"""))
def stream_expired_state(spark, sf_dir):
    rows = runner.to_table(jobs.expired_state(positions(spark, sf_dir)), "expired")
    return rows.select("entity_id", "vehicle_id", "route_id", "event_ts", "expires_at")


@query("stream_live_vehicles", sql("positions", f"""
    SELECT vehicle_id, entity_id, event_ts, first_seen, expires_at
    FROM (SELECT *, min(event_ts) OVER (PARTITION BY vehicle_id, session_no) AS first_seen,
            max(event_ts) OVER (PARTITION BY vehicle_id, session_no)
            + interval '{WIDE_LIFETIME_S} seconds' AS expires_at FROM ({vehicle_sessions(WIDE_LIFETIME_S)})
          QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ingested_at DESC) = 1)
    WHERE epoch_ms(expires_at) > {CLOSED}"""))
def stream_live_vehicles(spark, sf_dir):
    """Vehicles left in the upserted table when all batches and the last timers have run."""
    told = jobs.latest_state(arriving(spark, sf_dir), WIDE_LIFETIME_S)
    base = work_dir(spark, "live")
    writer = presence.live_table(told, ["vehicle_id"], f"{base}/live", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return presence.read_live(told, f"{base}/live").select(
        "vehicle_id", "entity_id", "event_ts", "first_seen", "expires_at")


@query("stream_route_members", sql("positions", f"""
    SELECT route_id, vehicle_id, min(event_ts) AS first_seen,
      max(event_ts) + interval '3600 seconds' AS expires_at,
      epoch_ms(max(event_ts)) + 3600000 > {CLOSED} AS alive
    FROM (SELECT *, sum(opens) OVER (PARTITION BY route_id, vehicle_id ORDER BY event_ts, ingested_at
            ROWS UNBOUNDED PRECEDING) AS session_no
          FROM (SELECT *, CASE WHEN event_ts <= lag(event_ts) OVER (
                  PARTITION BY route_id, vehicle_id ORDER BY event_ts, ingested_at)
                  + interval '3600 seconds' THEN 0 ELSE 1 END AS opens
                FROM positions WHERE route_id IS NOT NULL))
    GROUP BY route_id, vehicle_id, session_no"""))
def stream_route_members(spark, sf_dir):
    """Every stay of a vehicle on a route as last told, with an hour's lifetime: routes never fall silent then."""
    told = runner.to_versions(jobs.route_members(arriving(spark, sf_dir), 3600), "members")
    last = clean.newest_per(told, ["route_id", "vehicle_id", "first_seen"],
                            [F.col("version"), F.col("expires_at"), ~F.col("alive")])
    return last.select("route_id", "vehicle_id", "first_seen", "expires_at", "alive")


@query("stream_route_sessions", sql("positions", f"""
    SELECT DISTINCT route_id, session_start, session_end, vehicle_id
    FROM (SELECT route_id, vehicle_id, min(event_ts) OVER s AS session_start,
            max(event_ts) OVER s + interval '90 seconds' AS session_end
          FROM (SELECT *, sum(opens) OVER (PARTITION BY route_id ORDER BY event_ts, ingested_at
                  ROWS UNBOUNDED PRECEDING) AS session_no
                FROM (SELECT *, CASE WHEN event_ts <= lag(event_ts) OVER (
                        PARTITION BY route_id ORDER BY event_ts, ingested_at)
                        + interval '90 seconds' THEN 0 ELSE 1 END AS opens
                      FROM positions WHERE route_id IS NOT NULL))
          WINDOW s AS (PARTITION BY route_id, session_no))
    WHERE epoch_ms(session_end) <= {CLOSED}"""))
def stream_route_sessions(spark, sf_dir):
    members = runner.to_versions(jobs.route_members(arriving(spark, sf_dir)), "members")
    windows = runner.to_table(jobs.route_windows(arriving(spark, sf_dir)), "windows")
    return jobs.listed_vehicles(members, windows)


# Message sources: JSON text in several deliveries, with unreadable, late and repeated messages among them.
# A message belongs to the delivery of its sixth of the month; every 37th comes two deliveries later, and
# every 41st comes again at once and with the next delivery. What a delivery holds is late by the watermark
# of the delivery before, which knows the newest message of all earlier ones.

DELIVERY = "least(4, (day(make_timestamp(timestamp * 1000000)) - 1) // 6)"

subquery("delivered", "vehicle_messages", f"""
    SELECT *, make_timestamp(timestamp * 1000000) AS event_ts, entity_id NOT LIKE '%7' AS readable,
      unnest(CASE WHEN ingested_at % 41 = 0 THEN [own, own, least(4, own + 1)] ELSE [own] END) AS delivery
    FROM (SELECT *, CASE WHEN ingested_at % 37 = 0 THEN least(4, {DELIVERY} + 2) ELSE {DELIVERY} END AS own
          FROM vehicle_messages)""")

subquery("in_time", "delivered", """
    SELECT d.*, d.event_ts <= w.mark AS late FROM delivered d LEFT JOIN (
      SELECT delivery, max(max(event_ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)
        - interval '60 seconds' AS mark
      FROM delivered WHERE readable GROUP BY delivery) w USING (delivery)""")


def delivered(spark, sf_dir):
    """The folder of message files."""
    flat = realtime.flat_vehicles(spark, sf_dir)
    own = F.least(F.lit(4), F.expr("int((day(timestamp_seconds(timestamp)) - 1) div 6)"))
    own = F.when(F.col("ingested_at") % 37 == 0, F.least(F.lit(4), own + 2)).otherwise(own)
    times_ = F.when(F.col("ingested_at") % 41 == 0, F.array(own, own, F.least(F.lit(4), own + 1))).otherwise(F.array(own))
    raw = flat.select(F.explode(times_).alias("delivery"), F.col("entity_id").alias("key"),
                      F.to_json(F.struct(*flat.columns)).alias("value"))
    cut = F.when(F.col("key").endswith("7"), F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    return runner.deliveries(raw.select("delivery", cut.alias("value")), "delivery", 5, "messages")


def source_rows(spark, sf_dir):
    raw = messages.file_stream(spark, delivered(spark, sf_dir), 1)
    return runner.observed(messages.once(messages.parse_positions(raw)), "source")


@query("stream_positions_source", sql("in_time", """
    SELECT DISTINCT entity_id, feed, vehicle_id, trip_id, route_id, latitude, longitude, speed_mps, event_ts
    FROM in_time WHERE readable AND late IS NOT TRUE"""))
def stream_positions_source(spark, sf_dir):
    return source_rows(spark, sf_dir)[0].select(
        "entity_id", "feed", "vehicle_id", "trip_id", "route_id", "latitude", "longitude", "speed_mps", "event_ts")


@query("stream_source_counts", sql("in_time", """
    SELECT count(*) AS delivered, count(*) FILTER (NOT readable) AS unreadable,
      count(*) FILTER (readable AND late IS TRUE) AS late,
      count(DISTINCT entity_id) FILTER (readable AND late IS NOT TRUE) AS kept,
      count(*) FILTER (readable AND late IS NOT TRUE)
        - count(DISTINCT entity_id) FILTER (readable AND late IS NOT TRUE) AS repeated FROM in_time"""))
def stream_source_counts(spark, sf_dir):
    """What became of the messages; the late ones are counted by the query's progress."""
    rows, run = source_rows(spark, sf_dir)
    raw = spark.read.text(delivered(spark, sf_dir))
    readable = messages.parse_positions(raw).count()
    late = runner.late_rows(run)
    return rows.agg(F.count(F.lit(1)).alias("kept")).select(
        F.lit(runner.input_rows(run)).cast("long").alias("delivered"),
        F.lit(runner.input_rows(run) - readable).cast("long").alias("unreadable"), F.lit(late).cast("long").alias("late"),
        "kept", (F.lit(readable - late).cast("long") - F.col("kept")).alias("repeated"))


@query("stream_trip_updates_source", sql("stop_messages", """
    SELECT entity_id, trip_id, route_id, vehicle_id, stop_sequence, stop_id, arrival_delay, departure_delay, event_ts
    FROM stop_messages"""))
def stream_trip_updates_source(spark, sf_dir):
    nested = realtime.nested_updates(spark, sf_dir)
    day = F.expr("int(least(4, (day(timestamp_seconds(feed_timestamp)) - 1) div 6))")
    raw = nested.select(day.alias("delivery"), F.to_json(F.struct(*nested.columns)).alias("value"))
    folder = runner.deliveries(raw, "delivery", 5, "updates")
    rows = messages.parse_trip_updates(messages.file_stream(spark, folder, 1))
    return runner.to_table(rows, "updates").select(
        "entity_id", "trip_id", "route_id", "vehicle_id", "stop_sequence", "stop_id", "arrival_delay",
        "departure_delay", "event_ts")


# Alert sinks: JSON lines, read back by their declared layouts. JSON text holds milliseconds.

def through_json(spark, stream, layout, key):
    base = work_dir(spark, "alerts")
    writer = message_sinks.json_sink(stream, f"{base}/data", f"{base}/checkpoint", key)
    writer.trigger(availableNow=True).start().awaitTermination()
    return messages.parse(spark.read.text(f"{base}/data"), layout, key)


@query("stream_delay_json", sql("delays", """
    SELECT * REPLACE (date_trunc('milliseconds', event_ts) AS event_ts) FROM delays WHERE trip_id IS NOT NULL"""))
def stream_delay_json(spark, sf_dir):
    updates = adapters.trip_updates(events(spark, sf_dir))
    return through_json(spark, jobs.delay_alerts(positions(spark, sf_dir), updates), schemas.DELAY_EVENT, "trip_id")


@query("stream_bunching_json", sql("pairs", f"""
    SELECT * REPLACE (date_trunc('milliseconds', window_start) AS window_start,
      date_trunc('milliseconds', window_end) AS window_end) FROM ({ROUNDED_PAIRS} pairs)"""))
def stream_bunching_json(spark, sf_dir):
    found = jobs.bunching_alerts(positions(spark, sf_dir), positions(spark, sf_dir))
    return rounded(through_json(spark, found, schemas.BUNCHING_ALERT, "route_id"))
