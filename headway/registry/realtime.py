"""Message parsing and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway import adapters
from headway.functions import labels
from headway.operators import alerts, explore
from headway.registry.base import haversine, query, rnd, sql, subquery
from headway.registry.lake import positions
from headway.sinks.messages import to_messages
from headway.sources import messages

DAY_S = 24 * 3600


def trip_updates(spark, sf_dir):
    return adapters.trip_updates(adapters.table(spark, sf_dir, "events"))


def feeds(spark, sf_dir):
    return adapters.feed_messages(adapters.table(spark, sf_dir, "events"))


# Nested feeds

VEHICLES = """SELECT cast(event_id AS varchar) AS entity_id,
      CASE WHEN user_id % 3 = 0 THEN 'namma_metro' ELSE 'bmtc' END AS feed,
      'vehicle_positions' AS feed_type, epoch_us(ts) // 1000000 AS feed_timestamp,
      event_id AS ingested_at,
      CASE WHEN k % 19 <> 0 THEN 'V' || user_id END AS vehicle_id, 'label ' || user_id AS label,
      CASE WHEN k % 13 <> 0 THEN 'T' || user_id || '-' || strftime(ts, '%Y%m%d') END AS trip_id,
      CASE WHEN k % 13 <> 0 AND k % 17 <> 0 THEN 'R' || (user_id % 12) END AS route_id,
      latitude, longitude, bearing, coalesce(speed_mps, 0) AS speed_mps,
      k AS current_stop_sequence, event_type AS current_status,
      CASE WHEN k % 2 = 0 THEN 'MANY_SEATS_AVAILABLE' END AS occupancy_status,
      epoch_us(ts) // 1000000 AS timestamp
    FROM ev JOIN positions ON positions.ingested_at = ev.event_id"""

subquery("vehicle_messages", "ev positions", VEHICLES)

DELAY = "cast(floor(value) * 10 - 300 AS integer)"

subquery("stop_messages", "ev", f"""
    SELECT event_id || '-u' AS entity_id,
      CASE WHEN user_id % 3 = 0 THEN 'namma_metro' ELSE 'bmtc' END AS feed,
      'T' || user_id || '-' || strftime(ts, '%Y%m%d') AS trip_id,
      CASE WHEN k % 17 <> 0 THEN 'R' || (user_id % 12) END AS route_id,
      CASE WHEN k % 5 <> 0 THEN 'V' || user_id END AS vehicle_id,
      cast(n AS integer) AS stop_sequence, 'S' || (k + n - 1) AS stop_id,
      CASE WHEN n = 2 THEN {DELAY} + 60 WHEN k % 7 <> 0 THEN {DELAY} END AS arrival_delay,
      CASE WHEN n = 1 AND k % 11 <> 0 THEN {DELAY} + 30 END AS departure_delay,
      epoch_us(ts) // 1000000 AS feed_timestamp, date_trunc('second', ts) AS event_ts
    FROM ev, range(1, 3) AS r(n)""")


def flat_vehicles(spark, sf_dir):
    return messages.flatten_vehicles(feeds(spark, sf_dir), F.col("ingested_at"))


def nested_updates(spark, sf_dir):
    return messages.flatten_trip_updates(feeds(spark, sf_dir), F.col("ingested_at"))


@query("flatten_vehicle_entities", sql("vehicle_messages", "SELECT * FROM vehicle_messages"))
def flatten_vehicle_entities(spark, sf_dir):
    return flat_vehicles(spark, sf_dir)


@query("flatten_trip_updates", sql("stop_messages", "SELECT * FROM stop_messages"))
def flatten_trip_updates(spark, sf_dir):
    return messages.explode_stops(nested_updates(spark, sf_dir))


def damaged(raw):
    """Raw messages, of which those with a key ending in 7 arrive cut off."""
    cut = F.expr("left(value, length(value) - 9)")
    return raw.select(F.when(F.col("key").endswith("7"), cut).otherwise(F.col("value"))
                      .alias("value"))


@query("src_positions_json", sql("vehicle_messages", """
    SELECT entity_id, feed, feed_timestamp, vehicle_id, trip_id, route_id, latitude, longitude,
      bearing, speed_mps, current_status, timestamp,
      make_timestamp(timestamp * 1000000) AS event_ts,
      strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS ingestion_date
    FROM vehicle_messages WHERE entity_id NOT LIKE '%7'"""))
def src_positions_json(spark, sf_dir):
    raw = damaged(to_messages(flat_vehicles(spark, sf_dir), "entity_id"))
    return messages.parse_positions(raw).select(
        "entity_id", "feed", "feed_timestamp", "vehicle_id", "trip_id", "route_id", "latitude",
        "longitude", "bearing", "speed_mps", "current_status", "timestamp", "event_ts",
        "ingestion_date")


@query("src_trip_updates_json", sql("stop_messages", """
    SELECT entity_id, trip_id, route_id, vehicle_id, stop_sequence, stop_id, arrival_delay,
      departure_delay, event_ts FROM stop_messages"""))
def src_trip_updates_json(spark, sf_dir):
    raw = to_messages(nested_updates(spark, sf_dir), "entity_id")
    return messages.parse_trip_updates(raw).select(
        "entity_id", "trip_id", "route_id", "vehicle_id", "stop_sequence", "stop_id",
        "arrival_delay", "departure_delay", "event_ts")


@query("feed_message_counts", sql("ev", """
    SELECT CASE WHEN user_id % 3 = 0 THEN 'namma_metro' ELSE 'bmtc' END AS feed, feed_type,
      epoch_us(ts) // 1000000 AS feed_timestamp, count(*) AS messages
    FROM ev, (VALUES ('vehicle_positions'), ('trip_updates')) AS t(feed_type)
    GROUP BY ALL"""))
def feed_message_counts(spark, sf_dir):
    columns = ["feed", "feed_type", "feed_timestamp"]
    return explore.message_counts(flat_vehicles(spark, sf_dir).select(*columns)
                                  .unionByName(nested_updates(spark, sf_dir).select(*columns)))


@query("to_json_messages")
def to_json_messages(spark, sf_dir):
    return to_messages(flat_vehicles(spark, sf_dir), "entity_id")


# Alerts

@query("delay_class", sql("updates", """
    SELECT trip_id, stop_id, event_ts, arrival_delay,
      CASE WHEN arrival_delay > 120 THEN 'DELAY' WHEN arrival_delay < -120 THEN 'EARLY'
        ELSE 'ON_TIME' END AS alert_type FROM updates"""))
def delay_class(spark, sf_dir):
    return trip_updates(spark, sf_dir).select(
        "trip_id", "stop_id", "event_ts", "arrival_delay",
        labels.delay_class(F.col("arrival_delay")).alias("alert_type"))


@query("alert_severity", sql("updates", """
    SELECT trip_id, stop_id, event_ts, CASE WHEN abs(arrival_delay) > 600 THEN 'CRITICAL'
      WHEN abs(arrival_delay) > 120 THEN 'WARNING' ELSE 'INFO' END AS severity FROM updates"""))
def alert_severity(spark, sf_dir):
    return trip_updates(spark, sf_dir).select(
        "trip_id", "stop_id", "event_ts", labels.severity(F.col("arrival_delay")).alias("severity"))


subquery("delays", "positions updates", """
    SELECT u.trip_id, u.route_id, p.vehicle_id, u.arrival_delay AS delay_sec,
      CASE WHEN u.arrival_delay > 0 THEN 'DELAY' ELSE 'EARLY' END AS alert_type, p.event_ts
    FROM updates u JOIN positions p ON p.trip_id = u.trip_id
      AND abs(epoch_us(p.event_ts) - epoch_us(u.event_ts)) <= 120000000
    WHERE abs(u.arrival_delay) > 120""")

PAIR_DISTANCE = haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")


def pairs(seconds: int) -> str:
    return f"""SELECT a.route_id, a.vehicle_id AS vehicle_id_a, b.vehicle_id AS vehicle_id_b,
          {PAIR_DISTANCE} AS distance_m, a.event_ts AS window_start, b.event_ts AS window_end
        FROM positions a JOIN positions b ON a.route_id = b.route_id
          AND a.vehicle_id < b.vehicle_id
          AND a.event_ts >= b.event_ts - interval '{seconds} seconds'
          AND a.event_ts <= b.event_ts + interval '{seconds} seconds'
        WHERE {PAIR_DISTANCE} < 500"""


subquery("pairs", "positions", pairs(90))
ROUNDED_PAIRS = f"""SELECT route_id, vehicle_id_a, vehicle_id_b, {rnd('distance_m', 3)}
    AS distance_m, window_start, window_end FROM """

subquery("alerts", "delays pairs", """
    SELECT *, greatest(event_ts, coalesce(other_ts, event_ts)) AS created_at,
      CASE WHEN abs(coalesce(delay_sec, 0)) > 600 THEN 'CRITICAL'
        WHEN abs(coalesce(delay_sec, 0)) > 120 THEN 'WARNING' ELSE 'INFO' END AS severity,
      sha256(concat_ws('|', alert_type, coalesce(route_id, ''), vehicle_id,
        coalesce(vehicle_id_b, ''), coalesce(trip_id, ''),
        coalesce(cast(delay_sec AS varchar), ''), cast(epoch_us(event_ts) AS varchar),
        coalesce(cast(epoch_us(other_ts) AS varchar), ''))) AS alert_id
    FROM (SELECT alert_type, route_id, vehicle_id, NULL::varchar AS vehicle_id_b, trip_id,
            delay_sec, NULL::double AS distance_m, event_ts, NULL::timestamp AS other_ts
          FROM delays
          UNION ALL SELECT 'BUNCHING', route_id, vehicle_id_a, vehicle_id_b, NULL, NULL,
            distance_m, window_start, window_end FROM pairs)""")


def rounded(found):
    """Distances to the millimetre, half up as ``F.round`` does, without its decimal number for every row."""
    scaled = F.col("distance_m") * 1000
    whole = F.floor(scaled)
    return found.withColumn("distance_m", F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / 1000)


def delays(spark, sf_dir):
    return alerts.delay_alerts(positions(spark, sf_dir), trip_updates(spark, sf_dir))


def alert_feed(spark, sf_dir):
    return alerts.alert_feed(delays(spark, sf_dir),
                             alerts.bunching_alerts(positions(spark, sf_dir)))


@query("delay_alerts", sql("delays", "SELECT * FROM delays"))
def delay_alerts(spark, sf_dir):
    return delays(spark, sf_dir)


@query("bunching_alerts", sql("pairs", ROUNDED_PAIRS + "pairs"))
def bunching_alerts(spark, sf_dir):
    return rounded(alerts.bunching_alerts(positions(spark, sf_dir)))


@query("bunching_alerts_900s", sql("positions", ROUNDED_PAIRS + f"({pairs(900)})"))
def bunching_alerts_900s(spark, sf_dir):
    return rounded(alerts.bunching_alerts(positions(spark, sf_dir), window_s=900))


ALERT_COLUMNS = "alert_type, route_id, vehicle_id, vehicle_id_b, trip_id, delay_sec"


@query("alerts_union", sql("alerts", f"""
    SELECT {ALERT_COLUMNS}, {rnd('distance_m', 3)} AS distance_m, severity, created_at
    FROM alerts"""))
def alerts_union(spark, sf_dir):
    return rounded(alert_feed(spark, sf_dir)).drop("alert_id")


@query("alert_ids", sql("alerts", "SELECT alert_id, alert_type FROM alerts"))
def alert_ids(spark, sf_dir):
    return alert_feed(spark, sf_dir).select("alert_id", "alert_type")


@query("recent_alerts", sql("alerts", f"""
    SELECT alert_id, {ALERT_COLUMNS}, severity, created_at FROM alerts
    WHERE route_id IS NOT NULL
      AND created_at > (SELECT max(ts) FROM events) - interval '{DAY_S} seconds'"""))
def recent_alerts(spark, sf_dir):
    now = positions(spark, sf_dir).agg(F.max("event_ts")).scalar()
    seen, told = (alerts.alertable(rows, now, DAY_S) for rows in (positions(spark, sf_dir), trip_updates(spark, sf_dir)))
    feed = alerts.alert_feed(alerts.delay_alerts(seen, told), alerts.bunching_alerts(seen))
    found = alerts.recent_alerts(alerts.valid_alerts(feed), now, DAY_S)
    return found.drop("distance_m", "message")
