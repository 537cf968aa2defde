"""Latest state, client calculations, record checks and map views."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway import adapters
from headway.functions.numbers import round_to
from headway.operators import alerts, clean, explore, kpis, state
from headway.registry.base import haversine, query, rnd, rnd_mean, sql, subquery
from headway.registry.lake import positions, silver
from headway.registry.realtime import trip_updates
from headway.session import materialise

HOUR_S = 3600

subquery("latest", "positions", """
    SELECT * FROM positions QUALIFY row_number() OVER (
      PARTITION BY vehicle_id ORDER BY ingested_at DESC) = 1""")


def latest(spark, sf_dir):
    return state.latest_vehicle_state(positions(spark, sf_dir))


def now(spark, sf_dir):
    return positions(spark, sf_dir).agg(F.max("event_ts")).scalar()


@query("latest_vehicle_state", sql("latest", "SELECT * FROM latest"))
def latest_vehicle_state(spark, sf_dir):
    return latest(spark, sf_dir)


@query("vehicle_lookup", sql("latest", "SELECT * FROM latest WHERE vehicle_id = 'V7'"))
def vehicle_lookup(spark, sf_dir):
    return state.vehicle_lookup(latest(spark, sf_dir), "V7")


def active_sql(seconds: int) -> str:
    return sql("latest", f"""SELECT vehicle_id, route_id, event_ts FROM latest
        WHERE (SELECT epoch_us(max(ts)) FROM events) - epoch_us(event_ts) <= {seconds * 1_000_000}""")


@query("active_vehicles", active_sql(300))
def active_vehicles(spark, sf_dir):
    alive = state.active_vehicles(latest(spark, sf_dir), now(spark, sf_dir))
    return alive.select("vehicle_id", "route_id", "event_ts")


@query("active_vehicles_6h", active_sql(6 * HOUR_S))
def active_vehicles_6h(spark, sf_dir):
    alive = state.active_vehicles(latest(spark, sf_dir), now(spark, sf_dir), 6 * HOUR_S)
    return alive.select("vehicle_id", "route_id", "event_ts")


@query("live_route_members", sql("latest", """
    SELECT route_id, vehicle_id, event_ts FROM latest
    WHERE (SELECT epoch_us(max(ts)) FROM events) - epoch_us(event_ts) <= 21600000000"""))
def live_route_members(spark, sf_dir):
    return state.live_route_members(latest(spark, sf_dir), now(spark, sf_dir), 6 * HOUR_S)


def sessions_sql(gap_s: int) -> str:
    return sql("positions", f"""
        SELECT route_id, session_start, session_end, session_observations, vehicle_id, min(event_ts) AS first_seen,
          max(event_ts) AS last_seen, count(*) AS observations
        FROM (SELECT route_id, vehicle_id, event_ts, min(event_ts) OVER s AS session_start,
                max(event_ts) OVER s + interval '{gap_s} seconds' AS session_end,
                count(*) OVER s AS session_observations
              FROM (SELECT *, sum(opens) OVER (PARTITION BY route_id ORDER BY event_ts, ingested_at
                      ROWS UNBOUNDED PRECEDING) AS session_no
                    FROM (SELECT *, CASE WHEN event_ts <= lag(event_ts) OVER (
                            PARTITION BY route_id ORDER BY event_ts, ingested_at)
                            + interval '{gap_s} seconds' THEN 0 ELSE 1 END AS opens
                          FROM positions WHERE route_id IS NOT NULL))
              WINDOW s AS (PARTITION BY route_id, session_no))
        GROUP BY ALL""")


@query("route_vehicle_sessions", sessions_sql(90))
def route_vehicle_sessions(spark, sf_dir):
    return state.route_vehicle_sessions(positions(spark, sf_dir))


@query("route_vehicle_sessions_1h", sessions_sql(HOUR_S))
def route_vehicle_sessions_1h(spark, sf_dir):
    return state.route_vehicle_sessions(positions(spark, sf_dir), HOUR_S)


@query("snapshot_messages")
def snapshot_messages(spark, sf_dir):
    columns = ("vehicle_id", "route_id", "latitude", "longitude", "speed_mps", "event_ts")
    live = materialise(latest(spark, sf_dir).select(*columns), "state")
    return state.snapshot_messages(live, per_message=100)


# Client calculations

subquery("client", "positions", """
    SELECT entity_id, route_id, latitude, longitude,
      CASE WHEN ingested_at % 4 <> 0 THEN cast(ingested_at % 97 - 10 AS integer) * 15 END
        AS eta_seconds,
      CASE WHEN ingested_at % 5 <> 0 THEN cast(ingested_at % 61 - 30 AS integer) * 10 END
        AS delay_seconds, ingested_at % 11 = 0 AS is_bunching FROM positions""")


def client_rows(spark, sf_dir):
    n = F.col("ingested_at")
    eta = F.when(n % 4 != 0, (n % 97 - 10).cast("int") * 15)
    delay = F.when(n % 5 != 0, (n % 61 - 30).cast("int") * 10)
    return positions(spark, sf_dir).withColumns({
        "eta_seconds": eta, "delay_seconds": delay, "is_bunching": n % 11 == 0})


@query("planar_xy", sql("positions", f"""
    SELECT entity_id, {rnd('(longitude - 77.5946e0) * 110540e0', 3)} AS x,
      {rnd('(latitude - 12.9716e0) * 111320e0', 3)} AS z FROM positions"""))
def planar_xy(spark, sf_dir):
    rows = state.planar_positions(positions(spark, sf_dir))
    return rows.select("entity_id", round_to(F.col("x"), 3).alias("x"),
                       round_to(F.col("z"), 3).alias("z"))


@query("display_state", sql("client", """
    SELECT entity_id, CASE WHEN is_bunching THEN 'BUNCHING' WHEN delay_seconds > 120 THEN 'DELAYED'
      WHEN delay_seconds < -60 THEN 'EARLY' ELSE 'ON_TIME' END AS display_state FROM client"""))
def display_state(spark, sf_dir):
    return state.display_columns(client_rows(spark, sf_dir)).select("entity_id", "display_state")


@query("eta_label", sql("client", """
    SELECT entity_id, CASE WHEN eta_seconds IS NULL THEN coalesce(route_id, '')
      WHEN eta_seconds < 60 THEN 'NOW' ELSE (eta_seconds // 60) || 'm' END AS eta_label,
      CASE WHEN eta_seconds IS NULL THEN NULL WHEN delay_seconds > 120 THEN 'red'
        WHEN delay_seconds < -60 THEN 'cyan' ELSE 'green' END AS eta_tone FROM client"""))
def eta_label(spark, sf_dir):
    rows = state.display_columns(client_rows(spark, sf_dir))
    return rows.select("entity_id", "eta_label", "eta_tone")


# Record checks

subquery("records", "positions", """
    SELECT CASE WHEN ingested_at % 41 <> 0 THEN vehicle_id END AS vehicle_id, route_id,
      CASE WHEN ingested_at % 50 <> 0 THEN latitude END AS latitude, longitude,
      CASE WHEN ingested_at % 77 <> 0 THEN bearing END AS bearing,
      ingested_at % 77 = 0 AS bad_bearing, coalesce(speed_mps, 0) AS speed_mps, current_status,
      feed, epoch_us(event_ts) // 1000000 AS timestamp FROM positions""")


def records(spark, sf_dir):
    """Position records as text, some of them unreadable."""
    n = F.col("ingested_at")

    def text(name):
        return F.col(name).cast("string")

    return positions(spark, sf_dir).select(
        F.when(n % 41 != 0, F.col("vehicle_id")).alias("vehicle_id"), "route_id",
        F.when(n % 50 != 0, text("latitude")).otherwise("bad").alias("latitude"),
        text("longitude").alias("longitude"),
        F.when(n % 77 != 0, text("bearing")).otherwise("n/a").alias("bearing"),
        text("speed_mps").alias("speed_mps"), "current_status", "feed",
        F.unix_seconds("event_ts").cast("string").alias("timestamp"))


RECORD_COLUMNS = """vehicle_id, route_id, latitude, longitude, bearing, speed_mps, current_status,
    feed, timestamp"""


@query("valid_positions", sql("records", f"""
    SELECT {RECORD_COLUMNS}, false AS is_bunching FROM records
    WHERE vehicle_id IS NOT NULL AND latitude IS NOT NULL AND NOT bad_bearing"""))
def valid_positions(spark, sf_dir):
    return state.valid_positions(records(spark, sf_dir)).drop("trip_id", "eta_seconds",
                                                              "delay_seconds")


@query("rejected_positions", sql("records", """
    SELECT vehicle_id, latitude, longitude, timestamp, CASE WHEN vehicle_id IS NULL
        THEN 'vehicle_id' WHEN latitude IS NULL THEN 'latitude' ELSE 'bearing' END AS reject_reason
    FROM records WHERE vehicle_id IS NULL OR latitude IS NULL OR bad_bearing"""))
def rejected_positions(spark, sf_dir):
    return state.rejected_positions(records(spark, sf_dir)).select(
        "vehicle_id", "latitude", "longitude", "timestamp", "reject_reason")


# Enrichment, replay, routes, maps

@query("enriched_positions", sql("positions updates pairs", """
    SELECT p.entity_id, p.vehicle_id, p.trip_id, p.event_ts, d.delay_seconds,
      EXISTS (SELECT 1 FROM pairs b WHERE p.vehicle_id = b.vehicle_id_a AND p.event_ts = b.window_start
        OR p.vehicle_id = b.vehicle_id_b AND p.event_ts = b.window_end) AS is_bunching
    FROM positions p ASOF LEFT JOIN (
      SELECT trip_id, event_ts, max(arrival_delay) AS delay_seconds FROM updates
      WHERE arrival_delay IS NOT NULL GROUP BY ALL) d
    ON p.trip_id = d.trip_id AND p.event_ts >= d.event_ts"""))
def enriched_positions(spark, sf_dir):
    rows = positions(spark, sf_dir)
    found = explore.enriched_positions(rows, trip_updates(spark, sf_dir),
                                       alerts.bunched_vehicles(rows))
    return found.select("entity_id", "vehicle_id", "trip_id", "event_ts", "delay_seconds",
                        "is_bunching")


@query("replay_frames", sql("silver", """
    SELECT entity_id, vehicle_id, route_id, latitude, longitude, event_ts,
      time_bucket(interval '1 hour', event_ts) AS frame_start FROM silver
    QUALIFY row_number() OVER (PARTITION BY vehicle_id, time_bucket(interval '1 hour', event_ts)
      ORDER BY event_ts DESC, ingested_at DESC) = 1"""))
def replay_frames(spark, sf_dir):
    return explore.replay_frames(silver(spark, sf_dir), HOUR_S).select(
        "entity_id", "vehicle_id", "route_id", "latitude", "longitude", "event_ts", "frame_start")


@query("route_summary", sql("route_list daily", """
    SELECT r.*, g.feed, g.ingestion_date, g.avg_speed_kmh, g.max_speed_kmh FROM route_list r
    LEFT JOIN (SELECT * FROM daily QUALIFY row_number() OVER (
      PARTITION BY route_id ORDER BY ingestion_date DESC, feed DESC) = 1) g USING (route_id)"""))
def route_summary(spark, sf_dir):
    routes = adapters.routes(adapters.table(spark, sf_dir, "nation"))
    daily = kpis.speed_stats(clean.silver(positions(spark, sf_dir).select(*clean.KPI_COLUMNS)))
    return explore.route_summary(routes, daily).select(
        "route_id", "route_long_name", "agency_id", "feed", "ingestion_date", "avg_speed_kmh",
        "max_speed_kmh")


@query("route_deviation", sql("positions shape_points", f"""
    SELECT entity_id, route_id, vehicle_id, event_ts,
      {rnd('d', 3)} AS distance_m, {rnd('d', 3)} > 200 AS is_deviation
    FROM (SELECT p.entity_id, p.route_id, p.vehicle_id, p.event_ts,
            min({haversine('p.latitude', 'p.longitude', 's.lat', 's.lon')}) AS d
          FROM positions p LEFT JOIN shape_points s ON p.route_id = s.route_id GROUP BY ALL)"""))
def route_deviation(spark, sf_dir):
    shapes = adapters.shapes(adapters.table(spark, sf_dir, "nation"))
    return explore.route_deviation(positions(spark, sf_dir), shapes)


@query("nearest_stop", sql("positions stops", f"""
    SELECT p.entity_id, p.event_ts, n.best.s AS stop_id, n.best.d AS distance_m
    FROM positions p LEFT JOIN (
      SELECT p.entity_id, min({{'d': {rnd(haversine('p.latitude', 'p.longitude', 's.stop_lat', 's.stop_lon'), 3)},
        's': s.stop_id}}) AS best FROM positions p JOIN stops s ON p.latitude IS NOT NULL
      AND p.longitude IS NOT NULL AND s.stop_lat IS NOT NULL GROUP BY 1) n USING (entity_id)"""))
def nearest_stop(spark, sf_dir):
    stops = adapters.stops(adapters.table(spark, sf_dir, "customer"))
    return explore.nearest_stop(positions(spark, sf_dir), stops)


@query("congestion_grid", sql("silver", f"""
    SELECT cast(floor(latitude / 5e-3) AS bigint) AS cell_lat,
      cast(floor(longitude / 5e-3) AS bigint) AS cell_lon, hour_of_day, count(*) AS observations,
      {rnd_mean('avg(speed_mps)', 2)} AS avg_speed_mps,
      {rnd("100e0 * count(*) FILTER (speed_category = 'STATIONARY') / count(*)", 1)}
        AS stationary_pct FROM silver GROUP BY ALL"""))
def congestion_grid(spark, sf_dir):
    return explore.congestion_grid(silver(spark, sf_dir))
