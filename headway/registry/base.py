"""Registration of queries, and assembly of the SQL from shared subqueries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headway.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SUBQUERIES: dict[str, tuple[tuple[str, ...], str]] = {}


def plain_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side has them (the session runs in UTC)."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        @functools.wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_timestamps(run(prepare(spark), sf_dir))

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return prepared

    return register


def subquery(name: str, needs: str, body: str) -> None:
    SUBQUERIES[name] = (tuple(needs.split()), body)


def sql(needs: str, select: str) -> str:
    """The statement with the named subqueries, and what these need, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in SUBQUERIES[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return select
    parts = ",\n".join(f"{n} AS ({SUBQUERIES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{select}"


def rnd(expr: str, digits: int) -> str:
    return f"(round(({expr}) * 1e{digits}) / 1e{digits})"


def rnd_mean(expr: str, digits: int) -> str:
    """The same for a floating sum, whose last bits depend on the row order."""
    return rnd(rnd(expr, 9), digits)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(12742000 * atan2(sqrt({h}), sqrt(1 - {h})))"


# Views over the test tables, the same as headway.adapters.

subquery("ev", "", "SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS integer) AS k FROM events")

subquery("positions", "ev", """
    SELECT cast(event_id AS varchar) AS entity_id, 'V' || user_id AS vehicle_id,
      CASE WHEN k % 17 <> 0 THEN 'R' || (user_id % 12) END AS route_id,
      'T' || user_id || '-' || strftime(ts, '%Y%m%d') AS trip_id,
      CASE WHEN user_id % 3 = 0 THEN 28.65e0 ELSE 12.95e0 END
        + (k - 50) * CASE WHEN k >= 95 THEN 2e-2 ELSE 1e-4 END AS latitude,
      CASE WHEN user_id % 3 = 0 THEN 77.10e0 ELSE 77.55e0 END
        + (event_id % 100 - 50) * 1e-4 AS longitude,
      k * 3.6e0 AS bearing, CASE WHEN k % 23 <> 0 THEN value / 10 END AS speed_mps,
      event_type AS current_status,
      CASE WHEN user_id % 3 = 0 THEN 'namma_metro' ELSE 'bmtc' END AS feed,
      ts AS event_ts, strftime(ts, '%Y-%m-%d') AS ingestion_date, event_id AS ingested_at
    FROM ev""")

subquery("updates", "ev", """
    SELECT 'T' || user_id || '-' || strftime(ts, '%Y%m%d') AS trip_id,
      CASE WHEN k % 17 <> 0 THEN 'R' || (user_id % 12) END AS route_id,
      'V' || user_id AS vehicle_id, 'S' || k AS stop_id,
      cast(floor(value) * 10 - 300 AS integer) AS arrival_delay, ts AS event_ts
    FROM ev""")

subquery("stops", "", """
    SELECT 'S' || c_custkey AS stop_id, c_name AS stop_name,
      12.9716e0 + (c_custkey % 400 - 200) * 2e-3 AS stop_lat,
      77.5946e0 + (c_custkey % 300 - 150) * 2e-3 AS stop_lon FROM customer""")

subquery("typed_stops", "", """
    SELECT 'S' || c_custkey AS stop_id, c_name AS stop_name,
      CASE WHEN c_custkey % 50 <> 0
        THEN 12.9716e0 + (c_custkey % 400 - 200) * 2e-3 END AS stop_lat,
      77.5946e0 + (c_custkey % 300 - 150) * 2e-3 AS stop_lon,
      cast(c_custkey % 2 AS bigint) AS location_type,
      'feed-' || c_nationkey || '-' || (c_custkey // 5000) AS feed_name,
      CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS cast_errors FROM customer""")

subquery("route_list", "", """
    SELECT 'R' || n_nationkey AS route_id, n_name AS route_long_name,
      cast(n_regionkey AS varchar) AS agency_id FROM nation""")

subquery("shape_points", "", """
    SELECT 'R' || n_nationkey AS route_id,
      CASE WHEN n_nationkey % 3 = 0 THEN 28.65e0 ELSE 12.95e0 END + (i - 10) * 5e-4 AS lat,
      CASE WHEN n_nationkey % 3 = 0 THEN 77.10e0 ELSE 77.55e0 END
        + (i - 10) * (n_nationkey - 5) * 1e-4 AS lon
    FROM nation, range(20) AS r(i)""")

# Lake layers

subquery("bronze", "positions", """
    SELECT * FROM positions WHERE vehicle_id IS NOT NULL AND abs(latitude) <= 90
      AND abs(longitude) <= 180""")

SPEED_LABEL = """CASE WHEN speed_mps < 0.5 THEN 'STATIONARY' WHEN speed_mps < 5 THEN 'SLOW'
    WHEN speed_mps < 15 THEN 'NORMAL' ELSE 'FAST' END"""
HOUR_LABEL = """CASE WHEN hour(event_ts) IN (7, 8, 9, 10) THEN 'AM_PEAK'
    WHEN hour(event_ts) IN (17, 18, 19, 20) THEN 'PM_PEAK' WHEN hour(event_ts) >= 22 THEN 'NIGHT'
    WHEN hour(event_ts) <= 5 THEN 'EARLY_MORNING' ELSE 'OFFPEAK' END"""
IN_BOX = """(feed = 'bmtc' AND latitude >= 12.6e0 AND latitude <= 13.3e0 AND longitude >= 77.2e0
      AND longitude <= 77.9e0 OR feed = 'namma_metro' AND latitude >= 28.4e0
      AND latitude <= 28.9e0 AND longitude >= 76.8e0 AND longitude <= 77.4e0)"""


def deduped(seconds: int, source: str = "bronze") -> str:
    return f"""SELECT * FROM {source} QUALIFY row_number() OVER (
        PARTITION BY vehicle_id, time_bucket(interval '{seconds} seconds', event_ts)
        ORDER BY ingested_at DESC, entity_id DESC) = 1"""


subquery("kept", "bronze", deduped(30))

subquery("silver", "kept", f"""
    SELECT * REPLACE (coalesce(route_id, 'UNKNOWN') AS route_id,
        coalesce(trip_id, 'UNKNOWN') AS trip_id, coalesce(speed_mps, 0) AS speed_mps),
      {SPEED_LABEL.replace('speed_mps', 'coalesce(kept.speed_mps, 0)')} AS speed_category,
      cast(hour(event_ts) AS integer) AS hour_of_day,
      cast(dayofweek(event_ts) AS integer) AS day_of_week, {HOUR_LABEL} AS time_bucket,
      {HOUR_LABEL} IN ('AM_PEAK', 'PM_PEAK') AS is_peak_hour, {IN_BOX} AS is_valid_bbox
    FROM kept""")

subquery("used", "silver", "SELECT * FROM silver WHERE is_valid_bbox AND route_id <> 'UNKNOWN'")

GOLD_MEASURES = {
    "unique_vehicles": "count(DISTINCT vehicle_id)",
    "total_observations": "count(*)",
    "avg_speed_mps": rnd_mean("avg(speed_mps)", 2),
    "avg_speed_kmh": rnd_mean("avg(speed_mps) * 3.6e0", 2),
    "max_speed_kmh": rnd_mean("max(speed_mps) * 3.6e0", 2),
    "median_speed_kmh": rnd_mean("median(speed_mps) * 3.6e0", 2),
    "stationary_pct": rnd("100e0 * count(*) FILTER (speed_category = 'STATIONARY') / count(*)", 1),
    "slow_pct": rnd("100e0 * count(*) FILTER (speed_category = 'SLOW') / count(*)", 1),
    "avg_speed_am_peak_kmh": rnd_mean("avg(speed_mps) FILTER (time_bucket = 'AM_PEAK') * 3.6e0", 2),
    "avg_speed_pm_peak_kmh": rnd_mean("avg(speed_mps) FILTER (time_bucket = 'PM_PEAK') * 3.6e0", 2),
    "first_seen": "min(event_ts)",
    "last_seen": "max(event_ts)",
    "active_hours": rnd("date_diff('minute', min(event_ts), max(event_ts)) / 60e0", 1),
    "reliability_score": "coalesce(greatest(0e0, " + rnd_mean(
        "100e0 - stddev_samp(speed_mps) / nullif(avg(speed_mps), 0) * 50e0", 1) + "), 0e0)",
}


def measures(*names: str) -> str:
    listed = ", ".join(f"{GOLD_MEASURES[n]} AS {n}" for n in names)
    return sql("used", f"""SELECT route_id, feed, ingestion_date, {listed} FROM used
        GROUP BY route_id, feed, ingestion_date""")


subquery("daily", "used", "SELECT route_id, feed, ingestion_date, " + ", ".join(
    f"{e} AS {n}" for n, e in GOLD_MEASURES.items()) + " FROM used GROUP BY ALL")

ROLLING = rnd_mean("""avg(avg_speed_kmh) OVER (PARTITION BY route_id, feed ORDER BY ingestion_date
    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", 2)
RANK = "rank() OVER (PARTITION BY feed, ingestion_date ORDER BY avg_speed_kmh DESC)"

subquery("gold", "daily", f"""
    SELECT *, {ROLLING} AS avg_speed_kmh_7d, cast({RANK} AS integer) AS speed_rank_today
    FROM daily""")
