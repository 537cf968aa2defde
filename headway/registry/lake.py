"""Lake queries: Bronze, Silver, Gold and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from headway import adapters
from headway.functions import geo, labels, times
from headway.operators import clean, explore, kpis, quality
from headway.registry.base import (HOUR_LABEL, IN_BOX, RANK, ROLLING, SPEED_LABEL,
                                   deduped, haversine, measures, query, rnd, rnd_mean,
                                   sql)
from headway.plans import incremental
from headway.session import materialise, work_dir
from headway.sinks import lake as lake_sinks
from headway.sources import lake

WIDE_BUCKET_S = 6 * 3600


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.positions(adapters.table(spark, sf_dir, "events"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.silver(positions(spark, sf_dir))


def slim_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver with only what the indicators read."""
    return clean.silver(positions(spark, sf_dir).select(*clean.KPI_COLUMNS))


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as a written table, as its readers expect it."""
    return materialise(kpis.gold_from_bronze(positions(spark, sf_dir)), "gold")


# Bronze

@query("bronze_scan", sql("positions", """
    SELECT * REPLACE (CASE WHEN feed = 'namma_metro' THEN bearing END AS bearing)
    FROM positions"""))
def bronze_scan(spark, sf_dir):
    """Two generations of the table, the older one written before there was a bearing."""
    rows = positions(spark, sf_dir)
    older, newer = work_dir(spark, "bronze-a"), work_dir(spark, "bronze-b")
    rows.where(F.col("feed") == "bmtc").drop("bearing").write.parquet(older)
    rows.where(F.col("feed") == "namma_metro").write.parquet(newer)
    return lake.bronze(spark, older, newer)


@query("bronze_filter", sql("bronze", "SELECT * FROM bronze"))
def bronze_filter(spark, sf_dir):
    return clean.plausible(positions(spark, sf_dir))


PROFILE = f"""SELECT feed, ingestion_date, count(*) AS row_count,
    count(DISTINCT vehicle_id) AS unique_vehicles, {rnd_mean('avg(speed_mps)', 2)} AS avg_speed_mps,
    min(event_ts) AS earliest, max(event_ts) AS latest FROM positions"""


@query("bronze_profile", sql("positions", PROFILE + " GROUP BY feed, ingestion_date"))
def bronze_profile(spark, sf_dir):
    return explore.profile_order(explore.profile(positions(spark, sf_dir)))


@query("bronze_profile_filtered", sql("positions", PROFILE + """
    WHERE feed = 'bmtc' AND ingestion_date = '2024-01-15' GROUP BY feed, ingestion_date"""))
def bronze_profile_filtered(spark, sf_dir):
    chosen = explore.filtered(positions(spark, sf_dir), date_filter="2024-01-15",
                              feed_filter="bmtc")
    return explore.profile(chosen)


@query("bronze_totals", sql("positions", """
    SELECT count(*) AS total_rows, count(DISTINCT vehicle_id) AS total_vehicles,
      count(DISTINCT feed) AS feeds, count(DISTINCT route_id) AS unique_routes,
      min(event_ts) AS pipeline_start, max(event_ts) AS pipeline_latest FROM positions"""))
def bronze_totals(spark, sf_dir):
    return explore.totals(positions(spark, sf_dir))


@query("bronze_sample", sql("positions", f"""
    SELECT vehicle_id, route_id, {rnd('latitude', 4)} AS lat, {rnd('longitude', 4)} AS lon,
      {rnd('speed_mps', 1)} AS speed_mps, current_status, feed, event_ts
    FROM positions ORDER BY event_ts DESC, entity_id LIMIT 10"""))
def bronze_sample(spark, sf_dir):
    return explore.newest_sample(positions(spark, sf_dir), 10)


# Silver

@query("null_defaults", sql("positions", """
    SELECT entity_id, coalesce(route_id, 'UNKNOWN') AS route_id,
      coalesce(trip_id, 'UNKNOWN') AS trip_id, coalesce(speed_mps, 0) AS speed_mps
    FROM positions"""))
def null_defaults(spark, sf_dir):
    rows = clean.with_null_defaults(positions(spark, sf_dir))
    return rows.select("entity_id", "route_id", "trip_id", "speed_mps")


@query("speed_category", sql("positions", f"""
    SELECT entity_id, {SPEED_LABEL.replace('speed_mps', 'coalesce(speed_mps, 0)')}
      AS speed_category FROM positions"""))
def speed_category(spark, sf_dir):
    return positions(spark, sf_dir).select(
        "entity_id", labels.speed_category(F.col("speed_mps")).alias("speed_category"))


@query("time_features", sql("positions", f"""
    SELECT entity_id, cast(hour(event_ts) AS integer) AS hour_of_day,
      cast(dayofweek(event_ts) AS integer) AS day_of_week, {HOUR_LABEL} AS time_bucket,
      {HOUR_LABEL} IN ('AM_PEAK', 'PM_PEAK') AS is_peak_hour FROM positions"""))
def time_features(spark, sf_dir):
    return clean.with_time_features(positions(spark, sf_dir)).select(
        "entity_id", "hour_of_day", "day_of_week", "time_bucket", "is_peak_hour")


@query("geo_valid_flag", sql("positions", f"""
    SELECT entity_id, feed, {IN_BOX} AS is_valid_bbox FROM positions"""))
def geo_valid_flag(spark, sf_dir):
    return clean.with_geo_flag(positions(spark, sf_dir)).select("entity_id", "feed",
                                                                "is_valid_bbox")


@query("event_time", sql("positions", """
    SELECT entity_id, date_trunc('second', event_ts) AS event_time,
      strftime(event_ts, '%Y-%m-%d') AS partition_date FROM positions"""))
def event_time(spark, sf_dir):
    epoch = F.unix_seconds("event_ts")
    stamped = positions(spark, sf_dir).select("entity_id",
                                              times.event_time(epoch).alias("event_time"))
    return stamped.withColumn("partition_date", times.partition_date(F.col("event_time")))


@query("dedup_positions", sql("kept", "SELECT * FROM kept"))
def dedup_positions(spark, sf_dir):
    return clean.dedup(clean.plausible(positions(spark, sf_dir)))


@query("dedup_positions_6h", sql("bronze", deduped(WIDE_BUCKET_S)))
def dedup_positions_6h(spark, sf_dir):
    return clean.dedup(clean.plausible(positions(spark, sf_dir)), WIDE_BUCKET_S)


@query("silver_positions", sql("silver", "SELECT * FROM silver"))
def silver_positions(spark, sf_dir):
    return silver(spark, sf_dir)


@query("haversine_distance", sql("positions", f"""
    SELECT entity_id, {rnd(haversine('12.9716e0', '77.5946e0', 'latitude', 'longitude'), 3)}
      AS distance_m FROM positions"""))
def haversine_distance(spark, sf_dir):
    center = [F.lit(c) for c in geo.CITY_ORIGIN]
    distance = geo.haversine_m(*center, F.col("latitude"), F.col("longitude"))
    return positions(spark, sf_dir).select(
        "entity_id", (F.round(distance * 1000) / 1000).alias("distance_m"))


# Gold

@query("route_vehicle_counts", measures("unique_vehicles", "total_observations"))
def route_vehicle_counts(spark, sf_dir):
    return kpis.vehicle_counts(slim_silver(spark, sf_dir))


@query("route_speed_stats", measures("avg_speed_mps", "avg_speed_kmh", "max_speed_kmh"))
def route_speed_stats(spark, sf_dir):
    return kpis.speed_stats(slim_silver(spark, sf_dir))


@query("route_speed_median", measures("median_speed_kmh"))
def route_speed_median(spark, sf_dir):
    return kpis.speed_median(slim_silver(spark, sf_dir))


@query("route_congestion_pct", measures("stationary_pct", "slow_pct"))
def route_congestion_pct(spark, sf_dir):
    return kpis.congestion_pct(slim_silver(spark, sf_dir))


@query("route_peak_speeds", measures("avg_speed_am_peak_kmh", "avg_speed_pm_peak_kmh"))
def route_peak_speeds(spark, sf_dir):
    return kpis.peak_speeds(slim_silver(spark, sf_dir))


@query("route_activity_window", measures("first_seen", "last_seen", "active_hours"))
def route_activity_window(spark, sf_dir):
    return kpis.activity_window(slim_silver(spark, sf_dir))


@query("route_reliability", measures("reliability_score"))
def route_reliability(spark, sf_dir):
    return kpis.reliability(slim_silver(spark, sf_dir))


@query("route_daily_kpis", sql("gold", "SELECT * FROM gold"))
def route_daily_kpis(spark, sf_dir):
    return kpis.gold_from_bronze(positions(spark, sf_dir))


@query("rolling_speed", sql("daily", f"""
    SELECT route_id, feed, ingestion_date, avg_speed_kmh, {ROLLING} AS avg_speed_kmh_7d
    FROM daily"""))
def rolling_speed(spark, sf_dir):
    daily = kpis.speed_stats(slim_silver(spark, sf_dir))
    return kpis.with_rolling_speed(daily.select(*kpis.GRAIN, "avg_speed_kmh"))


@query("speed_rank", sql("daily", f"""
    SELECT route_id, feed, ingestion_date, avg_speed_kmh,
      cast({RANK} AS integer) AS speed_rank_today FROM daily"""))
def speed_rank(spark, sf_dir):
    daily = kpis.speed_stats(slim_silver(spark, sf_dir))
    return kpis.with_speed_rank(daily.select(*kpis.GRAIN, "avg_speed_kmh"))


# Data checks

def failures(table: str, column: str, check: str, condition: str, source: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{check}' AS check_name,
        count(*) FILTER ({condition}) AS failures FROM {source}"""


def nulls(table: str, source: str, *columns: str) -> list[str]:
    return [failures(table, c, "not_null", f"{c} IS NULL", source) for c in columns]


def foreign(table: str, source: str, column: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return failures(table, column, "accepted_values", f"{column} NOT IN ({listed})", source)


NOT_NULL_SQL = (nulls("bronze", "positions", "latitude", "longitude", "event_ts", "route_id")
                + nulls("silver", "silver", "vehicle_id", "latitude", "longitude", "feed")
                + nulls("gold", "daily", "route_id", "feed", "reliability_score"))
ACCEPTED_SQL = [foreign("silver", "silver", "feed", tuple(geo.FEED_BOXES)),
                foreign("silver", "silver", "speed_category", labels.SPEED_CATEGORIES),
                foreign("silver", "silver", "time_bucket", labels.TIME_BUCKETS),
                foreign("bronze", "positions", "route_id", ("R1", "R2", "R3"))]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _not_null(spark, sf_dir) -> list[DataFrame]:
    bronze = positions(spark, sf_dir)
    # route_id may be null in Bronze; the check shows a table that fails.
    return [quality.report(bronze, "bronze", quality.bronze_not_null() + quality.not_null("route_id")),
            quality.report(clean.silver(bronze), "silver", quality.silver_not_null()),
            quality.report(kpis.reliability(clean.silver(bronze)), "gold",
                           quality.gold_not_null())]


def _accepted(spark, sf_dir) -> list[DataFrame]:
    bronze = positions(spark, sf_dir)
    return [quality.report(clean.silver(bronze), "silver", quality.silver_accepted_values()),
            quality.report(bronze, "bronze",
                           quality.accepted_values("route_id", ("R1", "R2", "R3")))]


@query("dq_not_null", sql("positions silver daily", " UNION ALL ".join(NOT_NULL_SQL)))
def dq_not_null(spark, sf_dir):
    return union(_not_null(spark, sf_dir))


@query("dq_accepted_values", sql("positions silver", " UNION ALL ".join(ACCEPTED_SQL)))
def dq_accepted_values(spark, sf_dir):
    return union(_accepted(spark, sf_dir))


@query("dq_report", sql("positions silver daily", " UNION ALL ".join(NOT_NULL_SQL + ACCEPTED_SQL)))
def dq_report(spark, sf_dir):
    bronze = positions(spark, sf_dir)
    bronze_checks = (quality.bronze_not_null() + quality.not_null("route_id")
                     + quality.accepted_values("route_id", ("R1", "R2", "R3")))
    silver_checks = quality.silver_not_null() + quality.silver_accepted_values()
    return union([quality.report(bronze, "bronze", bronze_checks),
                  quality.report(clean.silver(bronze), "silver", silver_checks),
                  quality.report(kpis.reliability(clean.silver(bronze)), "gold",
                                 quality.gold_not_null())])


@query("incremental_gold", sql("gold", "SELECT * FROM gold"))
def incremental_gold(spark, sf_dir):
    """Gold after three runs: the first half of the month, the second half, and two dates once more."""
    bronze, root = work_dir(spark, "bronze"), work_dir(spark, "lake")
    rows = clean.plausible(positions(spark, sf_dir))
    lake_sinks.refresh(rows, bronze, lake_sinks.LAKE_PARTITIONS)
    days = sorted(r[0] for r in rows.select("ingestion_date").distinct().collect())  # One row per date.
    for part in (days[:len(days) // 2], days[len(days) // 2:], [days[0], days[-1]]):
        incremental.run(spark, bronze, root, part)
    return incremental.read(spark, root, "gold").drop("updated_at")
