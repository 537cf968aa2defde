"""Bronze to Silver: filters, null defaults, labels, newest row per vehicle and time bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions import geo, labels, times
from headway.functions.numbers import blank_to_null

DEDUP_SECONDS = 30

# What the daily indicators need of a position.
KPI_COLUMNS = ("entity_id", "vehicle_id", "route_id", "latitude", "longitude", "speed_mps", "feed",
               "event_ts", "ingestion_date", "ingested_at")


def complete(df: DataFrame) -> DataFrame:
    """Rows with a vehicle id and both coordinates."""
    return df.where(blank_to_null(F.col("vehicle_id")).isNotNull()
                    & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def plausible(df: DataFrame) -> DataFrame:
    """Complete rows whose coordinates exist on the globe."""
    return complete(df).where(geo.on_globe(F.col("latitude"), F.col("longitude")))


def newest_per(df: DataFrame, keys: Sequence[str], newest: Sequence[Column],
               computed: Mapping[str, Column] | None = None) -> DataFrame:
    """One whole row per key, the greatest by ``newest``; ``computed`` keys are not columns of ``df``.

    An aggregate, not a window: map tasks keep one row per key before the shuffle, so copies of
    one key never meet in bulk, and the same call runs on streams. Key columns come back as grouping
    columns, so a filter on them reaches the input.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys, *[expr.alias(name) for name, expr in (computed or {}).items()]).agg(
        F.max_by(row, F.struct(*newest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def dedup(df: DataFrame, seconds: int = DEDUP_SECONDS, include_feed: bool = False) -> DataFrame:
    """Newest row per vehicle and fixed time bucket; the larger entity id wins a tie."""
    keys = ["vehicle_id", "feed"] if include_feed else ["vehicle_id"]
    return newest_per(df, keys, [F.col("ingested_at"), F.col("entity_id")],
                      {"_bucket": times.bucket_number(F.col("event_ts"), seconds)})


def with_null_defaults(df: DataFrame) -> DataFrame:
    defaults = {"route_id": F.lit(labels.UNKNOWN), "trip_id": F.lit(labels.UNKNOWN),
                "speed_mps": F.lit(0.0)}
    return df.withColumns({name: F.coalesce(F.col(name), value)
                           for name, value in defaults.items() if name in df.columns})


def with_speed_category(df: DataFrame) -> DataFrame:
    return df.withColumn("speed_category", labels.speed_category(F.col("speed_mps")))


def with_time_features(df: DataFrame) -> DataFrame:
    ts = F.col("event_ts")
    hour = times.hour_of_day(ts)
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": times.day_of_week_sunday0(ts),
        "time_bucket": labels.time_bucket(hour),
        "is_peak_hour": labels.is_peak(hour),
    })


def with_geo_flag(df: DataFrame, boxes: Mapping[str, geo.Box] = geo.FEED_BOXES) -> DataFrame:
    inside = geo.in_feed_box(F.col("feed"), F.col("latitude"), F.col("longitude"), boxes)
    return df.withColumn("is_valid_bbox", inside)


def enrich(df: DataFrame, boxes: Mapping[str, geo.Box] = geo.FEED_BOXES) -> DataFrame:
    """Null defaults and all labels, no shuffle."""
    return with_geo_flag(with_time_features(with_speed_category(with_null_defaults(df))), boxes)


def silver(bronze: DataFrame, dedup_seconds: int = DEDUP_SECONDS,
           boxes: Mapping[str, geo.Box] = geo.FEED_BOXES) -> DataFrame:
    """The cleaned table without its load stamp (see ``stamped``)."""
    return enrich(dedup(plausible(bronze), dedup_seconds), boxes)


def stamped(df: DataFrame, column: str = "updated_at") -> DataFrame:
    return df.withColumn(column, F.current_timestamp())
