"""Data checks. Each table is read once, whatever the number of checks on it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from headway.functions import geo, labels


class Check(NamedTuple):
    column: str
    rule: str
    fails: Column


def not_null(*columns: str) -> list[Check]:
    return [Check(c, "not_null", F.col(c).isNull()) for c in columns]


def accepted_values(column: str, values: Sequence[str]) -> list[Check]:
    """Null passes; it is a matter for ``not_null``."""
    return [Check(column, "accepted_values", F.col(column).isNotNull() & ~F.col(column).isin(*values))]


def between(column: str, low: float, high: float) -> list[Check]:
    return [Check(column, "between", F.col(column).isNotNull() & ~F.col(column).between(low, high))]


def report(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """(table_name, column_name, check_name, failures), one row per check."""
    counts = df.agg(*[F.sum(F.when(c.fails, 1).otherwise(0)).alias(f"_{i}")
                      for i, c in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(c.column).alias("column_name"),
                 F.lit(c.rule).alias("check_name"),
                 F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("failures"))
        for i, c in enumerate(checks)])
    return counts.select(F.explode(rows).alias("_r")).select("_r.*")


class ExpectationFailed(ValueError):
    pass


def require(checks: DataFrame) -> None:
    """Raise when any check of a report failed (the report has one row per check)."""
    failed = checks.where(F.col("failures") > 0).collect()
    if failed:
        raise ExpectationFailed("; ".join(
            f"{r.table_name}.{r.column_name} {r.check_name}: {r.failures} rows" for r in failed))


def bronze_not_null() -> list[Check]:
    return not_null("latitude", "longitude", "event_ts")


def silver_not_null() -> list[Check]:
    return not_null("vehicle_id", "latitude", "longitude", "feed")


def silver_accepted_values() -> list[Check]:
    return (accepted_values("feed", tuple(geo.FEED_BOXES))
            + accepted_values("speed_category", labels.SPEED_CATEGORIES)
            + accepted_values("time_bucket", labels.TIME_BUCKETS))


def gold_not_null() -> list[Check]:
    return not_null("route_id", "feed", "reliability_score")


def stop_checks() -> list[Check]:
    box = geo.STOPS_BOX
    return between("stop_lat", box.lat_min, box.lat_max) + not_null("stop_id")


def route_checks() -> list[Check]:
    return not_null("route_id")
