"""Latest state per vehicle, the views served from it, and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headway import schemas
from headway.functions import geo, labels
from headway.functions.numbers import blank_to_null
from headway.operators import clean
from headway.plans.sessions import gap_sessions

VEHICLE_LIFETIME_S = 90
STALE_AFTER_S = 300


def latest_vehicle_state(positions: DataFrame) -> DataFrame:
    """The last written position of every vehicle."""
    known = positions.where(blank_to_null(F.col("vehicle_id")).isNotNull())
    order = [F.col("ingested_at"), F.col("event_ts"), F.col("entity_id")]
    return clean.newest_per(known, ["vehicle_id"], order)


def seen_within(state: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return state.where(F.col("event_ts") >= as_of - F.expr(f"INTERVAL '{seconds}' SECOND"))


def active_vehicles(state: DataFrame, as_of: Column, stale_after_s: int = STALE_AFTER_S) -> DataFrame:
    """Vehicles not silent for longer than ``stale_after_s``."""
    return seen_within(state, as_of, stale_after_s)


def vehicle_lookup(state: DataFrame, vehicle_id: str) -> DataFrame:
    return state.where(F.col("vehicle_id") == vehicle_id)


def route_vehicle_sessions(positions: DataFrame, gap_s: int = VEHICLE_LIFETIME_S) -> DataFrame:
    """Vehicles listed on each route while the route's set stays alive.

    The set lives until ``gap_s`` seconds after the last position on the route.
    """
    known = positions.where(blank_to_null(F.col("vehicle_id")).isNotNull()
                            & blank_to_null(F.col("route_id")).isNotNull())
    return gap_sessions(known, "route_id", "vehicle_id", "event_ts", gap_s)


def live_route_members(state: DataFrame, as_of: Column,
                       lifetime_s: int = VEHICLE_LIFETIME_S) -> DataFrame:
    """Variant where every vehicle expires by itself."""
    return seen_within(state, as_of, lifetime_s).select("route_id", "vehicle_id", "event_ts")


def snapshot_messages(state: DataFrame, per_message: int = 1000) -> DataFrame:
    """The live vehicles as JSON messages of about ``per_message`` vehicles each.

    Vehicles are dealt to messages by hash, so no busy route makes an oversized message and the
    number of messages grows with the fleet.
    """
    messages = F.ceil(state.agg(F.count(F.lit(1))).scalar() / F.lit(per_message))
    part = F.pmod(F.xxhash64("vehicle_id"), F.greatest(messages, F.lit(1).cast("long")))
    row = F.struct(*[F.col(c) for c in state.columns])
    body = F.to_json(F.struct(F.lit("snapshot").alias("type"),
                              F.sort_array(F.collect_list(row)).alias("data")))
    return (state.withColumn("part", part).groupBy("part")
            .agg(F.count(F.lit(1)).alias("vehicles"), body.alias("body")))


# Client-side calculations

def planar_positions(positions: DataFrame) -> DataFrame:
    x, z = geo.planar_xz(F.col("latitude"), F.col("longitude"))
    return positions.withColumns({"x": x, "z": z})


def display_columns(df: DataFrame) -> DataFrame:
    """Needs eta_seconds, delay_seconds and is_bunching."""
    return df.withColumns({
        "display_state": labels.display_state(F.col("is_bunching"), F.col("delay_seconds")),
        "eta_label": labels.eta_label(F.col("eta_seconds"), F.col("route_id")),
        "eta_tone": labels.eta_tone(F.col("eta_seconds"), F.col("delay_seconds")),
    })


# Record checks

POSITION_REQUIRED = ("vehicle_id", "latitude", "longitude", "timestamp")
POSITION_DEFAULTS = {"bearing": 0.0, "speed_mps": 0.0, "current_status": "", "feed": "",
                     "is_bunching": False}


def checked_positions(records: DataFrame) -> DataFrame:
    """Text records typed as position records, with ``reject_reason`` (null when valid).

    A missing or unreadable required value and an unreadable optional value both reject.
    """
    reason = F.lit(None).cast("string")
    out: list[Column] = []
    for field in schemas.API_POSITION:
        name, dtype = field.name, field.dataType
        default = F.lit(POSITION_DEFAULTS.get(name)).cast(dtype)
        if name not in records.columns:
            out.append(default.alias(name))
            continue
        value = F.col(name).try_cast(dtype)
        bad = value.isNull() if name in POSITION_REQUIRED else F.col(name).isNotNull() & value.isNull()
        reason = F.coalesce(reason, F.when(bad, name))
        out.append(F.coalesce(value, default).alias(name))
    return records.select(*out, reason.alias("reject_reason"))


def valid_positions(records: DataFrame) -> DataFrame:
    return checked_positions(records).where("reject_reason IS NULL").drop("reject_reason")


def rejected_positions(records: DataFrame) -> DataFrame:
    return checked_positions(records).where("reject_reason IS NOT NULL")
