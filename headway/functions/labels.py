"""Classification rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class bounds and names.
SPEED_CLASSES = ((0.5, "STATIONARY"), (5.0, "SLOW"), (15.0, "NORMAL"))
SPEED_ABOVE = "FAST"
AM_PEAK_HOURS = (7, 10)
PM_PEAK_HOURS = (17, 20)
NIGHT_HOURS = (22, 23)
EARLY_BEFORE_HOUR = 6
DELAY_THRESHOLD_S = 120
CRITICAL_DELAY_S = 600
DISPLAY_LATE_S = 120
DISPLAY_EARLY_S = -60
UNKNOWN = "UNKNOWN"

SPEED_CATEGORIES = ("STATIONARY", "SLOW", "NORMAL", "FAST")
TIME_BUCKETS = ("AM_PEAK", "PM_PEAK", "NIGHT", "EARLY_MORNING", "OFFPEAK")


def speed_category(speed_mps: Column) -> Column:
    speed = F.coalesce(speed_mps, F.lit(0.0))
    (first_bound, first_name), *rest = SPEED_CLASSES
    label = F.when(speed < first_bound, first_name)
    for bound, name in rest:
        label = label.when(speed < bound, name)
    return label.otherwise(SPEED_ABOVE)


def time_bucket(hour: Column) -> Column:
    return (F.when(hour.between(*AM_PEAK_HOURS), "AM_PEAK")
            .when(hour.between(*PM_PEAK_HOURS), "PM_PEAK")
            .when(hour.between(*NIGHT_HOURS), "NIGHT")
            .when(hour < EARLY_BEFORE_HOUR, "EARLY_MORNING")
            .otherwise("OFFPEAK"))


def is_peak(hour: Column) -> Column:
    peak = hour.between(*AM_PEAK_HOURS) | hour.between(*PM_PEAK_HOURS)
    return F.coalesce(peak, F.lit(False))


def delay_class(delay_s: Column, threshold: int = DELAY_THRESHOLD_S) -> Column:
    return (F.when(delay_s > threshold, "DELAY")
            .when(delay_s < -threshold, "EARLY")
            .otherwise("ON_TIME"))


def severity(delay_s: Column) -> Column:
    size = F.abs(F.coalesce(delay_s, F.lit(0)))
    return (F.when(size > CRITICAL_DELAY_S, "CRITICAL")
            .when(size > DELAY_THRESHOLD_S, "WARNING")
            .otherwise("INFO"))


def display_state(is_bunching: Column, delay_s: Column) -> Column:
    return (F.when(is_bunching, "BUNCHING")
            .when(delay_s > DISPLAY_LATE_S, "DELAYED")
            .when(delay_s < DISPLAY_EARLY_S, "EARLY")
            .otherwise("ON_TIME"))


def eta_label(eta_s: Column, route_id: Column) -> Column:
    minutes = (eta_s / F.lit(60)).cast("int")
    return (F.when(eta_s.isNull(), F.coalesce(route_id, F.lit("")))
            .when(minutes <= 0, "NOW")
            .otherwise(F.concat(minutes.cast("string"), F.lit("m"))))


def eta_tone(eta_s: Column, delay_s: Column) -> Column:
    """Colour of the arrival label; there is none without an arrival time."""
    return F.when(eta_s.isNotNull(),
                  F.when(delay_s > DISPLAY_LATE_S, "red")
                  .when(delay_s < DISPLAY_EARLY_S, "cyan")
                  .otherwise("green"))
