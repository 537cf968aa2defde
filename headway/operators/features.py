"""Gold to model input: filled gaps, calendar, lags, codes, sliding sequences, scaling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions import labels, times
from headway.plans.ordered import ordinal_codes

SEQUENCE_LENGTH = 7
TARGET = "avg_speed_kmh"
PANEL = ("route_id", "feed")

# Input columns, filled columns, feature order and feed codes.
GOLD_INPUT = ("route_id", "feed", "ingestion_date", "avg_speed_kmh", "avg_speed_am_peak_kmh",
              "avg_speed_pm_peak_kmh", "stationary_pct", "slow_pct", "reliability_score",
              "unique_vehicles", "total_observations")
FILLED = ("avg_speed_am_peak_kmh", "avg_speed_pm_peak_kmh", "stationary_pct", "slow_pct",
          "reliability_score")
FEATURES = ("avg_speed_kmh", "avg_speed_am_peak_kmh", "avg_speed_pm_peak_kmh", "stationary_pct",
            "slow_pct", "reliability_score", "lag_1_speed", "lag_2_speed", "lag_3_speed",
            "rolling_7d_speed", "speed_momentum", "day_sin", "day_cos", "is_weekend",
            "feed_encoded", "route_encoded", "unique_vehicles")
FEED_CODES = {"bmtc": 0, "namma_metro": 1}


def gold_input(gold: DataFrame) -> DataFrame:
    return gold.select(*GOLD_INPUT).where(
        F.col(TARGET).isNotNull() & (F.col("route_id") != labels.UNKNOWN))


def input_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ingestion_date").alias("first_date"), F.max("ingestion_date").alias("last_date"),
        F.count_distinct("route_id").alias("routes"), F.count_distinct("feed").alias("feeds"))


def fill_with_medians(panel: DataFrame, columns: tuple[str, ...] = FILLED) -> DataFrame:
    """Nulls replaced by the column's median over the whole panel.

    The inputs are rounded to one or two digits, so the exact percentile keeps a bounded number
    of distinct values per column.
    """
    medians = panel.agg(F.struct(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])
                        .alias("m")).scalar()
    return panel.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in columns})


def with_calendar(panel: DataFrame) -> DataFrame:
    """Weekday with 0 = Monday, weekend flag and the week as a circle."""
    panel = panel.withColumn("ingestion_date", F.to_date("ingestion_date"))
    weekday = times.day_of_week_monday0(F.col("ingestion_date"))
    sine, cosine = times.cycle(weekday, 7)
    return panel.withColumns({"day_of_week": weekday,
                              "is_weekend": (weekday >= 5).cast("int"),
                              "day_sin": sine, "day_cos": cosine})


def with_lags(panel: DataFrame) -> DataFrame:
    """Speeds of the previous days, rolling mean and momentum per route and feed."""
    days = Window.partitionBy(*PANEL).orderBy("ingestion_date")
    speed = F.col(TARGET)
    lags = {f"lag_{n}_speed": F.lag(speed, n).over(days) for n in (1, 2, 3)}
    return (panel.withColumns(lags)
            .withColumn("rolling_7d_speed", F.avg(speed).over(days.rowsBetween(-6, 0)))
            .withColumn("speed_momentum", speed - F.col("lag_1_speed")))


def feed_code(feed: Column, codes: Mapping[str, int] = FEED_CODES) -> Column:
    code = F.lit(0)
    for name, number in codes.items():
        code = F.when(feed == name, number).otherwise(code)
    return code


def route_codes(panel: DataFrame) -> DataFrame:
    return ordinal_codes(panel, "route_id", "route_encoded")


def with_history(panel: DataFrame, days: int = 3) -> DataFrame:
    """The routes that have a row with two days before it, by counting: Gold's target is never null here."""
    counts = panel.groupBy(*PANEL).agg(F.count(F.lit(1)).alias("_days"))
    return counts.where(F.col("_days") >= days).select("route_id")


def engineer(panel: DataFrame) -> DataFrame:
    """All feature columns; rows without two days of history are dropped."""
    filled = fill_with_medians(panel)
    ready = with_lags(with_calendar(filled)).dropna(subset=["lag_1_speed", "lag_2_speed"])
    coded = ready.join(route_codes(with_history(panel)), "route_id", "left")
    return coded.withColumn("feed_encoded", feed_code(F.col("feed")))


def usable_length(features: DataFrame, wanted: int = SEQUENCE_LENGTH) -> int:
    """Sequence length the history allows: between 1 and ``wanted``."""
    days = features.agg(F.count_distinct("ingestion_date")).first()[0]
    return min(wanted, max(1, days - 1))


def sequences(features: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One sample per day that has ``length`` earlier days: x is (length, 17), y the day's speed."""
    earlier = (Window.partitionBy(*PANEL).orderBy("ingestion_date").rowsBetween(-length, -1))
    step = F.array(*[F.col(c).cast("float") for c in FEATURES])
    return (features.withColumn("x", F.collect_list(step).over(earlier))
            .where(F.size("x") == length)
            .select(*PANEL, F.col("ingestion_date").alias("date"), "x",
                    F.col(TARGET).cast("float").alias("target_speed_kmh")))


def steps(samples: DataFrame, x: str = "x") -> DataFrame:
    """Samples in long form: one row per sample and step, one column per feature."""
    long = samples.select(*PANEL, "date", F.posexplode(x).alias("step", "_v"))
    return long.select(*PANEL, "date", "step",
                       *[F.col("_v")[i].alias(c) for i, c in enumerate(FEATURES)])


def scaler_params(samples: DataFrame) -> DataFrame:
    """One row: x_min and x_max per feature (nulls ignored), y_min, y_max."""
    values = steps(samples.select(*PANEL, "date", "x"))
    x = values.agg(F.array(*[F.min(c) for c in FEATURES]).alias("x_min"),
                   F.array(*[F.max(c) for c in FEATURES]).alias("x_max"))
    y = samples.agg(F.struct(F.min("target_speed_kmh").alias("lo"),
                             F.max("target_speed_kmh").alias("hi")).alias("y")).scalar()
    return x.select("x_min", "x_max", y["lo"].alias("y_min"), y["hi"].alias("y_max"))


def scaler_table(params: DataFrame) -> DataFrame:
    """The parameters in long form, one row per feature."""
    named = F.arrays_zip(F.array(*[F.lit(c) for c in FEATURES]).alias("feature"),
                         "x_min", "x_max")
    return (params.select(F.explode(named).alias("r"))
            .select("r.feature", "r.x_min", "r.x_max"))


def _scaled(value: Column, low: float, high: float) -> Column:
    """In single precision, as the samples are."""
    span = 1.0 if high == low else high - low
    return ((value - F.lit(low).cast("float")) / F.lit(span).cast("float")).cast("float")


def scale(samples: DataFrame, params: DataFrame) -> DataFrame:
    """Min-max scaled x and target next to the raw target; a constant feature becomes 0.

    Like any fitted scaler it takes its parameters, one row of 36 numbers, to the driver.
    """
    p = params.first()
    if p is None or p.y_min is None:
        raise ValueError("there are no samples to scale")

    def one_step(step: Column) -> Column:
        return F.array(*[_scaled(F.get(step, F.lit(i)), low, high) for i, (low, high) in
                         enumerate(zip(p.x_min, p.x_max))])

    return (samples.withColumn("x_scaled", F.transform("x", one_step))
            .withColumn("target_scaled", _scaled(F.col("target_speed_kmh"), p.y_min, p.y_max)))


def unscale_target(value: Column, y_min: float, y_max: float) -> Column:
    return value * F.lit(1.0 if y_max == y_min else y_max - y_min) + F.lit(y_min)
