"""Silver to Gold: daily indicators per route, rolling trend and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.functions import labels
from headway.functions.numbers import percent_of, round_mean, round_to
from headway.functions.times import minute_boundaries
from headway.operators import clean
from headway.plans.ordered import exact_median, magnitude_bucket

GRAIN = ("route_id", "feed", "ingestion_date")
KMH = 3.6
ROLLING_ROWS = 7
CONGESTED = ("STATIONARY", "SLOW")
PEAKS = ("AM_PEAK", "PM_PEAK")
SUMMED = ("n", *(f"n_{p.lower()}" for p in PEAKS))


def measured(silver: DataFrame) -> DataFrame:
    """Rows that count: inside the feed's box and on a known route."""
    return silver.where(F.col("is_valid_bbox") & (F.col("route_id") != labels.UNKNOWN))


def _kmh(value, digits: int = 2):
    return round_mean(value * F.lit(KMH), digits)


def _counts() -> dict:
    return {"unique_vehicles": F.count_distinct("vehicle_id"),
            "total_observations": F.count(F.lit(1))}


def _speeds() -> dict:
    mean = F.avg("speed_mps")
    return {"avg_speed_mps": round_mean(mean, 2), "avg_speed_kmh": _kmh(mean),
            "max_speed_kmh": _kmh(F.max("speed_mps"))}


def _congestion() -> dict:
    return {f"{name.lower()}_pct": percent_of(F.col("speed_category") == name)
            for name in CONGESTED}


def _peaks() -> dict:
    return {f"avg_speed_{name.lower()}_kmh":
            _kmh(F.avg(F.when(F.col("time_bucket") == name, F.col("speed_mps"))))
            for name in PEAKS}


def _activity() -> dict:
    first, last = F.min("event_ts"), F.max("event_ts")
    return {"first_seen": first, "last_seen": last,
            "active_hours": round_to(minute_boundaries(first, last) / F.lit(60.0), 1)}


def _reliability() -> dict:
    mean = F.avg("speed_mps")
    spread = F.stddev_samp("speed_mps") / F.nullif(mean, F.lit(0.0))
    return {"reliability_score":
            F.greatest(F.lit(0.0), round_mean(F.lit(100.0) - spread * F.lit(50.0), 1))}


def _per_route_day(df: DataFrame, measures: dict) -> DataFrame:
    return df.groupBy(*GRAIN).agg(*[m.alias(name) for name, m in measures.items()])


def vehicle_counts(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _counts())


def speed_stats(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _speeds())


def speed_median(silver: DataFrame) -> DataFrame:
    median = exact_median(measured(silver), GRAIN, "speed_mps", "_median")
    return median.select(*GRAIN, _kmh(F.col("_median")).alias("median_speed_kmh"))


def congestion_pct(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _congestion())


def peak_speeds(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _peaks())


def activity_window(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _activity())


def reliability(silver: DataFrame) -> DataFrame:
    return _per_route_day(measured(silver), _reliability())


def with_rolling_speed(daily: DataFrame) -> DataFrame:
    rows = (Window.partitionBy("route_id", "feed").orderBy("ingestion_date")
            .rowsBetween(-(ROLLING_ROWS - 1), 0))
    return daily.withColumn("avg_speed_kmh_7d", round_mean(F.avg("avg_speed_kmh").over(rows), 2))


def with_speed_rank(daily: DataFrame) -> DataFrame:
    order = Window.partitionBy("feed", "ingestion_date").orderBy(
        F.col("avg_speed_kmh").desc_nulls_last())
    return daily.withColumn("speed_rank_today", F.rank().over(order))


# All indicators from counts

VALUE_ROW, VEHICLE_ROW = "value", "vehicle"
PARTIAL_KEYS = (*GRAIN, "row_kind", "vehicle_id", "speed_mps")


def partials(silver: DataFrame) -> DataFrame:
    """What the daily indicators need, in rows that add up: a row per speed and a row per vehicle of a route's day.

    Partials of disjoint parts of Silver may be joined by ``merged``. One shuffle gives both kinds.
    """
    rows = measured(silver).select(*GRAIN, "vehicle_id", "speed_mps", "time_bucket", "event_ts")
    grain = [F.col(c) for c in GRAIN]
    counted = rows.groupingSets(
        [[*grain, F.col("speed_mps")], [*grain, F.col("vehicle_id")]], *GRAIN, "speed_mps", "vehicle_id").agg(
        F.when(F.grouping("vehicle_id") == 1, VALUE_ROW).otherwise(VEHICLE_ROW).alias("row_kind"),
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col("time_bucket") == p, 1)).alias(f"n_{p.lower()}") for p in PEAKS],
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"))
    return counted.select(*PARTIAL_KEYS, *SUMMED, "first_seen", "last_seen")


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several parts of Silver as those of the whole."""
    return parts.groupBy(*PARTIAL_KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMMED], F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def daily(parts: DataFrame) -> DataFrame:
    """The indicators of each route, feed and date from its partials; no row of a group meets all others.

    Counts per coarse class of speed give the sums and the classes in which the median lies; only the
    values of these are walked in order.
    """
    value = F.col("row_kind") == VALUE_ROW
    classed = parts.withColumn("_class", F.when(value, magnitude_bucket(F.col("speed_mps"))))
    speed = F.col("speed_mps")

    def of(column: str, weight: Column | None = None) -> Column:
        return F.sum(F.when(value, F.col(column) if weight is None else weight * F.col(column)))

    labelled = labels.speed_category(speed)
    classes = classed.groupBy(*GRAIN, "_class").agg(
        F.count(F.when(~value, 1)).alias("_vehicles"), of("n").alias("_n"), of("n", speed).alias("_s1"),
        of("n", speed * speed).alias("_s2"), F.max("speed_mps").alias("_max"),
        *[F.sum(F.when(value & (labelled == c), F.col("n")).otherwise(0)).alias(f"_{c.lower()}") for c in CONGESTED],
        *[of(f"n_{p.lower()}").alias(f"_{p.lower()}") for p in PEAKS],
        *[of(f"n_{p.lower()}", speed).alias(f"_{p.lower()}_s1") for p in PEAKS],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    group = Window.partitionBy(*GRAIN)
    classes = classes.withColumns({
        "_upto": F.sum("_n").over(group.orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)),
        "_total": F.sum("_n").over(group)})
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))

    sums = ["_vehicles", "_n", "_s1", "_s2", *[f"_{c.lower()}" for c in CONGESTED],
            *[f"_{p.lower()}{x}" for p in PEAKS for x in ("", "_s1")]]
    groups = classes.groupBy(*GRAIN).agg(
        *[F.sum(c).alias(c) for c in sums], F.max("_max").alias("_max"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min(F.when(holds(low), F.struct("_class", (F.col("_upto") - F.col("_n")).alias("ahead")))).alias("_low"),
        F.max(F.when(holds(high), F.col("_class"))).alias("_high"))
    middle = groups.select(*GRAIN, F.explode(F.array_distinct(F.array("_low._class", "_high"))).alias("_class"),
                           F.col("_low.ahead").alias("_ahead"), F.col("_n").alias("_total"))
    walked = classed.where(value).select(*GRAIN, "_class", "speed_mps", "n").join(middle, [*GRAIN, "_class"]) \
        .withColumn("_upto", F.col("_ahead") + F.sum("n").over(
            group.orderBy("speed_mps").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumnRenamed("n", "_n")
    median = walked.groupBy(*GRAIN).agg(
        ((F.max(F.when(holds(low), speed)) + F.max(F.when(holds(high), speed))) / 2).alias("_median"))
    return _from_sums(groups.join(median, list(GRAIN), "left"))


def _from_sums(groups: DataFrame) -> DataFrame:
    n, s1 = F.col("_n"), F.col("_s1")
    mean = s1 / n
    variance = F.greatest(F.lit(0.0), F.col("_s2") - s1 * mean) / F.nullif(n - 1, F.lit(0))
    spread = F.sqrt(variance) / F.nullif(mean, F.lit(0.0))
    first, last = F.col("first_seen"), F.col("last_seen")
    return groups.select(
        *GRAIN, F.col("_vehicles").alias("unique_vehicles"), n.alias("total_observations"),
        round_mean(mean, 2).alias("avg_speed_mps"), _kmh(mean).alias("avg_speed_kmh"),
        _kmh(F.col("_max")).alias("max_speed_kmh"), _kmh(F.col("_median")).alias("median_speed_kmh"),
        *[round_to(F.lit(100.0) * F.col(f"_{c.lower()}") / n, 1).alias(f"{c.lower()}_pct") for c in CONGESTED],
        *[_kmh(F.col(f"_{p.lower()}_s1") / F.nullif(F.col(f"_{p.lower()}"), F.lit(0)))
          .alias(f"avg_speed_{p.lower()}_kmh") for p in PEAKS],
        first, last, round_to(minute_boundaries(first, last) / F.lit(60.0), 1).alias("active_hours"),
        F.greatest(F.lit(0.0), round_mean(F.lit(100.0) - spread * F.lit(50.0), 1)).alias("reliability_score"))


def with_windows(daily_rows: DataFrame) -> DataFrame:
    """The columns that look at other days and other routes."""
    return with_speed_rank(with_rolling_speed(daily_rows))


def gold(silver: DataFrame) -> DataFrame:
    """All daily indicators, one row per route, feed and date, straight from Silver.

    Both branches share the shuffle of the raw rows; ``daily(partials(silver))`` gives the same from counts that can be kept.
    """
    parts = [_counts(), _speeds(), _congestion(), _peaks(), _activity(), _reliability()]
    base = _per_route_day(measured(silver), {k: m for part in parts for k, m in part.items()})
    whole = base.join(speed_median(silver), list(GRAIN), "left")
    counts, speeds, *others = [list(part) for part in parts]
    ordered = [*GRAIN, *counts, *speeds, "median_speed_kmh", *sum(others, [])]
    return with_windows(whole.select(*ordered))


def gold_from_bronze(bronze: DataFrame, dedup_seconds: int = clean.DEDUP_SECONDS) -> DataFrame:
    """Gold straight from Bronze; reads only the columns the indicators use."""
    return gold(clean.silver(bronze.select(*clean.KPI_COLUMNS), dedup_seconds))


def presentation_order(gold_table: DataFrame) -> DataFrame:
    return gold_table.orderBy(F.col("ingestion_date").desc(), F.col("feed"),
                              F.col("avg_speed_kmh").asc_nulls_last())
