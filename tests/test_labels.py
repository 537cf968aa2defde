import pytest
from pyspark.sql import functions as F

from headway.functions import geo, labels, numbers, times


def evaluate(spark, values, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_speed_classes_at_their_bounds(spark):
    speeds = [0.49, 0.5, 4.99, 5.0, 14.99, 15.0, None]
    assert evaluate(spark, speeds, "double", labels.speed_category) == [
        "STATIONARY", "SLOW", "SLOW", "NORMAL", "NORMAL", "FAST", "STATIONARY"]


def test_time_buckets_by_hour(spark):
    hours = [5, 6, 7, 10, 11, 16, 17, 20, 21, 22, 23]
    assert evaluate(spark, hours, "int", labels.time_bucket) == [
        "EARLY_MORNING", "OFFPEAK", "AM_PEAK", "AM_PEAK", "OFFPEAK", "OFFPEAK", "PM_PEAK",
        "PM_PEAK", "OFFPEAK", "NIGHT", "NIGHT"]
    assert evaluate(spark, hours, "int", labels.is_peak) == [
        False, False, True, True, False, False, True, True, False, False, False]


def test_delay_class_and_severity(spark):
    delays = [120, 121, -120, -121, 600, 601, None]
    assert evaluate(spark, delays, "int", labels.delay_class) == [
        "ON_TIME", "DELAY", "ON_TIME", "EARLY", "DELAY", "DELAY", "ON_TIME"]
    assert evaluate(spark, delays, "int", labels.severity) == [
        "INFO", "WARNING", "INFO", "WARNING", "WARNING", "CRITICAL", "INFO"]


def test_display_state_and_eta_label(spark):
    df = spark.createDataFrame(
        [(0, True, 500, 30), (1, False, 121, 59), (2, False, -61, 60), (3, False, -60, 125),
         (4, None, None, -90), (5, False, 0, None)],
        "i int, bunching boolean, delay int, eta int").withColumn("route", F.lit("R9"))
    out = df.select("i", labels.display_state(F.col("bunching"), F.col("delay")).alias("state"),
                    labels.eta_label(F.col("eta"), F.col("route")).alias("eta"),
                    labels.eta_tone(F.col("eta"), F.col("delay")).alias("tone"))
    assert [(r.state, r.eta, r.tone) for r in out.orderBy("i").collect()] == [
        ("BUNCHING", "NOW", "red"), ("DELAYED", "NOW", "red"), ("EARLY", "1m", "cyan"),
        ("ON_TIME", "2m", "green"), ("ON_TIME", "NOW", "green"), ("ON_TIME", "R9", None)]


def test_box_bounds_are_inclusive_and_unknown_feeds_fail(spark):
    data = [(12.6, 77.2, "bmtc"), (13.3, 77.9, "bmtc"), (13.31, 77.9, "bmtc"),
            (28.4, 76.8, "namma_metro"), (12.9, 77.5, "namma_metro"), (12.9, 77.5, "other"),
            (12.9, 77.5, None)]
    df = spark.createDataFrame(data, "lat double, lon double, feed string")
    inside = geo.in_feed_box(F.col("feed"), F.col("lat"), F.col("lon"))
    assert [r[0] for r in df.select(inside).collect()] == [True, True, False, True, False, False,
                                                          False]


def test_rounding_goes_by_the_binary_value(spark):
    assert evaluate(spark, [1.005, 2.5, -2.5, 0.125], "double",
                    lambda v: numbers.round_to(v, 2)) == [1.0, 2.5, -2.5, 0.13]
    assert evaluate(spark, [5.634999999999999, 5.635], "double",
                    lambda v: numbers.round_mean(v, 2)) == [5.64, 5.64]


def test_minute_boundaries(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:59' a, timestamp'2024-01-01 00:01:01' b")
    assert df.select(times.minute_boundaries(F.col("a"), F.col("b"))).first()[0] == 1


def test_epoch_units_and_bucket_start(spark):
    df = spark.sql("SELECT 1700000000L s, 1700000000000L ms")
    out = df.select((times.event_time(F.col("s")) == times.event_time(F.col("ms"), "ms")).alias("e"),
                    times.bucket_start(times.event_time(F.col("s")), 30).cast("string").alias("b"))
    assert tuple(out.first()) == (True, "2023-11-14 22:13:00")
    with pytest.raises(ValueError):
        times.event_time(F.col("s"), "us")


def test_weekdays(spark):
    df = spark.sql("SELECT timestamp'2024-01-07 12:00:00' ts")  # a Sunday
    assert tuple(df.select(times.day_of_week_sunday0(F.col("ts")),
                           times.day_of_week_monday0(F.col("ts"))).first()) == (0, 6)


def test_sql_function_agrees_with_the_column(spark):
    geo.register_sql_functions(spark)
    df = spark.createDataFrame([(12.9, 77.5, 28.6, 77.2), (0.0, 0.0, 0.0, 0.001),
                                (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    column = geo.haversine_m(*[F.col(c) for c in "abcd"])
    out = df.select(F.round(column, 3).alias("x"),
                    F.expr("round(haversine(a, b, c, d), 3)").alias("y")).collect()
    assert all(r.x == r.y for r in out)
    assert out[1].x == 111.195 and out[2].x is None
