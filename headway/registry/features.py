"""Feature and model queries over Gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.numbers import round_to
from headway.operators import features, model
from headway.registry.base import query, rnd, rnd_mean, sql, subquery
from headway.registry.lake import gold_table
from headway.session import materialise

PANEL_COLUMNS = ", ".join(features.GOLD_INPUT)

subquery("panel", "gold", f"""SELECT {PANEL_COLUMNS} FROM gold
    WHERE avg_speed_kmh IS NOT NULL AND route_id <> 'UNKNOWN'""")

subquery("filled", "panel", "SELECT * REPLACE (" + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM panel)) AS {c}" for c in features.FILLED)
    + ") FROM panel")

subquery("calendar", "filled", """
    SELECT * REPLACE (cast(ingestion_date AS date) AS ingestion_date),
      cast(isodow(cast(ingestion_date AS date)) - 1 AS integer) AS day_of_week,
      CASE WHEN isodow(cast(ingestion_date AS date)) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      sin(2 * pi() * (isodow(cast(ingestion_date AS date)) - 1) / 7) AS day_sin,
      cos(2 * pi() * (isodow(cast(ingestion_date AS date)) - 1) / 7) AS day_cos FROM filled""")

subquery("lagged", "calendar", """
    SELECT *, lag(avg_speed_kmh, 1) OVER days AS lag_1_speed,
      lag(avg_speed_kmh, 2) OVER days AS lag_2_speed, lag(avg_speed_kmh, 3) OVER days AS lag_3_speed,
      avg(avg_speed_kmh) OVER (days ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_speed,
      avg_speed_kmh - lag(avg_speed_kmh, 1) OVER days AS speed_momentum
    FROM calendar WINDOW days AS (PARTITION BY route_id, feed ORDER BY ingestion_date)""")

subquery("ready", "lagged",
         "SELECT * FROM lagged WHERE lag_1_speed IS NOT NULL AND lag_2_speed IS NOT NULL")

subquery("codes", "ready", """
    SELECT route_id, cast(row_number() OVER (ORDER BY route_id) - 1 AS integer) AS route_encoded
    FROM (SELECT DISTINCT route_id FROM ready)""")

subquery("engineered", "ready codes", """
    SELECT *, CASE WHEN feed = 'namma_metro' THEN 1 ELSE 0 END AS feed_encoded
    FROM ready JOIN codes USING (route_id)""")

FLOATS = ", ".join(f"cast(f.{c} AS float) AS {c}" for c in features.FEATURES)

subquery("numbered", "engineered", """
    SELECT *, row_number() OVER (PARTITION BY route_id, feed ORDER BY ingestion_date) AS n
    FROM engineered""")

subquery("long_samples", "numbered", f"""
    SELECT t.route_id, t.feed, t.ingestion_date AS date, cast(f.n - t.n + 7 AS integer) AS step,
      cast(t.avg_speed_kmh AS float) AS target_speed_kmh, {FLOATS}
    FROM numbered t JOIN numbered f ON t.route_id = f.route_id AND t.feed = f.feed
      AND f.n BETWEEN t.n - 7 AND t.n - 1 WHERE t.n > 7""")

subquery("targets", "numbered", """
    SELECT route_id, feed, ingestion_date AS date, cast(avg_speed_kmh AS float) AS target_speed_kmh,
      lag_1_speed FROM numbered WHERE n > 7""")

DIGITS = 4


def rounded(df, columns):
    return df.withColumns({c: round_to(F.col(c).cast("double"), DIGITS) for c in columns})


def rounded_sql(columns) -> str:
    return ", ".join(f"{rnd(f'cast({c} AS double)', DIGITS)} AS {c}" for c in columns)


INTEGERS = ("is_weekend", "feed_encoded", "route_encoded", "unique_vehicles")
REALS = tuple(c for c in features.FEATURES if c not in INTEGERS)


def panel(spark, sf_dir):
    return features.gold_input(gold_table(spark, sf_dir))


def engineered(spark, sf_dir):
    return features.engineer(panel(spark, sf_dir))


def samples(spark, sf_dir):
    return materialise(features.sequences(engineered(spark, sf_dir)), "samples")


def scaled(spark, sf_dir):
    """Scaled samples with their split, and the scaler parameters."""
    rows = samples(spark, sf_dir)
    params = features.scaler_params(rows)
    return model.with_split(features.scale(rows, params)), params


@query("gold_feature_input", sql("panel", "SELECT * FROM panel"))
def gold_feature_input(spark, sf_dir):
    return panel(spark, sf_dir)


@query("feature_input_summary", sql("panel", """
    SELECT count(*) AS row_count, min(ingestion_date) AS first_date,
      max(ingestion_date) AS last_date, count(DISTINCT route_id) AS routes,
      count(DISTINCT feed) AS feeds FROM panel"""))
def feature_input_summary(spark, sf_dir):
    return features.input_summary(panel(spark, sf_dir))


KEYS = "route_id, feed, ingestion_date"


@query("feature_median_fill", sql("filled", f"""
    SELECT {KEYS}, {rounded_sql(features.FILLED)} FROM filled"""))
def feature_median_fill(spark, sf_dir):
    filled = features.fill_with_medians(panel(spark, sf_dir))
    return rounded(filled, features.FILLED).select(*KEYS.split(", "), *features.FILLED)


@query("calendar_features", sql("calendar", f"""
    SELECT {KEYS}, day_of_week, is_weekend, {rounded_sql(('day_sin', 'day_cos'))} FROM calendar"""))
def calendar_features(spark, sf_dir):
    days = features.with_calendar(panel(spark, sf_dir))
    return rounded(days, ("day_sin", "day_cos")).select(
        *KEYS.split(", "), "day_of_week", "is_weekend", "day_sin", "day_cos")


LAGS = ("lag_1_speed", "lag_2_speed", "lag_3_speed", "rolling_7d_speed", "speed_momentum")


@query("lag_features", sql("lagged", f"SELECT {KEYS}, {rounded_sql(LAGS)} FROM lagged"))
def lag_features(spark, sf_dir):
    lagged = features.with_lags(features.with_calendar(panel(spark, sf_dir)))
    return rounded(lagged, LAGS).select(*KEYS.split(", "), *LAGS)


@query("route_codes", sql("codes", "SELECT * FROM codes"))
def route_codes(spark, sf_dir):
    ready = features.with_lags(features.with_calendar(panel(spark, sf_dir)))
    return features.route_codes(ready.dropna(subset=["lag_1_speed", "lag_2_speed"]))


@query("engineered_features", sql("engineered", f"""
    SELECT {KEYS}, day_of_week, total_observations, {', '.join(INTEGERS)}, {rounded_sql(REALS)}
    FROM engineered"""))
def engineered_features(spark, sf_dir):
    return rounded(engineered(spark, sf_dir), REALS).select(
        *KEYS.split(", "), "day_of_week", "total_observations", *INTEGERS, *REALS)


SAMPLE_KEYS = "route_id, feed, date, step"


@query("training_sequences", sql("long_samples", f"""
    SELECT {SAMPLE_KEYS}, {rounded_sql(('target_speed_kmh', *features.FEATURES))}
    FROM long_samples"""))
def training_sequences(spark, sf_dir):
    rows = samples(spark, sf_dir)
    long = features.steps(rows).join(rows.drop("x"), ["route_id", "feed", "date"])
    values = ("target_speed_kmh", *features.FEATURES)
    return rounded(long, values).select(*SAMPLE_KEYS.split(", "), *values)


@query("scaler_params", sql("long_samples", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {rnd(f'cast(min({c}) AS double)', DIGITS)} AS x_min,
        {rnd(f'cast(max({c}) AS double)', DIGITS)} AS x_max FROM long_samples"""
    for c in (*features.FEATURES, "target_speed_kmh"))))
def scaler_params(spark, sf_dir):
    params = features.scaler_params(samples(spark, sf_dir))
    target = params.select(F.lit("target_speed_kmh").alias("feature"), F.col("y_min").alias("x_min"),
                           F.col("y_max").alias("x_max"))
    return rounded(features.scaler_table(params).unionByName(target), ("x_min", "x_max"))


def scaled_sql(c: str) -> str:
    low, high = (f"(SELECT {f}({c}) FROM long_samples)" for f in ("min", "max"))
    return (f"{rnd(f'cast(({c} - {low}) / CASE WHEN {high} = {low} THEN 1 ELSE {high} - {low} END AS double)', 3)}"
            f" AS {c}")


@query("scaled_features", sql("long_samples", f"""
    SELECT {SAMPLE_KEYS}, {', '.join(scaled_sql(c) for c in ('target_speed_kmh', *features.FEATURES))}
    FROM long_samples"""))
def scaled_features(spark, sf_dir):
    rows = scaled(spark, sf_dir)[0]
    keys = ["route_id", "feed", "date"]
    target = rows.select(*keys, F.col("target_scaled").alias("target_speed_kmh"))
    long = features.steps(rows, "x_scaled").join(target, keys)
    values = ("target_speed_kmh", *features.FEATURES)
    return long.select(*SAMPLE_KEYS.split(", "),
                       *[round_to(F.col(c).cast("double"), 3).alias(c) for c in values])


@query("split_counts", sql("targets", """
    SELECT CASE WHEN substr(md5(concat_ws('|', route_id, feed, strftime(date, '%Y-%m-%d'))), 1, 2)
      < '26' THEN 'validation' ELSE 'train' END AS split, count(*) AS samples
    FROM targets GROUP BY ALL"""))
def split_counts(spark, sf_dir):
    return model.split_counts(samples(spark, sf_dir))


@query("model_metrics", sql("ready", f"""
    SELECT feed, {rnd_mean('sqrt(avg(pow(lag_1_speed - avg_speed_kmh, 2)))', 4)} AS rmse,
      {rnd_mean('avg(abs(lag_1_speed - avg_speed_kmh))', 4)} AS mae, count(*) AS samples
    FROM ready GROUP BY feed"""))
def model_metrics(spark, sf_dir):
    """Errors of the simplest forecast: tomorrow is like today."""
    lagged = features.with_lags(features.with_calendar(panel(spark, sf_dir)))
    ready = lagged.dropna(subset=["lag_1_speed", "lag_2_speed"])
    return model.error_metrics(ready, "avg_speed_kmh", "lag_1_speed", "feed")


@query("speed_forecast")
def speed_forecast(spark, sf_dir):
    rows, params = scaled(spark, sf_dir)
    rows = materialise(rows, "scaled")
    return model.score(model.train(rows), rows, params)
