"""Speed forecast: repeatable split, distributed regression, scoring, metrics, model record."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headway.functions.numbers import round_mean
from headway.operators import features

# About 15 % of the two-digit hexadecimal prefixes.
VALIDATION_BELOW = "26"


def sample_key() -> Column:
    return F.concat_ws("|", "route_id", "feed", F.date_format("date", "yyyy-MM-dd"))


def with_split(samples: DataFrame, below: str = VALIDATION_BELOW) -> DataFrame:
    """``split`` = train or validation by a hash of the sample's key: the same on every run."""
    prefix = F.substring(F.md5(sample_key()), 1, 2)
    return samples.withColumn("split", F.when(prefix < below, "validation").otherwise("train"))


def split_counts(samples: DataFrame) -> DataFrame:
    return with_split(samples).groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def as_vectors(scaled: DataFrame) -> DataFrame:
    """The scaled sequence as one vector; a missing early lag counts as the feature's minimum."""
    flat = F.transform(F.flatten("x_scaled"), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return (scaled.withColumn("features", array_to_vector(flat))
            .withColumn("label", F.col("target_scaled").cast("double")))


def regressor(kind: str = "linear"):
    if kind == "linear":
        return LinearRegression(regParam=0.1, elasticNetParam=0.0, maxIter=50)
    if kind == "gbt":
        return GBTRegressor(maxDepth=3, maxIter=20, seed=42)
    raise ValueError(f"unknown model {kind!r}")


def train(scaled: DataFrame, kind: str = "linear") -> PipelineModel:
    """Fit on the training part of scaled samples that carry a ``split`` column."""
    rows = as_vectors(scaled.where(F.col("split") == "train"))
    return Pipeline(stages=[regressor(kind)]).fit(rows.select("features", "label"))


def score(model: PipelineModel, scaled: DataFrame, params: DataFrame) -> DataFrame:
    """Predicted speed in km/h next to the real one."""
    bounds = params.first()
    predicted = model.transform(as_vectors(scaled))
    speed = features.unscale_target(F.col("prediction"), bounds.y_min, bounds.y_max)
    return predicted.select("route_id", "feed", "date", "split", "target_speed_kmh",
                            speed.alias("predicted_speed_kmh"))


def error_metrics(scored: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    error = F.col(predicted).cast("double") - F.col(actual).cast("double")
    return scored.groupBy(*by).agg(
        round_mean(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        round_mean(F.avg(F.abs(error)), 4).alias("mae"),
        F.count(F.lit(1)).alias("samples"))


def model_record(spark: SparkSession, name: str, version: str, stage: str, uri: str) -> DataFrame:
    return (spark.createDataFrame([(name, version, stage, uri)],
                                  "model_name string, version string, stage string, "
                                  "artifact_uri string")
            .withColumn("updated_at", F.current_timestamp()))


def save_best(model: PipelineModel, folder: str, record: DataFrame, registry: str) -> None:
    """Store the model and add its registry row."""
    model.write().overwrite().save(folder)
    record.write.mode("append").parquet(registry)
