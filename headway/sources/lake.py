"""Lake tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headway import schemas


def bronze(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """All generations of the position table; columns a generation lacks are null."""
    wanted = schemas.BRONZE_POSITION if schema is None else schema
    return spark.read.schema(wanted).parquet(*paths)


def union_generations(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def feature_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Samples and the one-row scaler table."""
    scaler = spark.read.option("multiLine", True).json(f"{folder}/scaler")
    floats = {c: F.col(c).cast("array<float>") for c in ("x_min", "x_max")}
    return spark.read.parquet(f"{folder}/samples"), scaler.withColumns(floats)
