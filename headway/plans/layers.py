"""The lake's daily run: Bronze to Silver to Gold, as written tables, with checks in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from headway.operators import clean, kpis, quality
from headway.session import materialise
from headway.sinks import lake as sinks
from headway.sources import lake as sources


def silver_part(bronze: DataFrame, dates: Sequence[str] | None = None) -> DataFrame:
    """Silver of all dates, or of some.

    Time buckets never cross midnight, so a date can be rebuilt alone.
    """
    part = bronze if dates is None else bronze.where(F.col("ingestion_date").isin(*dates))
    return clean.stamped(clean.silver(part))


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The Silver table as it stands; none before the first run."""
    try:
        table = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return table.withColumn("ingestion_date", F.col("ingestion_date").cast("string"))


def run(spark: SparkSession, bronze_folder: str, silver_folder: str, gold_folder: str,
        dates: Sequence[str] | None = None) -> DataFrame:
    """Build both layers and return the check report.

    Both are written aside and checked first; a failed check raises and leaves the published tables
    as they were. Rolling means look back over dates, so Gold is rebuilt whole.
    """
    part = materialise(silver_part(sources.bronze(spark, bronze_folder), dates), "silver")
    old = None if dates is None else published(spark, silver_folder)
    whole = part if old is None else part.unionByName(
        old.where(~F.col("ingestion_date").isin(*dates)))
    gold = materialise(clean.stamped(kpis.gold(whole)), "gold")
    report = quality.report(
        part, "silver", quality.silver_not_null() + quality.silver_accepted_values()
    ).unionByName(quality.report(gold, "gold", quality.gold_not_null()))
    quality.require(report)
    if dates is None:
        sinks.refresh(part, silver_folder, sinks.LAKE_PARTITIONS)
    else:
        sinks.overwrite_partitions(part, silver_folder, *sinks.LAKE_PARTITIONS)
    sinks.refresh(gold, gold_folder)
    return report
