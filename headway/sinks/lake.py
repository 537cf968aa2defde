"""Lake sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from headway import schemas
from headway.functions import times
from headway.operators import clean, features

LAKE_PARTITIONS = ("feed", "ingestion_date")


def bronze_rows(positions: DataFrame) -> DataFrame:
    """Complete positions in the lake's column order, dated by event time."""
    dated = clean.complete(positions).withColumn(
        "ingestion_date", times.partition_date(F.col("event_ts")))
    return dated.select(*schemas.BRONZE_POSITION.fieldNames())


def bronze_sink(positions: DataFrame, folder: str, checkpoint: str,
                table_format: str = "parquet") -> DataStreamWriter:
    """Streaming writer of Bronze, partitioned by feed and date; files commit per batch.

    ``table_format`` takes other formats whose package is on the classpath.
    """
    return (bronze_rows(positions).writeStream.format(table_format).outputMode("append")
            .partitionBy(*LAKE_PARTITIONS).option("compression", "snappy")
            .option("path", folder).option("checkpointLocation", checkpoint))


def _balanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one partition together, so files are few; a large partition is split again."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def overwrite_partitions(df: DataFrame, folder: str, *partition_by: str) -> None:
    """Replace only the partitions present in ``df``, so a retried load repeats nothing."""
    (_balanced(df, partition_by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(folder))


def land_records(records: DataFrame, ingestion_date: str, folder: str) -> None:
    """Unpacked schedule records as they came, by feed, date and table."""
    overwrite_partitions(records.withColumn("ds", F.lit(ingestion_date)), folder,
                         "feed_name", "ds", "table_name")


def load_static(table: DataFrame, folder: str) -> None:
    """Bronze load of a schedule table that carries its load metadata."""
    overwrite_partitions(table, folder, "_feed_name", "_ingestion_date")


def refresh(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Full rebuild of a Silver or Gold table."""
    _balanced(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(folder)


def append_feed_log(rows: DataFrame, folder: str) -> None:
    clean.stamped(rows, "created_at").write.mode("append").parquet(folder)


def save_feature_store(samples: DataFrame, params: DataFrame, folder: str,
                       seq_len: int = features.SEQUENCE_LENGTH) -> None:
    """Samples with x, raw and scaled target as Parquet; the scaler row, with the length used, as JSON."""
    samples.write.mode("overwrite").parquet(f"{folder}/samples")
    document = params.withColumns({
        "feature_cols": F.array(*[F.lit(c) for c in features.FEATURES]),
        "seq_len": F.lit(seq_len)})
    document.write.mode("overwrite").json(f"{folder}/scaler")


def fan_out(*writers: DataStreamWriter) -> list:
    """Start several sinks in one session; each has its own checkpoint."""
    return [w.start() for w in writers]


def per_batch(writer: DataStreamWriter, *targets) -> DataStreamWriter:
    """One streaming query that hands every batch to several functions (batch, batch id)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        for target in targets:
            target(kept, batch_id)
        kept.unpersist()

    return writer.foreachBatch(write)
