"""Message sinks: keyed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value): the key column as text and the whole row as JSON."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")
    if key is None:
        return df.select(F.lit(None).cast("string").alias("key"), value)
    return df.select(F.col(key).cast("string").alias("key"), value)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None,
               every: str | None = None) -> DataStreamWriter:
    """Streaming writer to a topic. Needs Spark's Kafka package on the classpath."""
    writer = (to_messages(df, key).writeStream.format("kafka").outputMode("append")
              .option("kafka.bootstrap.servers", servers).option("topic", topic)
              .option("checkpointLocation", checkpoint))
    return writer.trigger(processingTime=every) if every else writer


def json_sink(df: DataFrame, folder: str, checkpoint: str, key: str | None = None
              ) -> DataStreamWriter:
    """Streaming writer to JSON lines, one message per line; the files are gzipped, as messages repeat all names."""
    return (to_messages(df, key).select("value").writeStream.format("text").outputMode("append")
            .option("compression", "gzip").option("path", folder).option("checkpointLocation", checkpoint))
