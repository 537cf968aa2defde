"""Tables in runs, of which a numbered list says what counts.

A run writes its rows into folders of its own (``<root>/<layer>/run=<id>/...``), which nobody reads yet.
It is published by one rename of a small file, the list of the dates and the run that holds each; the
highest number is the list in force. Until the rename every reader sees the tables as they were, and
a run that dies leaves folders that no list names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headway.session import children, remove

LISTS = "_published"
DATE = "ingestion_date"


def write_run(df: DataFrame, root: str, layer: str, run: str, partition_by: Sequence[str] = (DATE,),
              cluster_by: Sequence[str] = ()) -> None:
    """The rows of one run; a repeated write of the run replaces them.

    A folder per value of ``partition_by``, so that has to be few; rows of equal ``cluster_by`` lie together
    in the files, whose statistics let a reader skip the others.
    """
    together = (*partition_by, *cluster_by)
    balanced = df.hint("rebalance", *together) if together else df
    if cluster_by:
        balanced = balanced.sortWithinPartitions(*together)
    balanced.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{layer}/run={run}")


def read_run(spark: SparkSession, root: str, layer: str, run: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{layer}/run={run}")


def in_force(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The number and content of the list in force; (0, {}) before the first one."""
    numbers = [int(n.removesuffix(".json")) for n in children(spark, f"{root}/{LISTS}") if n.endswith(".json")]
    if not numbers:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{root}/{LISTS}/{max(numbers)}.json").first().value
    return max(numbers), json.loads(text)


def publish(spark: SparkSession, root: str, after: int, content: dict) -> int:
    """Put a list in force in place of number ``after``; fails if another run was faster."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    final = path(f"{root}/{LISTS}/{after + 1}.json")
    aside = path(f"{root}/{LISTS}/.{after + 1}-{uuid.uuid4().hex}.tmp")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if files.exists(final) or not files.rename(aside, final):
        raise RuntimeError(f"list {after + 1} of {root} was published by another run")
    return after + 1


def dated(spark: SparkSession, root: str, layer: str, schema: T.StructType, dates: dict[str, str],
          date: str = DATE) -> DataFrame:
    """A layer's rows of the given dates, each from the run that holds it; other folders are not read."""
    if not dates:
        return spark.createDataFrame([], schema)
    by_run: dict[str, list[str]] = {}
    for day, run in dates.items():
        by_run.setdefault(run, []).append(day)
    chosen = F.lit(False)
    for run, own in by_run.items():
        chosen = chosen | ((F.col("run") == run) & F.col(date).isin(*own))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])) \
        .parquet(f"{root}/{layer}")
    return rows.where(chosen).select(*schema.names)


def vacuum(spark: SparkSession, root: str, layers: Sequence[str], keep: int = 2) -> list[str]:
    """Remove runs that none of the last ``keep`` lists names, and older lists."""
    last, _ = in_force(spark, root)
    named: set[str] = set()
    for n in children(spark, f"{root}/{LISTS}"):
        if n.endswith(".json") and int(n.removesuffix(".json")) > last - keep:
            content = json.loads(spark.read.option("wholetext", True).text(f"{root}/{LISTS}/{n}").first().value)
            named |= {content.get("gold"), *content["dates"].values()}
        else:
            remove(spark, f"{root}/{LISTS}/{n}")
    gone = sorted({(layer, n) for layer in layers for n in children(spark, f"{root}/{layer}")
                   if n.removeprefix("run=") not in named})
    for layer, n in gone:
        remove(spark, f"{root}/{layer}/{n}")
    return [f"{layer}/{n}" for layer, n in gone]
