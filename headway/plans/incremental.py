"""The lake's daily run on some dates: only these are read from Bronze, and all layers change at once.

Silver, counts that add up (``kpis.partials``) and the indicators of a date come from that date alone.
What looks at other days, the rolling mean, is taken over the stored indicators, a row per route and
day. All layers are written as a run, checked, and put in force by one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headway import schemas
from headway.operators import clean, kpis, quality
from headway.plans.layers import silver_part
from headway.sinks import published
from headway.sources import lake

LAYERS = ("silver", "partials", "daily", "gold")


def _schema(spark: SparkSession, layer: str) -> T.StructType:
    """The layout of a layer, from an empty Bronze."""
    silver = clean.stamped(clean.silver(spark.createDataFrame([], schemas.BRONZE_POSITION)))
    parts = kpis.partials(silver)
    made = {"silver": lambda: silver, "partials": lambda: parts, "daily": lambda: kpis.daily(parts),
            "gold": lambda: clean.stamped(kpis.with_windows(kpis.daily(parts)))}
    return made[layer]().schema


def read(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """A layer as it is published."""
    _, content = published.in_force(spark, root)
    schema = _schema(spark, layer)
    if layer == "gold":
        return published.read_run(spark, root, "gold", content["gold"], schema) if content \
            else spark.createDataFrame([], schema)
    return published.dated(spark, root, layer, schema, content.get("dates", {}))


def run(spark: SparkSession, bronze_folder: str, root: str, dates: Sequence[str] | None = None,
        run_id: str | None = None) -> DataFrame:
    """Build all layers of some dates, or of all, and return the check report.

    A failed check raises, and so may the machine: the published tables stay as they were, and the
    run can be repeated. A date without rows in Bronze goes from all layers.
    """
    run_id = run_id or uuid.uuid4().hex
    number, before = published.in_force(spark, root)

    def layer(name: str, rows: DataFrame, partition_by: Sequence[str] = (published.DATE,)) -> DataFrame:
        published.write_run(rows, root, name, run_id, partition_by)
        return published.read_run(spark, root, name, run_id, rows.schema)

    silver = layer("silver", silver_part(lake.bronze(spark, bronze_folder), dates), (published.DATE, "feed"))
    parts = layer("partials", kpis.partials(silver))
    daily = layer("daily", kpis.daily(parts))

    here = [r[0] for r in silver.select(published.DATE).distinct().collect()]  # One row per date.
    held = {} if dates is None else {d: r for d, r in before.get("dates", {}).items() if d not in set(dates)}
    older = published.dated(spark, root, "daily", daily.schema, held)
    gold = layer("gold", clean.stamped(kpis.with_windows(daily.unionByName(older))), ())

    report = quality.report(
        silver, "silver", quality.silver_not_null() + quality.silver_accepted_values()
    ).unionByName(quality.report(gold, "gold", quality.gold_not_null()))
    quality.require(report)
    published.publish(spark, root, number, {"gold": run_id, "dates": held | {d: run_id for d in here}})
    return report
