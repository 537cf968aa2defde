"""Keyed state that expires: who is present, until when, and what was last heard.

Every row keeps its key present for a lifetime; rows whose lifetimes touch form one presence. State
holds the open presences only, and an event-time timer drops each one when the watermark passes its
end, so state is bounded by the live fleet, also for keys that never fall silent. Keys are dealt to
shards; a shard's presences are one columnar state value, merged by vectorised steps, so the Python
cost follows the rows and shards of a batch and not its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headway.operators import clean
from headway.session import children, remove
from headway.sources.messages import watermarked

SHARDS = 64
NEWEST = ("ingested_at", "event_ts", "entity_id")
STATE = T.StructType([T.StructField("presences", T.BinaryType())])


def merged(rows: pd.DataFrame, keys: Sequence[str], newest: Sequence[str]) -> pd.DataFrame:
    """Presences that touch become one: first begin, last end, and the newest row's columns."""
    rows = rows.sort_values([*keys, "first_seen"], kind="stable", ignore_index=True)
    group = rows.groupby(list(keys), sort=False, dropna=False)
    ends = group["expires_at"].cummax().shift()
    opens = (group.cumcount() == 0) | (rows["first_seen"] > ends)
    rows["_presence"] = opens.cumsum()
    span = rows.groupby("_presence").agg(first_seen=("first_seen", "min"), expires_at=("expires_at", "max"),
                                         _touched=("_touched", "any"))
    last = rows.sort_values(list(newest), kind="stable", na_position="first").drop_duplicates("_presence", keep="last")
    return last.drop(columns=list(span.columns)).join(span, on="_presence")[[c for c in rows if c != "_presence"]]


def _stacked(*frames: pd.DataFrame) -> pd.DataFrame:
    """Frames below each other; a column of nulls takes the type it has elsewhere."""
    tables = [pa.Table.from_pandas(f, preserve_index=False) for f in frames]
    return pa.concat_tables(tables, promote_options="permissive").to_pandas()


def changes(rows: DataFrame, keys: Sequence[str], lifetime_s: int, newest: Sequence[str] = NEWEST,
            shards: int = SHARDS, delay: str | None = None) -> DataFrame:
    """Change rows of every key's presences, for update mode: ``rows`` with first_seen, expires_at, alive.

    A presence that a batch touched comes out alive with its newest row; when the watermark reaches
    its end, ``lifetime_s`` after its last row, it comes out once more, not alive, and its state is gone.
    A row exactly ``lifetime_s`` after another still belongs to its presence.
    """
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField("first_seen", T.TimestampType()),
                           T.StructField("expires_at", T.TimestampType()), T.StructField("alive", T.BooleanType())])
    lifetime, names = pd.Timedelta(seconds=lifetime_s), [f.name for f in fields]

    def step(_, frames, state: GroupState):
        if state.exists:
            with pa.ipc.open_stream(state.get[0]) as reader:
                held = reader.read_pandas()
        else:
            held = None
        for frame in frames:
            if frame.empty:  # A timer's turn brings no rows.
                continue
            frame = frame[names].assign(first_seen=frame["event_ts"], expires_at=frame["event_ts"] + lifetime,
                                        _touched=True)
            held = merged(frame if held is None else _stacked(held, frame), keys, newest)
        if held is None:
            return
        now = state.getCurrentWatermarkMs()
        over = held["expires_at"] <= pd.Timestamp(max(now, 0), unit="ms")
        told = held[over | held["_touched"]]
        if len(told):
            yield told.drop(columns="_touched").assign(alive=~over[told.index])
        held = held[~over].assign(_touched=False)
        if len(held):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(held, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            end = int(held["expires_at"].min().value // 1_000_000)
            state.setTimeoutTimestamp(max(end - 1, now + 1))
        else:
            state.remove()

    dated = watermarked(rows, delay) if delay else watermarked(rows)
    dealt = dated.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandasWithState(
        step, schema, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def live(told: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The present keys after all changes told so far, with first_seen and expires_at.

    The last presence of a key ends last; of what was told about it the highest version counts.
    """
    last = clean.newest_per(told, keys, [F.col("expires_at"), F.col(version), ~F.col("alive")])
    return last.where("alive").drop("alive", version)


def live_table(told: DataFrame, keys: Sequence[str], folder: str, checkpoint: str, then=None) -> DataStreamWriter:
    """Writer that upserts changes into a table of the present keys, one version per batch (see ``read_live``).

    A batch builds version n from version n - 1 and removes version n - 2, so a repeated batch finds
    its input again and leaves the same rows. ``then(table, batch id)`` may use the new version.
    """
    spark, schema = told.sparkSession, told.drop("alive").schema

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.withColumn("_n", F.lit(1))
        if batch_id:
            before = spark.read.schema(schema).parquet(f"{folder}/version={batch_id - 1}")
            known = known.unionByName(before.withColumns({"alive": F.lit(True), "_n": F.lit(0)}))
        live(known, keys, "_n").select(*schema.names).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        if then is not None:
            then(spark.read.schema(schema).parquet(f"{folder}/version={batch_id}"), batch_id)
        if batch_id > 1:
            remove(spark, f"{folder}/version={batch_id - 2}")

    return told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_live(told: DataFrame, folder: str) -> DataFrame:
    """The newest finished version of a live table."""
    spark = told.sparkSession
    newest = max(int(name.removeprefix("version=")) for name in children(spark, folder)
                 if "_SUCCESS" in children(spark, f"{folder}/{name}"))
    return spark.read.schema(told.drop("alive").schema).parquet(f"{folder}/version={newest}")
