"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join of few bytes can make many rows, so it keeps a task for every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a crowded join key also where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches to Python workers are bounded in bytes, so that rows with long texts do not pile up; a batch
    # lies beside the heap several times, and its buffers stay with the executor.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    # Keyed stream state spills to disk instead of living on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Checkpoints upload changes, not whole snapshots; a join keeps one store per partition.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    # Sessions of one key are merged inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Settings that must be given before the session starts.
START_CONF = {
    # No call-site capture for every column expression; plans build in half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "headway") -> SparkSession:
    """A one-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in START_CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if is_local(spark) and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The stock value, on one machine: stateful streams cannot coalesce it at run time.
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


#: Folders made for local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}
#: Where each materialised table that is still in use lies.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master with the setting unset; the setting belongs
    to the running context and cannot be changed, so the folder is remembered here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[name] = tempfile.mkdtemp(prefix="headway-")
    return _LOCAL_ROOTS[name]


def own_root(spark: SparkSession) -> str:
    """This application's folder below the shared root."""
    return f"{shared_root(spark)}/headway/{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root."""
    return f"{own_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system; one that is missing is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the shared file system; none if it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a DataFrame below the shared root and read it back.

    Cuts the lineage, so a branch that reads the result twice computes it once, and the result
    outlives any executor. ``discard`` removes a table that a later one has replaced.
    """
    path = work_dir(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            remove(table.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Remove all that this application has written below the shared root, results included."""
    remove(spark, own_root(spark))
