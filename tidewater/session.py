"""Session settings and the shared scratch location."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What a cluster run should start with: AQE splits skewed joins and merges small
# shuffle partitions, so the initial partition number can be generous.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, name: str = "tidewater", memory: str = "12g",
                  **conf: str) -> SparkSession:
    """One local JVM, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_USED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`.

    Where a session leaves it unset, a folder beside the warehouse tables takes its place. A warehouse on the
    driver's own disk is refused unless the executors run in the driver, as they could not reach it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not local and (warehouse.startswith(("file:", "/")) or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{warehouse}/_steps".rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for this application's intermediate data, deleted when Python ends."""
    own = f"{shared_folder(spark)}/tidewater-{spark.sparkContext.applicationId}"
    if own not in _USED:
        _USED.add(own)
        atexit.register(discard, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored path is there; one question to the store, nothing is listed."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a step that nothing reads any more; a stopped session leaves it to the store's own expiry."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def open_writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes in here keep up to `most` directories open in a task, and so need not sort its rows by directory first.

    A task that meets more directories sorts the rest, as usual.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Store a step of an iteration in the shared folder and go on from the stored rows.

    This cuts the plan's lineage, survives a lost executor, runs the step once and gives
    the next one real sizes to choose its joins by.
    """
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
