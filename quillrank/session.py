"""Session defaults and the shared folder that long lineages are cut into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows that a task sorts or gathers at a time.
TASK_ROWS = 500_000

_local_dirs: list[tempfile.TemporaryDirectory] = []


def build_session(app: str = "quillrank", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    ``master`` stays unset on a cluster so that spark-submit decides it. On a
    local master the shuffle width follows the core count; on a cluster the
    width is the cluster's own setting and adaptive execution coalesces it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, reachable from every executor.

    Reads ``spark.checkpoint.dir``. Only a local master with nothing configured
    gets a temporary folder, since there driver and executors are one machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        holder = tempfile.TemporaryDirectory(prefix="quillrank-")
        _local_dirs.append(holder)
        configured = holder.name
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Used where two consumers must see the very same rows (sampled range bounds,
    partition numbers), or where an iterative fit would replay a long lineage.
    A lost executor then re-reads files instead of recomputing the plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the session has task slots.

    A large input already has more splits than slots and is left as it is.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots, *keys) if scan.rdd.getNumPartitions() < slots else scan


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for ``rows`` rows that sort or gather them: ``each`` rows a task at most on average, no fewer tasks than slots.

    Adaptive execution makes few tasks of a shuffle whose bytes are few; their rows in memory are many times as large.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's part of the shared folder once its results are written."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
