"""Session settings and the shared folder for data that must outlive a task."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that suit these jobs on any cluster; sizes (memory, shuffle partitions) stay with the operator.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # lets a session window merge its rows before the shuffle, so that one hot key stays small
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores="*", shuffle_partitions=8, memory="8g", app="gitgauge"):
    """A session for tests and the bench; on a cluster use the session that is already there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark, purpose):
    """A new folder below ``spark.checkpoint.dir``. A temporary folder stands in only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gitgauge-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose):
    """The frame, computed once into the shared folder and read back; cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark):
    """Shuffle files of the jobs in the block go when their job ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def task_count(df) -> int:
    """Tasks to deal rows over by default. An explicit number, since adaptive execution merges small partitions otherwise."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
