"""Session settings and the staging helper shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small partitions may hold much work (vectors, packed lists): merge them no further than to this size
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # a hot user's sessions merge in each map task before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # sides below this size (estimated, or measured by AQE) are broadcast; larger ones shuffle
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows placed by list id stay there for joins on (list, item) and (list, category)
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # vector means keep one buffer per list; stay on the hash path for usual task sizes
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


#: For jobs whose tables of lists and vectors grow with the input: ids and flags compress many times over, so the size of a
#: file says little about the rows that the driver would gather. What AQE measures is the size of the rows; the hash table that
#: the driver builds of a list's id is six times that, and every plan that reads the lists builds it again.
LEAN = {
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "512KB",
    "spark.sql.sources.fileCompressionFactor": "8",
}


#: Spark measures a batch for Arrow after each row, which costs many times what a small row does.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_session(app: str = "lapwing", master: str | None = None, shuffle_partitions: int | None = None, **extra):
    """Build a session; leave `master` empty on a cluster so that spark-submit decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere; a local session gets one shuffle partition per core."""
    for key in [*(LEAN.keys() - SETTINGS.keys()), BATCH_BYTES]:
        spark.conf.unset(key)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def lean(spark: SparkSession) -> SparkSession:
    """From here to the next `tune`, only tables that the driver can hold many times over are broadcast."""
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    return spark


def small_rows(spark: SparkSession, small: bool = True) -> SparkSession:
    """Whether rows sent to Arrow tasks are so small that their number alone bounds a batch."""
    spark.conf.set(BATCH_BYTES, str(2**31 - 1)) if small else spark.conf.unset(BATCH_BYTES)
    return spark


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's spark.checkpoint.dir, or a temp folder in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="lapwing-")
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and read it back: cuts lineage, survives executor loss, keeps column pruning and sizes.

    Spark removes shuffle files once the driver collects what refers to them: lean jobs, whose tables grow, have it collect now.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/lapwing/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) == LEAN["spark.sql.adaptive.autoBroadcastJoinThreshold"]:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
