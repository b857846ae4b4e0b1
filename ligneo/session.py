"""Session settings shared by tests, the benchmark and jobs."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master=None, shuffle_partitions=None, app="ligneo", driver_memory=None):
    """A session with the settings the operators were planned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local master may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ligneo-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    A lost executor costs no recomputation, and every later pass reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
