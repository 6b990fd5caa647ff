"""Session defaults for a cluster, and the shared folder the session names."""

import os
import tempfile

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks join sides from measured sizes, splits skewed partitions and merges small
# ones, so only the upper bound of the shuffle width is set by hand.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # The JVM never compiles a method above 8,000 bytes of code; past that size split code is the faster form.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Without it every column operation in Python also records its source line, at several calls to the JVM each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app: str = "bundlelens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, ready for checkpoints and written tables.

    Where the setting is absent a scratch folder is made, but only for a local master: executors on
    other machines could not see it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="bundlelens-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def hold(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to a table in the shared folder, and return that table.

    What it was computed from is then not repeated by each reader, nor by a task that is run again.
    """
    path = f"{shared_dir(df.sparkSession)}/held/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
