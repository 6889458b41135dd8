"""Tables written to the cluster's shared folder, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset in
local mode (tests, notebooks) a folder under /tmp is set for the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: Spark's setting to delete a query's shuffle files when it has ended, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch where the session leaves them open: a few blocks of texts. Each core's worker and its executor hold several batches
#: at a time, in and out, and keep what they grew to; with Spark's 10,000 rows a batch that is ten times as much for texts of 3 kB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """The session's limit on an Arrow batch, set where it is unset; it stays, for results that are computed later."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a lost executor
    costs a reread, not a recomputation. What was shuffled for it is given up."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex}"
    known = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, known)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for table in tables:
        path = getattr(table, "_verdigris_path", None)
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
