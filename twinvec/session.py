"""Session helpers: a tuned local session for tests/bench and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "twinvec", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings the library is designed for.

    On a cluster the caller's session wins: ``getOrCreate`` keeps its settings and we only
    add what is unset.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is used as is.
    Only when it is unset (local runs and tests) do we create a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="twinvec-ckpt-", dir=os.environ.get("TWINVEC_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df, *partition_by: str):
    """Cut lineage: write ``df`` as a parquet table under the session's checkpoint folder and read it back.

    The folder is the shared one named by ``spark.checkpoint.dir``; a lost executor then
    costs a re-read, never a replay of the lineage. Parquet keeps the schema, compresses,
    and lets later reads prune columns and push filters (faster than RDD checkpoint files).
    """
    spark = df.sparkSession
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/twinvec-tables/" + uuid.uuid4().hex
    # Version 2 pages hold integers such as positions as packed differences.
    df.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    if partition_by:  # with the schema, since a table without rows has no file that tells it
        back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    else:
        back = spark.read.parquet(path)
    back.stored_at = path
    return back


def discard(*tables) -> None:
    """Delete the files of tables that ``checkpoint`` returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
