"""Session helpers: local/test session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    # model calls are not repeatable: never run a task twice on purpose
    "spark.speculation": "false",
    # rows carry up to 2 MB of text: bound the rows per columnar and per Arrow batch
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

# Settings a cluster session should carry for ~100 TB of content (documented, not applied here):
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",              # initial; AQE coalesces by measured size
    "spark.sql.files.maxPartitionBytes": "256m",          # ~400 k scan tasks for 100 TB
    "spark.sql.parquet.columnarReaderBatchSize": "1024",  # <= 2 GB of text per reader batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    "spark.speculation": "false",
    "spark.task.maxFailures": "8",                        # executors may be lost at any time
}


def local_session(app: str = "docweave", cpus: int | str = "*", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench; cluster jobs bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it; only a local session (tests) without it takes a fresh scratch folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="docweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique table location below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as parquet to the shared folder and reading it back.

    Survives executor loss (the files are on shared storage), unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
