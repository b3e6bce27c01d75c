"""Session settings shared by tests, the benchmark and standalone runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with adaptive execution and skew handling on.

    Cluster deployments pass ``master=None`` and keep their own sizing; only
    settings that change plans rather than resources are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables: the one named in ``spark.checkpoint.dir``.

    Only a session that runs wholly in this process (``local[...]``) may lack the
    setting; it gets a temporary folder. On a cluster every executor would write to
    its own disk, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tillwise-ckpt-")
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Unlike a row checkpoint this keeps columnar storage, pruning and size
    statistics, and lost executors cannot undo it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint so lost executors cannot undo it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
