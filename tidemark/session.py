"""Session settings and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g"):
    """A session for tests and benchmarks; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # no call-site capture per column expression: plans here hold thousands
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # HotSpot never compiles methods above 8000 bytes of bytecode; let Spark split those
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder and cut its lineage.

    The folder comes from `spark.checkpoint.dir`. Only a local-mode session
    without that setting falls back to a temporary folder; a cluster session
    must name shared storage, because executors have to read the files back.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet files in the checkpoint folder, for rows that several later steps read parts of.

    Unlike `checkpoint`, the files are compressed, and a reader takes only the columns and row
    groups it needs.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
