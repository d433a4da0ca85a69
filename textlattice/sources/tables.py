"""Table access through Spark's readers only, so any store Spark can open will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` as a DataFrame (a file or a folder of files)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores: a small table is one row group, so one task.

    Only a table that is scanned in fewer tasks than cores is sent once more, a few hundred megabytes at most; larger ones stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Without that setting only a local session gets one, since its driver and executors share a disk; a cluster does not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/textlattice-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
