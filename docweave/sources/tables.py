"""Reading tables, and the two things every query needs from its session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a directory of tables, one file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Enough partitions for the cluster's cores before costly per-row work.

    A table that already has as many input splits as the cluster has cores is left alone, so large inputs pay no shuffle;
    only small files, which would run in one or two tasks, are dealt out.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 <= want else df


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut, so that losing an executor loses nothing.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset a local one is made on a single machine
    only; a cluster without a shared folder is an error.  Files go with the frame where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"docweave-{os.getuid()}"))
    return df.checkpoint(eager=True)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (installed packages and --py-files need no help)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
