"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is named and the master is local, a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not jvm.isDefined() and not master.split("[")[0] == "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")
        named = jvm.get() if jvm.isDefined() else tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: written to the shared folder, so it outlives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
