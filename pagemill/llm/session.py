"""What the operators of this subpackage need from a session."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
# Python workers give the memory of large arrays back at once, and keep some for smaller ones: fresh pages cost their time.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> SparkSession:
    """Give the checkpoint folder to the context, and let Python workers find this package where the driver did.

    The folder is the one that the cluster names in spark.checkpoint.dir; only a local session without that setting gets
    a folder of its own. Arrow batches get at most ROWS_A_BATCH rows unless the session says otherwise, for texts are long.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)
    for name, value in WORKERS.items():
        sc.environment.setdefault(name, value)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-checkpoint-"))
    if spark.conf.get(BATCH) == "10000":  # Spark's own default
        spark.conf.set(BATCH, str(ROWS_A_BATCH))
    return spark


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, without its lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)
