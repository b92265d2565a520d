"""What Python stages need from a session."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it (locally, or installed at one path everywhere)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: a scan of few row groups is dealt out once, others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
