"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where it is unset, one of our own, but only in
    local mode: on a cluster no other machine could read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="retort-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df (cut before, so counting is cheap), marked for broadcast up to a number of rows."""
    return F.broadcast(df) if df.count() <= rows else df
