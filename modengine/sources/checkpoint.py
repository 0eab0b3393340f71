"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the session's shared checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{named or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints'}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the session's checkpoint folder and go on from there,
    so that an executor lost later does not repeat the work behind it.

    The folder is the one the session names in ``spark.checkpoint.dir``; where it is
    unset, one in the warehouse, which every executor shares as well.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(folder or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()
