"""Cutting lineage, and numbering rows without one task for all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and the master is local, since no other machine would see it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with a column of numbers from 0 in an order without ties: range partitions number their own rows after those of the partitions before."""
    part, before = f"{name}_part", f"{name}_before"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    offsets = counts.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))  # a row for each partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), part).withColumn(name, (own + F.col(before)).cast("long")).drop(part, before)
