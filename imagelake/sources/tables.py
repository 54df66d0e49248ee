"""Decoded tables: writing, reading, and cutting a long lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_table(df: DataFrame) -> DataFrame:
    """df stored by checkpoint() in the folder of spark.checkpoint.dir, or one of our own where that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: str = "image_id", mode: str = "overwrite") -> None:
    """Each table as Parquet below path, a folder for each image where the table has that column."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
