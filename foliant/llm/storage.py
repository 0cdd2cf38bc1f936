"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..stages import saved, spent


def own_prefix(df: DataFrame, name: str) -> str:
    """A beginning of column names that no column of df has: name, with more underscores before it if need be."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["own_prefix", "read_table", "saved", "spent"]
