"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the whole cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: later jobs start from durable rows."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space, counted without building the words."""
    return F.when(text.rlike(r"\S"), F.length(F.regexp_replace(text, r"\s*+\S++\s*+", "x"))).otherwise(0).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only for a counted, narrow table; beyond ``rows`` the join shuffles (AQE splits hot keys)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
