"""All-or-nothing publication of several tables.

The tables are written below a folder of this attempt; one pointer, written last, names it. Readers go through the
pointer: a job that fails midway leaves nothing that they see, and a second publication is refused.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_POINTER = "folder STRING, tables ARRAY<STRING>"


def publish(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Write ``tables`` and then the pointer ``path/current``; refused where something is published already."""
    if not tables:
        raise ValueError("nothing to publish")
    save = lambda df: lambda folder: df.write.format(form).mode("errorifexists").save(folder)
    publish_parts(next(iter(tables.values())).sparkSession, {name: save(df) for name, df in tables.items()}, path)


def publish_parts(spark: SparkSession, parts: dict[str, Callable[[str], None]], path: str) -> None:
    """The same for writers of whole folders: each gets the folder it is to fill, and all become visible at once."""
    if not parts:
        raise ValueError("nothing to publish")
    if _pointer(spark, path) is not None:
        raise ValueError(f"{path} is published already")
    folder = f"attempt-{uuid.uuid4().hex}"
    for name, write in parts.items():
        write(f"{path}/{folder}/{name}")
    spark.createDataFrame([(folder, list(parts))], _POINTER).coalesce(1).write.mode("errorifexists").json(f"{path}/current")


def _pointer(spark: SparkSession, path: str):
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    store = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The commit protocol leaves its mark when the pointer is whole.
    if not store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current/_SUCCESS")):
        return None
    return spark.read.schema(_POINTER).json(f"{path}/current").first()


def published_folder(spark: SparkSession, path: str, name: str) -> str:
    """Where one table or part of what is published at ``path`` lies."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise ValueError(f"nothing is published at {path}")
    if name not in pointer["tables"]:
        raise ValueError(f"{path} has no table {name}")
    return f"{path}/{pointer['folder']}/{name}"


def published(spark: SparkSession, path: str, name: str, schema=None, form: str = "parquet") -> DataFrame:
    """One table of what is published at ``path``."""
    reader = spark.read.format(form) if schema is None else spark.read.format(form).schema(schema)
    return reader.load(published_folder(spark, path, name))
