"""Work on whole Arrow batches of gathered masks or planes: slices of bounded size, lists as flat arrays."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SLABS = "array<struct<x0: bigint, x1: bigint, y0: bigint, y1: bigint>>"
POINTS = "array<struct<x: double, y: double>>"
SLICE = 200_000  # slabs (or vertices) worked on at once; a single mask is never cut


def spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gather(slabs: DataFrame, *keys: str) -> DataFrame:
    """One row per mask with its slabs as an array.

    The explicit count keeps the per-mask work that follows spread over all tasks: its cost is in
    computing, which the byte sizes that AQE coalesces by do not show.
    """
    return spread(slabs, *keys).groupBy(*keys).agg(F.collect_list(F.struct("x0", "x1", "y0", "y1")).cast(SLABS).alias("slabs"))


COLUMNS = 512


def gather_columns(slabs: DataFrame, keys: list[str], *more: str, block: int = COLUMNS) -> DataFrame:
    """One row per key and block of columns with its slabs (x0, x1, y0, y1, then ``more``) as an array.

    Slabs are cut at the block borders, so a crowded key spreads over many rows.
    """
    parts = "sequence(x0 div {0}, (x1 - 1) div {0})".format(block)
    cut = slabs.filter("x0 < x1 AND y0 < y1").withColumn("_block", F.explode(F.expr(parts))).withColumns({
        "x0": F.expr(f"CAST(greatest(x0, _block * {block}) AS BIGINT)"), "x1": F.expr(f"CAST(least(x1, (_block + 1) * {block}) AS BIGINT)"),
        "y0": F.expr("CAST(y0 AS BIGINT)"), "y1": F.expr("CAST(y1 AS BIGINT)")})
    return spread(cut, *keys, "_block").groupBy(*keys, "_block").agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", *more)).alias("slabs"))


def per_batch(df: DataFrame, lists: str, keys: list[str], made: str, work) -> DataFrame:
    """``keys`` of ``df`` and the columns ``made``, by ``work`` on slices of bounded size.

    ``work(owner, flat, table)`` gets the flattened structs of the array column ``lists`` with the row each belongs
    to, and the slice; it returns the arrays of ``made`` and, where that is not one row for each row of the slice,
    the row each result belongs to.
    """
    fields = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(made).fields])
    kinds = T.StructType.fromDDL(made)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            sizes = np.asarray(whole.column(lists).combine_chunks().value_lengths().fill_null(0), np.int64)
            filled = np.concatenate([[0], np.cumsum(sizes)])
            start = 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(filled, filled[start] + SLICE, "right")) - 1)
                table = whole.slice(start, stop - start)
                flat = table.column(lists).combine_chunks().flatten()
                arrays, *rows = work(np.repeat(np.arange(stop - start), sizes[start:stop]), flat, table)
                own = table.select(keys) if not rows else table.select(keys).take(pa.array(rows[0]))
                for field, array in zip(kinds.fields, arrays):
                    kind = to_arrow_type(field.dataType)
                    own = own.append_column(field.name, array.cast(kind) if isinstance(array, pa.Array) else pa.array(array, kind))
                yield from own.to_batches()
                start = stop

    return df.mapInArrow(run, fields)


def matrix(flat: pa.StructArray, columns: int | None = None) -> np.ndarray:
    """Number fields of structs (the first ``columns`` of them), one row each."""
    return np.stack([np.asarray(flat.field(i)) for i in range(columns or flat.type.num_fields)], axis=1)


def point_lists(owner: np.ndarray, points: np.ndarray, count: int, null: np.ndarray | None = None) -> pa.Array:
    """Vertices, sorted by owner, as one list per owner; null where ``null`` says so."""
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(points[:, 0].astype(float)), pa.array(points[:, 1].astype(float))], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(offsets), each, mask=None if null is None else pa.array(null))
