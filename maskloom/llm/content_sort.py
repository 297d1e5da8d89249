"""Exact document dedup by content sort.

Normalised texts (white space deleted) are range-partitioned by splitters that Spark samples from
their first characters and a hash (so that many texts with one beginning spread), sorted externally inside each partition, and compared with their neighbours; of each run of
equals one row stays. Only built-in SQL functions run.

A text that fills a large share of the rows or bytes would end in one range. Such texts (at most a
few per partition, so their list has a proven bound and may be broadcast) get a salt as second sort key:
their run is cut into ``salts`` pieces that are sorted as separate ranges, and the heads of the
pieces are sorted once more. The rule only spreads work; the answer is the same with or without it.

Defined cases: a null text counts as empty, all empty texts are one group, a null id sorts last,
repeated rows stay separate rows of which one is kept, an empty table gives an empty result. Only
the id and the text column are read; other columns may have any name.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import shuffle_partitions, stage, text_or_empty

PREFIX = 64


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the longest original text (code points), then the smallest id, stays.
    """
    parts = shuffle_partitions(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("len"), F.regexp_replace(text, r"\s+", "").alias("norm"))
    rows = rows.withColumn("mark", F.xxhash64("norm"))

    marks = cut_lineage(rows.groupBy("mark").agg(F.count("*").alias("n"), F.sum(F.length("norm") + 1).alias("size")))
    whole = marks.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    hot = (marks.filter((F.col("n") > 1) & ((F.col("n") * 4 * parts > (whole["n"] or 0)) | (F.col("size") * 4 * parts > (whole["size"] or 0))))
           .select("mark", F.lit(True).alias("hot")))  # at most 8 * parts rows
    rows = rows.join(F.broadcast(hot), "mark", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))

    best = [F.col("len").desc(), F.col("id").asc_nulls_last()]
    # Splitters are sampled from a bounded prefix and a hash, never from whole texts; equals agree in both.
    rows = rows.withColumn("prefix", F.substring("norm", 1, PREFIX))
    run = Window.partitionBy("prefix", "mark", "salt", "norm")
    first = run.orderBy(*best)
    every = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = (rows.repartitionByRange(parts, "prefix", "mark", "salt")
             .select("id", "len", "norm", "hot", "salt", F.row_number().over(first).alias("place"),
                     F.first("id").over(every).alias("head"), F.count("*").over(every).alias("size"))
             .select("id", "len", "hot", "salt", "place", "head", "size", F.sha2("norm", 256).alias("sha"),
                     F.when(F.col("hot") & (F.col("place") == 1), F.col("norm")).alias("norm")))
    local = stage(local, "content-sort")

    single = local.filter(~F.col("hot")).select("id", F.col("head").alias("keep_id"), F.col("size").alias("group_size"),
                                                (F.col("place") == 1).alias("kept"), "sha")
    over = Window.partitionBy("prefix", "norm")
    ahead = over.orderBy(*best, "salt")
    heads = (local.filter(F.col("hot") & (F.col("place") == 1)).withColumn("prefix", F.substring("norm", 1, PREFIX)).repartitionByRange(parts, "prefix")
             .select("sha", "salt", F.first("id").over(ahead).alias("keep_id"), F.sum("size").over(over).alias("group_size"),
                     (F.row_number().over(ahead) == 1).alias("leads")))
    spread = (local.filter("hot").select("id", "sha", "salt", "place").join(heads, ["sha", "salt"])
              .select("id", "keep_id", "group_size", (F.col("leads") & (F.col("place") == 1)).alias("kept"), "sha"))
    return (single.unionByName(spread)
            .select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")))
