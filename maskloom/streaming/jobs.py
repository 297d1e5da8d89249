"""Streams of tile results, edits, actions and new files.

Every job reads a growing folder and publishes per micro-batch into a folder named by the batch
id, which a replay overwrites: results are exactly-once without a transaction log of our own.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# State on local disk instead of executor heap, for key counts that follow the data.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DEFAULT_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema, streaming: bool = False, pattern: str = "*.parquet", files_per_batch: int = 256) -> DataFrame:
    """The append-only action log, as a batch or as a stream of its files, some per micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if streaming else spark.read
    return reader.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def _run(stream: DataFrame, sink, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Drain a stream; ``conf`` holds for the start of this query only, where the session says nothing else."""
    spark = stream.sparkSession
    mine = {k: v for k, v in (conf or {}).items() if spark.conf.get(k, None) in (None, DEFAULT_STATE)}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).foreachBatch(sink).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_tile_results(results: DataFrame, tombstones: DataFrame, out: str, checkpoint: str) -> None:
    """Append new proposals of a stream of candidates (STR-01).

    ``results``: image_id, layer_id, tile_idx, candidate, annotation_id, signature. Tombstoned masks go first. The state
    holds one short row per candidate of a mask and one per mask, with the time of the first and of the last micro-batch
    that showed it: what first came in this batch has both alike. So a candidate seen before is dropped, and a mask
    seen before gets origins but no second proposal. What earlier batches wrote is never read.
    """
    key = ["image_id", "layer_id", "signature"]
    order = ["image_id", "layer_id", "signature", "tile_idx", "candidate", "annotation_id"]
    live = results.select(*order).join(tombstones.select(*key).distinct(), key, "left_anti")
    # Every candidate counts for itself and, without tile and number, for its mask.
    nothing = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in ("tile_idx", "candidate")]
    levels = F.array(F.struct(F.lit(True).alias("origin"), "tile_idx", "candidate"), F.struct(F.lit(False).alias("origin"), *nothing))
    each = live.select(*key, "annotation_id", F.current_timestamp().alias("now"), F.inline(levels))
    first = F.struct("now", F.col("annotation_id").isNull().alias("none"), "annotation_id")
    seen = each.groupBy(*key, "origin", "tile_idx", "candidate").agg(F.min(first).alias("first"), F.max("now").alias("last"))
    judged = seen.select(*order[:5], F.col("first.annotation_id").alias("annotation_id"), "origin", (F.col("first.now") == F.col("last")).alias("fresh"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter("fresh").persist()
        batch.filter("NOT origin").select(*key, "annotation_id").write.mode("overwrite").parquet(f"{out}/proposals/batch={batch_id}")
        batch.filter("origin").select(*order).write.mode("overwrite").parquet(f"{out}/origins/batch={batch_id}")
        batch.unpersist()

    _run(judged, sink, checkpoint, "update", STATE_CONF)


def _apply_edits(key, batches, state: GroupState):
    """Edits of one image in sequence order; one applies only against the revision it expects."""
    revision = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    applied, seen = [], []
    for expected in rows["expected_revision"]:
        ok = expected == revision
        revision += int(ok)
        applied.append(ok)
        seen.append(revision)
    state.update((revision,))
    yield pd.DataFrame({"image_id": key[0], "seq": rows["seq"].to_numpy(), "applied": applied, "revision": seen})


def apply_edit_stream(edits: DataFrame) -> DataFrame:
    """Optimistic edit log (STR-02): image_id, seq, expected_revision -> applied or conflict.

    State is one number per image. The rows of a key in one micro-batch are bounded by the source's
    trigger limits (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    return edits.groupBy("image_id").applyInPandasWithState(
        _apply_edits, "image_id BIGINT, seq BIGINT, applied BOOLEAN, revision BIGINT", "revision BIGINT", "append", GroupStateTimeout.NoTimeout)


def action_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Actions per event-time window and action; runs the same on a batch and on a stream."""
    timed = events.withWatermark("created_at", late) if events.isStreaming else events
    slot = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return (timed.groupBy(slot.alias("w"), "action").agg(F.count("*").alias("n"))
            .selectExpr("w.start AS window_start", "action", "n"))


def action_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withWatermark("created_at", late) if events.isStreaming else events
    return (timed.groupBy(F.session_window("created_at", gap).alias("w"), "image_id").agg(F.count("*").alias("n"))
            .selectExpr("w.start AS session_start", "w.end AS session_end", "image_id", "n"))


def run_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream. ``append`` keeps every batch, ``complete`` keeps the last result."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/batch={batch_id}" if mode == "append" else f"{out}/latest"
        batch.write.mode("overwrite").parquet(target)

    _run(stream, sink, checkpoint, mode)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def coverage_stream(receipts: DataFrame, planned: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Completed tiles per image from a stream of receipts (STR-04), joined with the plan on read."""
    counts = receipts.dropDuplicates(["image_id", "tile_idx"]).groupBy("image_id").agg(F.count("*").alias("completed_tiles"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(counts, sink, checkpoint, "update")
    schema = "image_id BIGINT, completed_tiles BIGINT, version INT"
    latest = (receipts.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
              .groupBy("image_id").agg(F.max_by("completed_tiles", "version").alias("completed_tiles")))
    return planned.join(latest, "image_id", "left").na.fill(0, ["completed_tiles"]).withColumn("status", F.expr(
        "CASE WHEN completed_tiles = total_tiles THEN 'complete' WHEN completed_tiles = 0 THEN 'running' ELSE 'partial' END"))


def ingest_files(files: DataFrame) -> DataFrame:
    """First file of each content (STR-05): path, sha256."""
    return files.dropDuplicates(["sha256"])
