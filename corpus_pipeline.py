"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All but the
last return the columns of documents; n_chars follows the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import line_chunks, minhash, mixing, pieces, toxicity
from maskloom.llm.common import stage, table


def piece_model() -> str:
    """Place of the public SentencePiece model; another installation may set its own."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go in full from every text but their first."""
    out = line_chunks.dedup_runs(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    back = pieces.encode_and_decode(docs, piece_model())
    return back.select(*docs.columns, "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-dedup", drop_near_duplicates), ("mixing", mix_sources), ("pieces", encode_pieces)]

#: Rounding and the learned model have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
