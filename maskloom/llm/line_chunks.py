"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk starts at the
second of them, so boundaries depend on the lines around them only and survive shifts. Chunks of
several lines that occur again anywhere are removed but for their first place (smallest id, then
line). A narrow pass finds repeated chunk hashes; only those chunks are read as text and compared byte
by byte. Built-in SQL functions only; every step is linear in the lines of a text.

Defined cases: a null text counts as empty, an empty text is one empty line; single lines are
never removed; a null id sorts last; rows that share an id are ordered by a hash of their text, and
rows alike in id and text stand at the same place, so all of them keep it; an empty table gives no
rows. Only the id and the text column are read.

``dedup_lines`` removes whole chunks only, so a repeated passage can keep its head and tail.
``dedup_runs`` removes every repeated run in full. The same chunks come first; heads and tails that
they leave follow exactly, by pairs of neighbouring lines that are not blank (with the blank lines between
them) and single lines of more than ``passage`` words, wherever these lie in no chunk that goes. A run of
several lines is repeated exactly if each of its pairs is; a pair or line within a later copy of a
chunk has its first place in no chunk that goes. So chunks never change what goes, and every distinct line
stays somewhere. Blank lines at the edges of a chunk stay, as between pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import broadcast_if_small, text_or_empty, word_count

SEP = "\n"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _starts(lines: Column, rate: int) -> Column:
    """First line of every chunk."""
    hashes = F.transform(lines, line_hash)
    rolled = F.zip_with(F.slice(hashes, 1, F.size(hashes) - 1), F.slice(hashes, 2, F.size(hashes)), lambda a, b: ((a * 31 + b) % 65521) % rate)
    return F.concat(F.array(F.lit(0)), F.filter(F.transform(rolled, lambda v, i: F.when(v == 0, i + 1)), lambda i: i.isNotNull()))


def _chunks(docs: DataFrame, rate: int) -> DataFrame:
    """(far, id, mark, lines, chunk): chunks of two lines or more, as (start, size)."""
    split = docs.select("far", "id", "mark", F.split("text", SEP).alias("lines")).filter(F.size("lines") > 1)
    cut = split.withColumn("starts", _starts(F.col("lines"), rate))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines")))
    spans = F.filter(F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("size"))), lambda s: s["size"] > 1)
    texts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice("lines", s["start"] + 1, s["size"]), SEP).alias("text")))
    return cut.select("far", "id", "mark", F.explode(texts).alias("chunk")).select("far", "id", "mark", "chunk.*").withColumn("key", F.xxhash64("text"))


def _windows(docs: DataFrame, passage: int) -> DataFrame:
    """(far, id, mark, chunk): pairs of neighbouring lines and long single lines outside the spans ``held``, as (start, size, text)."""
    split = docs.select("far", "id", "mark", "held", F.split("text", SEP).alias("lines"))
    split = split.withColumn("solid", F.filter(F.transform("lines", lambda v, i: F.when(v.rlike(r"\S"), i)), lambda i: i.isNotNull()))
    pairs = F.zip_with(F.slice("solid", 1, F.greatest(F.size("solid") - 1, F.lit(0))), F.slice("solid", 2, F.size("solid")),
                       lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size")))
    line = lambda i: F.get("lines", i)
    # Only a line of more than twice as many characters can hold that many words.
    long = F.filter("solid", lambda i: (F.length(line(i)) > 2 * passage) & (word_count(line(i)) > passage))
    spans = F.concat(pairs, F.transform(long, lambda i: F.struct(i.alias("start"), F.lit(1).alias("size"))))
    inside = lambda s: F.exists("held", lambda h: (h["start"] <= s["start"]) & (s["start"] + s["size"] <= h["start"] + h["size"]))
    spans = F.when(F.col("held").isNull(), spans).otherwise(F.filter(spans, lambda s: ~inside(s)))
    texts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice("lines", s["start"] + 1, s["size"]), SEP).alias("text")))
    return split.select("far", "id", "mark", F.explode(texts).alias("chunk")).select("far", "id", "mark", "chunk.*").withColumn("key", F.xxhash64("text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 3) -> DataFrame:
    """All columns of ``docs`` with the text deduplicated, and n_lines, n_removed (lines)."""
    return _without(docs, id_col, text_col, _repeats(_chunks(_base(docs, id_col, text_col), rate)))


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 50, rate: int = 3) -> DataFrame:
    """As ``dedup_lines``, but every repeated run of lines, and every repeated line of more than ``passage`` words, goes in full."""
    base = _base(docs, id_col, text_col)
    chunks = cut_lineage(_solid(_repeats(_chunks(base, rate))).distinct())
    held = chunks.groupBy("far", "id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("held"))
    rest = _windows(base.join(broadcast_if_small(held, 100_000), ["far", "id", "mark"], "left"), passage)
    return _without(docs, id_col, text_col, _repeats(rest).drop("text").unionByName(chunks))


def _place(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).isNull().alias("far"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("mark")]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_place(id_col, text_col), text_or_empty(text_col).alias("text"))


def _repeats(chunks: DataFrame) -> DataFrame:
    """(far, id, mark, start, size, text) of every chunk but the first of equal keys and equal bytes."""
    again = cut_lineage(chunks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    seen = chunks.join(broadcast_if_small(again, 500_000), "key", "left_semi")
    place = F.struct("far", "id", "mark", "start")
    firsts = seen.groupBy("key", "text").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "text", "first")
    return seen.join(firsts, ["key", "text"]).filter(place != F.col("first")).select("far", "id", "mark", "start", "size", "text")


def _solid(chunks: DataFrame) -> DataFrame:
    """Spans of chunks without the blank lines at their edges, where two lines or more are not blank."""
    solid = F.filter(F.transform(F.split("text", SEP), lambda v, i: F.when(v.rlike(r"\S"), i)), lambda i: i.isNotNull())
    return (chunks.withColumn("solid", solid).filter(F.size("solid") > 1)
            .select("far", "id", "mark", (F.col("start") + F.element_at("solid", 1)).alias("start"),
                    (F.element_at("solid", -1) - F.element_at("solid", 1) + 1).alias("size")))


def _without(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """``docs`` without the lines of ``spans``."""
    gone = spans.select("far", "id", "mark", "start", "size").distinct().groupBy("far", "id", "mark").agg(
        F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + size - 1)")))).alias("gone"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *_place(id_col, text_col))
    joined = keyed.join(gone, ["far", "id", "mark"], "left")
    original = text_or_empty(f"row.{text_col}")
    lines = F.split(original, SEP)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), SEP))
    return joined.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
                         F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
