"""Content-addressed WARC archive: payload bytes once, exact record headers beside them, records by join.

An archive is a folder of two tables.

``payloads``  digest (SHA-256), payload, n (records that hold it). Rows are grouped by digest *and*
              bytes, so equal means equal bytes; the digest is then verified to be unique before it
              is used as an address, and a digest of two payloads stops the writer.
``headers``   the exact WARC and HTTP header bytes of every record, the address of its payload, and
              in how many copies that payload is dealt out on reading.

A record is its header, its payload (none for a revisit) and two line ends. Reading joins both tables
by address; a payload that many records hold is dealt out in one copy for each ``PER_COPY`` records
and the records are spread over the copies, so no address fills one task and at most
records / PER_COPY payloads are added.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response
and the others revisit it; smaller payloads are all responses.

Defined cases: a null payload is empty; a null url gives a record without target; line ends in a url
are percent-encoded; a null id is below every other id, and a group of null ids alone is all
responses; rows alike in id and payload are records alike (all with the largest id are responses);
an empty table gives an empty archive. Only the three named columns are read.
"""
from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST = 1000
PER_COPY = 500
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PAYLOADS = "digest string, payload binary, keeper long, n long"
HEADERS = "header binary, digest string, salt long"


def _urn(record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record.cast("string"), F.lit("null")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _header(revisit: Column, date: str) -> Column:
    """WARC header and HTTP header of a record with the columns id, url, size, sha1, keeper."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("size")), F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("keeper"))),
                                 _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))), F.lit("\r\n"), http)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least: int = LEAST, date: str = DATE) -> None:
    """Write one record per row of ``pages`` to the folder ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    (rows.groupBy("digest", "payload").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select("digest", "keeper", "n")
    shared = stored.groupBy("digest").count().filter("count > 1").limit(1).collect()
    if shared:
        raise ValueError(f"two payloads share the digest {shared[0]['digest']}")

    narrow = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    held = narrow.join(stored.filter("n > 1"), "digest", "left")
    revisit = (F.col("size") >= least) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    copies = F.ceil(F.coalesce("n", F.lit(1)) / PER_COPY)
    (held.select(_header(revisit, date).cast("binary").alias("header"), "digest", F.pmod(F.xxhash64("id", "url"), copies).alias("salt"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): every record's exact header bytes and its full payload, revisits resolved."""
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    dealt = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PER_COPY) - 1)).alias("salt"))
    return headers.join(dealt, ["digest", "salt"]).select("header", "payload", "digest")


def field(name: str, header: str = "header") -> Column:
    """Value of a WARC header field of records; null where it is not there."""
    found = F.regexp_extract(F.col(header).cast("string"), rf"(?:^|\r\n)(?i:{name}): ?([^\r\n]*)", 1)
    return F.when(found != "", found)


def described(records: DataFrame) -> DataFrame:
    """What the records say: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    ``intact``: length and both digests, taken from the payload that was read, are those written down.
    """
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    sha1 = F.sha1("payload")
    size = F.octet_length("payload").cast("long")
    http_size = F.regexp_extract(F.col("header").cast("string"), r"\r\n\r\nHTTP/(?s:.*)\r\nContent-Length: (\d+)\r\n\r\n$", 1).try_cast("long")
    return records.select(
        number("WARC-Record-ID").alias("page_id"), size.alias("payload_bytes"), sha1.alias("payload_digest"), field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        ((field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1)) & (http_size == size) & (F.sha2("payload", 256) == F.col("digest"))).alias("intact"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(record): the records as a WARC file holds them, without their closing line ends."""
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat("header", body).alias("record"))


def export_files(records: DataFrame, path: str, compression: str = "gzip", per_file: int = 20_000) -> None:
    """WARC files that any reader of the format takes; every task writes its own."""
    (record_bytes(records).select(F.col("record").cast("string"))
     .write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path))


def _split(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        size = next((int(line.split(b":", 1)[1]) for line in content[at:stop].split(b"\r\n") if line[:15].lower() == b"content-length:"), None)
        if size is None:
            raise ValueError(f"the record at byte {at} has no length")
        block = content[stop + 4:stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut off")
        inner = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else 0
        yield content[at:stop + 4] + block[:inner], block[inner:]
        at = stop + 4 + size + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of WARC files, gzipped or not; a revisit's payload is empty. One file is read at a time by a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                content = raw.as_py()
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                held, size = [], 0
                for pair in _split(content):
                    held.append(pair)
                    size += len(pair[1])
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary")


def _batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["header", "payload"])
