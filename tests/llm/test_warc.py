"""Content-addressed archive: exact records, revisits, shared payloads, files that other readers take."""
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from maskloom.llm import warc_store

BIG, OTHER = "<p>" + "é" * 700 + "</p>\r\n\r\nWARC/1.1\r\n", "x" * 1000
PAGES = ([(i, f"http://a/{i}", BIG) for i in range(40, 60)] + [(5, "u\r\nX: y", OTHER), (9, None, OTHER), (9, "again", OTHER), (9, "again", OTHER)]
         + [(1, "s", "x" * 999), (2, "t", "x" * 999), (3, "e", ""), (4, "n", None), (None, "null id", OTHER), (None, None, "y" * 2000), (None, None, "y" * 2000)])


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["id", "payload", "digest", "n", "keeper", "header", "salt", "size"])})


def want(rows):
    most = defaultdict(lambda: None)
    for p, _, h in rows:
        if p is not None and (most[h or ""] is None or p > most[h or ""]):
            most[h or ""] = p
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and most[h or ""] is not None and p != most[h or ""]
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", most[h or ""] if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_copy", [500, 3])
def test_archive(spark, tmp_path, monkeypatch, per_copy):
    monkeypatch.setattr(warc_store, "PER_COPY", per_copy)  # 3: a payload of many records is dealt out in several copies
    path = str(tmp_path / "archive")
    warc_store.write_archive(frame(spark, PAGES), path)
    read = warc_store.read_archive(spark, path)
    assert sorted(map(tuple, warc_store.described(read).collect()), key=str) == want(PAGES)
    assert spark.read.parquet(path + "/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_exact_record_and_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc_store.write_archive(frame(spark, PAGES), path)
    read = warc_store.read_archive(spark, path)
    records = {bytes(r.record) for r in warc_store.record_bytes(read).collect()}
    sha = hashlib.sha1(OTHER.encode()).hexdigest()
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1000\r\n\r\n"
    assert ("WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: u%0D%0AX: y\r\n"
            f"WARC-Payload-Digest: sha1:{sha}\r\nWARC-Refers-To: <urn:page:9>\r\n"
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n{http}").encode() in records

    warc_store.export_files(read, str(tmp_path / "files"))
    files = list((tmp_path / "files").glob("part-*.gz"))
    assert files and all(gzip.open(f).read(9) == b"WARC/1.1\r" for f in files)
    again = sorted((bytes(r.header), bytes(r.payload)) for r in warc_store.read_files(spark, str(tmp_path / "files" / "part-*")).collect())
    empty = lambda r: b"" if b"WARC-Type: revisit" in bytes(r.header) else bytes(r.payload)
    assert again == sorted((bytes(r.header), empty(r)) for r in read.collect())


def test_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc_store.write_archive(frame(spark, PAGES).limit(0), path)
    assert warc_store.described(warc_store.read_archive(spark, path)).count() == 0
    with pytest.raises(ValueError):
        list(warc_store._split(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc_store._split(b"no record"))
