"""Periodic runs against the definition, on random and built texts; the query's planted periods."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and smallest_period(w[i:i + length]) == q:
                out.append((i, length, q))
            i = max(i + 1, j + 1) if j > i else i + 1
    out.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in out for i in range(s + q, s + length)}
    return out, " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(0, 6)):
            unit = [rng.choice("a b c é ab".split()) for _ in range(rng.randrange(1, 7))]
            w += unit * rng.randrange(1, 9) + unit[:rng.randrange(0, len(unit) + 1)]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t \r"]) for x in w)))
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "z " * 5), (204, "z " * 6), (205, "  " * 9), (206, "a b " * 4000), (206, "a b " * 4000), (None, "x y z " * 4)]
    return rows


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (10, 3)])
def test_runs(spark, least, times, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH", 400)  # many batches and texts beyond one
    rows = texts(least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ["id", "runs", "collapsed", "n_words"]})
    got = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic_runs.periodic_runs(df, min_length=least, min_exponent=times).collect()), key=str)
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        if len(w) > 5000:  # one run of period two
            want.append((d, len(w), [(0, len(w), 2)], "a b"))
        else:
            runs, text = brute(w, least, times)
            want.append((d, len(w), runs, text))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_long_texts():
    """A single word 300 000 times, and a Fibonacci word: many runs, deep classes, large ordered sets."""
    a, b = "b", "a"
    while len(b) < 3000:
        a, b = b, b + a
    for w in (["w"] * 300_000, list(b)):
        raw = np.frombuffer(" ".join(w).encode(), np.uint8)
        found = periodic_runs.find_runs(periodic_runs.Words(raw, np.array([0, len(raw)])), 2, 2)
        got = [(s, length, q) for s, q, length in found.tolist()]
        assert got == ([(0, 300_000, 1)] if w[0] == "w" else brute(w, 2, 2)[0])


def test_planted_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") + str(rng.randrange(9)) for _ in range(rng.randrange(0, 90)))) for i in range(300)] + [(None, "q " * 7), (301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, text = brute(w)
        top = min(((-length, s, q) for s, length, q in runs), default=None)
        want[d] = (len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
                   hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.op13_lcp_kruskal_runs(spark, str(tmp_path)).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 10
