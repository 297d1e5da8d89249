"""Phrase counts and collocations against brute force, with parts of the tree far smaller than the text."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import collocations

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def grams(rows, depth):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, n


def brute(rows, top, depth=4, least=30, covered=80):
    f, n = grams(rows, depth)
    held = Counter()
    for (lang, w), a in f.items():
        if a >= least:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    held[lang, w[i:i + m]] = max(held[lang, w[i:i + m]], a)
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least and not (held[lang, w] and 100 * held[lang, w] >= covered * a):
            score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "É", "é", "a-b", "x", " ", "z\u0085z", "z\u0085", "0", "naïve", "q'"]
    phrases = ["New York City hall", "in spite of", "the of", "x x x x"]
    rows = []
    for i in range(260):
        parts = []
        for _ in range(rng.randrange(0, 40)):
            parts.append(rng.choice(phrases) if rng.random() < .3 else rng.choice(vocabulary[:3] if rng.random() < .6 else vocabulary))
            parts.append(rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", " \x0b"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None, "und", "x\ty"])))
    return rows + [(None, "en"), ("", "fr"), (" .,", "en"), ("the " * 5000, "en"), ("the " * 5000, "en")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["doc_id", "phrase", "f", "group", "entry", "w", "k", "a", "n"])})


@pytest.mark.parametrize("budget,flush,top,least", [(2_000_000, 2_000_000, 2000, 30), (150, 70, 2000, 30), (40, 1000, 7, 3)])
def test_collocations(spark, budget, flush, top, least):
    rows = texts(budget)
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), top=top, budget=budget, flush=flush, least=least).collect()))
    want = brute(rows, top, least=least)
    assert got == want and len(want) > 20


def test_parts_hold_their_budget(spark):
    """Long prefixes are split at every level, and no group but one of a full-depth leaf exceeds twice the budget."""
    rows, budget = texts(4), 60
    df = frame(spark, rows)
    words = collocations.word_counts(df)
    often = collocations.often_table(words, 1)
    partition = collocations.plan_groups(df.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")), words, often, 4, budget)
    assert len(partition.last) == 4 and all(len(x) for x in partition.long[:3])
    f, _ = grams(rows, 4)
    lexicon = collocations.Lexicon()
    data = [(lang, w) for (lang, w), n in f.items() if len(w) == 4 for _ in range(n)]
    suffixes = np.array([lexicon.of([f"{lang}\t{x}".encode() for x in w]) for lang, w in data]).T
    group, shared = partition.route(suffixes, lexicon.hashes())
    leaves = Counter(map(tuple, suffixes.T))
    size, most = Counter(group.tolist()), Counter()
    for g, s in zip(group.tolist(), suffixes.T):
        most[g] = max(most[g], leaves[tuple(s)])
    assert all(n <= 2 * budget + most[g] for g, n in size.items()) and set(shared.tolist()) == {0, 1, 2, 3}


def test_rare_words_end_a_suffix(spark):
    rows = [("a b c. a b. a b", "en")] * 10 + [("a rare b", "de"), (None, None)]
    words = collocations.word_counts(frame(spark, rows))
    bits = collocations.often_table(words, 20)
    lexicon = collocations.Lexicon()
    data = b"a b c a rare b"
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["en"]})
    number, piece = collocations.numbered(batch, np.frombuffer(data, np.uint8), np.array([0, len(data)]), lexicon, bits)
    assert list(lexicon.number) == [b"en\ta", b"en\tb"] and number.tolist() == [1, 2, 1, 2]
    assert piece[0] == piece[1] and len(set(piece.tolist())) == 3


def test_wide_numbers_and_empty(spark):
    """Suffixes whose numbers do not fit 64 bits are combined like others; an empty table gives nothing."""
    rng = np.random.default_rng(1)
    suffixes = rng.integers(1, 90_000, (4, 300_000))
    suffixes[:, 150_000:] = suffixes[:, :150_000]  # 17 bits a column
    n = rng.integers(1, 5, 300_000)
    want = Counter()
    for s, k in zip(map(tuple, suffixes.T), n.tolist()):
        want[s] += k
    out, total = collocations.combine(suffixes, n)
    assert list(map(tuple, out.T)) == sorted(want) and dict(zip(map(tuple, out.T), total.tolist())) == want
    assert collocations.combine(suffixes)[1].sum() == 300_000
    out, total = collocations.combine(suffixes[:, :500] % 3 + 1)
    assert list(map(tuple, out.T)) == sorted(set(map(tuple, (suffixes[:, :500] % 3 + 1).T))) and total.sum() == 500
    assert collocations.collocations(frame(spark, texts(1)).limit(0)).count() == 0
