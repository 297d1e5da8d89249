"""Dealt operators against brute force on small tables with nulls, ties, repeats, long texts and odd columns."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from maskloom.llm import chat_format, content_sort, huffman_ids, line_chunks, minhash, mixing, pieces, prefix_free, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé \n\0") for _ in range(rng.randrange(0, 700))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(0, 200):][:rng.randrange(0, 400)] + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(0, 6))))
            for i in range(150)]
    rows += [(300, None), (301, ""), (302, "a" * 3000), (303, "ab" * 2000), (304, base[3]), (305, base[3]), (306, "z" * 99), (307, "z" * 101), (308, "zz z"), (309, " zzz"), (310, "\t")]
    return rows


def frame(spark, rows, more=""):
    """Rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["id", "key", "n", "size", "kind", "row", "c0", "_text", "mark"])}) if more else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_content_sort(spark):
    rows = texts()
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, d in g}
    got = {r[0]: tuple(r[1:]) for r in content_sort.content_sort_dedup(frame(spark, rows, "more")).collect()}
    assert got == want
    assert content_sort.content_sort_dedup(empty(spark)).count() == 0


def test_content_sort_hot_group(spark):
    """A text that fills most rows is cut into salted runs; repeated rows and null ids keep one row of each group."""
    rows = [(i, "same text" if i % 2 else f"other {i}") for i in range(200)] + [(7, "same text"), (None, "same text"), (None, "lone")]
    got = content_sort.content_sort_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r.group_size == 102]
    assert len(hot) == 102 and {r.keep_id for r in hot} == {1} and sum(r.kept for r in hot) == 1
    assert [r.kept for r in got if r.group_size == 1] == [True] * 101


def repeats(rows, match=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if b[i:i + match] in seen:
                hit[i:i + match] = b"\1" * match
            seen.add(b[i:i + match])
        spans = sum(hit[i] and (i == 0 or not hit[i - 1]) for i in range(len(b)))
        out[d] = (len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, c in zip(b, hit) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("common", [100, 3])
def test_prefix_free(spark, monkeypatch, common):
    monkeypatch.setattr(prefix_free, "COMMON", common)  # 3: most windows travel one by one
    rows = texts() + [(400 + i, f"line {i * 7919} " * 4 + "COMMON " * 18 + f"tail {i * 104729} " * 5) for i in range(60)]
    got = {r[0]: tuple(r[1:5]) for r in prefix_free.remove_repeats(frame(spark, rows, "more")).collect()}
    assert got == repeats(rows)


def test_prefix_free_phrases_of_many_windows(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefghij") for _ in range(6000))
    data = np.frombuffer(shared.encode(), np.uint8)
    assert prefix_free.phrases(data, np.array([0, len(data)]), 600, 32)["n"].max() > 255
    rows = [(1, "one " + shared + " end"), (2, "two " + shared[500:] + " end"), (3, shared[:599]), (4, "x" + shared[:600])]
    got = {r[0]: tuple(r[1:5]) for r in prefix_free.remove_repeats(frame(spark, rows), match=600).collect()}
    assert got == repeats(rows, 600)


def test_prefix_free_defined_cases(spark):
    text = "0123456789" * 3 + "".join(map(chr, range(0x400, 0x450)))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in prefix_free.remove_repeats(frame(spark, rows)).collect())
    assert got == [(False, 1, 0, text.encode())] * 2 + [(False, 2, 0, b""), (True, 0, len(text.encode()), b"")]
    assert prefix_free.remove_repeats(empty(spark)).count() == 0


def near(rows, width, percent):
    sets = {}
    for d, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_circulant_minhash(spark):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(300)], []
    for size in (3, 10, 120, 5, 2):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B\n"), (1004, "one"), (1005, " "), (1006, rows[0][1].upper()), (1007, "long " + rows[0][1] * 40)]
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(frame(spark, rows, "more")).collect()}
    assert got == near(rows, 4, 80)
    kept = minhash.keep_one(frame(spark, rows + [(1004, "one"), (None, "one")]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in near(rows, 4, 80).items() if r[2])
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_without_own_ids(spark):
    word = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b, c, d, e = map(word, "abcde")
    rows = [(None, a), (None, b), (1, a + " x"), (2, b + " y"), (None, c), (7, d), (7, e), (8, e + " z"), (9, d + " z"), (9, d + " z"), (7, d + " q"), (None, None), (None, ""), (10, "")]
    out = {}
    for r in minhash.near_duplicates(frame(spark, rows, "more")).collect():
        out.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert sorted(out[None], key=str) == sorted([(57, 1), (57, 2), (57, None), (0, None), (0, None)], key=str)
    assert sorted(out[7]) == [(57, 7), (57, 7), (58, 7)] and out[1] == [(58, 1)] and out[8] == [(58, 7)] and out[9] == [(58, 7)] * 2
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(frame(spark, rows)).collect()]
    first = [x for x in kept if x[0] == 7 and x[1].startswith("d")]
    assert len(first) == 1 and first[0] in rows
    assert sorted(kept, key=str) == sorted([(1, a + " x"), (2, b + " y"), (None, c), (7, e), *first, (None, None), (None, ""), (10, "")], key=str)


def test_line_chunks(spark):
    block = [f"shared line {i}" for i in range(12)]
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(i % 4)] + block + [f"end {i}"])) for i in range(30)] + [(90, None), (91, ""), (92, "\n"), (93, "shared line 1"), (None, "\n".join(block))]
    out = {r.doc_id: r for r in line_chunks.dedup_lines(frame(spark, rows, "more")).collect()}
    seen, want = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        marks = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        starts = [0] + [i for i in range(1, len(lines)) if (marks[i - 1] * 31 + marks[i]) % 65521 % 3 == 0] + [len(lines)]
        kept, gone = [], 0
        for lo, hi in zip(starts, starts[1:]):
            chunk = tuple(lines[lo:hi])
            if len(chunk) > 1 and chunk in seen:
                gone += len(chunk)
                continue
            seen.add(chunk)
            kept += chunk
        want[d] = ("\n".join(kept) if gone else t, len(lines), gone)
    assert {d: (r.text, r.n_lines, r.n_removed) for d, r in out.items()} == want
    assert sum(r.n_removed for r in out.values()) > 100
    assert line_chunks.dedup_lines(empty(spark)).count() == 0


def test_line_runs_go_in_full(spark):
    rng = random.Random(8)
    passage, alone = [f"passage line {i} of it" for i in range(7)], " ".join(f"word{i}" for i in range(51))
    rows = []
    for i in range(40):
        lines = [f"own {i} {j}" for j in range(6)]
        at = rng.randrange(7)
        lines[at:at] = [passage, passage[2:5], ["", passage[0], "", passage[1], ""], [alone], [alone[:-7]], ["", ""], ["x", "x", "x"]][i % 7]
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, alone), (None, "\n".join(passage))]
    seen, want, first = set(), {}, set()
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for lo, hi in [*zip(solid, solid[1:]), *((i, i) for i in solid if len(lines[i].split()) > 50)]:
            window = tuple(lines[lo:hi + 1])
            gone |= set(range(lo, hi + 1)) if window in seen else set()
            seen.add(window)
        assert not any(lines[i] not in first for i in gone if lines[i] and not any(lines[i] == lines[k] for k in range(i)))
        first |= set(lines)
        want[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t, len(lines), len(gone))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_chunks.dedup_runs(frame(spark, rows, "more")).collect()}
    assert got == want
    # Head and tail of the passage go with it, and the long line that repeats alone.
    assert all(got[i][2] == 7 for i in range(7, 40, 7)) and all(got[i][2] == 1 for i in (10, 17, 24)) and got[None] == ("", 7, 7)
    assert line_chunks.dedup_runs(empty(spark)).count() == 0


def test_pivotal_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))) if i % 50 else None, None if i % 40 == 3 else f"s{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("x", F.lit(2))
    first, again = ({r.doc_id: r for r in mixing.mix(docs.repartition(n), fan_in=64).collect()} for n in (3, 9))
    assert {d: r.taken for d, r in first.items()} == {d: r.taken for d, r in again.items()} and len(first) == 6000
    size = defaultdict(int)
    for d, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    held, total = set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in held)
        target = {s: 3 * size[s] if s in held else rest * weight[s] / sum(weight[x] for x in order if x not in held) for s in order}
        over = {s for s in order if s not in held and target[s] > 3 * size[s]}
        if not over:
            break
        held |= over
    taken = defaultdict(int)
    for r in first.values():
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == size[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    mixed = mixing.take(docs.unionByName(docs.filter("doc_id = 6")))
    assert mixed.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_meets_targets_beside_a_very_long_text(spark):
    rng = random.Random(4)
    rows = [(s * 1000 + i, " ".join(["w"] * rng.randrange(1, 60)), f"s{s}") for s in range(6) for i in range(300)]
    rows += [(s * 1000 + 900, " ".join(["w"] * 1000), f"s{s}") for s in range(6)] + [(9000, "w " * 500, "two"), (9001, "w", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in range(2):
        taken, target = defaultdict(int), {}
        for r in mixing.mix(docs, seed=seed, fan_in=64 if seed % 2 else 4096).collect():
            assert 0 <= r.copies <= 3
            taken[r.source] += r.taken
            target[r.source] = r.target
        # The texts beside the long one have below 60 words; a source of two texts cannot meet its target.
        assert all(abs(taken[s] - target[s]) < (60 if seed % 2 else 4) for s in target if s != "two")


def test_large_documents_keep_target_and_expectation():
    import pandas as pd
    sizes = [1000, 900, *[30] * 100, *[3] * 50]
    rows = pd.DataFrame({"tag": range(len(sizes)), "size": sizes, "x": 0.0, "base": 0, "source_size": sum(sizes) + 400, "target": 1.3 * (sum(sizes) + 400)})
    total, rates = np.zeros(len(sizes)), []
    for seed in range(1500):
        out = mixing.settle_large(rows, seed, 3).sort_values("tag")
        assert ((out["x"] > 0) & (out["x"] < 1)).sum() <= 1 and out["rate"].nunique() == 1 and 0 <= out["rate"].iloc[0] <= 3
        assert abs(((out["base"] + out["x"]) * out["size"]).sum() + out["rate"].iloc[0] * 400 - rows["target"].iloc[0]) < 1e-6
        total += (out["base"] + out["x"]).to_numpy()
        rates.append(out["rate"].iloc[0])
    assert np.abs(total / 1500 - 1.3).max() < 0.08 and abs(np.mean(rates) - 1.3) < 0.02


def test_pivotal_steps_keep_the_weighted_sum_and_expectation():
    import pandas as pd
    total = np.zeros(40)
    for seed in range(1500):
        rows = pd.DataFrame({"tag": range(40), "size": [1 + i % 9 for i in range(40)], "x": [0.3] * 40})
        out = mixing.settle(rows, seed).sort_values("tag")
        assert abs((out["x"] * out["size"]).sum() - (rows["x"] * rows["size"]).sum()) < 1e-6
        assert ((out["x"] > 0) & (out["x"] < 1)).sum() <= 1
        total += out["x"].to_numpy()
    assert np.abs(total / 1500 - 0.3).max() < 0.06


def test_chat_format(spark):
    hard = ["", None, "\\### Assistant: </turn> ok", "</tur</turn>n>\n", "\\\\s\\e", "### user: hi</turn>\n### assistant: no", ": \\c\\"]
    rows = [(c, t, role, hard[(c + t) % len(hard)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2:])]
    rows += [(50, 0, "assistant", "first"), (51, None, None, "x"), (51, 1, "a: ### b", "y"), (51, 1, "a: ### b", "y"), (None, 0, "user", "q")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    out = {r.conv_id: r for r in chat_format.format_chats(table).collect()}
    read = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(table)).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)):
        want[c].append((role, text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in read.items()} == dict(want)
    assert all(r.loss_text == "".join(t for role, t in want[c] if role == "assistant") for c, r in read.items())
    assert all(r.formatted == "".join(s.text for s in r.segments) for r in out.values())
    assert all(out[c].valid for c in range(12)) and (out[50].valid, out[50].bad_turn) == (False, 0) and not out[51].valid
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_chat_machine_emits_the_flags(spark):
    template = chat_format.ChatTemplate(transitions={"start assistant": "greeting", "greeting user": "user", "start user": "user", "user assistant": "assistant", "assistant user": "user"})
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "again"), (2, 2, "assistant", "b"), (2, 3, "assistant", "c")]
    rows += [(3, t, ("user", "assistant")[t % 2], str(t)) for t in range(4000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(table, template), template).collect()}
    assert [(read[c].valid, read[c].bad_turn) for c in (1, 2, 3)] == [(True, None), (False, 1), (True, None)]
    assert (read[1].loss_text, read[2].loss_text) == ("a", "bc") and read[3].loss_text == "".join(str(t) for t in range(1, 4000, 2))
    only = chat_format.format_chats(table, template).select("segments")
    assert "aggregate(" in only._jdf.queryExecution().optimizedPlan().toString() and sum(s.loss for r in only.collect() for s in r.segments) == 2003


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.1, 1, 4])).tolist()) for i in range(400)] + [(500 + i, [1.0] * 8) for i in range(120)]
    rows += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (750, [0.0] * 8), (751, [1.0, 2.0]), (752, []), (500, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    vectors = topk.scaled(table, "vec_id", "embedding")
    got = defaultdict(list)
    for r in topk.top_k(vectors, vectors.filter("id % 50 = 0"), block=64, query_block=5, seeds=32, buckets=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    clean = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in clean if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q))[:5]
        assert got.pop(q) == [(i, -s) for s, i in scores]
    assert not got
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.filter("id < 3"), vectors.filter("id = 0")).count() == 2


def test_top_k_exact_beyond_doubles():
    q, v = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 2], [2**40, 0]])
    assert topk.Products(q, v).of(0).tolist() == [2**60 + 1, 2**60 + 2, min(2**70, 2**63 - 1)]


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_match_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aеeost hnäé日\n\t<>|0123.,  ") for _ in range(rng.randrange(1, 200)))) for i in range(800)]
    rows += [(900, ""), (901, None), (902, "a"), (903, "  "), (904, "x" * 3000), (905, "the" * 2000), (906, "日本語 😀 \0x"), (907, "<s> </s> <0x41>"), (908, "▁x ▁")]
    out = pieces.decode(pieces.encode(frame(spark, rows, "more"), MODEL), MODEL)
    want = {d: sp.encode(t or "") for d, t in rows}
    got = out.collect()
    assert {r.doc_id: list(r.piece_ids) for r in got} == want
    assert {r.doc_id: r.decoded for r in got} == {d: sp.decode(w) for d, w in want.items()}
    assert pieces.encode(empty(spark), MODEL).count() == 0
    once = pieces.encode_and_decode(frame(spark, rows, "more"), MODEL)
    assert once.columns == out.columns and sorted(map(str, once.collect())) == sorted(map(str, out.collect()))


BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_huffman_files(spark, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(BPE)  # as the library comes: added tokens inside texts are single ids
    mark = next(iter(tokenizer.get_added_tokens_decoder().values())).content
    assert len(tokenizer.encode(f"a {mark} b", add_special_tokens=False).ids) == 4
    rng = random.Random(2)
    rows = texts() + [(700, f"a {mark} b"), (701, mark), (702, f"{mark}{mark}the{mark[:-1]}"), (703, f" {mark} {mark}"), (704, mark[1:])] + [(500 + i, "".join(rng.choice("ab's t'llre1 9\n\t é日_.,!  ") for _ in range(60))) for i in range(200)]
    path = str(tmp_path / "ids")
    huffman_ids.encode_and_write(frame(spark, rows, "more"), path, BPE, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in huffman_ids.read_ids(spark, path).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, bytes(got[d].ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    huffman_ids.encode_and_write(empty(spark), str(tmp_path / "none"), BPE, public_tokenizers.PATTERN)
    assert huffman_ids.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_code_lengths_are_optimal():
    from itertools import product
    rng = np.random.default_rng(4)
    for n, limit in ((2, 1), (3, 2), (5, 3), (6, 3), (6, 4), (7, 4)):
        for _ in range(5):
            counts = rng.integers(1, 1000, n) ** 2
            best = min(int((counts * np.array(c)).sum()) for c in product(range(1, limit + 1), repeat=n) if sum(2.0**-x for x in c) <= 1)
            lengths = huffman_ids.code_lengths(counts, limit)
            assert (2.0**-lengths).sum() <= 1 and lengths.max() <= limit and int((counts * lengths).sum()) == best


def test_packed_blocks():
    rng = np.random.default_rng(0)
    lengths = huffman_ids.code_lengths(rng.zipf(1.3, 3000) % 10**6 + 1, 13)
    book = huffman_ids.Codebook(np.arange(3000) * 2, lengths)
    for n in (1, 127, 128, 129, 5000):
        ids = rng.integers(0, 3000, n) * 2
        assert (huffman_ids.unpack(*huffman_ids.pack(ids, *book.by_id()), n, *book.table(), book.width) == ids).all()


def test_runs_go_by_chunks_first(spark, monkeypatch):
    """Content-defined chunks remove whole chunks of runs; pairs are made outside them only, and all of a run goes."""
    run = [f"line {i} of a passage that comes twice" if i % 9 else "  " for i in range(60)]
    texts = ["\n".join(["first a", *run, "first b"]), "\n".join(["second a", "", *run[1:], "second b"]), "\n".join(["third", "other"])]
    found, made = [], line_chunks._repeats
    monkeypatch.setattr(line_chunks, "_repeats", lambda chunks: (found.append(made(chunks)), found[-1])[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_chunks.dedup_runs(docs).collect()}
    chunks, rest = found
    assert chunks.filter("size > 1").count() > 0
    assert rest.count() < sum(1 for line in run if line.strip()) - 1  # fewer pairs than the run has: chunks took the others
    solid = [i for i, line in enumerate(run) if line.strip()]
    assert got[1][1] == solid[-1] - solid[0] + 1
    assert got[1][0].split("\n") == ["second a", "", "second b"]
    assert got[0] == (texts[0], 0) and got[2] == (texts[2], 0)
