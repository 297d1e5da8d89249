"""Toxicity on held-out labels, and the pipeline's stages one after another."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm import minhash, toxicity
from maskloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_automaton_finds_misspelled_terms():
    match = toxicity.Matcher({"worthless": 4.0, "idiot": 5.0, "scum": 3.0})
    assert match("worthless") == (4.0, 0) and match("wortless") == (4.0, 1) and match("idiott") == (5.0, 1) and match("id1ot") == (5.0, 1)
    assert match("scun") is None and match("wothles") is None and match("patriot") is None
    rng, terms = random.Random(0), ["worthless", "idiot", "scum"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1, *row[1:]] if False else [v for v in _next(row, x, b, i)]
        return row[-1]

    def _next(row, x, b, i):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(out[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        return out

    for _ in range(2000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "x", "i"])
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= min(toxicity.edits(len(word)), toxicity.edits(len(t)))]
        assert (match(word) is not None) == bool(near), word


def test_quotation_counts_apart():
    match = toxicity.Matcher({"idiot": 5.0})
    open_, quoted = toxicity.features("you are an idiot now", match), toxicity.features('he said "an idiot" and left', match)
    assert open_[0] > 0 and open_[2] == 0 and quoted[0] == 0 and quoted[2] > 0
    assert toxicity.features("", match) == [0.0] * toxicity.FEATURES


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter(toxicity.fold_of("doc_id") == 2)
    rows = scored.select("toxic", "predicted", "score").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    assert rows and right >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_fold_of_repeated_texts(spark):
    """A text said under many ids is learned under the smallest, in whatever order its rows come."""
    texts = ["you utter scumbag go away", "a quiet day at the lake", "such a scumbag again", "tea and bread for two"] * 40
    rows = [(i, texts[i] + f" {i % 12 // 4}") for i in range(len(texts))]
    labels = spark.createDataFrame([(i, int("scumbag" in t)) for i, t in rows], "doc_id long, toxic int")
    models = [toxicity.learn(spark.createDataFrame(order, "doc_id long, text string").repartition(parts), labels) for order, parts in ((rows, 2), (rows[::-1], 7))]
    assert models[0] == models[1]


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (1, None)], "doc_id long, text string").withColumn("toxic", F.lit(5)).withColumn("score0", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, none)).collect()
    assert len(out) == 4 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert toxicity.reject_toxic(docs, none).columns == docs.columns
    assert toxicity.score(docs.limit(0), toxicity.Model({})).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    from maskloom.llm.common import stage
    docs = [table(spark, SF, "documents")]
    for name, step in corpus_pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def test_stages_keep_their_contract(spark, stages):
    start, clean, lines, near, mixed, coded = stages
    for df in stages[:-1]:
        assert df.columns == start.columns
    labels = table(spark, SF, "labels")
    toxic = start.join(labels.filter("toxic = 1"), "doc_id").count()
    gone = start.count() - clean.count()
    wrong = start.join(clean.select("doc_id"), "doc_id", "left_anti").join(labels.filter("toxic = 0"), "doc_id").count()
    assert gone >= 0.9 * toxic and wrong <= 2
    assert lines.count() == clean.count() and lines.filter(F.length("text") != F.col("n_chars")).count() == 0
    again = minhash.near_duplicates(near, width=5)
    assert again.filter("not kept").count() == 0
    assert mixed.join(near.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert coded.count() == mixed.count() and coded.filter("not exact").count() == 0


def test_run_has_the_rows_of_the_last_stage(spark, stages):
    keys = ["doc_id", "n_pieces"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*keys).collect())) == sorted(map(tuple, stages[-1].select(*keys).collect()))
