"""Toxicity from a learned lexicon, met through Levenshtein automata, with context windows.

A lexicon of terms and log-odds weights is counted from labelled documents with Spark. The terms
form a trie. Each distinct word of a batch runs through the trie as a Levenshtein automaton (its
states are letters read and edits spent, paired with trie nodes), so misspelled terms are caught.
Every hit is then read in a window of words around it: quotation marks on both sides count it as
quotation, other hits nearby as abuse. A logistic model over these few sums gives the score.

The lexicon and the model come from labelled rows only, and only where crc32(id) mod 4 is not 2.
The lexicon for the model's own fit is counted on remainders 0 and 1 and the model is fitted on
remainder 3, so that terms are new to the rows that weigh them; the final lexicon uses all three.

Bounds: the lexicon holds at most ``terms`` terms, and the model is fitted on at most ``sample`` labelled
rows (those of least hash). Everything else reads all rows and whole texts.

Defined cases: a null or empty text has no hits and gets the score of no evidence; repeated rows are
scored alike; labels that are null are no labels; without any label, or without both classes, the
lexicon is empty and every score is 0; an empty table gives no rows. A label never enters a score.
Labelled rows alike in text and label count once, under their smallest id, which decides their fold.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, stage, text_or_empty

WORD = regex.compile(r"[\p{L}\p{N}\p{M}'*@$]+")
QUOTES = frozenset("\"'“”„«»‘’‹›`")
WINDOW = 6
THRESHOLD = 0.3
FEATURES = 7


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: tuple[float, ...] = ()

    @property
    def empty(self) -> bool:
        return not self.weights or not self.coefficients


class Trie:
    """Terms by character; ``find`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = (term, weight)
        self.seen: dict[str, tuple[float, int]] = {}

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, distance) of the nearest term, heaviest on ties.

        States of the automaton are (letters read, edits spent); each is paired with a trie node. A
        state without edits left can only follow the word's own letters.
        """
        allow, end = edits(len(word)), len(word)
        best: tuple[int, float] | None = None
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, spent = stack.pop()
            if spent == allow:
                while i < end and node is not None:
                    node = node.get(word[i])
                    i += 1
                if node is None:
                    continue
            if i == end and "" in node:
                term, weight = node[""]
                if spent <= edits(len(term)) and (best is None or (spent, -weight) < best):
                    best = (spent, -weight)
            if spent == allow:
                continue
            if i < end:
                stack.append((node, i + 1, spent + 1))  # a letter too many
            for ch, below in node.items():
                if ch == "":
                    continue
                stack.append((below, i, spent + 1))  # a letter too few
                if i < end:
                    stack.append((below, i + 1, spent + (ch != word[i])))
        return None if best is None else (-best[1], best[0])


def edits(length: int) -> int:
    """Allowed distance: short words are taken only as they stand."""
    return 0 if length < 5 else 1


def _deletions(word: str) -> Iterator[str]:
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1:]


class Matcher:
    """Words of a batch to (weight, distance); only words that share a deletion form with a term walk the trie."""

    def __init__(self, weights: dict[str, float]):
        self.trie = Trie(weights)
        self.forms = {form for term in weights for form in (_deletions(term) if edits(len(term)) else (term,))}
        # One edit leaves the first two letters or the last three of a term as they are.
        self.heads, self.tails = {term[:2] for term in weights}, {term[-3:] for term in weights}
        self.longest = max(map(len, weights), default=0)
        self.known: dict[str, tuple[float, int] | None] = {}

    def near(self, word: str) -> bool:
        forms = self.forms
        if word in forms:
            return True
        if not edits(len(word)) or len(word) > self.longest + 1 or not (word[:2] in self.heads or word[-3:] in self.tails):
            return False
        for i in range(len(word)):
            if word[:i] + word[i + 1:] in forms:
                return True
        return False

    def __call__(self, word: str) -> tuple[float, int] | None:
        if word in self.known:
            return self.known[word]
        found = self.trie.find(word) if self.near(word) else None
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = found
        return found


def features(text: str, match: Matcher) -> list[float]:
    """Evidence of one text: exact and misspelled weight in the open, quoted weight, density, length."""
    text = text.lower()
    met = {word: found for word in set(WORD.findall(text)) if (found := match(word.strip("'")))}
    if not met:
        return [0.0] * FEATURES
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    hits = [(at, met[text[s:e]]) for at, (s, e) in enumerate(spans) if text[s:e] in met]
    exact = near = quoted = 0.0
    places = [at for at, _ in hits]
    crowd, lo, hi = 0.0, 0, 0
    for at, (weight, far) in hits:
        first, last = max(0, at - WINDOW), min(len(spans) - 1, at + WINDOW)
        before, after = text[spans[first][0]:spans[at][0]], text[spans[at][1]:spans[last][1] + 1]
        inside = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
        while places[lo] < first:
            lo += 1
        while hi < len(places) and places[hi] <= last:
            hi += 1
        crowd = max(crowd, float(hi - lo - 1))
        if inside:
            quoted += weight
        elif far:
            near += weight
        else:
            exact += weight
    return [np.log1p(exact), np.log1p(near), np.log1p(quoted), np.log1p(crowd), float(np.log1p(len(met))), float(exact > 0), np.log1p(len(hits)) / np.log(len(spans) + 2)]


def fold_of(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    return texts.join(broadcast_if_small(marks, 1_000_000), "id").filter(fold_of("id") != 2)


def count_terms(rows: DataFrame, terms: int, support: int = 4) -> dict[str, float]:
    """The ``terms`` heaviest words by smoothed log-odds over distinct texts: words said in toxic texts and hardly elsewhere."""
    def words(batches):
        for batch in batches:
            # One entry for a word and class of a batch: (in toxic, in clean) texts.
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {w.strip("'") for w in WORD.findall(text.lower())}:
                    if len(word) > 2:
                        tally.setdefault(word, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()),
                                              pa.array([v[1] for v in tally.values()], pa.int64())], names=["word", "t", "c"])

    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return {}
    tallies = rows.select("text", "toxic").mapInArrow(words, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    best = (tallies.filter(F.col("t") >= support).withColumn("w", odds).filter("w > 2")
            .orderBy((F.col("w") * F.sqrt("t")).desc(), "word").limit(terms).select("word", "w").collect())  # at most `terms` rows
    return {r.word: float(r.w) for r in best}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", terms: int = 2000, sample: int = 20_000) -> Model:
    # Of rows alike in text and label the smallest id stays, so that folds and with them the fit are those of the data.
    alike = _labelled(docs, labels, id_col).groupBy("text", "toxic").agg(F.min("id").alias("id"))
    rows = stage(alike.select("id", "text", "toxic", fold_of("id").alias("fold")), "labelled")
    first = count_terms(rows.filter("fold < 2"), terms)
    picked = rows.filter("fold = 3").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)  # ids only, at most `sample`
    chosen = rows.filter("fold = 3").join(F.broadcast(picked), "id", "left_semi")
    evidence = chosen.select("text", "toxic").mapInArrow(_evidence(first), "x array<double>, toxic int").collect()  # a few numbers a row, at most `sample` rows
    if not first or len({r.toxic for r in evidence}) < 2:
        return Model({})
    beta = _fit(np.array([r.x for r in evidence]), np.array([r.toxic for r in evidence], float))
    return Model(count_terms(rows, terms), beta)


def _evidence(weights: dict[str, float]):
    def run(batches):
        match = Matcher(weights)
        for batch in batches:
            x = [features(t, match) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and score and predicted."""
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], text_or_empty(text_col).alias("_text"))
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])

    def run(batches):
        match = None if model.empty else Matcher(model.weights)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if match is None:
                p = np.zeros(len(texts))
            else:
                x = np.array([features(t, match) for t in texts]).reshape(len(texts), FEATURES)
                p = 1 / (1 + np.exp(-np.clip(model.coefficients[0] + x @ np.array(model.coefficients[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, same columns."""
    model = learn(docs, labels, id_col)
    cols = docs.columns
    carried = docs.select(F.col("text"), F.struct(*cols).alias("row"))
    return score(carried, model).filter("predicted = 0").select(*[F.col("row")[c].alias(c) for c in cols])
