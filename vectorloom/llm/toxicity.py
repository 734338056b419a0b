"""Toxicity by weak supervision.

Many voters look at a text: each word that a bounded sample of labelled rows associates with
toxicity (at most ``LEXICON`` of them) and a small fixed list vote by being present, patterns vote
on density, repetition, address and shouting, and the given label is one more voter that may err.
A generative model estimates, by expectation maximisation, how often each voter fires in either
class; voters that fire together beyond what the class explains share their weight. Its posterior
labels, not the given ones, then train a logistic regression over the same evidence, which scores
every whole text in one pass without a shuffle.

``SAMPLE_ROWS`` bounds the labelled documents that are fitted on: those with the smallest hash of
doc_id among the labels that may be learnt from. Their words are counted and their votes taken on the
executors; the driver gets at most ``LEXICON`` words and the votes, whatever the texts' lengths.

Defined results: a null text scores as an empty one; labels with a null in either column are left
out and several labels of one document are averaged; of documents that share a doc_id the first text
in order is learnt from, and each gets its row; without any label, or labels of one class, the fixed
list alone votes; texts of any length are read whole; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage
from .columns import private

SAMPLE_ROWS = 6000
LEXICON, LEAST_Z, LEAST_DOCS = 150, 5.0, 5
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
#: Insults that vote whatever the sample holds.
INSULTS = "idiot moron scum stupid trash loser pathetic worthless disgusting clown dumb imbecile bastard filth vermin degenerate".split()
#: Words of address that, before an insult, make an attack.
ADDRESS = {"you", "your", "youre", "u"}
PATTERNS = ("no hit", "one hit", "two hits", "three hits", "five hits", "dense", "repeated", "address", "shouting", "exclaiming")


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray  # how often each voter fires in the clean and in the toxic class
    shares: np.ndarray  # what is left of each voter's weight beside those it goes along with


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def evidence(text: str, words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """The votes of all lexicon words, then those of the patterns."""
    counts = Counter(w for w in words if w in lexicon)
    votes = np.zeros(len(lexicon) + len(PATTERNS), np.float32)
    votes[[lexicon[w] for w in counts]] = 1
    hits, n = sum(counts.values()), len(words)
    address = any(b in counts and (a in ADDRESS or c in ADDRESS) for a, b, c in zip(["", *words], words, [*words[1:], ""], strict=False)) if hits else False
    letters = sum(map(str.isalpha, text)) if hits else 0
    shouting = hits > 0 and sum(map(str.isupper, text)) > 0.5 * letters > 0
    votes[len(lexicon) :] = [hits == 0, hits >= 1, hits >= 2, hits >= 3, hits >= 5, hits > 0 and hits >= 0.01 * n, max(counts.values(), default=0) >= 2, address, shouting, hits > 0 and text.count("!") >= 3]
    return votes


def mine(texts: DataFrame, rate: float) -> list[str]:
    """The words of (text, toxic) rows whose share of toxic documents stands out most."""
    if not 0 < rate < 1:
        return []

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):  # one text's words at a time
                found = list(set(words_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic >= 0.5] * len(found), pa.bool_())], ["word", "inside"])

    counts = texts.select("text", "toxic").mapInArrow(distinct, "word string, inside boolean").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("inside"))
    z = (F.col("inside") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    best = counts.where(F.col("n") >= LEAST_DOCS).select("word", F.round(z, 9).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(LEXICON)
    return [r["word"] for r in best.collect()]


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels, firing rates (class, voter) and shares, by expectation maximisation."""
    fired = np.column_stack([votes, gold]).astype(np.float64)
    post = 0.05 + 0.9 * gold
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rates = np.stack([(fired.T @ q + 0.5) / (q.sum() + 1) for q in (1 - post, post)])
        rest = fired - np.outer(1 - post, rates[0]) - np.outer(post, rates[1])
        spread = np.sqrt((rest**2).mean(0) + 1e-9)
        together = np.clip((rest.T @ rest) / len(rest) / np.outer(spread, spread), 0, 1)
        shares = 1 / together.sum(0)
        log = np.log(rates) - np.log(1 - rates)
        score = np.log(prior / (1 - prior)) + fired @ (shares * (log[1] - log[0])) + (shares * (np.log(1 - rates[1]) - np.log(1 - rates[0]))).sum()
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post, rates, shares


def fit(lexicon: list[str], votes: np.ndarray, toxic: np.ndarray, rounds: int = 400) -> Model:
    """A model from the votes on labelled texts; toxic holds numbers from 0 to 1."""
    place = {w: k for k, w in enumerate(lexicon)}
    if not len(toxic) or not 0 < np.mean(toxic >= 0.5) < 1:
        weights = np.zeros(len(place) + len(PATTERNS))
        weights[len(place) :] = [-2.0, 0.0, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        return Model(place, weights, -0.5, np.zeros((2, 0)), np.zeros(0))
    post, rates, shares = label_model(votes, (toxic >= 0.5).astype(np.float64))
    weights, bias, moved = np.zeros(votes.shape[1]), 0.0, np.zeros(votes.shape[1] + 1)
    for _ in range(rounds):  # gradient descent with momentum
        p = 1 / (1 + np.exp(-(votes @ weights + bias)))
        grad = np.append(votes.T @ (p - post) / len(votes) + 1e-4 * weights, (p - post).mean())
        moved = 0.9 * moved - 0.5 * grad
        weights, bias = weights + moved[:-1], bias + moved[-1]
    return Model(place, weights, float(bias), rates, shares)


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, toxic) of the bounded sample; its ids are few enough to broadcast."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic")).dropna().groupBy("id").agg(F.avg("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labels that may be learnt from, wherever their documents are found."""
    texts = stage(training_rows(documents, labels.where(~held_out())), "toxicity-sample")
    rate = texts.agg(F.avg((F.col("toxic") >= 0.5).cast("double"))).first()[0] or 0.0
    lexicon = list(dict.fromkeys([*mine(texts, rate), *INSULTS]))
    place = {w: k for k, w in enumerate(lexicon)}

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [evidence(t.as_py(), words_of(t.as_py()), place).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(votes, pa.list_(pa.float32()))], ["id", "toxic", "votes"])

    found = texts.select(F.col("id").cast("string"), "text", "toxic").mapInArrow(voted, "id string, toxic double, votes array<float>").toArrow().sort_by("id")
    unstage(texts)
    votes = np.array(found["votes"].combine_chunks().flatten(), np.float64).reshape(-1, len(lexicon) + len(PATTERNS))
    return fit(lexicon, votes, found["toxic"].to_numpy())


def score(documents: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """The input's columns and the score as column ``name``, which they may not have."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                text = text.as_py() or ""
                out[k] = evidence(text, words_of(text), model.lexicon) @ model.weights + model.bias
            out = 1 / (1 + np.exp(-out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return documents.mapInArrow(scored, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", F.col("text").cast("string")), train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with the columns that came in."""
    name = f"{private(documents.columns)}score"
    return score(documents, train(documents, labels), name).where(F.col(name) < THRESHOLD).drop(name)
