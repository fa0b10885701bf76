"""Toxicity by multiple-instance learning: sentences are scored, labels are for documents.

A document is toxic when one of its sentences is, so the probabilities of its sentences
are combined by noisy-or, ``1 - prod(1 - p)``.  Only document labels are learned from; the
sentence scores that come out locate the offending sentences.  A sentence counts by what its
telling words add to the chance of one without any, so such sentences count nothing, however
many there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import drop_tools, id_remainder, smallest_hashes

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that count as features beside the word itself.
BEGINNINGS = (4, 5, 6)
#: Training documents taken for each label, and the longest text (characters) among them.
PER_LABEL = 2_500
LONGEST_TRAINED = 50_000
#: A feature is used if so many toxic training documents have it, and their share is so many
#: times its share of the others.
LEAST_DOCUMENTS = 4
LEAST_RATIO = 8.0
#: Log odds of a sentence in which no word carries weight, from which the weights are counted.
BIAS = -11.0
#: Words whose weight a task remembers.
REMEMBERED = 300_000

SCHEMA = (
    "score double, predicted int, n_sentences int, "
    "offending array<struct<start:int,end:int,score:double>>"
)


@dataclass(frozen=True)
class Model:
    """A word's weight is the sum over its features; a sentence's score adds ``bias``."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        return sum(self.weights.get(feature, 0.0) for feature in features(word))


def features(word: str) -> list[str]:
    """The lower-case word, marked, and its beginnings that are shorter than it."""
    word = word.lower()
    return [f"={word}", *(word[:n] for n in BEGINNINGS if n < len(word))]


def _evidence(z: np.ndarray | float, bias: float) -> np.ndarray:
    """-log(1 - p) of sentences with the log odds ``z``, beyond that of one without weight."""
    return np.maximum(np.logaddexp(0.0, z) - np.logaddexp(0.0, bias), 0.0)


def fit(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.15) -> Model:
    """Noisy-or likelihood of the document labels, climbed by Adam over all sentences.

    Without documents of both labels nothing is learned, and no document is toxic.
    """
    y = np.asarray(labels, bool)
    if y.all() or not y.any():
        return Model({}, BIAS)
    held = [Counter(), Counter()]
    documents_of: Counter[str] = Counter()  # sums of random numbers, one for each document
    random = np.random.default_rng(10).integers(1, 2**40, len(texts))
    for text, label, number in zip(texts, y, random.tolist()):
        words = {w.lower() for w in WORD.findall(text)}
        found = {f for w in words for f in features(w)}
        held[int(label)].update(found)
        if label:
            documents_of.update(dict.fromkeys(found, number))
    toxic, clean = y.sum(), (~y).sum()
    # Of features that the same toxic documents have, the most specific speaks for all.
    specific: dict[int, str] = {}
    for f, n in held[1].items():
        if n >= LEAST_DOCUMENTS and n / toxic >= LEAST_RATIO * (held[0][f] + 0.5) / clean:
            rival = specific.get(documents_of[f])
            if rival is None or (f[0] == "=", len(f), f) > (rival[0] == "=", len(rival), rival):
                specific[documents_of[f]] = f
    chosen = sorted(specific.values())
    index = {f: i for i, f in enumerate(chosen)}
    of_word: dict[str, list[int]] = {}
    sentence_of, feature_of, document_of = [], [], []
    for document, text in enumerate(texts):
        for sentence in SENTENCE.findall(text):
            here = len(document_of)
            document_of.append(document)
            for word in set(WORD.findall(sentence)):
                if (got := of_word.get(word)) is None:
                    got = of_word[word] = [index[f] for f in features(word) if f in index]
                for feature in got:
                    sentence_of.append(here)
                    feature_of.append(feature)
    s, f, d = (np.asarray(x, np.int64) for x in (sentence_of, feature_of, document_of))
    theta = np.full(len(chosen), 4.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    balance = np.where(y, len(y) / (2 * toxic), len(y) / (2 * clean))
    least = np.logaddexp(0.0, BIAS)  # keeps the slope of a document without evidence finite
    for step in range(1, steps + 1):
        z = BIAS + np.bincount(s, theta[f], len(d))
        total = np.bincount(d, _evidence(z, BIAS), len(y))  # -log of the chance of no toxic one
        slope = np.where(y, -1 / np.expm1(np.clip(total, least, 500)), 1.0) * balance
        by_sentence = slope[d] / (1 + np.exp(-np.clip(z, -500, 500)))
        gradient = np.bincount(f, by_sentence[s], len(chosen)) / len(y) + 1e-4 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= (
            rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        )
    weights = {name: float(w) for name, w in zip(chosen, theta) if abs(w) > 1e-3}
    return Model(weights, BIAS)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents whose id is not held out.

    A bounded sample: for each label the ``PER_LABEL`` ids that hash lowest, texts of up to
    ``LONGEST_TRAINED`` characters.  Rows with a null id, text or label are left out.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(
        "label IN (0, 1)"
    )
    known = known.where(id_remainder(F.col("doc_id"), 5) != 0)
    picked = smallest_hashes(known.where("label = 0"), "doc_id", PER_LABEL).unionByName(
        smallest_hashes(known.where("label = 1"), "doc_id", PER_LABEL)
    )
    rows = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= LONGEST_TRAINED))
        .join(F.broadcast(picked), "doc_id")  # 2 * PER_LABEL rows
        .orderBy(F.xxhash64("text"), "doc_id", "label")
        .limit(2 * PER_LABEL)
        .select("text", "label")
        .collect()
    )
    return fit([r.text for r in rows], [r.label for r in rows])


def judge(text: str, model: Model, known: dict[str, float]) -> tuple:
    """Score, prediction, number of sentences and the offending ones of one text.

    ``known`` remembers word weights.  Offending sentences, as code point spans, are those of a
    chance of one half or more; a document over the threshold without such a sentence names
    its worst one.
    """
    words = set(WORD.findall(text))
    if len(known) > REMEMBERED:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = model.word(word)
    if not any(known[word] for word in words):
        return 0.0, 0, sum(1 for _ in SENTENCE.finditer(text)), []
    total, n, found, worst = 0.0, 0, [], None
    for match in SENTENCE.finditer(text):
        n += 1
        z = sum(known[word] for word in set(WORD.findall(match.group())))
        if not z:
            continue
        z += model.bias
        total += float(_evidence(z, model.bias))
        span = (match.start(), match.end(), float(1 / (1 + np.exp(-min(max(z, -500), 500)))))
        if span[2] >= 0.5:
            found.append(span)
        if worst is None or span[2] > worst[2]:
            worst = span
    score = float(-np.expm1(-total))
    if score >= 0.5 and not found and worst is not None:
        found = [worst]
    return score, int(score >= 0.5), n, found


def scorer(model: Model):
    """A column function: text to ``SCHEMA``; a null text is judged as an empty one."""

    @F.pandas_udf(SCHEMA)
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_tools()
        known: dict[str, float] = {}
        for texts in batches:
            rows = [judge(text or "", model, known) for text in texts]
            yield pd.DataFrame(
                [
                    (score, predicted, n, [dict(zip(("start", "end", "score"), x)) for x in spans])
                    for score, predicted, n, spans in rows
                ],
                columns=["score", "predicted", "n_sentences", "offending"],
            )
        known = texts = rows = None
        drop_tools()  # a worker that gets no other task keeps nothing

    return toxicity


def toxicity(documents: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """All rows and columns of ``documents`` plus ``into``, a struct of ``SCHEMA``.

    Nulls, empty texts and those without a telling word score 0.  Repeated rows are each
    scored; an empty table gives an empty result; other columns pass through untouched.
    """
    return documents.withColumn(into, scorer(model)(F.col("text")))
