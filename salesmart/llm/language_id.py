"""Language identification: known words first, then shorter and shorter character n-grams.

A word seen in training scores by its log frequency in each language.  An unseen word backs
off to its character n-grams: the longest length of which training has seen any scores it.  A
text's score is the sum over its words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import drop_tools, stored


def _marks() -> str:
    """The combining marks, as ranges of a character class: vowel signs, accents."""
    planes = (range(0x300, 0x20000), range(0xE0000, 0xE1000))  # there are none elsewhere
    marks = [c for plane in planes for c in plane if unicodedata.category(chr(c))[0] == "M"]
    return "".join(
        f"{chr(run[0])}-{chr(run[-1])}"
        for _, grouped in groupby(enumerate(marks), lambda at: at[1] - at[0])
        if (run := [mark for _, mark in grouped])
    )


#: Letters, and the marks that follow them.
WORD = re.compile(rf"[^\W\d_]++(?:[{_marks()}]++[^\W\d_]*+)*+")
#: Longest character n-gram; a word is framed by blanks first.
LONGEST_NGRAM = 4
#: Documents that ``sample`` takes of each language, by lowest hash (about so many).
PER_LANGUAGE = 1_200
#: Values of the hash that decides, so many that a share of any table is more than none.
HASHES = 2**62
#: A word or n-gram is kept if training has it so often, and so often for each word of its language:
#: that bounds the model, whatever it was counted over.
LEAST_COUNT = 3
LEAST_SHARE = 3e-6
#: Distinct texts whose counts a task holds before it hands them on.
COUNTED_TOGETHER = 200_000
#: Distinct words whose n-grams a task counts at a time.
WORDS_TOGETHER = 50_000
#: Distinct texts between white space whose scores a task remembers, and of how many the scores
#: are added up at a time (twice as many, if texts are long).
REMEMBERED = 200_000
TOKENS_TOGETHER = 25_000
UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, n_words int, n_known int"


def ngrams(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _counted_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of each language with their number.

    What stands between white space is counted first: no word holds any, and there are far
    fewer distinct ones to look for words in than there is text.
    """
    drop_tools()
    tokens: dict[str, Counter] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            tokens.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, tokens.values())) > COUNTED_TOGETHER:
                yield from _words_of(tokens)
                tokens = {}
    yield from _words_of(tokens)
    tokens = frame = None
    drop_tools()  # a worker that gets no other task keeps nothing


def _words_of(tokens: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, counted in tokens.items():
        words: Counter = Counter()
        for token, times in counted.items():
            for word in WORD.findall(token.lower()):
                words[word] += times
        if words:
            yield pd.DataFrame({"lang": lang, "gram": list(words), "times": list(words.values())})


def _counted_ngrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams of the words, which come with their number."""
    counts: dict[tuple[str, int], Counter] = {}
    held: dict[str, tuple[list[str], list[int]]] = {}

    def add_held() -> None:
        for lang, (words, times) in held.items():
            for n, grams, summed in _ngram_sums(words, np.array(times)):
                counter = counts.setdefault((lang, n), Counter())
                for gram, number in zip(grams, summed):
                    counter[gram] += number
        held.clear()

    def counted() -> Iterator[pd.DataFrame]:
        for (lang, n), grams in counts.items():
            yield pd.DataFrame(
                {"lang": lang, "n": n, "gram": list(grams), "times": list(grams.values())}
            )
        counts.clear()

    for frame in frames:
        for lang, part in frame.groupby("lang", sort=False):
            words, times = held.setdefault(lang, ([], []))
            words += part["gram"].tolist()
            times += part["times"].tolist()
        if sum(len(words) for words, _ in held.values()) >= WORDS_TOGETHER:
            add_held()
            if sum(map(len, counts.values())) > COUNTED_TOGETHER:
                yield from counted()
    add_held()
    yield from counted()


def _ngram_sums(words: list[str], times: np.ndarray) -> Iterator[tuple[int, list[str], list[int]]]:
    """Of each n, the distinct n-grams of the framed words and their numbers.

    A word's n-grams count ``times`` each.  An n-gram is told by the rank of its first n - 1
    characters among those of all words and by its last character.
    """
    text = "".join(f" {word} " for word in words)
    lengths = np.array([len(word) + 2 for word in words])
    characters, last = np.unique(
        np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True
    )
    ends = np.repeat(np.cumsum(lengths), lengths)
    times = np.repeat(times, lengths)
    at, code = np.arange(len(last)), last
    for n in range(1, LONGEST_NGRAM + 1):
        if n > 1:
            inside = at + n <= ends[at]
            at = at[inside]
            code = rank[inside] * len(characters) + last[at + n - 1]
        if not len(at):
            return
        _, first, rank = np.unique(code, return_index=True, return_inverse=True)
        summed = np.zeros(len(first), np.int64)
        np.add.at(summed, rank, times[at])
        yield n, [text[i : i + n] for i in at[first].tolist()], summed.tolist()


@dataclass
class Model:
    """``rows[n][gram]`` is the row of ``logs[n]`` with its log frequency in each language.

    n is 0 for whole words; ``known`` says of each word which languages have it.
    """

    languages: list[str]
    rows: list[dict[str, int]] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    known: np.ndarray | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """Of some words, a row each: the scores, and in which languages they are known."""
        scores, known = np.zeros((2, len(words), len(self.languages)))
        rows = np.array([self.rows[0].get(word, -1) for word in words], np.int64)
        scores[rows >= 0] = self.logs[0][rows[rows >= 0]]
        known[rows >= 0] = self.known[rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for n in range(LONGEST_NGRAM, 0, -1):
            row, found, numbers = self.rows[n].get, [], []
            for at in left.tolist():
                got = [r for gram in ngrams(words[at], n) if (r := row(gram)) is not None]
                found += got
                numbers.append(len(got))
            numbers = np.array(numbers, np.int64)
            some = numbers > 0
            if some.any():
                starts = (np.cumsum(numbers) - numbers)[some]
                summed = np.add.reduceat(self.logs[n][found], starts, axis=0)
                scores[left[some]] = summed / numbers[some][:, None]
            left = left[~some]
        return np.hstack([scores, known])


def sample(documents: DataFrame, trained: Column) -> tuple[list[str], DataFrame]:
    """Languages of the rows where ``trained`` holds and lang is not null, and some of the rows.

    In each language about ``PER_LANGUAGE``: the documents whose id hashes below
    ``PER_LANGUAGE`` / (documents of the language).
    """
    usable = documents.where(trained & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().collect()
    languages = sorted(row["lang"] for row in sizes)
    share = F.lit(0)
    for row in sizes:  # a language each
        share = F.when(
            F.col("lang") == row["lang"], int(min(1.0, PER_LANGUAGE / row["count"]) * HASHES)
        ).otherwise(share)
    picked = usable.where(F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id")), F.lit(HASHES)) < share)
    return languages, picked.select("lang", "text")


def train(documents: DataFrame, trained: Column) -> Model:
    """Counts words and n-grams of all rows where ``trained`` holds and lang is not null.

    Counting runs in tasks, the sums in Spark: words first, and the n-grams from the distinct
    words.  What reaches the driver is the model, of at most 1 / ``LEAST_SHARE`` words a language.
    """
    usable = documents.where(trained & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(row["lang"] for row in usable.groupBy("lang").count().collect())
    if not languages:
        return Model([])
    summed = F.sum("times").alias("times")
    words = stored(
        usable.select("lang", "text")
        .mapInPandas(_counted_words, "lang string, gram string, times long")
        .groupBy("lang", "gram")
        .agg(summed),
        "words",
    )
    least = F.lit(LEAST_COUNT)
    for row in words.groupBy("lang").agg(summed).collect():  # a language each
        least = F.when(
            F.col("lang") == row["lang"], max(LEAST_COUNT, math.ceil(LEAST_SHARE * row["times"]))
        ).otherwise(least)
    grams = (
        words.mapInPandas(_counted_ngrams, "lang string, n int, gram string, times long")
        .groupBy("lang", "n", "gram")
        .agg(summed)
    )
    counts = words.select("lang", F.lit(0).alias("n"), "gram", "times").unionByName(grams)
    return model_of(languages, counts.where(F.col("times") >= least).toPandas())


def model_of(languages: list[str], counts: pd.DataFrame) -> Model:
    """Log frequencies with half a count added to each; columns lang, n, gram, times."""
    model = Model(languages)
    position = {lang: i for i, lang in enumerate(languages)}
    for n in range(LONGEST_NGRAM + 1):
        part = counts[counts["n"] == n]
        grams = sorted(set(part["gram"]))
        rows = {gram: i for i, gram in enumerate(grams)}
        table = np.full((len(grams), len(languages)), 0.5)
        where = (
            part["gram"].map(rows).to_numpy(dtype=int),
            part["lang"].map(position).to_numpy(dtype=int),
        )
        np.add.at(table, where, part["times"].to_numpy(dtype=float))
        if n == 0:
            model.known = table > 0.5
        model.rows.append(rows)
        model.logs.append(np.log(table / table.sum(axis=0, keepdims=True)) if grams else table)
    return model


class Guesser:
    """Scores texts with a model and remembers what it met between white space.

    That may hold no word or several; their scores and numbers are added up.  Texts are taken
    together, so that what is new in them is looked up at once and not one by one.
    """

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        # Of each its scores, in which languages its words are known, words, and if it has letters.
        self.table = np.zeros((1024, 2 * len(self.model.languages) + 2))

    def _learn(self, tokens: list[str]) -> None:
        n, at = len(self.model.languages), len(self.row)
        while at + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        mine = self.table[at : at + len(tokens)]
        words, owner, lettered = [], [], [token.isalpha() for token in tokens]
        for i, token in enumerate(tokens):
            if lettered[i]:  # then it is a word
                words.append(token)
                owner.append(i)
                continue
            found = WORD.findall(token)
            words += found
            owner += [i] * len(found)
            # Words may be numerals like ½ or Ⅷ, which are no letters.
            lettered[i] = any(letter.isalpha() for word in found for letter in word)
        if words:
            values = np.ones((len(words), mine.shape[1]))
            if n:
                values[:, : 2 * n] = self.model.words(list(map(str.lower, words)))
            owner = np.array(owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            mine[owner[starts]] = np.add.reduceat(values, starts, axis=0)
        mine[:, -1] = lettered
        self.row.update(zip(tokens, range(at, at + len(tokens))))

    def _rows(self, tokens: list[str]) -> list[int]:
        distinct = dict.fromkeys(tokens)
        new = [token for token in distinct if token not in self.row]
        if len(self.row) + len(new) > REMEMBERED:
            self._forget()
            new = list(distinct)
        self._learn(new)
        return list(map(self.row.__getitem__, tokens))

    def guess(self, text: str | None) -> tuple[str, float, int, int]:
        return self.guesses([text])[0]

    def guesses(self, texts: Sequence[str | None]) -> list[tuple[str, float, int, int]]:
        totals = np.zeros((len(texts), self.table.shape[1]))
        held, starts, owners = [], [], []

        def add_held() -> None:
            if held:
                rows = self._rows(held)
                np.add.at(totals, owners, np.add.reduceat(self.table[rows], starts, axis=0))
            for each in (held, starts, owners):
                each.clear()

        for i, text in enumerate(texts):
            tokens = text.split() if text else []
            for begin in range(0, len(tokens), TOKENS_TOGETHER):
                starts.append(len(held))
                owners.append(i)
                held += tokens[begin : begin + TOKENS_TOGETHER]
                if len(held) >= TOKENS_TOGETHER:
                    add_held()
        add_held()
        return [self._guess(total) for total in totals]

    def _guess(self, total: np.ndarray) -> tuple[str, float, int, int]:
        languages, n = len(self.model.languages), int(total[-2])
        if not total[-1] or not languages:
            return UNDETERMINED, 0.0, n, 0
        return self._best(total[:languages], n, total[languages:-2])

    def _best(
        self, total: np.ndarray, n: int, known: np.ndarray
    ) -> tuple[str, float, int, int]:
        best = int(np.argmax(total))  # ties: the language first by code point
        chances = np.exp(total - total[best])
        return self.model.languages[best], float(1 / chances.sum()), n, int(known[best])


def identifier(model: Model):
    """A column function: text to ``SCHEMA``."""

    @F.pandas_udf(SCHEMA)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_tools()
        guesser = Guesser(model)
        for texts in batches:
            found = guesser.guesses(texts)
            yield pd.DataFrame(
                {
                    "lang_pred": [lang for lang, _, _, _ in found],
                    "score": [score for _, score, _, _ in found],
                    "n_words": [n for _, _, n, _ in found],
                    "n_known": [known for _, _, _, known in found],
                }
            )
        guesser = texts = found = None
        drop_tools()  # a worker that gets no other task keeps nothing

    return language


def identify(documents: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """All rows and columns of ``documents`` plus ``into``, a struct of ``SCHEMA``.

    ``score`` is the posterior of the predicted language, which nears 1 with the number of words;
    ``n_known`` are the words that training has seen in that language.  A null text, one without a letter,
    or a model without languages gives ``und`` and 0.  Ties go to the first language by code
    point.  Repeated rows are each scored; other columns pass through.
    """
    return documents.withColumn(into, identifier(model)(F.col("text")))


def least_known(named: DataFrame, trained: Column, found: str) -> dict[str, float]:
    """For each language, the share of known words that a hundredth of its documents stays below.

    ``named`` has ``identify``'s column ``found``; all rows learned from count that have a word.
    """
    learned = trained & F.col("lang").isNotNull() & F.col("text").isNotNull()
    n_words, n_known = F.col(found)["n_words"], F.col(found)["n_known"]
    rows = (
        named.where(learned & (n_words > 0))
        .groupBy("lang")
        .agg(F.percentile_approx(n_known / n_words, 0.01, 10_000).alias("share"))
    )
    return {row["lang"]: row["share"] for row in rows.collect()}  # a row for each language
