"""Document quality: histogram gradient-boosted trees over statistics of a document.

Trees are complete binary trees of one depth, kept as arrays, so that a batch of documents
walks down all of them with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from salesmart.llm.common import id_remainder, smallest_hashes

#: Training documents taken for each label, by lowest hash.
PER_LABEL = 5_000
TREES = 80
DEPTH = 4
RATE = 0.15
BINS = 64
#: A leaf holds so many training documents at least; second derivatives are padded by this.
LEAST_IN_LEAF = 5
PENALTY = 1.0
#: A score from which label 1 is predicted.
CUT = 0.3

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\v\f",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "mark": b"!?",
    "bar": b"|",
    "hash": b"#$%&*@~^",
    "angle": b"<>{}[]()/\\=_+",
    "quote": b"\"'`;:-",
}
_SIGNS = tuple(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())
_NAMES = [*_CLASSES, "other_ascii", "beyond_ascii"]


def _lookup() -> np.ndarray:
    table = np.full(256, _NAMES.index("other_ascii"), np.int64)
    table[128:] = _NAMES.index("beyond_ascii")
    for i, signs in enumerate(_CLASSES.values()):
        table[list(signs)] = i
    return table


_LOOKUP = _lookup()
STATISTICS = [
    *(f"share_{name}" for name in _NAMES),
    "log_bytes",
    "log_words",
    "mean_word",
    "distinct_words",
    "commonest_word",
    "shouted_words",
    "punctuated_words",
    "short_words",
    "log_lines",
    "distinct_lines",
    "mean_line",
    "commonest_line",
    "repeated_pairs",
]


def statistics(text: bytes) -> list[float]:
    """The numbers a document is judged by, all finite; zeros for an empty text."""
    counts = np.bincount(_LOOKUP[np.frombuffer(text, np.uint8)], minlength=len(_NAMES))
    size = max(len(text), 1)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    distinct = Counter(words)
    pairs = set(zip(words, words[1:]))
    return [
        *(counts / size),
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(distinct) / n,
        max(distinct.values(), default=0) / n,
        sum(times for word, times in distinct.items() if word.isupper()) / n,
        sum(times for word, times in distinct.items() if word.endswith(_SIGNS)) / n,
        sum(times for word, times in distinct.items() if len(word) <= 3) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / m,
        n / m,
        max(Counter(lines).values(), default=0) / m,
        1 - len(pairs) / max(len(words) - 1, 1),
    ]


def _table(texts: list[bytes | None]) -> np.ndarray:
    rows = [statistics(text or b"") for text in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))


@dataclass(frozen=True)
class Model:
    """``features`` and ``cuts`` (trees x inner nodes), ``leaves`` (trees x leaves).

    Node i has the children 2 i + 1, if its statistic is at most the cut, and 2 i + 2.
    """

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            total += leaf[node - len(cut)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic loss; splits by second-order gain over histograms of quantile bins.

    With one label only, every document gets the share of label 1.
    """
    y = np.asarray(labels, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    inner, base = 2**DEPTH - 1, float(np.log(share / (1 - share)))
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if len(y) < 2 * LEAST_IN_LEAF or y.min() == y.max():
        return Model(base, *empty)
    edges = [
        np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T
    ]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], axis=1)
    width = binned.shape[1]
    flat = binned + np.arange(width) * BINS
    total, features, cuts, leaves = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            here = np.flatnonzero(node == i)
            best = _split(flat[here], slope[here], bend[here], width) if len(here) else None
            right = np.zeros(len(here), bool)
            if best is not None:
                feature[i], cut[i] = best[0], edges[best[0]][best[1]]
                right = binned[here, best[0]] > best[1]
            node[here] = 2 * i + 1 + right
        leaf = np.zeros(inner + 1)
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, bend, inner + 1)
        leaf = -RATE * g / (h + PENALTY)
        total += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Model(base, np.array(features), np.array(cuts), np.array(leaves))


def _split(flat: np.ndarray, slope: np.ndarray, bend: np.ndarray, width: int):
    """(feature, last bin on the left) of the best split of these rows, or None."""
    cells = flat.ravel()
    shape = width, BINS
    n = np.bincount(cells, minlength=width * BINS).reshape(shape).cumsum(1)
    g = np.bincount(cells, np.repeat(slope, width), width * BINS).reshape(shape).cumsum(1)
    h = np.bincount(cells, np.repeat(bend, width), width * BINS).reshape(shape).cumsum(1)
    all_g, all_h = slope.sum(), bend.sum()
    gain = (
        g**2 / (h + PENALTY)
        + (all_g - g) ** 2 / (all_h - h + PENALTY)
        - all_g**2 / (all_h + PENALTY)
    )
    gain[(n < LEAST_IN_LEAF) | (len(slope) - n < LEAST_IN_LEAF)] = 0
    best = int(np.argmax(gain))
    return divmod(best, BINS) if gain.flat[best] > 1e-6 else None


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(text or b"") for text in texts], dtype=object)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents whose id is not held out.

    A bounded sample: for each label the ``PER_LABEL`` ids that hash lowest.  Statistics are
    taken in tasks; ``2 * PER_LABEL`` rows of them reach the driver.  Rows with a null id,
    text or label are left out.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(
        "label IN (0, 1)"
    )
    known = known.where(id_remainder(F.col("doc_id"), 5) != 0)
    picked = smallest_hashes(known.where("label = 0"), "doc_id", PER_LABEL).unionByName(
        smallest_hashes(known.where("label = 1"), "doc_id", PER_LABEL)
    )
    rows = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked), "doc_id")  # 2 * PER_LABEL rows
        .select(
            F.xxhash64("text").alias("order"),
            "label",
            _statistics_of(F.col("text").cast("binary")).alias("statistics"),
        )
        .orderBy("order", "label")
        .limit(2 * PER_LABEL)
        .collect()
    )
    table = np.array([r["statistics"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit(table, np.array([r["label"] for r in rows]))


def scorer(model: Model):
    """A column function: UTF-8 bytes of a text to its score, the chance of label 1."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(_table(texts.tolist())))

    return quality


def quality(documents: DataFrame, model: Model, into: str = "quality") -> DataFrame:
    """All rows and columns of ``documents`` plus ``into``, a score from 0 to 1.

    A null text scores as an empty one.  Repeated rows are each scored; an empty table gives
    an empty result; other columns pass through.
    """
    return documents.withColumn(into, scorer(model)(F.col("text").cast("binary")))
