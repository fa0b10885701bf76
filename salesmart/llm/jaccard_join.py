"""Similarity self-join of documents on word n-grams, by recursive chosen paths.

1.  Each text becomes its set of hashed word n-grams.  Texts of equal sets are one class from
    here on, so copies are never compared with each other.
2.  A set is embedded as ``ELEMENTS`` minima (one-permutation minhash, densified), two of
    which agree with the Jaccard similarity as chance.  In every run a set follows each of
    its elements with chance 1 / (threshold * ELEMENTS); classes on one path share a bucket.
    A bucket of more than ``SMALL_BUCKET`` classes is split again by further elements, up
    to ``DEEPEST`` times.  A pair at the threshold meets in one run with a chance that
    branching processes give, and runs are repeated until ``TARGET_RECALL``.
3.  Classes of a bucket are compared by short sketches, all with all, in blocks; pairs that
    could be similar join their classes into a candidate group.
4.  In each candidate group all pairs are compared exactly, again in blocks, on the whole
    sets.  No pairs leave the tasks: only each class's number of links and the edges of a
    spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import (
    CHARS_AT_A_TIME,
    batched,
    components,
    drop_tools,
    find_roots,
    kept_tool,
    per_run,
    perhaps_among,
    stored,
)
from salesmart.llm.tokens import in_portions

WORDS = 5
THRESHOLD = 0.8
ELEMENTS = 128
SMALL_BUCKET = 256
DEEPEST = 4
TARGET_RECALL = 0.999
#: Bytes of the embedding compared in buckets, and the agreement that counts as possible: five
#: standard deviations below the threshold.
SKETCH = 32
#: Classes of a bucket, or of a candidate group, that one block holds; n-grams that it holds.
BLOCK_CLASSES = 512
BLOCK_NGRAMS = 400_000
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 250_000


def runs_needed(
    threshold: float = THRESHOLD, deepest: int = DEEPEST, target: float = TARGET_RECALL
) -> int:
    """Runs after which a pair at the threshold has met with chance ``target``.

    Along the elements that such a pair shares the paths branch once on average; ``missed``
    is the chance that none of length ``deepest`` is common to both.
    """
    missed = 0.0
    for _ in range(deepest):
        missed = math.exp(missed - 1)
    return math.ceil(math.log(1 - target) / math.log(missed))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams as sorted arrays of 64-bit hashes.

    Words are what stands between white space, in lower case and without anything but
    letters and digits.  A text of fewer than ``words`` words has one n-gram, all of it;
    a text without words has none.
    """

    def __init__(self, words: int = WORDS):
        self.words = words
        self.index: dict[bytes, int] = {}
        self.hashes = np.empty(1 << 16, np.uint64)
        self.used = 0

    def _learn(self, word: bytes) -> int:
        plain = "".join(filter(str.isalnum, word.decode(errors="replace").lower()))
        if not plain:
            self.index[word] = -1
            return -1
        at = self.used
        if at >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[at] = xxhash.xxh3_64_intdigest(plain.encode())
        self.index[word] = at
        self.used += 1
        return at

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if len(self.index) > REMEMBERED:
                self.index, self.used = {}, 0
            index = self.index
            rows = np.array(
                [i if (i := index.get(w)) is not None else self._learn(w) for w in text.split()],
                np.int64,
            )
            out.append(self._ngrams(self.hashes[rows[rows >= 0]]))
        return out

    def _ngrams(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        n = min(self.words, len(words))
        rolled = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(rolled)]
        return np.unique(mixed(rolled + np.uint64(n)))


def shingler(words: int) -> Shingler:
    """The worker's shingler, which remembers words until the task ends."""
    return kept_tool(("shingler", words), lambda: Shingler(words))


@cache
def _donors() -> np.ndarray:
    """For each empty bin the order in which it looks for a full one."""
    return np.argsort(np.random.default_rng(20180417).random((ELEMENTS, ELEMENTS)), axis=1)


def embed(ngrams: np.ndarray) -> np.ndarray:
    """``ELEMENTS`` minima of a sorted, not empty set, as unsigned 32-bit integers.

    The top bits of a hash choose a bin, in which the smallest hash counts; an empty bin
    borrows from the first full one in its own fixed order.
    """
    bits = np.uint64(64 - (ELEMENTS - 1).bit_length())
    bins = (ngrams >> bits).astype(np.int64)
    first = np.r_[0, np.flatnonzero(bins[1:] != bins[:-1]) + 1]
    out = np.zeros(ELEMENTS, np.uint64)
    out[bins[first]] = mixed(ngrams[first])
    if len(first) < ELEMENTS:
        full = np.zeros(ELEMENTS, bool)
        full[bins[first]] = True
        empty = np.flatnonzero(~full)
        order = _donors()[empty]
        donor = order[np.arange(len(empty)), np.argmax(full[order], axis=1)]
        out[empty] = mixed(out[donor] + empty.astype(np.uint64))
    return (out >> np.uint64(32)).astype(np.uint32)


_DESCRIBED = "doc_id {id}, class long, ngrams int, minima binary, sketch binary"


def class_of(ngrams: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(ngrams.tobytes()), "little", signed=True)


def _describe(words: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = shingler(words)
        for frame in frames:
            ids = frame["doc_id"].tolist()
            for begin, texts in in_portions(frame["text"].tolist(), CHARS_AT_A_TIME):
                out = []
                for i, found in enumerate(made.sets(texts), begin):
                    row = (ids[i], class_of(found), len(found))
                    if len(found):
                        minima = embed(found)
                        row += (minima.tobytes(), minima[:SKETCH].astype(np.uint8).tobytes())
                    else:
                        row += (None, None)
                    out.append(row)
                yield pd.DataFrame(
                    out, columns=["doc_id", "class", "ngrams", "minima", "sketch"]
                )
        made = frame = texts = found = out = None
        drop_tools()  # waiting workers keep nothing

    return task


def _followed(keys: np.ndarray, elements: np.ndarray, threshold: float):
    """Row numbers and keys of the longer paths that follow from a path key per row."""
    hashed = mixed(elements ^ keys[:, None])
    row, column = np.nonzero(hashed < np.uint64(int(2**64 / (threshold * ELEMENTS))))
    return row, mixed(hashed[row, column] + np.uint64(0x632BE59BD9B4E019)).view(np.int64)


def _elements(minima: list[bytes]) -> np.ndarray:
    values = np.frombuffer(b"".join(minima), np.uint32).reshape(-1, ELEMENTS).astype(np.uint64)
    return mixed((np.arange(ELEMENTS, dtype=np.uint64) << np.uint64(32)) | values)


def _first_paths(threshold: float, runs: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 2_000):
                part = frame.iloc[begin : begin + 2_000]
                elements, classes = _elements(part["minima"].tolist()), part["class"].to_numpy()
                for run in range(runs):
                    keys = np.full(len(part), mixed(np.array([run + 1], np.uint64))[0])
                    row, key = _followed(keys, elements, threshold)
                    yield pd.DataFrame({"bucket": key, "class": classes[row]})

    return task


def _longer_paths(threshold: float):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 2_000):
                part = frame.iloc[begin : begin + 2_000]
                keys = part["bucket"].to_numpy().view(np.uint64)
                row, key = _followed(keys, _elements(part["minima"].tolist()), threshold)
                yield pd.DataFrame({"bucket": key, "class": part["class"].to_numpy()[row]})

    return task


def _forest(left: np.ndarray, right: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the true cells of ``similar`` (left x right) connect."""
    names = np.concatenate([left, right])
    i, j = np.nonzero(similar)
    root = find_roots(len(names), i, j + len(left))
    return [(int(names[k]), int(names[r])) for k, r in enumerate(root) if names[k] != names[r]]


def least_agreement(threshold: float) -> float:
    return SKETCH * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / SKETCH))


def _possible(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    if len(left) * len(right) <= 4096:
        agree = (left[:, None, :] == right[None, :, :]).sum(axis=2)
    else:
        agree = np.zeros((len(left), len(right)), np.uint8)
        for k in range(SKETCH):
            agree += left[:, k][:, None] == right[:, k][None, :]
    return agree >= least_agreement(threshold)


_BLOCKS = "a long, b long, bucket long, block int, names binary, data binary"


def _compare_buckets(threshold: float):
    """Edges of each bucket of one block; other buckets' blocks packed into a row each."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def bucket(run: dict) -> list[tuple]:
            names = run["class"]
            if run["blocks"][0] > 1:
                data = b"".join(run["sketch"])
                here = int(run["bucket"][0]), int(run["block"][0])
                return [(None, None, *here, names.tobytes(), data)]
            if len(names) < 2:
                return []
            if len(names) == 2:  # most buckets
                agree = sum(x == y for x, y in zip(*run["sketch"]))
                edge = (int(names[0]), int(names[1]), None, None, None, None)
                return [edge] if agree >= least_agreement(threshold) else []
            sketches = np.frombuffer(b"".join(run["sketch"]), np.uint8).reshape(-1, SKETCH)
            found = _forest(names, names, _possible(sketches, sketches, threshold))
            return [(a, b, None, None, None, None) for a, b in found]

        names = ["a", "b", "bucket", "block", "names", "data"]
        for frame in batched(per_run(frames, ["bucket", "block"], bucket), names):
            yield frame.astype({"a": "Int64", "b": "Int64", "bucket": "Int64", "block": "Int32"})

    return task


def _compare_sketch_blocks(threshold: float):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.frombuffer(row.data, np.uint8).reshape(-1, SKETCH)
                y = np.frombuffer(row.other_data, np.uint8).reshape(-1, SKETCH)
                found = _forest(
                    np.frombuffer(row.names, np.int64),
                    np.frombuffer(row.other_names, np.int64),
                    _possible(x, y, threshold),
                )
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return task


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices."""
    out = np.zeros((len(x), len(y)), np.float32)
    if x is y:
        values, times = np.unique(np.concatenate(x), return_counts=True)
        both = values[times > 1]
    else:
        both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    step = 4096

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        column = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        kept = both[column] == values if len(both) else np.zeros(len(values), bool)
        row, column = row[kept], column[kept]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (xr, xc), (yr, yc) = cells(x), cells(y)
    for begin in range(0, len(both), step):
        parts = []
        for row, column, n in ((xr, xc, len(x)), (yr, yc, len(y))):
            a, b = np.searchsorted(column, [begin, begin + step])
            part = np.zeros((n, min(step, len(both) - begin)), np.float32)
            part[row[a:b], column[a:b] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _exact(names_x, sets_x, copies_x, names_y, sets_y, copies_y, threshold, same):
    """Links of each class of x and of y (counted in documents), and a spanning forest."""
    size_x = np.array([len(s) for s in sets_x], np.float64)
    size_y = np.array([len(s) for s in sets_y], np.float64)
    overlap = _overlaps(sets_x, sets_y).astype(np.float64)
    # overlap / union >= threshold, without a division that could round
    linked = overlap * (1 + threshold) >= threshold * (size_x[:, None] + size_y[None, :]) - 1e-9
    linked &= overlap > 0
    if same:
        np.fill_diagonal(linked, False)
    out = [(int(c), int(k), None) for c, k in zip(names_x, linked @ copies_y) if k]
    if not same:
        out += [(int(c), int(k), None) for c, k in zip(names_y, linked.T @ copies_x) if k]
    return out + [(a, None, b) for a, b in _forest(names_x, names_y, linked)]


_VERIFIED = "class long, links long, other long"
_VERIFIED_BLOCKS = (
    f"{_VERIFIED}, group long, block int, names binary, copies binary, sizes binary, data binary"
)


def _verify_groups(words: int, threshold: float):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def group(run: dict) -> list[tuple]:
            names, copies = run["class"], run["copies"]
            sets = shingler(words).sets([text or b"" for text in run["text"]])
            # An id may be repeated: rows of other texts drop out, and repeated rows.
            own = [i for i, found in enumerate(sets) if class_of(found) == names[i]]
            _, first = np.unique(names[own], return_index=True)
            own = np.array(own)[first]
            names, copies, sets = names[own], copies[own], [sets[i] for i in own]
            if run["blocks"][0] > 1:
                sizes = np.array([len(s) for s in sets], np.int64)
                packed = (names, copies, sizes, np.concatenate(sets))
                here = int(run["group"][0]), int(run["block"][0])
                return [(None, None, None, *here, *(x.tobytes() for x in packed))]
            found = _exact(names, sets, copies, names, sets, copies, threshold, True)
            return [(*row, None, None, None, None, None, None) for row in found]

        names = "class links other group block names copies sizes data".split()
        kinds = dict.fromkeys(["class", "links", "other", "group"], "Int64") | {"block": "Int32"}
        for frame in batched(per_run(frames, ["group", "block"], group), names):
            yield frame.astype(kinds)
        frame = None
        drop_tools()  # waiting workers keep nothing

    return task


def _verify_blocks(threshold: float):
    def unpacked(names, copies, sizes, data):
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        sets = np.split(np.frombuffer(data, np.uint64), ends[:-1])
        return np.frombuffer(names, np.int64), sets, np.frombuffer(copies, np.int64)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                x = unpacked(r.names, r.copies, r.sizes, r.data)
                y = unpacked(r.other_names, r.other_copies, r.other_sizes, r.other_data)
                found = _exact(*x, *y, threshold, r.block == r.other_block)
                yield pd.DataFrame(
                    found, columns=["class", "links", "other"], dtype=object
                ).astype("Int64")

    return task


def _block_pairs(packed: DataFrame, key: str) -> DataFrame:
    """Every block with itself and with every later block of its key."""
    other = packed.select(
        F.col(key).alias("_key"),
        *[F.col(c).alias(f"other_{c}") for c in packed.columns if c != key],
    )
    return packed.join(
        other, (F.col(key) == F.col("_key")) & (F.col("block") <= F.col("other_block"))
    ).drop("_key")


def _candidate_edges(minima: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of similar classes that met."""
    paths = minima.mapInPandas(_first_paths(threshold, runs), "bucket long, class long")
    wide, edges = [], []
    for depth in range(1, DEEPEST + 1):
        paths = stored(paths, "paths")
        sizes = paths.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        sizes = stored(sizes, "buckets")
        last = depth == DEEPEST
        whole = sizes if last else sizes.where(F.col("members") <= SMALL_BUCKET)
        sketched = paths.join(whole, "bucket").join(
            minima.select("class", "sketch"), "class"
        )
        blocks = F.ceil(F.col("members") / BLOCK_CLASSES).cast("int")
        rows = sketched.select(
            "bucket",
            "class",
            "sketch",
            blocks.alias("blocks"),
            F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"),
        )
        compared = stored(
            rows.repartition("bucket", "block")
            .sortWithinPartitions("bucket", "block")
            .mapInPandas(_compare_buckets(threshold), _BLOCKS),
            "compared",
        )
        edges.append(compared.where("a IS NOT NULL").select("a", "b"))
        if last:
            wide = compared.where("data IS NOT NULL").drop("a", "b")
            edges.append(
                _block_pairs(wide, "bucket").mapInPandas(
                    _compare_sketch_blocks(threshold), "a long, b long"
                )
            )
            break
        # Stored, so that Spark knows how few they are.
        large = stored(sizes.where(F.col("members") > SMALL_BUCKET).select("bucket"), "large")
        if large.isEmpty():
            break
        paths = stored(paths.join(large, "bucket"), "paths")
        # Whatever follows is about these classes only.
        minima = stored(
            minima.join(paths.select("class").distinct(), "class", "left_semi"), "minima"
        )
        # Dealt out by class: a broadcast would leave the work to the few tasks that read paths.
        paths = paths.join(minima.select("class", "minima").hint("merge"), "class").mapInPandas(
            _longer_paths(threshold), "bucket long, class long"
        )
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found


def join(
    documents: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per document with its class, its number of links and its component.

    Columns: doc_id; class_id, the smallest id of the documents of the same n-gram set;
    n_links, the other documents of a Jaccard similarity of ``threshold`` or more (copies
    counted each); component_id, the smallest id that links lead to, itself included; kept,
    true where doc_id = component_id.  A null or empty text, one without a word, or a null
    id links with nothing and is kept.  Rows that repeat an id count each.  An empty table
    gives an empty result; columns beside doc_id and text are not read.

    N-grams are told apart by 64-bit hashes, and so are n-gram sets.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    described = stored(
        rows.mapInPandas(_describe(words), _DESCRIBED.format(id=kind)), "described"
    )
    joined = described.where("doc_id IS NOT NULL AND ngrams > 0")
    classes = stored(
        joined.groupBy("class")
        .agg(
            F.min("doc_id").alias("class_id"),
            F.count("*").alias("copies"),
            F.first("ngrams").alias("ngrams"),
        ),
        "classes",
    )
    minima = stored(
        joined.select("class", "minima", "sketch").dropDuplicates(["class"]), "minima"
    )
    edges = _candidate_edges(minima, threshold, runs_needed(threshold, DEEPEST, target_recall))
    groups = components(edges).select(
        F.col("node").alias("class"), F.col("component").alias("group")
    )
    members = stored(groups.join(classes, "class"), "members")
    sizes = members.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("ngrams") / BLOCK_NGRAMS)
        )
        .cast("int")
        .alias("blocks")
    )
    placed = members.join(sizes, "group").select(
        F.col("class_id").alias("doc_id"),
        "group",
        "class",
        "copies",
        "blocks",
        F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"),
    )
    # How many documents have candidates is not known beforehand: never a broadcast.  Texts of
    # the others should not be shuffled.
    wanted, _ = perhaps_among(rows, members.select("class_id"), "doc_id")
    texts = wanted.join(placed.hint("merge"), "doc_id")
    verified = stored(
        texts.select("group", "block", "blocks", "class", "copies", "text")
        .repartition("group", "block")
        .sortWithinPartitions("group", "block")
        .mapInPandas(_verify_groups(words, threshold), _VERIFIED_BLOCKS),
        "verified",
    )
    packed = verified.where("data IS NOT NULL").drop("class", "links", "other")
    exact = stored(
        verified.where("data IS NULL")
        .select("class", "links", "other")
        .unionByName(
            _block_pairs(packed, "group").mapInPandas(_verify_blocks(threshold), _VERIFIED)
        ),
        "exact",
    )
    links = exact.groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(
        exact.where("other IS NOT NULL").select(
            F.col("class").alias("a"), F.col("other").alias("b")
        )
    ).select(F.col("node").alias("class"), "component")
    of_class = (
        classes.join(links, "class", "left")
        .join(linked, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    named = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = of_class.join(named, "component").select(
        "class",
        "class_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    alone = F.col("class_id").isNull()
    return (
        described.select(
            "doc_id",
            F.when(F.expr("doc_id IS NOT NULL AND ngrams > 0"), F.col("class")).alias("class"),
        )
        .join(of_class, "class", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            (alone | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
        )
    )
