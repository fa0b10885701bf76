"""Which tokens of two tokenizers cover the same bytes of a text.

Both sides encode a space and the text: side A by a byte-level vocabulary of the tokenizers
library, side B by a sentencepiece model, which adds the space itself.  Byte offsets where
tokens of both sides end cut the text into groups.  ``merge_asof`` finds for each token start of
one side, within its document, the token of the other side that covers it; both directions
together are all overlapping pairs, the links.

Texts that are null, empty, or not given back byte for byte by both sides (like texts with
U+2581, which B reads as a space) have no tokens.  Rows are documents, told apart by their
place, so repeated rows, repeated ids and null ids each give a row and count as documents of
their own.  Empty tables give empty results.  ``groups`` keeps all other columns; the names it
adds take underscores where the table has them already.

A text is cut into segments before a space between other characters, where both tokenizers
always begin a token, so groups never cross segments and memory follows the segment, not the
text, unless a text has no such space.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from salesmart.llm.common import free_name, kept_tool, stored

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Characters of a segment, and of the segments aligned at a time.
SEGMENT = 400_000
PORTION = 1_000_000
#: Links of documents written at a time.
LINKS_AT_A_TIME = 2_000_000
#: Pairs whose counts are sent to every task at most: the most frequent ones.  The counts of all
#: others meet their documents by a shuffle.
HOT_PAIRS = 1 << 19
#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge bytes.
_PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_B_SPACE = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _SideA:
    """Ids of a byte-level vocabulary.

    Where the file merges in the order of its ids, as ranks do, tiktoken gives the same ids four
    times as fast; otherwise the tokenizers library encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        letters = _letter_bytes()
        vocabulary = {
            bytes(letters[c] for c in token): number
            for token, number in parts["model"]["vocab"].items()
            if all(c in letters for c in token)
        }
        added = {token["id"] for token in parts["added_tokens"]}
        ranks = {token: number for token, number in vocabulary.items() if number not in added}
        size = max([*vocabulary.values(), *added]) + 1
        self.bytes = [b""] * size
        for token, number in vocabulary.items():
            self.bytes[number] = token
        merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        numbers = [parts["model"]["vocab"][left + right] for left, right in merges]
        cut = parts["pre_tokenizer"] or {}
        self.fast = None
        if (
            numbers == sorted(numbers)
            and len(ranks) == 256 + len(merges)
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not parts["normalizer"]
        ):
            import tiktoken

            self.fast = tiktoken.Encoding(
                "own", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}
            )
        else:
            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True  # their strings are plain text
        self.divisible = self.fast is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is not None:
            return [np.array(self.fast.encode_ordinary(t), np.int64) for t in texts]
        found = self.slow.encode_batch(texts, add_special_tokens=False)
        return [np.array(f.ids, np.int64) for f in found]


class _SideB:
    """Ids of a sentencepiece model, of texts without their leading space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [
            bytes([int(piece[3:5], 16)])
            if model.is_byte(i)
            else piece.replace(_B_SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        # No piece may hold a space after another character.
        self.divisible = not any(
            _B_SPACE in piece.lstrip(_B_SPACE) for piece in pieces
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@dataclass
class Part:
    """Aligned segments of one document: token ids of both sides and where its groups end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray  # tokens of A up to the end of each group
    b_ends: np.ndarray
    links: np.ndarray  # distinct pairs a << 32 | b, ascending
    times: np.ndarray  # occurrences of each
    written: str | None = None


@dataclass
class _Document:
    number: int
    parts: list[Part] = field(default_factory=list)
    whole: bool = True


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _SideA(a_path), _SideB(b_path)
        self.a_sizes, self.b_sizes = (
            np.array([len(token) for token in side.bytes]) for side in (self.a, self.b)
        )
        self.divisible = self.a.divisible and self.b.divisible
        # Decimal ids with the sign after them: inside a group's side, and at its end.
        self.signs = [f"{i}{s}" for i in range(len(self.a.bytes)) for s in ",|"]
        self.signs += [f"{i}{s}" for i in range(len(self.b.bytes)) for s in ",;"]

    def segments(self, text: str) -> Iterator[str]:
        """The space and the text, cut before single spaces between other characters."""
        text = " " + text
        begin = 0
        while self.divisible and len(text) - begin > SEGMENT:
            at = begin + SEGMENT
            while (at := text.find(" ", at)) >= 0 and (
                at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()
            ):
                at += 1
            if at < 0:
                break
            yield text[begin:at]
            begin = at
        yield text[begin:] if begin else text

    def align(self, segments: list[tuple[int, str]], written: bool) -> list[tuple[int, Part | None]]:
        """Parts of (document, segment) pairs, one for each document, None if bytes differ."""
        texts = [segment for _, segment in segments]
        a_ids = self.a.encode(texts)
        b_ids = self.b.encode([text[1:] for text in texts])
        spoilt = {
            number
            for (number, text), a, b in zip(segments, a_ids, b_ids)
            if not _same(text.encode(), a, self.a.bytes) or not _same(text.encode(), b, self.b.bytes)
        }
        numbers = list(dict.fromkeys(number for number, _ in segments))
        kept = [i for i, (number, _) in enumerate(segments) if number not in spoilt]
        whole = [number for number in numbers if number not in spoilt]
        place = {number: i for i, number in enumerate(whole)}
        document = np.array([place[segments[i][0]] for i in kept], np.int64)
        parts = self._parts(
            len(whole), document, [a_ids[i] for i in kept], [b_ids[i] for i in kept], written
        )
        found = dict(zip(whole, parts))
        return [(number, found.get(number)) for number in numbers]

    def _parts(self, documents, document, a_ids, b_ids, written) -> list[Part]:
        if not documents:
            return []
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        a_document = np.repeat(document, [len(ids) for ids in a_ids])
        b_document = np.repeat(document, [len(ids) for ids in b_ids])
        # All segments lie end to end, so starts ascend over the documents.
        a_starts, b_starts = (
            np.cumsum(size) - size for size in (self.a_sizes[a], self.b_sizes[b])
        )
        left = pd.DataFrame({"start": a_starts, "document": a_document, "a": np.arange(len(a))})
        right = pd.DataFrame({"start": b_starts, "document": b_document, "b": np.arange(len(b))})
        over_a = pd.merge_asof(left, right, on="start", by="document")["b"].to_numpy()
        over_b = pd.merge_asof(right, left, on="start", by="document")["a"].to_numpy()
        a_first = b_starts[over_a] == a_starts  # a token that begins where one of B begins
        b_first = a_starts[over_b] == b_starts
        # Pairs with equal starts come from both directions.
        link_a = np.concatenate([np.arange(len(a)), over_b[~b_first]])
        link_b = np.concatenate([over_a, np.flatnonzero(~b_first)])
        pairs, times = np.unique(
            (a_document[link_a] * len(self.a.bytes) + a[link_a]) * len(self.b.bytes) + b[link_b],
            return_counts=True,
        )
        of, second = np.divmod(pairs, len(self.b.bytes))
        of, first = np.divmod(of, len(self.a.bytes))
        links = (first << 32) | second
        a_last, b_last = np.append(a_first[1:], True), np.append(b_first[1:], True)
        a_ends, b_ends = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        signs = self._in_order(a, b, a_first, b_first, a_last, b_last) if written else None
        ids = np.arange(documents + 1)
        a_cuts, b_cuts = np.searchsorted(a_document, ids), np.searchsorted(b_document, ids)
        link_cuts = np.searchsorted(of, ids)
        group_cuts = np.append(np.searchsorted(a_ends, a_cuts[:-1], "right"), len(a_ends))
        parts = []
        for i in range(documents):
            mine = slice(a_cuts[i], a_cuts[i + 1]), slice(b_cuts[i], b_cuts[i + 1])
            ends = slice(group_cuts[i], group_cuts[i + 1])
            some = slice(link_cuts[i], link_cuts[i + 1])
            text = None
            if signs is not None:
                codes = signs[mine[0].start + mine[1].start : mine[0].stop + mine[1].stop]
                text = "".join(map(self.signs.__getitem__, codes.tolist()))
            parts.append(
                Part(
                    a[mine[0]],
                    b[mine[1]],
                    a_ends[ends] - a_cuts[i],
                    b_ends[ends] - b_cuts[i],
                    links[some],
                    times[some],
                    text,
                )
            )
        return parts

    def _in_order(self, a, b, a_first, b_first, a_last, b_last) -> np.ndarray:
        """Places in ``signs`` of all tokens, group by group, side A first."""
        a_group, b_group = np.cumsum(a_first) - 1, np.cumsum(b_first) - 1
        a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
        out = np.empty(len(a) + len(b), np.int64)
        before = np.concatenate([[0], b_upto])[a_group]
        out[np.arange(len(a)) + before] = 2 * a + a_last
        out[np.arange(len(b)) + a_upto[b_group]] = 2 * (len(self.a.bytes) + b) + b_last
        return out

    def documents(self, texts: Iterable[str | None], written: bool) -> Iterator[_Document]:
        """The parts of each text, in order; a document without tokens has none."""
        waiting: list[_Document] = []
        segments: list[tuple[int, str]] = []
        size = 0

        def work() -> None:
            nonlocal size
            by_number = {d.number: d for d in waiting}
            for number, part in self.align(segments, written):
                if part is None:
                    by_number[number].whole = False
                else:
                    by_number[number].parts.append(part)
            segments.clear()
            size = 0

        for number, text in enumerate(texts):
            waiting.append(_Document(number))
            for segment in self.segments(text) if text else ():
                segments.append((number, segment))
                size += len(segment)
                if size >= PORTION:
                    work()
                    done, waiting[:] = waiting[:-1], waiting[-1:]
                    yield from done
        work()
        yield from waiting


def _same(text: bytes, ids: np.ndarray, tokens: list[bytes]) -> bool:
    return b"".join(map(tokens.__getitem__, ids.tolist())) == text


def aligner(a_path: str, b_path: str) -> Aligner:
    return kept_tool(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)


def _shifted(parts: list[Part], ends: str, ids: str) -> np.ndarray:
    """Group ends counted from the document's first token."""
    before, found = 0, []
    for part in parts:
        found.append(getattr(part, ends) + before)
        before += len(getattr(part, ids))
    return _joined(found, np.int32)


def _groups_of(document: _Document) -> tuple:
    parts = document.parts if document.whole else []
    return (
        _joined([p.a for p in parts], np.int32),
        _joined([p.b for p in parts], np.int32),
        _shifted(parts, "a_ends", "a"),
        _shifted(parts, "b_ends", "b"),
    )


def _digest_of(document: _Document) -> tuple:
    parts = document.parts if document.whole else []
    if not parts:
        return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
    digest = hashlib.sha256()
    for part in parts[:-1]:
        digest.update(part.written.encode())
    digest.update(parts[-1].written[:-1].encode())  # nothing follows the last group
    links, times = parts[0].links, parts[0].times
    if len(parts) > 1:
        links, place = np.unique(np.concatenate([p.links for p in parts]), return_inverse=True)
        times = np.bincount(place, np.concatenate([p.times for p in parts])).astype(np.int64)
    return (
        sum(len(p.a) for p in parts),
        sum(len(p.b) for p in parts),
        sum(len(p.a_ends) for p in parts),
        int(times.sum()),
        digest.hexdigest(),
        links,
        times,
    )


_GROUPS = {"a_ids": "array<int>", "b_ids": "array<int>", "a_ends": "array<int>", "b_ends": "array<int>"}
_DIGEST = {
    "n_a": "long",
    "n_b": "long",
    "n_groups": "long",
    "n_links": "long",
    "groups_sha256": "string",
    "links": "array<long>",
    "times": "array<long>",
}


def _arrow_of(kind: str, values: list) -> pa.Array:
    if kind.startswith("array"):
        lengths = np.cumsum([0, *map(len, values)])
        flat = np.concatenate(values) if values else np.empty(0, np.int64)
        item = pa.int32() if kind == "array<int>" else pa.int64()
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, item))
    return pa.array(values, pa.string() if kind == "string" else pa.int64())


def _mapped(documents: DataFrame, text: str, paths: tuple[str, str], columns: dict, of, written):
    """``documents`` without ``text`` and with ``columns``, made of each document by ``of``."""
    others = [name for name in documents.columns if name != text]
    schema = StructType([documents.schema[name] for name in others])
    names = [free_name(documents.select(others), name) for name in columns]
    kinds = list(columns.values())
    for name, kind in zip(names, kinds):
        schema = schema.add(name, DataType.fromDDL(kind))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        for batch in batches:
            rest = [batch.column(batch.schema.get_field_index(name)) for name in others]
            begin, held, size = 0, [], 0
            texts = (value.as_py() for value in batch.column(batch.schema.get_field_index(text)))

            def out():
                made = [_arrow_of(kind, list(v)) for kind, v in zip(kinds, zip(*held))]
                kept = [column.slice(begin, len(held)) for column in rest]
                return pa.RecordBatch.from_arrays(kept + made, [*others, *names])

            for document in tool.documents(texts, written):
                held.append(of(document))
                size += sum(len(v) for v in held[-1] if isinstance(v, np.ndarray))
                if size >= LINKS_AT_A_TIME:
                    yield out()
                    begin, held, size = begin + len(held), [], 0
            if held:
                yield out()

    return documents.select(*others, text).mapInArrow(task, schema), names


def groups(
    documents: DataFrame, text: str = "text", paths: tuple[str, str] | None = None
) -> DataFrame:
    """The token ids of both sides and where each group ends in them.

    Adds to all columns but ``text``: ``a_ids``, ``b_ids``, and ``a_ends``, ``b_ends``, the
    numbers of tokens up to the end of each group.
    """
    return _mapped(documents, text, paths or default_paths(), _GROUPS, _groups_of, False)[0]


def digests(
    documents: DataFrame,
    text: str = "text",
    paths: tuple[str, str] | None = None,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Numbers of tokens, groups and links, a hash of the groups, and how usual its links are.

    Instead of ``text``: n_a, n_b, n_groups, n_links, groups_sha256; n_best, the links whose pair
    of ids is linked in as many documents as any pair of that A id; count_sum, the numbers of
    documents summed over the links.
    """
    aligned, names = _mapped(
        documents, text, paths or default_paths(), _DIGEST, _digest_of, True
    )
    n_links, sha, links, times = names[3:]
    row = free_name(aligned, "row")
    aligned = stored(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    found = aligned.select(
        F.col(row).alias("row"), F.inline(F.arrays_zip(F.col(links).alias("pair"), F.col(times).alias("times")))
    )
    usual = _usual(found, hot_pairs)
    sums = usual.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("count")).alias("_sum"),
    )
    plain = aligned.drop(links, times)
    return plain.join(sums, F.col(row) == F.col("_row"), "left").select(
        *[name for name in plain.columns if name not in (row, sha)],
        F.coalesce("_best", F.lit(0)).alias(free_name(plain, "n_best")),
        F.coalesce("_sum", F.lit(0)).alias(free_name(plain, "count_sum")),
        sha,
    )


def _first_id(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def _usual(found: DataFrame, hot_pairs: int) -> DataFrame:
    """Adds ``count``, the rows that hold the pair, and ``best``, whether its A id has no higher.

    The most frequent pairs go to all tasks, ``hot_pairs`` at most; they make up nearly all
    links.  All other pairs meet their counts by a shuffle on the pair.
    """
    counts = found.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = stored(counts, "pairs")
    highest = counts.groupBy(_first_id(F.col("pair")).alias("a")).agg(F.max("count").alias("most"))
    counts = stored(
        counts.join(highest, _first_id(F.col("pair")) == F.col("a")).select(
            "pair", "count", (F.col("count") == F.col("most")).alias("best")
        ),
        "usual_pairs",
    )
    steps = (
        counts.groupBy(F.floor(F.log2("count")).cast("int").alias("step"))
        .agg(F.count(F.lit(1)).alias("pairs"))
        .collect()  # a row for each power of two
    )
    least, hot = None, 0
    for step, pairs in sorted(map(tuple, steps), reverse=True):
        if hot + pairs > hot_pairs:
            break
        least, hot = 2**step, hot + pairs
    if least is None:
        return found.join(counts, "pair")
    most = counts.where(F.col("count") >= least)
    usual = found.join(F.broadcast(most), "pair")
    if hot == sum(pairs for _, pairs in steps):
        return usual
    rare = found.join(F.broadcast(most.select("pair")), "pair", "left_anti")
    return usual.unionByName(rare.join(counts.where(F.col("count") < least), "pair"))
