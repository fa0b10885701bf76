"""Texts to token ids with a public tokenizer, word by word with a memory of words."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from salesmart.llm.common import kept_tool

#: Bytes that end a word without being letters, digits or part of a special token's name.
_ENDINGS = b".,!?;:%&$#*"
#: A full stop or comma that ends a plain word: a piece of its own.
_LAST = r"([A-Za-z0-9])([.,])([ \n])"
#: Bytes of words and their ids that a worker remembers, about.
REMEMBERED = 48_000_000
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: itself if printable, else from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class _Words:
    """Words with their ids, laid end to end."""

    #: Bytes that an entry takes beside its word and ids.
    ENTRY = 150

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.ids = array("I")
        self.ends = array("q", [0])  # of the ids of each row, after a 0
        self.letters = 0

    def size(self) -> int:
        return self.ENTRY * len(self.row) + self.letters + 4 * len(self.ids)

    def add(self, word: bytes, ids) -> int:
        row = self.row[word] = len(self.row)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.letters += len(word)
        return row

    def get(self, word: bytes):
        if (row := self.row.get(word)) is None:
            return None
        return self.ids[self.ends[row] : self.ends[row + 1]]


class Encoder:
    """The ids that ``tokenizer.encode(text, add_special_tokens=False)`` gives, at speed.

    For byte-level tokenizers that drop white space and lower the case, like the one the
    queries use: they cut a text into letters, single digits and runs of other signs, each
    encoded by itself.  So the ids of a text are those of its words in a row, those of a
    word that ends in common signs are its stem's and its ending's.  Arrow cuts texts at ASCII
    white space and numbers the distinct words, so that Python sees each of them once a
    portion; they are remembered until they take too many bytes.  A new stem of plain Latin letters is one piece and goes
    straight to the tokenizer's model; anything else, and words with ``<|``, which may hold
    a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.endings: dict[bytes, list[int]] = {}
        self.words = _Words()

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _stem(self, stem: bytes) -> list[int]:
        if stem.isalpha():
            return [t.id for t in self.model.tokenize(stem.decode())]
        text = stem.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            spelled = text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            return [t.id for t in self.model.tokenize(spelled)]
        return self._whole(text)

    def _encode(self, word: bytes):
        if b"<|" in word:
            return self._whole(word.decode())
        low = word.lower()
        stem = low.rstrip(_ENDINGS)
        if stem == low:
            return self._stem(low) if stem == word else self._known(low)
        if not stem or not stem.decode()[-1].lower()[-1].isalnum():
            return self._whole(word.decode())  # signs before the ending belong to it
        ending = low[len(stem) :]
        if (tail := self.endings.get(ending)) is None:
            tail = self._whole(ending.decode())
            if len(ending) <= 3:
                self.endings[ending] = tail
        return [*self._known(stem), *tail]

    def _known(self, stem: bytes):
        """Ids of a lower-case stem, remembered as a word."""
        ids = self.words.get(stem)
        if ids is None:
            ids = self._stem(stem)
            self.words.add(stem, ids)
        return ids

    def _row(self, word: bytes) -> int:
        ids = self._encode(word)
        row = self.words.row.get(word)  # a stem of its own by now
        return self.words.add(word, ids) if row is None else row

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text, as arrays of unsigned 32-bit integers."""
        if not texts:
            return []
        if self.words.size() > REMEMBERED:
            self.words = _Words()
        cut = pc.replace_substring_regex(
            pa.array(texts, pa.large_binary()).cast(pa.large_string()), _LAST, r"\1 \2\3"
        )
        split = pc.ascii_split_whitespace(cut)
        numbered = split.flatten().dictionary_encode()
        known = self.words.row
        rows = np.array(
            [
                self._row(word) if (row := known.get(word)) is None else row
                for word in numbered.dictionary.cast(pa.large_binary()).to_pylist()
            ],
            np.int64,
        )
        words = rows[numbered.indices.to_numpy()]
        bounds = np.array(self.words.ends, np.int64)
        size = (bounds[1:] - bounds[:-1])[words]
        ends = np.cumsum(size)
        places = np.arange(int(size.sum()))
        places += np.repeat(bounds[words] - ends + size, size)
        ids = np.array(self.words.ids, np.uint32)[places]
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        cuts = np.append(0, ends)[last]
        return np.split(ids, cuts[:-1])


def encoder(path: str) -> Encoder:
    """The worker's encoder: what one task has remembered serves the next."""
    return kept_tool(("encoder", path), lambda: Encoder(path))


def in_portions(texts: list[bytes | None], most: int):
    """Slices of ``texts`` of about ``most`` bytes, at least one text each; None is empty."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= most:
            yield begin, [t or b"" for t in texts[begin : i + 1]]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, [t or b"" for t in texts[begin:]]
