"""Token ids in binary files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, each of some documents, and a skippable frame at its
end that holds for every frame its compressed size, decompressed size and checksum: the
seekable format of the zstandard project.  Any zstandard reader can decompress the whole;
``read_frames`` reads the table and then only the frames asked for, and checks them.

A frame's content, little-endian: number of documents (u32), width of an id in bytes (u32),
their ids in the corpus (i64 each), their numbers of token ids (u64 each), the token ids.
Documents without an id have frames of their own, marked by the highest bit of the width.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.llm.common import CHARS_AT_A_TIME, stored
from salesmart.llm.tokens import encoder, in_portions
from salesmart.plans.scratch import scratch_path

END_ID = 1
#: Fixed values of the format: skippable frame, footer, and the flag for checksums.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Added to the width of an id in frames of documents without one, whose ids are 0.
WITHOUT_IDS = 1 << 31
#: Token ids after which a frame is closed, and documents after which a file is.
FRAME_IDS = 1 << 17
LEVEL = 3
#: Rows that a file's task sorts and encodes.
ROWS_PER_FILE = 10_000


def write_file(
    sink, documents: Iterable[tuple[int | None, np.ndarray]], width: int
) -> list[tuple]:
    """Writes (doc_id, token ids) pairs; returns (frame, documents, token ids) for each."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    table, written = [], []

    def close(held: list[tuple[int | None, np.ndarray]]) -> None:
        marked = width | WITHOUT_IDS if held[0][0] is None else width
        sizes = np.array([len(ids) for _, ids in held], "<u8")
        content = b"".join(
            [
                struct.pack("<II", len(held), marked),
                np.array([doc_id or 0 for doc_id, _ in held], "<i8").tobytes(),
                sizes.tobytes(),
                *(ids.astype(f"<u{width}").tobytes() for _, ids in held),
            ]
        )
        packed = compress(content)
        sink.write(packed)
        table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        written.append((len(written), len(held), int(sizes.sum())))

    held, n = [], 0
    for document in documents:
        if held and (held[-1][0] is None) != (document[0] is None):
            close(held)
            held, n = [], 0
        held.append(document)
        n += len(document[1])
        if n >= FRAME_IDS:
            close(held)
            held, n = [], 0
    if held:
        close(held)
    entries = b"".join(struct.pack("<III", *entry) for entry in table)
    footer = struct.pack("<IBI", len(table), WITH_CHECKSUMS, SEEKABLE)
    sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
    return written


def seek_table(source, size: int) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, size, checksum) of each frame of an open file."""
    source.seek(size - 9)
    number, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the file")
    source.seek(size - 9 - 12 * number)
    entries = list(struct.iter_unpack("<III", source.read(12 * number)))
    offsets = np.cumsum([0, *(entry[0] for entry in entries)]).tolist()
    return [(offset, *entry) for offset, entry in zip(offsets, entries)]


def read_frames(source, size: int, frames: Iterable[int]) -> Iterator[tuple]:
    """(frame, doc_id or None, token ids) of the documents of the frames asked for."""
    table = seek_table(source, size)
    for frame in frames:
        offset, packed, length, checksum = table[frame]
        source.seek(offset)
        content = zstandard.ZstdDecompressor().decompress(source.read(packed), length)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {frame} does not match its checksum")
        number, width = struct.unpack_from("<II", content)
        ids = np.frombuffer(content, "<i8", number, 8)
        sizes = np.frombuffer(content, "<u8", number, 8 + 8 * number).astype(np.int64)
        without, width = width & WITHOUT_IDS, width & ~WITHOUT_IDS
        tokens = np.frombuffer(content, f"<u{width}", offset=8 + 16 * number)
        names = [None] * number if without else ids.tolist()
        for doc_id, end, n in zip(names, np.cumsum(sizes).tolist(), sizes.tolist()):
            yield frame, doc_id, tokens[end - n : end]


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):  # Hadoop writes these in ways that are no URIs elsewhere
        path = f"/{path.removeprefix('file:').lstrip('/')}"
    return fs.FileSystem.from_uri(path)


_MANIFEST = "part int, file string, frame int, documents long, ids long"


def _write(folder: str, tokenizer: str, width: int):
    """Writes a partition's rows, in their order, as one file.

    The name is new in every attempt, and only a finished attempt's rows name it, so a task
    that is lost or run twice leaves a file that nobody reads.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = -1

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            nonlocal part
            for frame in frames:
                named = frame["named"].tolist()
                ids = [i if has else None for i, has in zip(frame["doc_id"].tolist(), named)]
                part = int(frame["part"].iloc[0]) if len(frame) else part
                for begin, texts in in_portions(frame["text"].tolist(), CHARS_AT_A_TIME):
                    for i, tokens in enumerate(encoder(tokenizer).encode_all(texts), begin):
                        yield ids[i], np.append(tokens, np.uint32(END_ID))

        stream = documents()
        first = next(stream, None)
        if first is None:
            return
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = f"tokens-{uuid.uuid4().hex}.zst"
        with system.open_output_stream(f"{root}/{name}", compression=None) as sink:
            written = write_file(sink, (x for some in ([first], stream) for x in some), width)
        yield pd.DataFrame(
            [(part, name, *row) for row in written],
            columns=["part", "file", "frame", "documents", "ids"],
        )

    return task


def write(documents: DataFrame, folder: str, tokenizer: str, width: int = 2) -> DataFrame:
    """Writes all documents in ascending order of doc_id; returns the manifest.

    The manifest has a row per frame: part (files ascend by it), file, frame, documents,
    ids, and ``first``, the number of token ids of all frames before it.  ``folder`` is a
    path or URI on storage that all executors share.  A null text is an empty one, each
    document ends with id 1.  Rows of equal id are ordered by a hash of their text, and so
    are those with a null id, which come last.  An empty table writes nothing.  ``width`` is 2 for vocabularies below 65,536, else 4.
    """
    rows = documents.select(
        # Pandas would make floating point numbers of ids among nulls.
        F.col("doc_id").isNotNull().alias("named"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    parts = max(1, -(-rows.count() // ROWS_PER_FILE))
    ordered = (
        rows.repartitionByRange(parts, F.desc("named"), "doc_id", "text_hash")
        .sortWithinPartitions(F.desc("named"), "doc_id", "text_hash")
        .select("named", "doc_id", "text", F.spark_partition_id().alias("part"))
    )
    manifest = stored(ordered.mapInPandas(_write(folder, tokenizer, width), _MANIFEST), "manifest")
    files = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    )
    return manifest.join(files, "part").select(
        *manifest.columns,
        (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("first"),
    )


def _read(folder: str):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        for rows in frames:
            for file, wanted in rows.groupby("file", sort=False):
                first = dict(zip(wanted["frame"].tolist(), wanted["first"].tolist()))
                path = f"{root}/{file}"
                with system.open_input_file(path) as source:
                    found, place, last = [], 0, None
                    for frame, doc_id, ids in read_frames(source, source.size(), sorted(first)):
                        if frame != last:
                            place, last = first[frame], frame
                        wide = ids.astype("<u4").tobytes()
                        found.append((doc_id, place, len(ids), zlib.crc32(wide)))
                        place += len(ids)
                columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pd.DataFrame(found, columns=columns, dtype=object).astype("Int64")

    return task


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the frames in ``manifest``: doc_id, start, n_tokens, ids_crc32.

    Frames are read wherever there is room, files in one piece; a manifest filtered to some
    frames reads no others.
    """
    files = max(1, manifest.select("file").distinct().count())
    return (
        manifest.select("file", "frame", "first")
        # A fixed number: by the few bytes of the manifest Spark would make it one task.
        .repartition(files, "file")
        .mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def round_trip(documents: DataFrame, tokenizer: str, without_ids: bool = False) -> DataFrame:
    """Writes all documents below the shared scratch folder and reads the files back.

    Documents with a null id are written too, and returned if ``without_ids`` is set.
    """
    spark = documents.sparkSession
    folder = scratch_path(spark, "token_files")
    manifest = stored(write(documents, folder, tokenizer), "token_manifest")
    found = read(spark, folder, manifest)
    return found if without_ids else found.where("doc_id IS NOT NULL")
