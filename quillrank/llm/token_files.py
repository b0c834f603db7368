"""Token ids as little-endian numbers in independent zstandard frames with a trailing seek table."""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import pieces, record_batch
from quillrank.llm.pretokens import Memory, keys, unit
from quillrank.session import pin, scratch_path

#: Ids of a frame at least; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
#: Units that the library encodes in one text.
JOINED = 8_192
#: Units whose ids a Python worker remembers between batches.
REMEMBERED = 600_000
#: Fixed values of the seekable zstandard format: numbers at the start of its last, skippable frame and at its end.
SKIPPABLE, SEEK_TABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the descriptor of a seek table whose entries have checksums.
WITH_CHECKSUMS = 0x80

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts from the tokenizers library, as bytes; the library encodes each distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Bytes of text that each id stands for: a letter of the vocabulary is a byte, a special string is itself.
        special = self.library.get_added_tokens_decoder()
        self.sizes = np.zeros(max(self.library.get_vocab(True).values()) + 1, np.int64)
        for token, number in self.library.get_vocab(True).items():
            self.sizes[number] = len(token.encode()) if number in special else len(token)
        self.memory = Memory(self.units, REMEMBERED)
        self.feed = len(self.alone(["\n"])[0])

    def alone(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, new: list) -> list[bytes]:
        """Little-endian ids of the units behind keys.

        A unit starts with a space or line feed and has no other white space, so
        that many in a row are encoded as one text, each as if it stood alone; the
        bytes that ids stand for tell where each begins. Other texts are encoded by
        themselves.
        """
        out: list[bytes] = [b""] * len(new)
        texts = [unit(k) for k in new]
        plain = [n for n, k in enumerate(new) if len(k) > (k[:1] == "\n") and not isinstance(k, tuple)]
        for start in range(0, len(plain), JOINED):
            part = plain[start : start + JOINED]
            (found,) = self.library.encode_batch_fast(["".join([texts[n] for n in part])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum([len(texts[n].encode()) for n in part])
            places = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right") * 4
            raw = ids.tobytes()
            for n, a, b in zip(part, [0, *places[:-1].tolist()], places.tolist()):
                out[n] = raw[a:b]
        rest = sorted(set(range(len(new))).difference(plain))
        for n, ids in zip(rest, self.alone([texts[n] for n in rest])):
            out[n] = ids
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, one after the other."""
        cuts = [keys(t) for t in texts]
        got = self.memory.of(cuts)
        return [b"".join(map(got, cut))[self.feed :] for cut in cuts]


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes documents into frames and the seek table behind them."""

    def __init__(self, sink: BinaryIO, level: int = 1):
        self.sink, self.press = sink, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.waiting: list[bytes] = []
        self.size = 0
        self.entries: list[tuple[int, int, int]] = []

    def add(self, ids: bytes) -> tuple[int, int]:
        """(frame, byte in its content) where the document's ids start."""
        place = len(self.entries), self.size
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self._flush()
        return place

    def _flush(self) -> None:
        raw = b"".join(self.waiting)
        packed = self.press.compress(raw)
        self.sink.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        """Write what waits and the seek table."""
        if self.waiting:
            self._flush()
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        foot = struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_TABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Reads single frames by the seek table and compares their checksums."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        if size < 17:
            raise ValueError("no seek table")
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_TABLE or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * count
        if start < 8 or struct.unpack("<II", self._at(start - 8, 8)) != (SKIPPABLE, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(self._at(start, 12 * count), "<u4").reshape(count, 3)
        self.starts = np.r_[0, np.cumsum(self.entries[:, 0], dtype=np.int64)]
        if self.starts[-1] != start - 8:
            raise ValueError("damaged seek table")

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(int(start))
        return self.source.read(int(size))

    def frame(self, number: int) -> bytes:
        """The content of one frame."""
        packed, size, check = map(int, self.entries[number])
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[number], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return raw


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it; a path without scheme is a local one."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``part-*.zst`` files of ``folder``; return the index of what was written.

    Files follow each other, and documents lie in each, in ascending doc_id
    order; the ids of a text are followed by ``end_id``. The index has doc_id,
    part, frame, at (byte in the frame's content), part_start (ids before it in
    the file), n_tokens. Null texts are empty, an empty table gives no rows, rows
    with one doc_id stay apart, in the order of their texts; other columns are not
    read. ``folder`` must be one that all executors reach. A task writes under a
    name of its own and then renames, so that a repeated task replaces its file.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(parts, "doc_id") if parts else dealt.repartitionByRange("doc_id")
    dealt = dealt.sortWithinPartitions("doc_id", "text")
    schema = "doc_id long, part int, frame int, at int, part_start long, n_tokens long"
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filled = pieces(batches)
        first = next(filled, None)
        if first is None:
            return
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        name = posixpath.join(top, f"part-{part:06d}.zst")
        own = f"{name}.{uuid.uuid4().hex}"
        total = 0
        with system.open_output_stream(own) as sink:
            writer = FrameWriter(sink)
            for lists in chain([first], filled):
                rows = []
                for doc_id, ids in zip(lists[0], encoder(tokenizer)(lists[1])):
                    ids += end
                    rows.append((doc_id, part, *writer.add(ids), total, len(ids) // 4))
                    total += len(ids) // 4
                yield record_batch(rows, schema)
            writer.close()
        system.move(own, name)

    return pin(dealt.mapInArrow(write, schema), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, part, part_start, ids_crc32, n_tokens) of the documents in ``index``, from the files themselves.

    Only the frames that hold them are decompressed, each against its checksum.
    """
    # A file's documents stay in order, and its frames are read once: the index is small, a few numbers a document.
    runs = index.repartition("part", "frame").sortWithinPartitions("part", "frame", "at")
    schema = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        opened: tuple[int, FrameReader] | None = None
        held: tuple[tuple[int, int], bytes] | None = None
        for batch in batches:
            rows = batch.to_pydict()
            found = []
            for part, frame, at, n in zip(rows["part"], rows["frame"], rows["at"], rows["n_tokens"]):
                if not opened or opened[0] != part:
                    if opened:
                        opened[1].source.close()
                    opened = part, FrameReader(system.open_input_file(posixpath.join(top, f"part-{part:06d}.zst")))
                if not held or held[0] != (part, frame):
                    held = (part, frame), opened[1].frame(frame)
                found.append(zlib.crc32(held[1][at : at + 4 * n]))
            yield record_batch(list(zip(*(rows[k] for k in ("doc_id", "part", "part_start", "n_tokens")), found)), schema)
        if opened:
            opened[1].source.close()

    return runs.mapInArrow(read, schema)


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files, read them back: doc_id, start, n_tokens, ids_crc32 of each document.

    ``start`` counts the ids of all documents before it in ascending doc_id order.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    index = write_tokens(docs, tokenizer, folder, end_id)
    # One row for each file.
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("ids")).orderBy("part").collect()
    before = np.r_[0, np.cumsum([r["ids"] for r in sizes], dtype=np.int64)].tolist()
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, before long")
    read = read_tokens(index, folder).join(F.broadcast(offsets), "part")
    return read.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
