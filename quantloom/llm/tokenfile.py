"""Token ids in seekable Zstandard files.

A file is a row of independent Zstandard frames, each with a content checksum:

- data frames hold the ids of whole documents, one each unless a writer is told otherwise, as
  little-endian unsigned 32-bit integers;
- one index frame holds, per document, its id, its number of token ids and the number of its data
  frame (three columns of little-endian 64-bit integers; a null doc_id is the least integer);
- the last frame is the skippable one of the public seekable format: per frame its compressed
  size, its content size and the low 32 bits of its content's XXH64, then the footer.

A reader finds any document from the seek table and the index, and decompresses its frame only.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .runtime import fresh_path, tidy

#: Fixed values of the public seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(2**63)
#: A data frame is closed at the first document end from this many ids on: with 1 each document with ids has a frame of its own.
FRAME_IDS = 1
LEVEL = 3


class TokenFileWriter:
    """Writes documents' ids, in the order in which they come, to an open binary stream."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.stream, self.frame_ids = stream, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.held_ids = self.total = 0
        self.index: list[tuple[int, int, int]] = []

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.stream.write(packed)

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
            self.held, self.held_ids = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((NO_ID if doc_id is None else int(doc_id), len(ids), len(self.frames)))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.total += len(ids)
        if self.held_ids >= self.frame_ids:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, "<i8").reshape(-1, 3).T.tobytes())
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class TokenFile:
    """Random access to one file; reads the seek table and the index, then only the frames that are asked for."""

    def __init__(self, uri: str):
        self.system, self.path = storage.opened(uri)
        self.file = self.system.open_input_file(self.path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self._bytes(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        index = np.frombuffer(self.frame(n - 1), "<i8").reshape(3, -1)
        self.doc_ids, self.counts, self.frame_of = index
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def _bytes(self, start: int, size: int) -> bytes:
        return self.file.read_at(int(size), int(start))

    def frame(self, k: int) -> bytes:
        content = zstandard.ZstdDecompressor().decompress(self._bytes(self.at[k], self.packed[k]), max_output_size=int(self.plain[k]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} of {self.path} differs from its checksum")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the documents at the places ``wanted``, ascending, or of all."""
        frame, ids, origin = -1, np.zeros(0, "<u4"), 0
        for k in range(len(self.counts)) if wanted is None else sorted(wanted):
            if self.frame_of[k] != frame:
                frame = int(self.frame_of[k])
                ids = np.frombuffer(self.frame(frame), "<u4")
                origin = self.starts[np.searchsorted(self.frame_of, frame)]
            yield k, ids[self.starts[k] - origin : self.starts[k + 1] - origin]


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches pool[begin:begin+size] in a row, and their bounds."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return pool[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


class ByteBpe:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, each distinct stretch encoded once.

    A text is cut before every space that a non-space character follows or precedes, and a stretch
    of Latin letters is cut from the ASCII punctuation (but an apostrophe) after it. At such places
    the vocabulary's splitting pattern always begins a new pretoken, and merges never cross
    pretokens, so the parts' ids in a row are the text's. Texts with a space between two other
    white-space characters (or at an end, next to one) go to the library whole.
    """

    AWKWARD = r"(^|[\s\x{1c}-\x{1f}\v\x{85}\p{Z}]) ([\s\x{1c}-\x{1f}\v\x{85}\p{Z}]|$)"
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    SPLIT = f"(?s)^(?P<word> ?[{LETTERS}]+)(?P<rest>[!-&(-/:-@\\[-`{{-~].*)$"
    MOST_KNOWN = 3 << 17

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.alphabet = self.tokenizer.model, _visible_bytes()
        self.one_word = re.compile(f" ?[{self.LETTERS}]+").fullmatch
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Of a single pretoken: straight to the model."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _parts(self, names: list[str]) -> list[bytes]:
        known = self.known if len(self.known) < self.MOST_KNOWN else {}
        self.known = known
        other = []
        for s in names:
            if s not in known:
                if self.one_word(s):
                    known[s] = self._word(s)
                else:
                    other.append(s)
        known.update(zip(other, [ids.tobytes() for ids in self.encode(other)], strict=True))
        return [known[s] for s in names]

    def _stretches(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the stretches in a row, their bounds)."""
        cut = pc.extract_regex(names, self.SPLIT)
        words = pc.if_else(cut.is_valid(), pc.struct_field(cut, "word"), names).dictionary_encode()
        rests = pc.fill_null(pc.struct_field(cut, "rest"), "").dictionary_encode()
        parts = self._parts(words.dictionary.to_pylist() + rests.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        place = np.column_stack((words.indices.to_numpy(), rests.indices.to_numpy() + len(words.dictionary))).ravel()
        begin = np.concatenate(([0], np.cumsum(size)))
        ids, ends = _gathered(np.frombuffer(b"".join(parts), np.uint32), begin[place], size[place])
        return ids, ends[::2]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        awkward = np.flatnonzero(pc.match_substring_regex(texts, self.AWKWARD).to_numpy(zero_copy_only=False))
        whole = dict(zip(awkward.tolist(), self.encode([texts[int(k)].as_py() for k in awkward]), strict=True))
        if whole:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), awkward)), "", texts)
        parts = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(parts)
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        first = np.zeros(len(flat), np.int64)
        first[bounds[:-1]] = 1
        coded = flat.dictionary_encode()
        used, place = np.unique(coded.indices.to_numpy() * np.int64(2) + 1 - first, return_inverse=True)
        lead = pc.if_else(pa.array(used % 2 == 1), " ", "")
        pool, cuts = self._stretches(pc.binary_join_element_wise(lead, coded.dictionary.take(pa.array(used // 2)).cast(pa.string()), ""))
        ids, ends = _gathered(pool, cuts[:-1][place], np.diff(cuts)[place])
        if not whole:
            return ids, ends[bounds]
        split = [whole.get(k, ids[ends[bounds[k]] : ends[bounds[k + 1]]]) for k in range(len(texts))]
        return np.concatenate(split), np.concatenate(([0], np.cumsum(list(map(len, split)))))


#: One encoder per worker process and vocabulary, so that what it knows is kept from task to task.
_encoders: dict[str, ByteBpe] = {}


def encoder_of(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


@dataclass(frozen=True)
class Written:
    """One file of the output: its place in the order, its URI, documents and ids."""

    place: int
    uri: str
    documents: int
    ids: int


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> list[Written]:
    """Encode every text and write its ids, with ``end_id`` after them, to files in ascending doc_id order.

    Null doc_ids come first; rows with one doc_id are ordered by their text, repeated rows are each
    written; null and empty texts give the end id alone; other columns are not read. A text is
    encoded whole. Rows are dealt into ranges of (doc_id, hash of the text), so that one doc_id of
    very many rows spreads over files. Each task writes a file of its own name and a lost task's
    file is not listed. What comes to the driver is a row per file.
    """
    storage.make_folder(folder)
    rows = documents.select("doc_id", F.col("text").alias("text"))
    hashed = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), hashed.asc()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), hashed.asc(), F.col("text").asc_nulls_first()
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        uri = storage.join(folder, f"tokens-{place:06d}-{uuid.uuid4().hex}.zst")
        encoder, writer, stream = encoder_of(tokenizer), None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                ids, bounds = encoder.encode_column(part.column(1))
                if writer is None:
                    system, path = storage.opened(uri)
                    stream = system.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(stream)
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    writer.add(doc_id, np.concatenate((ids[a:b], end)))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"place": [place], "uri": [uri], "documents": [len(writer.index)], "ids": [writer.total]})

    listed = dealt.mapInArrow(tidy(write), "place long, uri string, documents long, ids long").collect()
    return [Written(**r.asDict()) for r in sorted(listed, key=lambda r: r.place)]


def read_tokens(spark, files: list[Written]) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    starts = np.concatenate(([0], np.cumsum([f.ids for f in files])))
    listed = spark.createDataFrame([(f.uri, int(s)) for f, s in zip(files, starts, strict=False)], "uri string, base long").repartition(len(files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                sums = np.fromiter((zlib.crc32(ids) for _, ids in file.documents()), np.int64, len(file.counts))
                none = pa.array(file.doc_ids == NO_ID)
                doc_ids = pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(file.doc_ids.astype(np.int64)))
                columns = [doc_ids, pa.array(file.starts[:-1] + base), pa.array(file.counts.astype(np.int64)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(tidy(read), schema)


def token_table(documents: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back; see ``write_tokens`` and ``read_tokens``."""
    spark = documents.sparkSession
    return read_tokens(spark, write_tokens(documents, tokenizer, folder or fresh_path(spark, "tokens"), end_id))
