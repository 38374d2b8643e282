"""Media columns: payloads kept as grayscale PNG members of ZIP archives, read by a data source.

``write_archives`` stores each payload, cut into rows of 8-bit samples, as a PNG image in an
archive of its task. ``ArchiveMedia`` is a Spark data source over a folder of such archives. It
plans partitions as byte ranges from the archives' sizes in the folder's manifest alone; a task reads the archive's central
directory and takes the members whose data begin in its range, so that every member is read by
exactly one task and the driver never lists members. Members' bytes come in Arrow batches of
bounded size, and a member whose read or check fails is tried again by its own offset.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import storage
from .runtime import fresh_path, tidy

#: Samples per image row, and the byte that fills the last row.
ROW, FILL = 576, 255
LEVEL = 1
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
#: The file that lists a folder's archives with their sizes; a folder without one is read whole.
MANIFEST = "archives.json"
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes, row: int = ROW) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of ``row``."""
    return text + bytes([FILL]) * (max(row, -(-len(text) // row) * row) - len(text))


def _chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def to_png(samples: bytes, row: int = ROW) -> bytes:
    """An 8-bit grayscale PNG, ``row`` samples wide; the number of samples is a multiple of ``row``."""
    lines = np.zeros((len(samples) // row, row + 1), np.uint8)  # a leading 0 per line: no filter
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, row)
    header = struct.pack(">IIBBBBB", row, len(lines), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples of an 8-bit grayscale PNG without filters, a row per image line."""
    if image[:8] != PNG_MAGIC:
        raise ValueError("not a PNG image")
    at, width, packed = 8, 0, []
    while at < len(image):
        size = int.from_bytes(image[at : at + 4], "big")
        kind, content = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + content) != int.from_bytes(image[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a PNG chunk differs from its checksum")
        if kind == b"IHDR":
            width, _, depth, colour, *_ = struct.unpack(">IIBBBBB", content)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grayscale")
        elif kind == b"IDAT":
            packed.append(content)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered image lines")
    return lines[:, 1:]


def write_archives(payloads: DataFrame, folder: str) -> int:
    """Store each row of ``payloads`` (key long, bytes binary) as a member; null bytes are empty, a null key is kept as such.

    Members are named by a running number and their key. Every task writes one archive under a
    name of its own. Which archives count is said by the folder's manifest, which is written once all
    tasks have succeeded, after what it said before; an archive of a lost or repeated attempt is not in it and is
    removed. What comes to the driver is a name and a size per task. Returns the number of archives.
    """
    storage.make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = stream = None
        name, k = uuid.uuid4().hex + ".zip", 0
        system, path = storage.opened(storage.join(folder, name))
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    stream = system.open_output_stream(path, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                image = to_png(padded(content.as_py() or b""))
                archive.writestr(zipfile.ZipInfo(f"{k}.{'' if key is None else key}.{len(content.as_py() or b'')}.png"), image)
                k += 1
        if archive is not None:
            archive.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [system.get_file_info(path).size]})

    rows = payloads.select("key", "bytes").mapInArrow(tidy(write), "name string, size long").collect()
    known = {**dict(listed(folder) or ()), **{r.name: r.size for r in rows}}
    storage.replace(storage.join(folder, MANIFEST), json.dumps(sorted(known.items())).encode())
    system, _ = storage.opened(folder)
    for uri, _ in storage.files_under(folder, ".zip"):
        if uri.rsplit("/", 1)[-1] not in known:
            system.delete_file(storage.opened(uri)[1])
    return len(rows)


def listed(folder: str) -> list[tuple[str, int]] | None:
    """(name, size) of the archives that the folder's manifest lists; None without a manifest."""
    found = [(uri, size) for uri, size in storage.files_under(folder, MANIFEST)]
    return [tuple(x) for x in json.loads(storage.read_range(found[0][0], 0, found[0][1]))] if found else None


class ByteRange(InputPartition):
    def __init__(self, uri: str, size: int, start: int, end: int):
        self.uri, self.size, self.start, self.end = uri, size, start, end


class _Tail:
    """A file-like view of an archive, for reading its central directory."""

    def __init__(self, uri: str, size: int):
        self.system, self.path = storage.opened(uri)
        self.file, self.size = self.system.open_input_file(self.path), size

    def __getattr__(self, name):
        return getattr(self.file, name)

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at if whence != 2 else self.size + at)


def retried(read: Callable[[], bytes], again: Callable[[], None] | None = None, tries: int = TRIES, wait: float = 0.05) -> bytes:
    """``read()``, again after a growing pause and a call of ``again`` if it fails; the last failure is raised."""
    for k in range(tries):
        try:
            return read()
        except (OSError, ValueError, struct.error, zipfile.BadZipFile):
            if k + 1 == tries:
                raise
            if again:
                again()
            time.sleep(wait * 2**k)
    raise AssertionError


def read_member(uri: str, offset: int, size: int, crc: int, fetch: Callable[[str, int, int], bytes] = storage.read_range) -> bytes:
    """The stored bytes of the member whose local header is at ``offset``, checked against its CRC."""

    def once() -> bytes:
        header = fetch(uri, offset, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset} of {uri}")
        name, extra = struct.unpack("<HH", header[26:30])
        content = fetch(uri, offset + 30 + name + extra, size)
        if len(content) != size or zlib.crc32(content) != crc:
            raise ValueError(f"the member at {offset} of {uri} differs from its checksum")
        return content

    return retried(once, getattr(fetch, "forget", None))


SCHEMA = "key long, n_bytes long, media binary"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self) -> list[InputPartition]:
        names = listed(self.folder)
        found = storage.files_under(self.folder, ".zip") if names is None else [(storage.join(self.folder, n), size) for n, size in names]
        ranges = [ByteRange(uri, size, at, min(size, at + self.range_bytes)) for uri, size in found for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        with zipfile.ZipFile(_Tail(partition.uri, partition.size)) as archive:
            members = sorted((m.header_offset, m.filename, m.file_size, m.CRC) for m in archive.infolist() if partition.start <= m.header_offset < partition.end)
        fetch = _Ahead(partition.uri, partition.size)
        keys, sizes, contents, held = [], [], [], 0
        for offset, name, size, crc in members:
            _, key, n, _ = name.split(".")
            keys.append(int(key) if key else None)
            sizes.append(int(n))
            contents.append(read_member(partition.uri, offset, size, crc, fetch))
            held += size
            if held >= self.batch_bytes:
                yield self._batch(keys, sizes, contents)
                keys, sizes, contents, held = [], [], [], 0
        if keys:
            yield self._batch(keys, sizes, contents)

    @staticmethod
    def _batch(keys, sizes, contents) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], names=["key", "n_bytes", "media"])


class _Ahead:
    """Range reads through one buffer, as members lie side by side."""

    WINDOW = 4 << 20

    def __init__(self, uri: str, size: int):
        self.uri, self.size, self.start, self.held = uri, size, 0, b""

    def forget(self) -> None:
        """Before a second try: what is held may be what was wrong."""
        self.held = b""

    def __call__(self, uri: str, start: int, size: int) -> bytes:
        if start < self.start or start + size > self.start + len(self.held):
            self.held = storage.read_range(uri, start, max(size, min(self.WINDOW, self.size - start)))
            self.start = start
        return self.held[start - self.start : start - self.start + size]


class ArchiveMedia(DataSource):
    """``spark.read.format("archive_media").load(folder)``: a row (key, n_bytes, media) per member of the folder's archives."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").options(**options).load(folder)


def feature_of(samples: np.ndarray) -> str:
    """A short description of an image: lines, mean, deviation, share of bright samples, and a 16-level histogram's fullest levels."""
    x = samples.ravel()
    levels = np.bincount(x >> 4, minlength=16)
    top = np.argsort(-levels, kind="stable")[:4]
    mean = x.mean(dtype=np.float64)
    deviation = float(np.sqrt(max(0.0, np.square(x, dtype=np.float64).mean() - mean * mean)))
    return f"h{len(samples)};m{mean:.3f};d{deviation:.3f};b{(x >= 128).mean():.4f};l{'-'.join(map(str, top))}"


DIGEST = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """Per member of ``read_media``: sizes and hashes of payload and stored form, and the payload's feature."""
    import hashlib

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(2).to_pylist():
                samples = from_png(image)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(tidy(describe), DIGEST)


def media_table(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text's UTF-8 bytes as an image, read the archives back and describe what was read.

    Null and empty texts are one row of fill bytes; repeated rows are a member each; a null doc_id
    stays null; an empty table gives an empty result; columns other than doc_id and text are not
    read. Equal texts get equal values.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "media")
    write_archives(documents.select(F.col("doc_id").alias("key"), F.encode(F.col("text"), "UTF-8").alias("bytes")), folder)
    return described(read_media(spark, folder)).withColumnRenamed("key", "doc_id")
