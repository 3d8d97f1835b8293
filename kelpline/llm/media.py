"""Media columns: texts stored as 8-bit images in archives, read by a Spark data source.

An archive is a sequence of members, each a header and a lossless 8-bit grey
PNG, then a directory of where the members start, then a footer that says where
the directory lies. The data source lists archives on the driver and plans byte
ranges over them; a reader opens the directory, takes the members that start in
its range and streams them in Arrow batches, retrying each member by its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kelpline.llm.common import shared_dir

UNIT = 64  # a payload's length is a positive multiple of this; also the width of its image
_MEMBER = struct.Struct("<4sBqQQI")  # mark, whether the id is null, id, unpadded bytes, media bytes, media crc32
_MARK, _FOOT = b"MEMB", struct.Struct("<4sQQI")  # mark, directory's offset, members, directory's crc32
_PNG = b"\x89PNG\r\n\x1a\n"
READ_TRIES = 4
MANIFEST = "manifest.txt"


# ------------------------------------------------------------------- codec


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and the padded UTF-8 bytes of a text (null: empty)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image, UNIT samples wide, a row for each UNIT bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of such an image; ValueError if anything in it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, height, data = 8, 0, b""
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
            if width != UNIT or body[8:10] != b"\x08\x00":
                raise ValueError("not an 8-bit grey image of the expected width")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy and mean step of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


# ------------------------------------------------------------------ archives


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ArchiveWriter:
    """Writes one archive; nothing reads it before `close` has moved it in place."""

    def __init__(self, folder: str):
        self.fs, path = _open(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.arc"
        self.fs.create_dir(path, recursive=True)
        self.stream = self.fs.open_output_stream(f"{self.path}.tmp")
        self.offsets: list[int] = []
        self.at = 0

    def add(self, member: int | None, n_bytes: int, media: bytes) -> None:
        self.offsets.append(self.at)
        head = _MEMBER.pack(_MARK, member is None, member or 0, n_bytes, len(media), zlib.crc32(media))
        self.stream.write(head)
        self.stream.write(media)
        self.at += len(head) + len(media)

    def close(self) -> tuple[str, int]:
        directory = np.array(self.offsets, dtype="<u8").tobytes()
        self.stream.write(directory)
        self.stream.write(_FOOT.pack(_MARK, self.at, len(self.offsets), zlib.crc32(directory)))
        self.stream.close()
        self.fs.move(f"{self.path}.tmp", self.path)
        return self.path.rpartition("/")[2], len(self.offsets)


def directory_of(file, size: int) -> np.ndarray:
    """Where the members of an archive start, with the end of the last."""
    mark, at, n, crc = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
    raw = file.read_at(8 * n, at)
    if mark != _MARK or zlib.crc32(raw) != crc:
        raise ValueError("a damaged directory")
    return np.append(np.frombuffer(raw, dtype="<u8"), at).astype(np.int64)


def read_member(open_file, offset: int, length: int, tries: int = READ_TRIES, pause: float = 0.2):
    """(id, unpadded bytes, media) of the member at ``offset``; a failed try reopens the file."""
    for k in range(tries):
        try:
            raw = open_file(k > 0).read_at(length, offset)
            mark, null, member, n_bytes, size, crc = _MEMBER.unpack_from(raw)
            media = raw[_MEMBER.size :]
            if mark != _MARK or len(media) != size or zlib.crc32(media) != crc:
                raise ValueError(f"a damaged member at {offset}")
            return (None if null else member), n_bytes, media
        except (OSError, ValueError, struct.error):
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


def write_archives(docs: DataFrame, folder: str, level: int = 6, most_bytes: int = 128 << 20) -> None:
    """Store every text as a member of an archive in ``folder``.

    Each attempt of a task writes files of its own and reports them; only files
    of successful attempts are listed in the folder's manifest, so a retried or
    lost task leaves no member twice. The driver gets one name per task and
    ``most_bytes`` of media.
    """

    def run(batches):
        names: list[str] = []
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_bytes, payload = payload_of(text.as_py())
                writer = writer or ArchiveWriter(folder)
                writer.add(doc_id, n_bytes, encode_png(payload, level))
                if writer.at >= most_bytes:
                    names.append(writer.close()[0])
                    writer = None
        if writer:
            names.append(writer.close()[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = sorted(r[0] for r in chosen.mapInArrow(run, "name string").collect())
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write("\n".join(names).encode())


# --------------------------------------------------------------- data source


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    size: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the manifest's archives; only names and sizes are read here."""
        files, path = _open(self.folder)
        with files.open_input_stream(f"{path}/{MANIFEST}") as listed:
            names = listed.read().decode().split()
        found = files.get_file_info([f"{path}/{n}" for n in names])
        return [ByteRange(i.path, at, min(at + self.range_bytes, i.size), i.size) for i in sorted(found, key=lambda i: i.path) for at in range(0, i.size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive
            return
        files, _ = _open(self.folder)
        opened: list = []

        def open_file(again: bool = False):
            if again and opened:
                opened.pop().close()
            if not opened:
                opened.append(files.open_input_file(partition.path))
            return opened[0]

        offsets = directory_of(open_file(), partition.size)
        first, last = np.searchsorted(offsets[:-1], [partition.start, partition.end])
        rows: list[tuple] = []
        held = 0
        for k in range(first, last):
            rows.append(read_member(open_file, int(offsets[k]), int(offsets[k + 1] - offsets[k])))
            held += len(rows[-1][2])
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: doc_id, n_bytes, media."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**options).load(folder)


def described(media: DataFrame) -> DataFrame:
    """Decodes stored media and describes the bytes read back."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, stored in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes", "media")), strict=True):
                stored = stored.as_py()
                back = decode_png(stored)
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, level: int = 6) -> DataFrame:
    """Stores every text in archives in the shared folder and describes what is read back.

    A row per row of ``docs``. A null or empty text is UNIT zero bytes; a null
    doc_id stays null; repeated rows are stored each for itself; an empty table
    gives an empty result; other columns are ignored.

    Scale: archives are compressed, so they take less room than their texts;
    ranges of some MB keep readers small whatever an archive's size. A payload
    is held whole by one task.
    """
    folder = f"{shared_dir(docs.sparkSession)}/archives-{uuid.uuid4().hex}"
    write_archives(docs, folder, level)
    return described(read_archives(docs.sparkSession, folder))
