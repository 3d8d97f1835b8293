"""MCAP logs as a Spark data source: a row a message, in order of log time within a file.

Written from the published container format: a magic, then records of an
opcode, a length and a body; chunks hold records, as they are or compressed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x89MCAP0\r\n"
SCHEMA, CHANNEL, MESSAGE, CHUNK = 0x03, 0x04, 0x05, 0x06  # fixed values of the format
COLUMNS = "file string, topic string, schema_name string, encoding string, sequence long, log_ns long, publish_ns long, data binary"


def _text(body: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", body, at)
    return body[at + 4 : at + 4 + n].decode(), at + 4 + n


def records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(raw):
        opcode, n = struct.unpack_from("<BQ", raw, at)
        yield opcode, raw[at + 9 : at + 9 + n]
        at += 9 + n


def unpacked(body: bytes) -> bytes:
    """The records of a chunk, checked against its checksum where it has one."""
    _, _, size, crc = struct.unpack_from("<QQQI", body)
    kind, at = _text(body, 28)
    (n,) = struct.unpack_from("<Q", body, at)
    held = body[at + 8 : at + 8 + n]
    if kind == "zstd":
        import zstandard

        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=size)
    elif kind == "lz4":
        held = pa.Codec("lz4").decompress(held, size).to_pybytes()
    elif kind:
        raise ValueError(f"unknown compression {kind!r}")
    if crc and zlib.crc32(held) != crc:
        raise ValueError("a damaged chunk")
    return held


def messages(raw: bytes, topics: set[str] | None = None) -> Iterator[tuple]:
    """(topic, schema name, encoding, sequence, log_ns, publish_ns, data) in order of log time."""
    if not raw.startswith(MAGIC):
        raise ValueError("not an MCAP file")
    schemas: dict[int, str] = {}
    channels: dict[int, tuple[str, str, str]] = {}
    found: list[tuple] = []

    def walk(part: bytes) -> None:
        for opcode, body in records(part):
            if opcode == SCHEMA:
                schemas[struct.unpack_from("<H", body)[0]] = _text(body, 2)[0]
            elif opcode == CHANNEL:
                channel, schema = struct.unpack_from("<HH", body)
                topic, at = _text(body, 4)
                channels[channel] = (topic, schemas.get(schema, ""), _text(body, at)[0])
            elif opcode == MESSAGE:
                channel, sequence, log, publish = struct.unpack_from("<HIQQ", body)
                own = channels[channel]
                if topics is None or own[0] in topics:
                    found.append((*own, sequence, log, publish, body[22:]))
            elif opcode == CHUNK:
                walk(unpacked(body))

    walk(raw[len(MAGIC) :])
    yield from sorted(found, key=lambda m: m[4])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class McapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        topics = options.get("topics")
        self.topics = set(topics.split(",")) if topics else None

    def partitions(self) -> list[_File]:
        """One file, or every ``.mcap`` under a folder, in order of path."""
        files, path = pafs.FileSystem.from_uri(self.path)
        if files.get_file_info(path).type == pafs.FileType.File:
            return [_File(path)]
        found = files.get_file_info(pafs.FileSelector(path, recursive=True))
        return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if i.path.endswith(".mcap")]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:
            return
        files, _ = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path) as stream:
            raw = stream.read()
        for m in messages(raw, self.topics):
            yield (partition.path, *m)


class McapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> McapReader:
        return McapReader(self.options)


def read_mcap(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Messages of a log or a folder of logs; only the wanted topics leave the reader."""
    spark.dataSource.register(McapSource)
    reader = spark.read.format("mcap")
    return (reader.option("topics", ",".join(topics)) if topics else reader).load(path)
