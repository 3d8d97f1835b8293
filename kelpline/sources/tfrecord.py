"""TFRecord files as a Spark data source: a row a record, with its features as JSON.

A record is a length, its checksum, the payload and the payload's checksum
(CRC-32C, masked). Payloads are Example messages of bytes, floats and integers.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8  # fixed values of CRC-32C and its mask
_table: list[int] = []


def crc32c(data: bytes) -> int:
    if not _table:
        for n in range(256):
            for _ in range(8):
                n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
            _table.append(n)
    c = 0xFFFFFFFF
    for b in data:
        c = _table[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def payloads(stream, verify: bool = True) -> Iterator[bytes]:
    while head := stream.read(12):
        n, crc = struct.unpack("<QI", head)
        if crc != masked(head[:8]):
            raise ValueError("a damaged length")
        body, (crc,) = stream.read(n), struct.unpack("<I", stream.read(4))
        if len(body) != n or (verify and crc != masked(body)):
            raise ValueError("a damaged record")
        yield body


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield number, wire, value


def _list(kind: int, raw: bytes) -> list:
    out: list = []
    for _, wire, v in fields(raw):
        if kind == 1:
            out.append(base64.b64encode(v).decode())
        elif kind == 2:
            out += [x for (x,) in struct.iter_unpack("<f", v)]
        elif wire == 0:
            out.append(v - (1 << 64) if v >> 63 else v)
        else:
            at = 0
            while at < len(v):
                x, at = _varint(v, at)
                out.append(x - (1 << 64) if x >> 63 else x)
    return out


def example(raw: bytes) -> dict[str, list]:
    """Features of an Example: base64 texts, floats or integers."""
    out = {}
    for _, _, features in fields(raw):
        for _, _, entry in fields(features):
            own = {n: v for n, _, v in fields(entry)}
            out[own[1].decode()] = next((_list(kind, v) for kind, _, v in fields(own.get(2, b""))), [])
    return out


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TfRecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.verify = options["path"], options.get("verify", "true") == "true"

    def partitions(self) -> list[_Shard]:
        files, path = pafs.FileSystem.from_uri(self.path)
        if files.get_file_info(path).type == pafs.FileType.File:
            return [_Shard(path)]
        found = files.get_file_info(pafs.FileSelector(path, recursive=True))
        return [_Shard(i.path) for i in sorted(found, key=lambda i: i.path) if ".tfrecord" in i.base_name]

    def read(self, partition: _Shard | None) -> Iterator[tuple]:
        if partition is None:
            return
        files, _ = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path) as stream:
            for k, raw in enumerate(payloads(stream, self.verify)):
                yield partition.path, k, json.dumps(example(raw), sort_keys=True)


class TfRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "file string, record long, features string"

    def reader(self, schema) -> TfRecordReader:
        return TfRecordReader(self.options)


def read_tfrecords(spark: SparkSession, path: str) -> DataFrame:
    """Records of a shard or of every shard under a folder; ``from_json`` gives them a type."""
    spark.dataSource.register(TfRecordSource)
    return spark.read.format("tfrecord").load(path)
