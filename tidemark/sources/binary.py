"""The byte formats of logs and segments of the store that this engine replaces: codecs, and readers as Spark data
sources. All numbers are little-endian.

A log is not self-synchronising, so a log file is one partition. Replay keeps the records before the first bad one.
A record cut short by the end of the file is a torn tail (``truncated``); any other fault is corruption.
"""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.model import MAX_KEY, MAX_VALUE, PUT, TOMBSTONE, Corruption

# fixed values of the format
HEADER_MAGIC, FOOTER_MAGIC, VERSION = 0x4C534D5452454531, 0x4C534D5353544654, 1
_HEAD, _SEGMENT_HEAD, _FOOTER = struct.Struct("<BII"), struct.Struct("<QII"), struct.Struct("<6QIIQ")
_M = 0xFFFFFFFF

Record = tuple[int, bytes, bytes]  # op, key, value


def encode_record(op: int, key: bytes, value: bytes = b"") -> bytes:
    body = _HEAD.pack(op, len(key), 0 if op == TOMBSTONE else len(value)) + key + (b"" if op == TOMBSTONE else value)
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Replay:
    """What a log holds: the records of the valid prefix, its length in bytes, and how it ends."""

    records: list[Record]
    valid_bytes: int
    truncated: bool = False
    corrupt: bool = False


def replay(data: bytes) -> Replay:
    out, at = Replay([], 0), 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            out.truncated = True
            break
        op, n_key, n_value = _HEAD.unpack_from(data, at)
        if op not in (PUT, TOMBSTONE) or n_key > MAX_KEY or n_value > MAX_VALUE:
            out.corrupt = True
            break
        end = at + _HEAD.size + n_key + n_value
        if end + 4 > len(data):
            out.truncated = True
            break
        if zlib.crc32(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
            out.corrupt = True
            break
        key_end = at + _HEAD.size + n_key
        out.records.append((op, data[at + _HEAD.size : key_end], data[key_end:end]))
        at = out.valid_bytes = end + 4
    return out


def hash_pair(key: bytes) -> tuple[int, int]:
    """The two hashes of a key from which its filter positions follow."""
    first, second = 2166136261, 0
    for b in key:
        first = (first ^ b) * 16777619 & _M
        second = (second + b) * 1025 & _M
        second ^= second >> 6
    second = second * 9 & _M
    second = (second ^ second >> 11) * 32769 & _M
    return first, second or 1


class Bloom:
    def __init__(self, n_keys: int, bits_per_key: int = 10, n_hashes: int = 7):
        self.n_hashes, self.bits = n_hashes, bytearray((max(64, (n_keys or 64) * bits_per_key) + 7) // 8)
        self.n_bits = len(self.bits) * 8  # whole bytes, so that a stored filter has the positions it was built with

    def positions(self, key: bytes) -> list[int]:
        a, b = hash_pair(key)
        return [(a + i * b) % self.n_bits for i in range(self.n_hashes)]

    def add(self, key: bytes) -> None:
        for p in self.positions(key):
            self.bits[p >> 3] |= 1 << (p & 7)

    def maybe(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.positions(key))

    def pack(self) -> bytes:
        return struct.pack("<II", self.n_hashes, len(self.bits)) + bytes(self.bits)

    @classmethod
    def unpack(cls, data: bytes) -> Bloom:
        n_hashes, size = struct.unpack_from("<II", data)
        if len(data) != 8 + size:
            raise Corruption("the filter has a wrong size")
        out = cls(1, 1, n_hashes)
        out.bits, out.n_bits = bytearray(data[8:]), size * 8
        return out


def encode_segment(records: Iterable[Record], interval: int = 16, bits_per_key: int = 10, n_hashes: int = 7) -> bytes:
    """A segment file; keys must strictly increase."""
    rows = list(records)
    bloom, data, index, last = Bloom(len(rows) or 100, bits_per_key, n_hashes), bytearray(_SEGMENT_HEAD.pack(HEADER_MAGIC, VERSION, 0)), [], None
    for i, (op, key, value) in enumerate(rows):
        if last is not None and key <= last:
            raise Corruption("keys of a segment must increase")
        if i % interval == 0:
            index.append((key, len(data)))
        bloom.add(key)
        data += encode_record(op, key, value)
        last = key
    block = struct.pack("<I", len(index)) + b"".join(struct.pack("<I", len(k)) + k + struct.pack("<Q", off) for k, off in index)
    parts = [_summed(block), _summed(bloom.pack())]
    at = [_SEGMENT_HEAD.size, len(data), len(data) + len(parts[0])]
    sizes = [len(data) - _SEGMENT_HEAD.size, len(parts[0]), len(parts[1])]
    return bytes(data) + b"".join(parts) + _FOOTER.pack(at[0], sizes[0], at[1], sizes[1], at[2], sizes[2], len(rows), 0, FOOTER_MAGIC)


def _summed(block: bytes) -> bytes:
    return block + struct.pack("<I", zlib.crc32(block))


def _checked(block: bytes, what: str) -> bytes:
    if len(block) < 8 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Corruption(f"the {what} fails its checksum")
    return block[:-4]


@dataclass
class SegmentFile:
    """An opened segment: records are decoded on reading, and checked then."""

    data: bytes
    index: list[tuple[bytes, int]]
    bloom: Bloom
    data_end: int
    record_count: int

    @classmethod
    def open(cls, data: bytes) -> SegmentFile:
        if len(data) < _SEGMENT_HEAD.size + _FOOTER.size:
            raise Corruption("the file is too short for a segment")
        magic, version, _ = _SEGMENT_HEAD.unpack_from(data)
        at, size, index_at, index_size, bloom_at, bloom_size, count, _, end_magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        if (magic, version, end_magic) != (HEADER_MAGIC, VERSION, FOOTER_MAGIC):
            raise Corruption("the file is no segment of a known version")
        if at != _SEGMENT_HEAD.size or index_at != at + size or bloom_at != index_at + index_size or bloom_at + bloom_size != len(data) - _FOOTER.size:
            raise Corruption("the regions of the segment don't adjoin")
        block = _checked(data[index_at : index_at + index_size], "index")
        index, place = [], 4
        for _ in range(struct.unpack_from("<I", block)[0]):
            n = struct.unpack_from("<I", block, place)[0]
            index.append((block[place + 4 : place + 4 + n], struct.unpack_from("<Q", block, place + 4 + n)[0]))
            place += 12 + n
        return cls(data, index, Bloom.unpack(_checked(data[bloom_at : bloom_at + bloom_size], "filter")), at + size, count)

    def span(self, key: bytes) -> tuple[int, int]:
        """The bytes that may hold a key: from the greatest index key not above it to the next one."""
        start = end = _SEGMENT_HEAD.size
        for k, off in self.index:
            if k > key:
                return start, off
            start, end = off, self.data_end
        return start, end

    def records(self, start: int = _SEGMENT_HEAD.size, end: int | None = None) -> Iterator[Record]:
        found = replay(self.data[start : self.data_end if end is None else end])
        if found.truncated or found.corrupt:
            raise Corruption("a record of the segment fails its checksum")
        yield from found.records

    def get(self, key: bytes, use_bloom: bool = True) -> tuple[str, bytes | None]:
        """VALUE with the value, TOMBSTONE or ABSENT."""
        if use_bloom and not self.bloom.maybe(key):
            return "ABSENT", None
        for op, k, value in self.records(*self.span(key)):
            if k == key:
                return ("TOMBSTONE", None) if op == TOMBSTONE else ("VALUE", value)
        return "ABSENT", None


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.paths, self.kind = sorted(glob.glob(options["path"])), kind

    def partitions(self) -> list[_File]:
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            data = file.read()
        if self.kind == "log":
            found = replay(data)
            if found.corrupt:
                raise Corruption(f"{partition.path} is corrupt after {found.valid_bytes} bytes")
            rows: Iterable[Record] = found.records
        else:
            rows = SegmentFile.open(data).records()
        for i, (op, key, value) in enumerate(rows):
            yield partition.number, i, bytearray(key), op, bytearray(value)


class LogSource(DataSource):
    """``spark.read.format("tidemark_log").load(path)``: one row per record of binary log files."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return "file int, seq long, k binary, op int, v binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "log")


class SegmentSource(LogSource):
    """``spark.read.format("tidemark_segment").load(path)``: one row per record of binary segment files."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_segment"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "segment")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, k, op, v): the valid prefixes of the log files of a folder or pattern, on any file system; see :func:`log_endings` for what follows them. A file is held by one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                found = replay(bytes(data)).records
                for at in range(0, len(found), 10_000):
                    yield pd.DataFrame([(name, at + i, k, op, v) for i, (op, k, v) in enumerate(found[at : at + 10_000])], columns=["path", "seq", "k", "op", "v"])

    return _files(spark, path).mapInPandas(rows, "path string, seq long, k binary, op int, v binary")


def log_endings(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, valid_bytes, dropped_bytes, truncated, corrupt): how far each log file can be replayed, and why no further.
    An empty file has nothing to replay and no row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name, len(data), replay(bytes(data))) for name, data in zip(batch["path"], batch["content"], strict=True)]
            out = [(name, len(r.records), r.valid_bytes, size - r.valid_bytes, r.truncated, r.corrupt) for name, size, r in found]
            yield pd.DataFrame(out, columns=["path", "records", "valid_bytes", "dropped_bytes", "truncated", "corrupt"])

    return _files(spark, path).mapInPandas(rows, "path string, records long, valid_bytes long, dropped_bytes long, truncated boolean, corrupt boolean")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
    spark.dataSource.register(SegmentSource)
