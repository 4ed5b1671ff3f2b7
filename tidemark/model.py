"""The data model: mutations of a keyed log, options of a store, and its errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

PUT, TOMBSTONE = 1, 2
#: Bytes that an entry of the in-memory table costs besides its key and value, and a record of the log likewise.
ENTRY_OVERHEAD, RECORD_OVERHEAD = 72, 13
#: Limits on replay, which writes are held to as well.
MAX_KEY, MAX_VALUE = 16 << 20, 64 << 20

LOG_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("k", T.StringType()), T.StructField("op", T.ByteType()), T.StructField("v", T.StringType())])


class Code(Enum):
    OK = "OK"
    NOT_FOUND = "NotFound"
    CORRUPTION = "Corruption"
    INVALID_ARGUMENT = "InvalidArgument"
    IO_ERROR = "IOError"


class StoreError(Exception):
    """A status other than OK; reads as its code and message."""

    code = Code.IO_ERROR

    def __str__(self) -> str:
        return f"{self.code.value}: {super().__str__()}"


class NotFound(StoreError):
    code = Code.NOT_FOUND


class Corruption(StoreError):
    code = Code.CORRUPTION


class InvalidArgument(StoreError):
    code = Code.INVALID_ARGUMENT


class NotOpen(StoreError):
    code = Code.IO_ERROR


@dataclass(frozen=True)
class StoreOptions:
    """How a store flushes, indexes and compacts. Options belong to a session; a store on disk doesn't keep them."""

    memtable_size_threshold: int = 4 << 20
    sparse_index_interval: int = 16
    bloom_bits_per_key: int = 10
    bloom_num_hashes: int = 7
    compaction_threshold: int = 4
    enable_bloom_filter: bool = True

    def __post_init__(self):
        if self.sparse_index_interval < 1:
            raise InvalidArgument("sparse_index_interval must be at least 1")
