"""Queries that work through a store or the byte formats, over the whole mutation log.

A store is made in the folder that all executors share. One whose contents a query returns stays there, as the result
reads it; one of which only facts are returned is deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.model import PUT, StoreError, StoreOptions
from tidemark.operators import segments, state
from tidemark.plans.log import mutation_log, probe_keys
from tidemark.sources import binary
from tidemark.sources.files import Files, shared_folder
from tidemark.store import Store

STORE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A log of the byte format holds so many sequence numbers.
CHUNK = 1000
#: A store that flushes when told to.
BY_HAND = StoreOptions(memtable_size_threshold=1 << 62, compaction_threshold=1 << 30)
SESSION = ("PUT a 1", "get a", "PUT b two  words", "DELETE a", "GET a", "flush", "FLUSH", "PUT c 3", "FLUSH", "COMPACT", "COMPACT", "GET b", "GET c", "PUT onlykey", "GET", "nonsense", "PUT d 4", "STATS", "", "EXIT", "GET b")


def query(f):
    STORE_QUERIES[f.__name__] = f
    return f


def _new(spark: SparkSession, options: StoreOptions = BY_HAND) -> Store:
    return Store(spark, options).open(f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@contextmanager
def _passing(spark: SparkSession, options: StoreOptions = BY_HAND) -> Iterator[Store]:
    store = _new(spark, options)
    path = store.path
    try:
        yield store
    finally:
        Files(spark, path).delete(path)


def _quarter(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    return segments.assign_fixed(mutation_log(spark, sf_dir)).where(F.col("seg_id") == i).drop("seg_id")


def _apply(store: Store, mutations: DataFrame) -> None:
    store.apply(mutations, order="seq", numbered=True)


def _reopened(store: Store) -> Store:
    path = store.path
    store.close()
    return store.open(path)


@query
def store_reopened(spark, sf_dir):
    """The live state of a store that got the newer half first, flushed, got the older half, and was opened again."""
    store = _new(spark)
    for i in (2, 3):
        _apply(store, _quarter(spark, sf_dir, i))
    store.flush()
    for i in (0, 1):
        _apply(store, _quarter(spark, sf_dir, i))
    return _reopened(store).snapshot()


@query
def store_multi_get(spark, sf_dir):
    """Lookups in a store with a compacted segment, a segment, and a log; a compacted tombstone is absent."""
    store = _new(spark)
    for i in range(4):
        _apply(store, _quarter(spark, sf_dir, i))
        if i < 3:
            store.flush()
        if i == 1:
            store.compact()
    return store.multi_get(probe_keys(spark, sf_dir))


@query
def store_removed(spark, sf_dir):
    """What is live once all values were put, in order, and the probe keys removed."""
    store = _new(spark)
    store.put_many(mutation_log(spark, sf_dir).where(F.col("op") == PUT).select("k", "v", "seq"), order="seq")
    store.remove_many(probe_keys(spark, sf_dir))
    store.flush()
    return store.snapshot()


@query
def store_scan(spark, sf_dir):
    """A range of the keys of a store."""
    store = _new(spark)
    _apply(store, mutation_log(spark, sf_dir))
    store.flush()
    return store.scan("u000010", "u000020")


@query
def store_lifecycle(spark, sf_dir):
    """Segments, their records, and mutations and bytes in memory after each step; the fourth flush compacts."""
    rows = []
    with _passing(spark, StoreOptions(memtable_size_threshold=1 << 62, compaction_threshold=4)) as store:

        def note() -> None:
            rows.append((len(rows), store.segment_count(), sum(s.records for s in store.manifest.segments), store.log().count(), int(store.memtable_size())))

        note()
        for i in range(4):
            _apply(store, _quarter(spark, sf_dir, i))
            note()
            store = _reopened(store)
            store.flush()
            note()
    return spark.createDataFrame(rows, "step int, n_segments int, records long, mutations long, bytes long")


@query
def store_statuses(spark, sf_dir):
    """How a store answers to what it can't do."""
    rows = []

    def status(case: str, f: Callable[[], object]) -> None:
        try:
            f()
            rows.append((case, "OK"))
        except StoreError as error:
            rows.append((case, error.code.value))

    with _passing(spark) as store:
        path = store.path
        status("put", lambda: store.put("k", "v"))
        status("get", lambda: store.get("k"))
        status("get absent", lambda: store.get("absent"))
        status("remove absent", lambda: store.remove("absent"))
        status("get empty key", lambda: store.get(""))
        status("put empty key", lambda: store.put("", "v"))
        other = Store(spark, BY_HAND).open(path)
        store.put("k", "w")
        status("put after another writer", lambda: other.put("k", "x"))
        status("get of the winner", lambda: store.get("k"))
        Files(spark, path).delete(f"{path}/{store.manifest.log[0]}")
        store.close()
        status("get when closed", lambda: store.get("k"))
        status("flush when closed", store.flush)
        status("open with missing data", lambda: store.open(path))
        status("open without a path", lambda: store.open(""))
        status("no index interval", lambda: StoreOptions(sparse_index_interval=0))
    return spark.createDataFrame(rows, "case string, status string")


@query
def cli_session(spark, sf_dir):
    """The answers to a session at the command line."""
    with _passing(spark) as store:
        rows = [(i, answer.replace(store.path, "PATH")) for i, answer in enumerate(cli.run(store, SESSION))]
    return spark.createDataFrame(rows, "answer_no int, answer string")


def _records(rows: pd.DataFrame) -> list[binary.Record]:
    return [(int(op), k.encode(), v.encode()) for op, k, v in zip(rows["op"], rows["k"], rows["v"], strict=True)]


@query
def wal_torn_tail(spark, sf_dir):
    """The log in byte logs of CHUNK sequence numbers, each cut short by a byte, and what replay makes of them."""

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(binary.encode_record(*r) for r in _records(rows.sort_values("seq")))[:-1]
        found = binary.replay(data)
        size = sum(len(k) + len(v) for _, k, v in found.records)
        out = (rows["chunk"].iloc[0], len(found.records), size, found.valid_bytes, len(data) - found.valid_bytes, found.truncated, found.corrupt)
        return pd.DataFrame([out], columns=["chunk", "records", "kv_bytes", "valid_bytes", "dropped_bytes", "truncated", "corrupt"])

    log = mutation_log(spark, sf_dir).withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    return log.groupBy("chunk").applyInPandas(chunk, "chunk long, records long, kv_bytes long, valid_bytes long, dropped_bytes long, truncated boolean, corrupt boolean")


@query
def segment_files(spark, sf_dir):
    """A segment in the byte format for each CHUNK sequence numbers: its regions, and what its records and lookups give."""

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        records = sorted(_records(rows), key=lambda r: r[1])
        data = binary.encode_segment(records)
        file = binary.SegmentFile.open(data)
        found = [file.get(k) for _, k, _ in records]
        right = sum(answer == (("VALUE", v) if op == PUT else ("TOMBSTONE", None)) for answer, (op, _, v) in zip(found, records, strict=True))
        absent = sum(file.get(k + b"!") == ("ABSENT", None) for _, k, _ in records)
        out = (rows["chunk"].iloc[0], file.record_count, file.data_end - 16, len(file.index), file.bloom.n_bits, len(data), list(file.records()) == records, right, absent)
        return pd.DataFrame([out], columns=["chunk", "records", "data_size", "index_entries", "n_bits", "file_size", "read_back", "found", "absent"])

    log = mutation_log(spark, sf_dir).withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    newest = state.latest(log, keys=("chunk", "k"))
    schema = "chunk long, records long, data_size long, index_entries long, n_bits long, file_size long, read_back boolean, found long, absent long"
    return newest.select("chunk", "k", "op", "v").groupBy("chunk").applyInPandas(chunk, schema)
