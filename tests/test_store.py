"""The store end to end: reopening, flushing, compaction, crashes, the command line, streams and byte formats."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.model import PUT, TOMBSTONE, Corruption, InvalidArgument, NotFound, NotOpen, StoreOptions
from tidemark.sources import binary
from tidemark.store import Store
from tidemark.streaming.ingest import ingest


def live(store):
    return {r["k"]: r["v"] for r in store.snapshot().collect()}


def rows(spark, *mutations):
    made = [(i, m, TOMBSTONE, "") if isinstance(m, str) else (i, m[0], PUT, m[1]) for i, m in enumerate(mutations)]
    return spark.createDataFrame(made, "at int, k string, op int, v string")


def apply(store, *mutations):
    store.apply(rows(store.spark, *mutations), "at")


def test_empty_store(spark, tmp_path):
    with Store(spark).open(str(tmp_path / "db")) as store:
        with pytest.raises(NotFound):
            store.get("anything")
        assert store.segment_count() == 0 and store.memtable_size() == 0
        assert not store.flush() and not store.compact() and live(store) == {}


def test_put_get_delete_and_reopen(spark, tmp_path):
    path = str(tmp_path / "db")
    with Store(spark).open(path) as store:
        store.put("key1", "val1")
        store.put("key2", "")
        store.remove("key1")
        assert live(store) == {"key2": ""} and store.get("key2") == ""
    with Store(spark).open(path) as store:
        assert live(store) == {"key2": ""}
        with pytest.raises(NotFound):
            store.get("key1")


def test_newer_segments_and_the_log_win(spark, tmp_path):
    path = str(tmp_path / "db")
    with Store(spark).open(path) as store:
        apply(store, ("item", "version1"), ("gone", "x"), ("flushed", "f"))
        store.flush()
        apply(store, ("item", "version2"), "gone")
        store.flush()
        apply(store, ("unflushed", "u"), "flushed")
        assert store.segment_count() == 2
    with Store(spark).open(path) as store:
        assert live(store) == {"item": "version2", "unflushed": "u"}
        got = {r["k"]: r["status"] for r in store.multi_get(spark.createDataFrame([("item",), ("gone",), ("no",)], "k string")).collect()}
        assert got == {"item": "VALUE", "gone": "TOMBSTONE", "no": "ABSENT"}
        assert [r["k"] for r in store.scan("item", "zzz").collect()] == ["item", "unflushed"]


def test_automatic_flush_and_compaction(spark, tmp_path):
    store = Store(spark, StoreOptions(compaction_threshold=3)).open(str(tmp_path / "db"))
    counts = []
    for batch in ((("k1", "v"), ("common", "old_v")), (("k2", "v2"),), (("common", "new_v"), "k1")):
        apply(store, *batch)
        store.flush()
        counts.append(store.segment_count())
    assert counts == [1, 2, 1] and live(store) == {"k2": "v2", "common": "new_v"}
    assert store.segments().where(F.col("op") == TOMBSTONE).count() == 0
    small = Store(spark, StoreOptions(memtable_size_threshold=100)).open(str(tmp_path / "small"))
    small.put("a", "x" * 100)
    assert small.segment_count() == 0  # the write that fills the table stays in it
    small.put("b", "y")
    assert small.segment_count() == 1 and live(small) == {"a": "x" * 100, "b": "y"}


def test_compaction_of_deletions_leaves_an_empty_segment(spark, tmp_path):
    store = Store(spark).open(str(tmp_path / "db"))
    apply(store, ("a", "1"))
    store.flush()
    apply(store, "a")
    store.flush()
    apply(store, ("b", "in the log"))
    assert store.compact() and store.segment_count() == 1 and store.segments().count() == 0
    assert live(store) == {"b": "in the log"}


def test_errors(spark, tmp_path):
    store = Store(spark)
    for call in (lambda: store.put("a", "b"), lambda: store.get("a"), lambda: store.flush()):
        with pytest.raises(NotOpen):
            call()
    with pytest.raises(InvalidArgument):
        store.open("")
    store.open(str(tmp_path / "db"))
    for call in (lambda: store.put("", "b"), lambda: store.get(""), lambda: store.remove(""), lambda: apply(store, ("ok", "1"), ("", "2"))):
        with pytest.raises(InvalidArgument):
            call()
    assert live(store) == {}


def test_crash_between_writing_and_committing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    store = Store(spark).open(path)
    for i in range(2):
        apply(store, (f"k{i}", str(i)))
        store.flush()

    def crash(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(Store, "_commit", crash)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert live(Store(spark).open(path)) == {"k0": "0", "k1": "1"}


def test_missing_data_is_corruption(spark, tmp_path):
    path = str(tmp_path / "db")
    store = Store(spark).open(path)
    apply(store, ("a", "1"))
    store.flush()
    shutil.rmtree(os.path.join(path, store.manifest.segments[0].path))
    with pytest.raises(Corruption):
        Store(spark).open(path)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "db")
    one, two = Store(spark).open(path), Store(spark).open(path)
    one.put("a", "1")
    with pytest.raises(NotOpen):
        two.put("a", "2")
    assert live(two.open(path)) == {"a": "1"}


def test_command_line(spark, tmp_path):
    store = Store(spark).open(str(tmp_path / "db"))
    said = list(cli.run(store, ["put name  Ada Lovelace ", "get name", "GET other", "put x", "flush", "COMPACT", "delete name", "get name", "stats", "what", "help", "", "exit", "get name"]))
    assert said[1:3] == ["Ada Lovelace", "NOT_FOUND"] and said[3].startswith("usage") and said[4] == "OK" and said[7] == "NOT_FOUND"
    assert "segments 1" in said[8] and said[9].startswith("unknown") and len(said) == 11


def test_streaming_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, ("a", "1"), ("b", "2"), "a", ("c", "3")).write.parquet(source)
    store = Store(spark).open(str(tmp_path / "db"))
    stream = spark.readStream.schema("at int, k string, op int, v string").parquet(source)
    ingest(stream, store, str(tmp_path / "checkpoint"), "at").awaitTermination()
    assert live(store) == {"b": "2", "c": "3"}


RECORDS = [(PUT, b"apple", b"pie"), (PUT, b"banana", b"split"), (TOMBSTONE, b"cat", b""), (PUT, b"dog", b"bark")]


def test_segment_bytes():
    data = binary.encode_segment(RECORDS, interval=2)
    file = binary.SegmentFile.open(data)
    assert (len(data), file.index, file.data_end, file.record_count) == (221, [(b"apple", 16), (b"cat", 61)], 97, 4)
    assert file.get(b"dog") == ("VALUE", b"bark") and file.get(b"cat") == ("TOMBSTONE", None) and file.get(b"elephant") == ("ABSENT", None)
    assert list(file.records()) == RECORDS
    with pytest.raises(Corruption):
        binary.encode_segment(reversed(RECORDS))
    flipped = lambda i: data[:i] + bytes([data[i] ^ 0xFF]) + data[i + 1 :]
    for broken in (b"X" * 8 + data[8:], data[:9], flipped(105), flipped(145), flipped(220)):
        with pytest.raises(Corruption):
            binary.SegmentFile.open(broken)
    with pytest.raises(Corruption):  # a damaged record is told on reading, not taken for an absent key
        binary.SegmentFile.open(data[:30] + b"?" + data[31:]).get(b"apple")
    assert list(binary.SegmentFile.open(binary.encode_segment([])).records()) == []


def test_log_bytes():
    data = b"".join(binary.encode_record(*r) for r in RECORDS)
    assert binary.replay(data).records == RECORDS
    torn = binary.replay(data + b"\x01\x0a\x00\x00\x00")
    assert torn.truncated and not torn.corrupt and torn.records == RECORDS and torn.valid_bytes == len(data)
    damaged = binary.replay(data[:10] + b"Z" + data[11:])
    assert damaged.corrupt and damaged.records == []
    assert binary.replay(b"\x07" + data).corrupt


def test_binary_sources(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "wal.log").write_bytes(b"".join(binary.encode_record(*r) for r in RECORDS))
    (tmp_path / "sst_000001.sst").write_bytes(binary.encode_segment(RECORDS))
    for kind, file in (("tidemark_log", "wal.log"), ("tidemark_segment", "sst_000001.sst")):
        got = spark.read.format(kind).load(str(tmp_path / file)).orderBy("seq").collect()
        assert [(r["op"], bytes(r["k"]), bytes(r["v"])) for r in got] == RECORDS


def test_late_batches_do_not_hide_newer_mutations(spark, tmp_path):
    """Sequence numbers decide, within the log, across flushes and after a compaction; a repeated batch is applied once."""
    rows = lambda *r: spark.createDataFrame(list(r), "seq long, k string, op int, v string")
    with Store(spark).open(str(tmp_path / "late")) as store:
        store.apply(rows((10, "a", 1, "newer"), (11, "b", 1, "x")), "seq", numbered=True, batch=("s", 0))
        store.apply(rows((5, "a", 1, "older")), "seq", numbered=True, batch=("s", 1))
        store.apply(rows((99, "a", 1, "repeated")), "seq", numbered=True, batch=("s", 1))
        assert store.get("a") == "newer" and store.log().count() == 3
        store.flush()
        store.apply(rows((7, "b", 1, "late"), (12, "c", 1, "y")), "seq", numbered=True, batch=("s", 2))
        assert store.get("b") == "x"
        store.flush()
        store.compact()
        assert {r["k"]: r["v"] for r in store.snapshot().collect()} == {"a": "newer", "b": "x", "c": "y"}
        store.put("a", "last")
        assert store.get("a") == "last"
    with Store(spark).open(str(tmp_path / "late")) as store:
        assert store.get("a") == "last" and store.manifest.streams == {"s": 2} and store.manifest.log_bytes > 0


@pytest.mark.parametrize("n", [1, 7, 105, 999])
def test_stored_filter_has_no_false_negative(n):
    records = [(PUT, b"key%05d" % i, b"v%d" % i) for i in range(n)]
    file = binary.SegmentFile.open(binary.encode_segment(records))
    assert [file.get(k) for _, k, _ in records] == [("VALUE", v) for _, _, v in records]


def test_logs_are_read_with_their_endings(spark, tmp_path):
    """An empty file has no row in either table."""
    whole = [(PUT, b"a", b"1"), (TOMBSTONE, b"b\xff", b""), (PUT, b"c", b"3")]
    data = b"".join(binary.encode_record(*r) for r in whole)
    broken = bytearray(data)
    broken[12] ^= 1
    for name, content in (("whole", data), ("torn", data[:-1]), ("corrupt", bytes(broken)), ("empty", b"")):
        (tmp_path / name).write_bytes(content)
    rows = {(r["path"].rpartition("/")[2], r["seq"], bytes(r["k"]), r["op"], bytes(r["v"])) for r in binary.read_logs(spark, str(tmp_path)).collect()}
    records = [(i, k, op, v) for i, (op, k, v) in enumerate(whole)]
    assert rows == {("whole", *r) for r in records} | {("torn", *r) for r in records[:2]}
    endings = {r["path"].rpartition("/")[2]: tuple(r)[1:] for r in binary.log_endings(spark, str(tmp_path)).collect()}
    last = len(binary.encode_record(*whole[2]))
    assert endings == {
        "whole": (3, len(data), 0, False, False),
        "torn": (2, len(data) - last, last - 1, True, False),
        "corrupt": (0, 0, len(data), False, True),
    }
