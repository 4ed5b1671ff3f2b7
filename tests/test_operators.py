"""Operators on small logs: the semantics of versions, tombstones, segments, indexes, filters and checksums."""

import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tidemark.functions.columns import fnv1a, key_bytes, one_at_a_time, record_bytes, record_crc
from tidemark.model import LOG_SCHEMA, PUT, TOMBSTONE, Code, InvalidArgument, NotFound, StoreOptions
from tidemark.operators import bloom, index, metrics, running, script, segments, state
from tidemark.sources import binary


def log_of(spark, *mutations):
    """A log from (key, value) puts and bare keys to delete, in order."""
    rows = [(i, m, TOMBSTONE, "") if isinstance(m, str) else (i, m[0], PUT, m[1]) for i, m in enumerate(mutations)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def live(df):
    return {r["k"]: r["v"] for r in df.collect()}


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def test_status():
    assert NotFound.code is Code.NOT_FOUND and str(NotFound("key1")) == "NotFound: key1"
    with pytest.raises(InvalidArgument):
        StoreOptions(sparse_index_interval=0)


def test_newest_wins_and_tombstones_hide(spark):
    log = log_of(spark, ("a", "1"), ("b", "2"), ("a", "3"), "b", "never put", ("c", ""), "d", ("d", "back"))
    assert live(state.snapshot(log)) == live(state.snapshot_by_rank(log)) == {"a": "3", "c": "", "d": "back"}
    assert {r["k"] for r in state.tombstones(log).collect()} == {"b", "never put"}
    assert [(r["k"], r["v"]) for r in state.resurrections(log).collect()] == [("d", "back")]
    assert live(state.as_of(log, 1)) == {"a": "1", "b": "2"}
    assert live(state.range_scan(log, "a", "c")) == {"a": "3"}


def test_three_valued_lookup(spark):
    log = log_of(spark, ("user1", "Alice"), "user1", "user2", ("user3", "x"))
    got = {r["k"]: (r["status"], r["v"]) for r in state.multi_get(keys(spark, "user1", "user2", "user3", "user4"), log).collect()}
    assert got == {"user1": ("TOMBSTONE", None), "user2": ("TOMBSTONE", None), "user3": ("VALUE", "x"), "user4": ("ABSENT", None)}
    assert {r["k"] for r in state.contains(keys(spark, "user2", "user4"), log).collect()} == {"user2"}
    assert {r["k"] for r in state.missing(keys(spark, "user2", "user4"), log).collect()} == {"user4"}
    assert state.get(log, "nowhere").count() == 0


def test_keys_sort_by_bytes(spark):
    log = log_of(spark, *((k, k) for k in ("orange", "apple", "é", "Zebra", "banana", "cherry")))
    assert [r["k"] for r in state.snapshot(log).orderBy("k").collect()] == ["Zebra", "apple", "banana", "cherry", "orange", "é"]


def test_memtable_size(spark):
    log = log_of(spark, *((f"k{i}", "x" * 100) for i in range(1, 6)))
    sizes = [r["total"] for r in running.running_size(log).orderBy("seq").collect()]
    assert sizes == [174, 348, 522, 696, 870]
    stats = state.memtable_stats(log, 0, 500).first()
    assert (stats["entries"], stats["bytes"], stats["is_empty"], stats["is_full"]) == (5, 870, False, True)
    assert state.memtable_stats(log, 99, 500).first()["is_empty"]
    assert [tuple(r) for r in segments.flush_bounds(log, 500).collect()] == [(0, 0, 2)]


def test_replaced_entries_count_once(spark):
    log = log_of(spark, ("k", "x" * 50), ("k", "y"), "k", ("k", "zz"))
    assert [(r["change"], r["total"]) for r in running.running_size(log).orderBy("seq").collect()] == [(123, 123), (-49, 74), (-1, 73), (2, 75)]


def test_running_total_across_blocks(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("x"))
    got = {r["seq"]: r["total"] for r in running.running_total(df, F.col("x"), block=64).collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(1000)}


def test_flush_bounds_on_the_events_table(spark, data_dir):
    from tidemark.plans.log import mutation_log

    wide = data_dir.replace("sf0.001", "sf0.01")
    assert [r["last"] + 1 for r in segments.flush_bounds(mutation_log(spark, wide), 64 << 10).collect()] == [1225, 2584, 3891, 5175, 6441, 7790, 9078]
    assert segments.flush_bounds(mutation_log(spark, data_dir), 16 << 10).collect() == []


def test_compaction(spark):
    old = log_of(spark, ("key1", "val1_old"), ("key2", "val2"), ("key3", "val3_old")).select("k", "op", "v")
    new = log_of(spark, ("key1", "val1_new"), "key3", ("key4", "val4")).select("k", "op", "v")
    assert live(segments.merge_all([old, new])) == {"key1": "val1_new", "key2": "val2", "key4": "val4"}
    assert live(segments.merge_all([log_of(spark, "a", "b").select("k", "op", "v")])) == {}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdé"), st.one_of(st.none(), st.text("xyz", max_size=3))), min_size=1, max_size=30), st.integers(1, 6))
def test_any_segmentation_gives_the_same_state(spark, mutations, n):
    log = log_of(spark, *(k if v is None else (k, v) for k, v in mutations))
    want = {}
    for k, v in mutations:
        want[k] = v
    want = {k: v for k, v in want.items() if v is not None}
    merged = segments.merge(segments.segment_contents(segments.assign_fixed(log, n)))
    assert live(merged) == live(state.snapshot(log)) == want


@pytest.mark.parametrize("newest_op", [PUT, TOMBSTONE])
def test_compaction_stats_orders_records_of_one_segment(spark, newest_op):
    """Whatever the order in which a segment's records are read, the greatest sequence number wins."""
    old = TOMBSTONE if newest_op == PUT else PUT
    rows = [(8 * i + j, f"k{i}", newest_op if j == 7 else old, "", 0) for i in range(40) for j in range(8)]
    for read in (rows, rows[::-1], [r for r in rows if r[0] % 8 == 7] + [r for r in rows if r[0] % 8 != 7]):
        for parts in (1, 7):
            log = spark.createDataFrame(spark.sparkContext.parallelize(read, parts), "seq long, k string, op int, v string, seg_id int")
            want = (320, 280, 40, 0) if newest_op == TOMBSTONE else (320, 280, 0, 40)
            assert tuple(segments.compaction_stats(log).first()) == want


def test_sparse_index_and_seek(spark):
    rows = [(1, f"key_{i:05d}", PUT, f"val_{i}") for i in range(200)]
    seg = spark.createDataFrame(rows, "seg_id int, k string, op int, v string")
    assert index.sparse_index(seg, 8).count() == 25
    file = binary.SegmentFile.open(binary.encode_segment(((PUT, k.encode(), v.encode()) for _, k, _, v in rows), 8))
    asked = ("key_00050", "key_00050_sub", "key_99999", "aaa", "key_00000", "key_00199")
    got = {r["k"]: (r["start_off"], r["end_off"]) for r in index.seek(keys(spark, *asked), seg, 8).collect()}
    assert got == {k: file.span(k.encode()) for k in asked}
    assert [file.get(k.encode(), use_bloom=False)[0] for k in asked] == ["VALUE", "ABSENT", "ABSENT", "ABSENT", "VALUE", "VALUE"]
    sizes = index.layout(seg, 8).first()
    assert sizes["file_size"] == len(file.data) and sizes["data_size"] + 16 == file.data_end


def test_published_folder_size(spark):
    seg = spark.range(50_000).select((F.when(F.col("id") < 44_388, 1).otherwise(2)).alias("seg_id"), F.format_string("user_key_%08d", "id").alias("k"), F.lit(PUT).alias("op"), F.lit("v" * 100).alias("v"))
    row = index.storage_overhead(seg).first()
    assert (row["logical_bytes"], row["physical_bytes"]) == (5_850_000, 6_653_354)


def test_hashes_and_bytes(spark):
    names = ["", "a", "foobar", "ключ", "é", "key with spaces"]
    got = keys(spark, *names).select("k", key_bytes(F.col("k")).alias("b"), fnv1a(F.col("k")).alias("h1"), one_at_a_time(F.col("k")).alias("h2")).collect()
    for r in got:
        assert r["b"] == list(r["k"].encode()) and (r["h1"], r["h2"]) == binary.hash_pair(r["k"].encode())
    assert {r["k"]: r["h1"] for r in got}["foobar"] == 3214735720


def test_bloom_filter(spark):
    present = spark.range(1000).select(F.concat(F.lit("present_key_"), F.col("id")).alias("k"))
    absent = spark.range(1000).select(F.concat(F.lit("absent_key_"), F.col("id")).alias("k"))
    bits = bloom.bits(present, 10_000)
    assert bits.count() == 5125
    assert bloom.probe(present, bits, 10_000).where("maybe").count() == 1000
    assert bloom.probe(absent, bits, 10_000).where("maybe").count() == 6
    fruit = {r["bit"] for r in bloom.bits(keys(spark, "apple", "banana", "orange"), 1000).collect()}
    assert fruit == {0, 59, 167, 184, 210, 222, 389, 500, 526, 552, 611, 699, 759, 778, 819, 833, 842, 868, 879, 939, 999}


def test_record_checksum(spark):
    df = spark.createDataFrame([("ключ", PUT, "value"), ("k", TOMBSTONE, ""), ("k", PUT, "")], "k string, op int, v string")
    args = (F.col("k"), F.col("op"), F.col("v"))
    for r in df.select("*", record_bytes(*args).alias("b"), record_crc(*args).alias("crc")).collect():
        want = binary.encode_record(r["op"], r["k"].encode(), r["v"].encode())
        assert bytes(r["b"]) == want[:-4] and r["crc"] == zlib.crc32(want[:-4])


def test_valid_prefix(spark):
    log = log_of(spark, ("a", "1"), ("b", "2"), ("c", "3"))
    assert {r["k"] for r in running.valid_prefix(log, F.col("k") == "b").collect()} == {"a"}
    assert running.valid_prefix(log, F.lit(False)).count() == 3


def test_floor_percentiles(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x")).union(spark.createDataFrame([("one", 5.0), ("none", None)], "g string, x double"))
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["p99"]) for r in metrics.floor_percentiles(df, "x", "g").collect()}
    assert got == {"g": (100, 51.0, 96.0, 100.0), "one": (1, 5.0, 5.0, 5.0)}


def test_script(spark):
    lines = ["put a  b c ", "GET a", "Delete", "", "frob x", "PUT k", "quit"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    got = [(r["command"], r["k"], r["v"], r["status"]) for r in script.parse(df).orderBy("line_no").collect()]
    assert got == [("PUT", "a", "b c", "OK"), ("GET", "a", "", "OK"), ("DELETE", "", "", "USAGE"), ("", "", "", "EMPTY"), ("FROB", "", "", "UNKNOWN"), ("PUT", "k", "", "USAGE"), ("QUIT", "", "", "OK")]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    assert rows_of(state.snapshot(empty)) == [] and segments.flush_bounds(empty, 10).collect() == []
    assert segments.segment_contents(segments.assign_fixed(empty)).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3, 50])
def test_offsets_and_seeks_do_not_depend_on_blocks(spark, blocks):
    keys = [(seg, f"k{(i * 37) % 101:03d}{'é' * (i % 3)}") for seg, n in ((0, 70), (1, 5), (2, 100)) for i in range(n)]
    segs = spark.createDataFrame([(s, k, PUT, "v" * len(k)) for s, k in keys], "seg_id int, k string, op int, v string")
    size = {(s, k): 13 + len(k.encode()) + len(k) for s, k in keys}
    want, entries_of, ends = {}, {}, {}
    for s in (0, 1, 2):
        at = 16
        for pos, k in enumerate(sorted((k for t, k in keys if t == s), key=str.encode)):
            want[s, k] = (pos, at)
            if pos % 4 == 0:
                entries_of.setdefault(s, []).append((k.encode(), at))
            at += size[s, k]
        ends[s] = at
    got = {(r["seg_id"], r["k"]): (r["pos"], r["off"]) for r in index.offsets(segs, blocks).collect()}
    assert got == want
    probes = ["", "a", "k", "k000", "k050", "k050é", "k0505", "k100éé", "z", *{k for _, k in keys[:20]}]
    found = {}
    for k in probes:
        for s, entries in entries_of.items():
            below = [i for i, (e, _) in enumerate(entries) if e <= k.encode()]
            offs = [off for _, off in entries] + [ends[s]]
            found[k, s] = (offs[below[-1]], offs[below[-1] + 1]) if below else (16, 16)
    rows = index.seek(spark.createDataFrame([(k,) for k in probes], "k string"), segs, 4, blocks).collect()
    assert {(r["k"], r["seg_id"]): (r["start_off"], r["end_off"]) for r in rows} == found and len(rows) == len(found)


def test_offsets_of_no_segment(spark):
    segs = spark.createDataFrame([], "seg_id int, k string, op int, v string")
    assert index.offsets(segs).count() == 0 and index.seek(spark.createDataFrame([("a",)], "k string"), segs).count() == 0
