"""The query catalogue: every operator applied to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import op_name, record_crc, record_size
from tidemark.operators import bloom, index, metrics, running, script, segments, state
from tidemark.plans.log import document_keys, mutation_log, probe_keys, table

POINT_KEY, RANGE = "u000012:3", ("u000010", "u000020")
FLUSH_THRESHOLD = 64 << 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assign_fixed(mutation_log(spark, sf_dir))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_contents(_segmented(spark, sf_dir)).select("seg_id", "k", "op", "v")


def _midpoint(log: DataFrame) -> int:
    return (log.agg(F.max("seq")).first()[0] or 0) // 2


@query
def snapshot(spark, sf_dir):
    return state.snapshot(mutation_log(spark, sf_dir)).select("k", "v")


@query
def snapshot_window(spark, sf_dir):
    return state.snapshot_by_rank(mutation_log(spark, sf_dir)).select("k", "v")


@query
def snapshot_as_of(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    return state.as_of(log, _midpoint(log)).select("k", "v", "seq")


@query
def multi_get(spark, sf_dir):
    return state.multi_get(probe_keys(spark, sf_dir), mutation_log(spark, sf_dir))


@query
def get_point(spark, sf_dir):
    return state.get(mutation_log(spark, sf_dir), POINT_KEY)


@query
def contains_keys(spark, sf_dir):
    return state.contains(probe_keys(spark, sf_dir), mutation_log(spark, sf_dir))


@query
def missing_keys(spark, sf_dir):
    return state.missing(probe_keys(spark, sf_dir), mutation_log(spark, sf_dir))


@query
def tombstones(spark, sf_dir):
    return state.tombstones(mutation_log(spark, sf_dir))


@query
def resurrected_keys(spark, sf_dir):
    return state.resurrections(mutation_log(spark, sf_dir))


@query
def version_history(spark, sf_dir):
    return state.versions(mutation_log(spark, sf_dir))


@query
def range_scan(spark, sf_dir):
    return state.range_scan(mutation_log(spark, sf_dir), *RANGE).select("k", "v")


@query
def sorted_scan(spark, sf_dir):
    return index.offsets(_contents(spark, sf_dir)).select("seg_id", F.col("pos").cast("long").alias("pos"), "k", op_name(F.col("op")).alias("status"))


@query
def segment_contents(spark, sf_dir):
    return _contents(spark, sf_dir)


@query
def compact_all(spark, sf_dir):
    return segments.merge(_contents(spark, sf_dir)).select("k", "v")


@query
def compaction_stats(spark, sf_dir):
    return segments.compaction_stats(_segmented(spark, sf_dir))


@query
def read_trace(spark, sf_dir):
    return segments.read_trace(_contents(spark, sf_dir), probe_keys(spark, sf_dir))


@query
def memtable_tail(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    return state.memtable(log, _midpoint(log) + 1).select("k", "op", "bytes")


@query
def memtable_stats(spark, sf_dir):
    log = mutation_log(spark, sf_dir)
    return state.memtable_stats(log, _midpoint(log) + 1, FLUSH_THRESHOLD)


@query
def running_size(spark, sf_dir):
    return running.running_size(mutation_log(spark, sf_dir))


@query
def flush_segments(spark, sf_dir):
    placed = segments.assign_by_size(mutation_log(spark, sf_dir), FLUSH_THRESHOLD)
    return placed.where("seg_id IS NOT NULL").groupBy("seg_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("mutations"), F.count_distinct("k").alias("records"))


@query
def flush_sweep(spark, sf_dir):
    """Segments and records on disk for three sizes of the in-memory table."""
    log = mutation_log(spark, sf_dir)
    parts = []
    for kib in (64, 128, 256):
        placed = segments.assign_by_size(log, kib << 10).where("seg_id IS NOT NULL")
        parts.append(placed.agg(F.lit(kib).alias("threshold_kib"), F.count_distinct("seg_id").alias("n_segments"), F.count_distinct("seg_id", "k").alias("n_records")))
    return parts[0].union(parts[1]).union(parts[2])


@query
def wal_encode_size(spark, sf_dir):
    sized = mutation_log(spark, sf_dir).withColumn("bytes", record_size(F.col("k"), F.col("op"), F.col("v")))
    return running.running_total(sized, F.col("bytes"), name="end_off").select("seq", "bytes", "end_off")


@query
def wal_crc(spark, sf_dir):
    return mutation_log(spark, sf_dir).select("seq", record_crc(F.col("k"), F.col("op"), F.col("v")).alias("crc"))


@query
def wal_valid_prefix(spark, sf_dir):
    """Replay up to the first record that is marked bad: the first of the last tenth whose number divides by 97."""
    log = mutation_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    return running.valid_prefix(log, (F.col("seq") >= last * 9 // 10) & (F.col("seq") % 97 == 0)).select("seq", "k", "op")


@query
def sparse_index(spark, sf_dir):
    return index.sparse_index(_contents(spark, sf_dir))


@query
def index_seek(spark, sf_dir):
    return index.seek(probe_keys(spark, sf_dir), _contents(spark, sf_dir))


@query
def segment_layout(spark, sf_dir):
    return index.layout(_contents(spark, sf_dir))


@query
def storage_overhead(spark, sf_dir):
    return index.storage_overhead(_contents(spark, sf_dir))


@query
def bloom_hashes(spark, sf_dir):
    return bloom.hashes(document_keys(spark, sf_dir).select("k"))


@query
def bloom_bits(spark, sf_dir):
    keys = document_keys(spark, sf_dir).select("k")
    return bloom.bits(keys, bloom.size(keys.count()))


@query
def bloom_probe(spark, sf_dir):
    """A filter over the even documents, probed with all of them: absent keys lie between present ones."""
    keys = document_keys(spark, sf_dir)
    present = keys.where("doc_id % 2 = 0").select("k")
    n_bits = bloom.size(present.count())
    found = bloom.probe(keys, bloom.bits(present, n_bits), n_bits)
    return found.select("k", "maybe")


@query
def bloom_segment_fill(spark, sf_dir):
    filled = bloom.segment_bits(_contents(spark, sf_dir))
    return filled.groupBy("seg_id", "n_bits").agg(F.count("*").alias("n_set"))


@query
def latency_percentiles(spark, sf_dir):
    return metrics.floor_percentiles(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), "p50", "p95", "p99")


@query
def cli_script(spark, sf_dir):
    """Command lines made of the events, parsed."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    line = (
        F.when(kind == 0, F.concat(F.lit("  put u"), F.col("user_id"), F.lit("   "), F.col("props"), F.lit(" \t")))
        .when(kind == 1, F.concat(F.lit("Get u"), F.col("user_id")))
        .when(kind == 2, F.concat(F.lit("DELETE u"), F.col("user_id"), F.lit(" x")))
        .when(kind == 3, F.lit("put onlykey"))
        .when(kind == 4, F.col("event_type"))
        .otherwise(F.lit(" stats "))
    )
    return script.parse(e.select(F.col("event_id").alias("line_no"), line.alias("line")))
