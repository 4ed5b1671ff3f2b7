"""A keyed store over Parquet: a log of mutations, immutable sorted segments, and versioned manifests.

A manifest names the log batches and segments that make up the store; whoever renames the next version into place
has committed. Data is written before the manifest that names it and deleted after one that doesn't, so a crash at
any point leaves the last committed state. Every record keeps its sequence number, and of a key's records the one with
the greatest wins, wherever it lies: a mutation that arrives late under an older number doesn't hide a newer one (but a
tombstone that a compaction has dropped is no longer there to be newer). Reads are one scan of all segments and the log, aggregated by key;
segments are range-partitioned, sorted and carry Parquet Bloom filters, so a point read skips row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import entry_size
from tidemark.model import LOG_SCHEMA, MAX_KEY, MAX_VALUE, PUT, TOMBSTONE, Corruption, InvalidArgument, NotFound, NotOpen, StoreOptions
from tidemark.operators import state
from tidemark.sources.files import Files


SEGMENT_SCHEMA = "seg_id int, seq long, k string, op byte, v string"


@dataclass(frozen=True)
class Segment:
    seg_id: int
    path: str
    records: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    log: tuple[str, ...] = ()
    next_seq: int = 0
    next_seg: int = 1
    #: Bytes of the log's entries at most (each mutation counted), and the last batch of each stream that was applied.
    log_bytes: int = 0
    streams: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            raw = json.loads(text)
            return cls(raw["version"], tuple(Segment(**s) for s in raw["segments"]), tuple(raw["log"]), raw["next_seq"], raw["next_seg"], raw["log_bytes"], raw["streams"])
        except (ValueError, KeyError, TypeError) as error:
            raise Corruption(f"manifest can't be read: {error}") from error


@dataclass
class Store:
    spark: SparkSession
    options: StoreOptions = field(default_factory=StoreOptions)
    path: str | None = None
    manifest: Manifest = field(default_factory=Manifest)
    _files: Files | None = None

    def open(self, path: str) -> Store:
        """Open or create the store in a folder; a manifest that names missing data is corrupt."""
        if not path:
            raise InvalidArgument("the path is empty")
        self.close()
        files = Files(self.spark, path)
        files.mkdirs(f"{path}/manifest")
        versions = sorted(n for n in files.names(f"{path}/manifest") if n.endswith(".json"))
        manifest = Manifest.from_json(files.read(f"{path}/manifest/{versions[-1]}")) if versions else Manifest()
        for part in (*(s.path for s in manifest.segments), *manifest.log):
            if not files.exists(f"{path}/{part}"):
                raise Corruption(f"the manifest names {part}, which is missing")
        self.path, self.manifest, self._files = path.rstrip("/"), manifest, files
        return self

    def close(self) -> None:
        """Let go of the store; what is in the log stays there."""
        self.path, self._files, self.manifest = None, None, Manifest()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # -- reads

    def log(self) -> DataFrame:
        """The mutations since the last flush."""
        self._opened()
        if not self.manifest.log:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*(f"{self.path}/{p}" for p in self.manifest.log))

    def segments(self) -> DataFrame:
        """The records of all segments (seg_id, seq, k, op, v), tombstones included."""
        self._opened()
        parts = [f"{self.path}/{s.path}" for s in self.manifest.segments]
        return self.spark.read.schema(SEGMENT_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SEGMENT_SCHEMA)

    def mutations(self) -> DataFrame:
        """Segments and log as one log."""
        return self.segments().drop("seg_id").unionByName(self.log())

    def snapshot(self) -> DataFrame:
        return state.snapshot(self.mutations()).select("k", "v")

    def scan(self, low: str, high: str) -> DataFrame:
        """Live keys from ``low`` up to but without ``high``, in order."""
        return state.range_scan(self.mutations(), low, high).select("k", "v")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(k, status, v) of each key of a table."""
        return state.multi_get(keys.select("k"), self.mutations())

    def get(self, key: str) -> str:
        """The value of a key; raises NotFound."""
        self._opened()
        self._check_key(key)
        row = state.get(self.mutations(), key).first()
        if row is None or row["status"] != "VALUE":
            raise NotFound(key)
        return row["v"]

    def segment_count(self) -> int:
        return len(self.manifest.segments)

    def memtable_size(self) -> int:
        """Bytes that the mutations since the last flush take, with each key counted once."""
        if not self.manifest.log:
            return 0
        size = entry_size(F.col("k"), F.col("op"), F.col("v"))
        return state.latest(self.log()).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]

    # -- writes

    def put(self, key: str, value: str) -> None:
        self._write_one(key, PUT, value)

    def remove(self, key: str) -> None:
        """Delete a key, whether or not it exists."""
        self._write_one(key, TOMBSTONE, "")

    def put_many(self, rows: DataFrame, order: str | None = None) -> None:
        """Put the rows (k, v) of a table; of equal keys the last by ``order`` wins (by position without one)."""
        self.apply(rows.withColumn("op", F.lit(PUT)), order)

    def remove_many(self, keys: DataFrame) -> None:
        self.apply(keys.select("k", F.lit(TOMBSTONE).alias("op"), F.lit("").alias("v")))

    def apply(self, mutations: DataFrame, order: str | None = None, numbered: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Append mutations (k, op, v) to the log as one batch. A full table is flushed first, as for any write; if
        that fails, or a mutation is invalid, nothing is applied.

        Mutations are newer than all before them, in the order of ``order``; if that is ``numbered``, its whole numbers
        are their sequence numbers. A ``batch`` of a stream (name and number) is applied once."""
        self._opened()
        if batch and batch[1] <= self.manifest.streams.get(batch[0], -1):
            return
        # the bound of the log's size spares reading the log for each write
        if self.manifest.log_bytes >= self.options.memtable_size_threshold and self.memtable_size() >= self.options.memtable_size_threshold:
            self.flush()
        ordered = mutations.orderBy(order) if order and not numbered else mutations
        seq = F.col(order).cast("long") if numbered else F.lit(self.manifest.next_seq).cast("long") + F.monotonically_increasing_id()
        rows = ordered.select(seq.alias("seq"), "k", F.col("op").cast("byte").alias("op"), F.when(F.col("op") == TOMBSTONE, "").otherwise(F.col("v")).alias("v"))
        target = f"wal/batch-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{target}")
        written = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/{target}")
        valid = F.col("seq").isNotNull() & F.col("k").isNotNull() & (F.octet_length("k") > 0) & (F.octet_length("k") <= MAX_KEY) & F.col("v").isNotNull() & (F.octet_length("v") <= MAX_VALUE) & F.col("op").isin(PUT, TOMBSTONE)
        facts = written.agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad"), F.sum(entry_size(F.col("k"), F.col("op"), F.col("v"))).alias("bytes")).first()
        if facts["bad"] or not facts["n"]:
            self._files.delete(f"{self.path}/{target}")
            if facts["bad"]:
                raise InvalidArgument(f"{facts['bad']} mutations have no number, an empty key, no value, or one that is too long")
            return
        now = self.manifest
        streams = now.streams | dict([batch] if batch else [])
        self._commit(replace(now, log=(*now.log, target), next_seq=max(now.next_seq, facts["last"] + 1), log_bytes=now.log_bytes + facts["bytes"], streams=streams))

    def flush(self) -> bool:
        """Turn the log into a segment, tombstones included; False if there is nothing to flush."""
        self._opened()
        if not self.manifest.log:
            return False
        old = self.manifest.log
        segment = self._write_segment(state.latest(self.log()).select("seq", "k", "op", "v"))
        self._commit(replace(self.manifest, segments=(*self.manifest.segments, segment), log=(), next_seg=segment.seg_id + 1, log_bytes=0))
        self._collect(old)
        if self.segment_count() >= self.options.compaction_threshold:
            self.compact()
        return True

    def compact(self) -> bool:
        """Merge all segments into one without tombstones; False if there are fewer than two."""
        self._opened()
        if self.segment_count() < 2:
            return False
        old = [s.path for s in self.manifest.segments]
        newest = state.latest(self.segments().drop("seg_id")).where(F.col("op") == PUT).select("seq", "k", "op", "v")
        segment = self._write_segment(newest)
        self._commit(replace(self.manifest, segments=(segment,), next_seg=segment.seg_id + 1))
        self._collect(old)
        return True

    def _write_segment(self, rows: DataFrame) -> Segment:
        seg_id = self.manifest.next_seg
        target = f"segments/sst_{seg_id:06d}-{uuid.uuid4().hex}"
        out = rows.select(F.lit(seg_id).alias("seg_id"), "seq", "k", F.col("op").cast("byte").alias("op"), "v").repartitionByRange("k").sortWithinPartitions("k")
        writer = out.write
        if self.options.enable_bloom_filter:
            share = min(0.5, max(1e-4, 0.6185**self.options.bloom_bits_per_key))
            writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.fpp#k", str(share)).option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/{target}")
        written = self.spark.read.schema(SEGMENT_SCHEMA).parquet(f"{self.path}/{target}")
        facts = written.agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"), F.count_if(~F.col("op").isin(PUT, TOMBSTONE)).alias("bad")).first()
        if facts["n"] != facts["keys"] or facts["bad"]:
            raise Corruption(f"{target} does not hold one valid record for each key")
        return Segment(seg_id, target, facts["n"])

    def _write_one(self, key: str, op: int, value: str) -> None:
        self._opened()
        self._check_key(key)
        self.apply(self.spark.createDataFrame([(key, op, value)], "k string, op int, v string"))

    def _commit(self, manifest: Manifest) -> None:
        manifest = replace(manifest, version=self.manifest.version + 1)
        if not self._files.write_new(f"{self.path}/manifest/{manifest.version:012d}.json", manifest.to_json()):
            raise NotOpen(f"another writer committed version {manifest.version}; open the store again")
        self.manifest = manifest

    def _collect(self, parts: list[str] | tuple[str, ...]) -> None:
        """Delete data that no manifest names any more, and manifests that name it."""
        for name in self._files.names(f"{self.path}/manifest"):
            if name.endswith(".json") and name < f"{self.manifest.version:012d}.json":
                self._files.delete(f"{self.path}/manifest/{name}")
        for part in parts:
            self._files.delete(f"{self.path}/{part}")

    def _opened(self) -> None:
        if self.path is None:
            raise NotOpen("the store is not open")

    @staticmethod
    def _check_key(key: str) -> None:
        if not key:
            raise InvalidArgument("the key is empty")
