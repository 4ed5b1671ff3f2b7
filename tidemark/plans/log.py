"""Tables of the query catalogue: the mutation log that the events table holds, and keys to probe it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import PUT, TOMBSTONE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(user, part):
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 6, "0"), F.lit(":"), part.cast("string"))


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, k, op, v): an error event deletes its key, any other puts the event's properties."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        _key(F.col("user_id"), F.col("event_id") % 7).alias("k"),
        F.when(gone, TOMBSTONE).otherwise(PUT).cast("int").alias("op"),
        F.when(gone, "").otherwise(F.col("props")).alias("v"),
    )


def probe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers; the log has some of them."""
    return table(spark, sf_dir, "customer").select(_key(F.col("c_custkey"), F.col("c_custkey") % 7).alias("k"))


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("k"), "doc_id")
