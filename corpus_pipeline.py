"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a table; all but
the last return the columns of documents. A stage's result is written before the next stage begins, which then
deletes what the one before it kept in the shared folder.

Results for unusual input, in all stages: a null or empty text fails the base rule of the first stage and goes there (any
other stage keeps it); texts are read whole; identical rows, whatever their ids, are copies of which the second stage
keeps one, those without a doc_id excepted: they link with nothing and all stay; rows that share a doc_id but not a text
are different documents; ties go to the smaller id; an empty table gives an empty table; columns that documents have
beside doc_id and text are carried along unread (n_chars is renewed where a text changes), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, quality_rules, secrets
from tidemark.llm.common import folders, forget, fresh, materialise
from tidemark.llm.queries import MIX, labelled_domains

#: Tables that the latest stage's result reads.
_held: list[DataFrame] = []


def _begin(docs: DataFrame) -> None:
    """Delete what earlier stages have kept, but for tables that ``docs`` itself still reads."""
    if _held:
        needed = folders(docs)
        for table in _held:
            if not folders(table) & needed:
                forget(table)
        _held[:] = [table for table in _held if folders(table) & needed]


def _hold(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    _held.append(df := materialise(df, name, small))
    return df


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _begin(docs)
    (row,) = fresh(docs.select("text"), "__row")
    counted = _hold(quality_rules.with_counts(docs.select(F.struct(*_columns(docs)).alias(row), "text")).drop("text"), "counted")
    return quality_rules.judge(counted, quality_rules.fit_on(counted)).where("kept").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    _begin(docs)
    joined = ngram_join.Join(docs)
    stay = _hold(joined.components().where("stays AND doc_id IS NOT NULL").groupBy("doc_id", "t").count(), "classes", small=True)
    joined.forget()
    doc, text, rank = fresh(docs, "__doc", "__text", "__rank")
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    kept = keyed.join(stay.select(F.col("doc_id").alias(doc), F.col("t").alias(text)), [doc, text], "left_semi").unionByName(keyed.where(F.col(doc).isNull()))
    if stay.where("count > 1").isEmpty():
        return _like(kept, docs)
    first = F.row_number().over(Window.partitionBy(doc, text).orderBy("text"))  # rows with the same id and text: one of them stays
    return _like(kept.withColumn(rank, F.when(F.col(doc).isNull(), 1).otherwise(first)).where(f"{rank} = 1"), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts."""
    _begin(docs)
    (row,) = fresh(docs.select("text"), "__row")
    scanned = secrets.with_secrets(docs.select(F.struct(*_columns(docs)).alias(row), "text"), secrets.train(spark))
    renewed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("redacted")}
    return scanned.select(*(renewed.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the domains have their shares of the tokens; none is dropped."""
    _begin(docs)
    domains = tuple(MIX)
    model = mixing.train(labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), domains)
    (row,) = fresh(docs.select("text", "doc_id"), "__row")
    scored = _hold(mixing.with_posterior(docs.select(F.struct(*_columns(docs)).alias(row), "text", "doc_id"), model).drop("text"), "posteriors")
    rated = mixing.with_rate(scored, mixing.fit(scored, domains, MIX, keep_all=True), domains)
    return rated.select(row, F.explode(F.sequence(F.lit(1), mixing.copies(F.col("rate"), F.col("doc_id")))).alias("n")).select(f"{row}.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, in sequences."""
    import public_tokenizers

    _begin(docs)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("secret_scan", without_secrets), ("mixing", mixed), ("best_fit_packing", packed)]

#: The label model, the forest and the packing search have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialise(docs, name)
    return docs
