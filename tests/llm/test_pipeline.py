"""Each stage of the pipeline on its own input, and the whole of it."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import check


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages(spark, data_dir, tokenizer_path):
    from tokenizers import Tokenizer

    from tidemark.llm.common import materialise

    docs = documents(spark, data_dir)
    planted = F.when(F.col("doc_id") == 3, F.concat("text", F.lit(' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" '))).otherwise(F.col("text"))
    docs = docs.withColumn("text", planted)
    columns, tables = docs.columns, [docs]
    for name, stage in p.STAGES[:-1]:
        out = materialise(stage(spark, tables[-1], data_dir), name)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        tables.append(out)
    raw, good, single, clean, mixed = (t.collect() for t in tables)

    kept = {r["doc_id"] for r in good}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    long_enough = {r["doc_id"] for r in raw if len(r["text"].split()) >= 10}
    assert all(i in kept for i, q in quality.items() if q == 1 and i in long_enough) and len(kept) < len(raw)

    classes, _ = near([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in single} == {i for i, (_, c) in classes.items() if i == c} and len(single) < len(good)

    before = {r["doc_id"]: r["text"] for r in single}
    assert sorted(r["doc_id"] for r in clean) == sorted(before)
    assert any(r["doc_id"] == 3 and r["text"] == before[3].replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]") for r in clean) and all(len(r["text"]) == r["n_chars"] for r in clean)
    assert not any('token = "' + "0123456789abcdef"[k] in r["text"] for r in clean for k in range(16))

    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in clean} and len(mixed) > len(clean)

    packed = p.STAGES[-1][1](spark, tables[-1], data_dir).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    own = Tokenizer.from_file(tokenizer_path)
    once = p.STAGES[-1][1](spark, tables[3], data_dir).collect()
    check([(r["doc_id"], r["text"]) for r in clean], once, lambda t: own.encode(t, add_special_tokens=False).ids, 1024)


def test_rows_that_repeat_an_id(spark, data_dir):
    docs = documents(spark, data_dir).limit(20)
    out = p.near_duplicates(spark, docs.union(docs), data_dir)
    assert out.groupBy("doc_id").count().where("count > 1").isEmpty()


def test_run(spark, data_dir):
    got = p.run(spark, data_dir).collect()
    assert got and {"doc_id", "sequence_id", "offset", "length"} <= set(got[0].asDict())


CLASHING = "doc_id long, text string, n long, k long, t long, stays string, secrets string, posterior string, kept string, __row string"


def test_one_id_with_different_texts_nulls_and_clashing_names(spark, data_dir):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, other), (1, one), (2, one + " end"), (3, None), (3, None), (4, ""), (None, one), (None, one), (5, other)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "s", "x", "p", "k", "r") for i, t in rows], CLASHING)
    out = p.near_duplicates(spark, docs, data_dir)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, one), (1, other), (3, None), (4, ""), (None, one), (None, one)], key=repr)
    clean = p.without_secrets(spark, docs, data_dir)
    assert clean.columns == docs.columns and sorted(((r["doc_id"], r["text"], r["secrets"]) for r in clean.collect()), key=repr) == sorted(((i, t, "x") for i, t in rows), key=repr)
    good = p.quality(spark, docs, data_dir)
    assert good.columns == docs.columns and not good.where("text IS NULL OR text = ''").count()


def test_empty_tables(spark, data_dir):
    empty = documents(spark, data_dir).limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, data_dir).collect() == []
