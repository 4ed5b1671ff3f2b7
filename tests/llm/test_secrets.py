import random
import re

import numpy as np
import pytest

from tidemark.llm import secrets as s


@pytest.fixture(scope="module")
def forest(spark):
    return s.train(spark)


def test_held_out_findings(spark, forest):
    from pyspark.sql import functions as F

    fresh = s.labelled_findings(1500, seed=99)
    rows = spark.createDataFrame(fresh, "c string, before string, after string, label int")
    got = rows.select(s._features(F.col("c"), F.col("before"), F.col("after")).alias("f"), "label").withColumn("p", F.expr(forest.sql("f"))).collect()
    assert np.mean([(r["p"] >= 0.5) == r["label"] for r in got]) > 0.93
    for r in got[:100]:
        assert abs(forest.probability(np.array(r["f"])) - r["p"]) < 1e-12


def brute(text, findings):
    """The text with the findings taken out, by position."""
    out, at = [], 0
    for f in findings:
        out += [text[at : f["start"]], s.REDACTED]
        at = f["start"] + len(f["secret"])
    return "".join(out) + text[at:]


def test_scan_finds_redacts_and_keeps_positions(spark, forest):
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = [hexa(40) for _ in range(4)]
    texts = {
        1: f'Ödland token = "{keys[0]}" und mehr',
        2: f'start {keys[1][:39]} commit {hexa(40)} then api_key="{keys[2]}"### end',
        3: "card 4785380592391139 and https://example.com/path/index/page/1234.html",
        4: f'{"x" * 20000} token = "{keys[3]}"{" y" * 20000}',
        5: "", 6: None, 7: "nothing here", 8: "Donaudampfschifffahrtsgesellschaft" * 400,
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, redacted string")
    got = s.with_secrets(df, forest).collect()
    assert len(got) == 9
    for r in got:
        text = texts[r["doc_id"]]
        for f in r["secrets"]:
            assert text[f["start"] : f["start"] + len(f["secret"])] == f["secret"] and re.fullmatch(s.CANDIDATE, f["secret"])
        assert r["redacted"] == (brute(text, r["secrets"]) if text is not None else None)
    found = {r["doc_id"]: [f["secret"] for f in r["secrets"]] for r in got}
    assert found[1] == [keys[0]] and keys[2] in found[2] and found[4] == [keys[3]]
    assert found[3] == found[5] == found[6] == found[7] == found[8] == []


def test_empty(spark, forest):
    assert s.with_secrets(spark.createDataFrame([], "doc_id long, text string"), forest).collect() == []


def test_short_digit_free_and_punctuated_secrets(spark, forest):
    texts = {
        1: ('the password = "hunter2!Xy9" is set', "hunter2!Xy9"),
        2: ('use token = "QwErTyUiOpAsDfGhJkLzXcVb" here', "QwErTyUiOpAsDfGhJkLzXcVb"),
        3: ('password="Tr0ub4dor&3-correct"', "Tr0ub4dor&3-correct"),
        4: ("connect to postgres://user:p4ss.w0rd!x@host now", "p4ss.w0rd!x"),
        5: ("set api_key=AbCdEf0123456789AbCd and go", "AbCdEf0123456789AbCd"),
        6: ("Note: the token: string is required, key: value, see mailto:bob@example.org at 10:45", None),
        7: ("Der Schlüssel: Donaudampfschifffahrtsgesellschaft und https://example.com/some/long/path/about/things", None),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    for r in s.with_secrets(df, forest).collect():
        text, secret = texts[r["doc_id"]]
        assert [(f["start"], f["secret"]) for f in r["secrets"]] == ([(text.index(secret), secret)] if secret else []), text
        assert r["redacted"] == (text.replace(secret, s.REDACTED) if secret else text)


def test_candidates_on_long_runs(spark, forest):
    df = spark.createDataFrame([(1, "key=" + "x&" * 20000), (2, 'a="' + "=:" * 20000), (3, ":" * 40000), (4, "=" * 40000 + "_" * 40000)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in s.with_secrets(df, forest).collect()) == [1, 2, 3, 4]


def test_very_many_candidates_in_one_text(spark, forest):
    """The cost of a text grows with its candidates, not with their square."""
    import time

    from pyspark.sql import functions as F

    def scan(n):
        words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.sha2(i.cast("string"), 256), 1, 20))
        df = spark.range(1).select(F.concat_ws(" ", words).alias("text"))
        began = time.perf_counter()
        right = F.forall(F.slice("secrets", -50, 50), lambda x: F.substring(F.col("text"), x["start"] + 1, F.length(x["secret"])) == x["secret"])
        found, ok = s.with_secrets(df, forest).select(F.size("secrets"), F.when(F.size("secrets") >= 50, right)).first()
        return found, ok, time.perf_counter() - began

    few, _, _ = scan(10_000)
    many, ok, seconds = scan(100_000)
    assert few > 5_000 and many > 9 * few and ok and seconds < 60


def test_training_takes_no_python_worker(spark, monkeypatch):
    forest = s.train(spark)

    def refuse(*_):
        raise AssertionError("rows that Python workers unpickle")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert s.train(spark) == forest
