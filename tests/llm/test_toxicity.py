import itertools
import random

import numpy as np
import pytest

from tidemark.llm import toxicity as t

BAD = ["blargh", "frobnik", "zorgle"]


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    plain = [a + b for a, b in itertools.product("ka lo mi nu ster bran dol fi".split(), "ra to ne shu lim vek".split())]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "en", "ish"]))
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, toxic))
    return docs, labels


def test_chain_equals_full_forward_backward():
    rng = np.random.default_rng(1)
    field = t.Field({"bad": 1.3, "worse": 2.1}, -1.7, rng.normal(size=(2, 2)))
    for words in (["bad"], ["x", "bad", "y"], ["bad", "worse", "x", "x", "bad", "y"], ["x"] * 90 + ["worse"] + ["y"] * 3 + ["bad"]):
        emit = np.array([[0.0, field.bias + field.weights.get(w, 0.0)] for w in words])[None]
        want = t._expectations(emit, field.transitions)[0][0, :, 1]
        # the windows used in training start without a preference, as the chain does
        at = [i for i, w in enumerate(words) if w in field.weights]
        got = t.Chain(field).marginals(len(words), at, [field.emission(words[i]) for i in at])
        assert np.allclose(got, want[at], atol=1e-9)


def test_held_out_accuracy_and_spans(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    field = t.train(df, lab.where("doc_id < 300"))
    got = t.score(df, field).collect()
    truth = dict(labels)
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] >= 300]) > 0.97
    texts = dict(docs)
    for r in got:
        for span in r["spans"]:
            assert texts[r["doc_id"]][span["start"] : span["end"]] == span["word"] and any(span["word"].lower().startswith(b) for b in BAD)


def test_unusual_input(spark):
    docs, labels = corpus(150)
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "İ blargh " * 9000), (1, docs[1][1]), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    got = t.score(df, t.train(df, lab)).collect()
    assert len(got) == 155 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[900]["score"] == by_id[901]["score"] < 0.5 < by_id[902]["score"]


def test_without_labels_and_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    field = t.train(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none)
    assert t.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), field).first()["score"] == pytest.approx(0)
    assert t.score(empty, field).collect() == []


@pytest.mark.parametrize("gap", [0, 1, 64, 100, 1000])
def test_gaps_are_exact_in_a_sticky_field(gap):
    """A tag that hardly ever changes carries over gaps of any length; each word is visited one by one to compare."""
    field = t.Field({"bad": 2.0}, 0.001, np.log(np.array([[0.999, 0.001], [0.001, 0.999]])))
    emissions = [0.0] * (2 * gap + 2)
    at = [0, gap + 1]
    words = [field.emission("bad") if i in at else None for i in range(len(emissions))]
    emit = np.array([[1.0, np.exp(field.bias if e is None else e)] for e in words])
    change = np.exp(field.transitions)
    forward, back = [emit[0] / emit[0].sum()], [np.ones(2)]
    for e in emit[1:]:
        forward.append(forward[-1] @ change * e / (forward[-1] @ change * e).sum())
    for e in emit[:0:-1]:
        back.append(change @ (e * back[-1]) / (change @ (e * back[-1])).sum())
    back = back[::-1]
    want = [(forward[i] * back[i])[1] / (forward[i] * back[i]).sum() for i in at]
    got = t.Chain(field).marginals(len(emissions), at, [field.emission("bad")] * 2)
    assert np.allclose(got, want, atol=1e-9)
