import random

import numpy as np
import pytest

from tidemark.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string"


def sentences(n=600, seed=3):
    """Texts in which the middle of three words follows from both its neighbours."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            a, b = rng.randrange(4), rng.randrange(4)
            words += [f"left{a}", f"mid{a}{b}", f"right{b}"]
        out.append((i, " ".join(words)))
    return out


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network.start(rng.integers(1, 50, lm.VOCABULARY))
    context, target = rng.integers(0, lm.VOCABULARY + 1, (200, len(lm.WINDOW))), rng.integers(0, 40, 200)
    before = net.log_probabilities(context, target).mean()
    for _ in range(20):
        net.step(context, target, 0.3)
    assert net.log_probabilities(context, target).mean() > before + 0.1
    everything = np.exp(net.log_probabilities(np.repeat(context[:1], lm.VOCABULARY, 0), np.arange(lm.VOCABULARY)))
    assert abs(everything.sum() - 1) < 1e-3
    assert np.array_equal(lm.Network.unpack(net.pack()).words, net.words)


def test_windows_stay_within_texts():
    ids = np.arange(lm.BUCKETS) % lm.VOCABULARY
    target, context, owner = lm.windows([b"a b c", b"", b"d"], ids)
    assert owner.tolist() == [0, 0, 0, 2]
    v = lm.VOCABULARY
    assert context.tolist() == [[v, v, target[1], target[2]], [v, target[0], target[2], v], [target[0], target[1], v, v], [v, v, v, v]]


def test_learns_from_both_sides(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 256)
    docs = spark.createDataFrame(sentences(), SCHEMA).coalesce(1)
    ids, network = lm.train(docs)
    rows = {r["doc_id"]: r for r in lm.score(docs.union(spark.createDataFrame([(9000, "mid00 left0 left1 right3 " * 45)], SCHEMA)), ids, network).collect()}
    counts = lm.count_words(docs).toPandas()["n"].to_numpy()
    share = counts / counts.sum()
    unigram = float((share * np.log(share)).sum())
    own = np.mean([r["mean_log_likelihood"] for i, r in rows.items() if i < 9000])
    assert own > unigram + 0.3 and rows[9000]["mean_log_likelihood"] < own - 0.5
    assert rows[0]["n_words"] == 180 and rows[0]["log_likelihood"] == pytest.approx(180 * rows[0]["mean_log_likelihood"])


def test_unusual_input(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x " * 30000, 3), (4, "a b", 4), (4, "a b", 4), (None, "c", 5)], SCHEMA + ", n_words int")
    got = lm.score_by_own_model(df).collect()
    assert [(r["n_words"], r["mean_log_likelihood"] is None) for r in sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_words"]))] == [(1, False), (0, True), (0, True), (30000, False), (2, False), (2, False)]
    assert lm.score_by_own_model(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_word_has_its_own_probability(spark):
    rng = random.Random(4)
    weights = [1 / (k + 1) for k in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.choices(range(6000), weights, k=200))) for i in range(300)], SCHEMA)
    vocab, network = lm.train(docs)
    counts = {r["word"]: r["n"] for r in vocab.words.collect()}
    hashes = lambda words: lm.word_hashes([" ".join(words).encode()])[0].view(np.int64).tolist()
    every = [f"w{k}" for k in range(6000) if hashes([f"w{k}"])[0] in counts]
    assert len(every) == len(counts) > 3 * lm.VOCABULARY
    unseen = [f"gibberish{k}" for k in range(500)]
    one = spark.createDataFrame([(k, w) for k, w in enumerate(every + unseen)], SCHEMA)
    got = [r["log_likelihood"] for r in lm.score(one, vocab, network).orderBy("doc_id").collect()]
    seen, rare = np.array(got[: len(every)]), np.array(got[len(every) :])
    unknown = 0
    model = network.log_probabilities(np.full((lm.TAIL, len(lm.WINDOW)), len(vocab.own)), vocab.tail)
    for (n, kinds, once), p in zip(vocab.sums, model, strict=True):
        unknown += np.exp(p) * (once + 1) / (n + once + 1)
    empty_ids = lm.VOCABULARY - lm.TAIL - int((vocab.own > 0).sum())
    assert empty_ids < 5 and abs(np.exp(seen).sum() + unknown - 1) < 0.01
    assert rare.max() < np.median(seen)
    share = np.array([counts[h] for h in hashes(every)]) / sum(counts.values())
    assert np.corrcoef(seen, np.log(share))[0, 1] > 0.9


def test_vocabulary_grows(spark):
    words = spark.range(5000).selectExpr("xxhash64(id) AS word", "1L AS n")
    small, counts = lm.vocabulary(words)
    large, more = lm.vocabulary(words.withColumn("n", words["n"] * 100000))
    assert len(counts) == lm.VOCABULARY and len(more) > 4 * lm.VOCABULARY and len(large.own) == len(more)
    assert counts.sum() == 5000 and more.sum() == 5000 * 100000


def test_production_parameters_train_on_every_position(spark):
    """Texts too short for a share of their positions; a tenth of them gives about 0.5 above the unigram."""
    rows = [(9 * i + k, " ".join(t.split()[20 * k : 20 * k + 20])) for i, t in sentences(1200) for k in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    vocab, network = lm.train(docs)
    n = np.array([r["n"] for r in vocab.words.collect()])
    got = lm.score(docs, vocab, network).selectExpr("sum(log_likelihood) / sum(n_words) AS mean").collect()[0]["mean"]
    assert got > float((n / n.sum() * np.log(n / n.sum())).sum()) + 2


def test_scores_match_a_plain_loop(spark):
    """Every probability by the definition: the hidden layer, two softmaxes, and the share of a word among its id's."""
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice((1, 7, 60)))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    vocab, net = lm.train(docs)
    counts = {r["word"]: r["n"] for r in vocab.words.collect()}
    side, edge = net.classes.shape[1], len(vocab.own)

    def softmax(z):
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def id_of(h):
        own = int(vocab.ids[(h >> 20) % len(vocab.ids)])
        return (own, False) if int(vocab.own[own]) == h else (int(vocab.tail[(h - (h >> 63 << 64)) % lm.TAIL]), True)

    for asked in (docs, spark.createDataFrame([(0, "w1 never-seen w2")], SCHEMA)):
        for row in asked.join(lm.score(asked, vocab, net), "doc_id").collect():
            hashes = [int(lm.word_hashes([w.encode()])[0][0]) for w in row["text"].split()]
            ids, total = [id_of(h) for h in hashes], 0.0
            for i, h in enumerate(hashes):
                around = [ids[i + d][0] if 0 <= i + d < len(ids) else edge for d in lm.WINDOW]
                hidden = np.append(np.tanh(sum(net.embeddings[k][c] for k, c in enumerate(around))), 1)
                own, is_tail = ids[i]
                p = softmax(hidden @ net.classes)[own // side] * softmax(hidden @ net.words[own // side])[own % side]
                if is_tail:
                    signed = h - (h >> 63 << 64)
                    n, kinds, once = (int(v) for v in vocab.sums[signed % lm.TAIL])
                    p *= counts[signed] / (n + once + 1) if signed in counts else (once + 1) / (kinds + 1) / (n + once + 1)
                total += np.log(p)
            assert row["log_likelihood"] == pytest.approx(total, abs=1e-2 + 1e-4 * abs(total))


def test_step_and_scores_in_place_and_as_by_plain_formulas():
    import tracemalloc

    side, n = 64, 8192
    rng = np.random.default_rng(1)
    network = lm.Network.start(rng.integers(1, 1000, side * side))
    context, target = rng.integers(0, side * side + 1, (n, len(lm.WINDOW))), rng.integers(0, side * side, n)
    tracemalloc.start()
    scores = network.log_probabilities(context, target)
    after_scores = tracemalloc.get_traced_memory()[1]
    before = lm.Network(*(x.astype(float) for x in (network.embeddings, network.classes, network.words)))
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    network.step(context, target, 0.6)
    after_step = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    matrix = 4 * n * side  # of the logits of a batch; with copies of it, caches and time go
    assert after_scores < 2.5 * matrix and after_step < 3 * matrix

    h = np.concatenate([np.tanh(sum(before.embeddings[k][context[:, k]] for k in range(len(lm.WINDOW)))), np.ones((n, 1))], 1)
    group, inner, at = target // side, target % side, np.arange(n)
    p = np.exp(h @ before.classes)
    p /= p.sum(1, keepdims=True)
    q = np.exp(np.einsum("nw,nwc->nc", h, before.words[group]))
    q /= q.sum(1, keepdims=True)
    assert np.allclose(scores, np.log(p[at, group] * q[at, inner]), atol=1e-4)
    p, q = -p, -q
    p[at, group] += 1
    q[at, inner] += 1
    words = before.words.copy()
    for g in range(side):
        words[g] += 0.6 / n * side * h[group == g].T @ q[group == g]
    slope = (p @ before.classes.T + np.einsum("nc,nwc->nw", q, before.words[group]))[:, : lm.WIDTH] * (1 - h[:, : lm.WIDTH] ** 2)
    embeddings = before.embeddings.copy()
    for k in range(len(lm.WINDOW)):
        np.add.at(embeddings[k], context[:, k], 0.6 / n * side * slope)
    assert np.allclose(network.classes, before.classes + 0.6 / n * h.T @ p, atol=1e-5)
    assert np.allclose(network.words, words, atol=1e-5) and np.allclose(network.embeddings, embeddings, atol=1e-5)
