"""LM scoring by masked pseudo-likelihood.

A window network sees the words on both sides of a position, never the word itself, and predicts that word; a
document's score is the sum of the conditional log-probabilities of all its words. The network is plain numpy: an
embedding table per window offset, one tanh layer, and a softmax in two levels (a class of words, then the word in
it), so a prediction costs twice the square root of the vocabulary.

Words are counted over all documents. The network's vocabulary grows with the number of words counted: the most
frequent words have an id each, the others share tail ids by their hash. A word that shares an id is scored as
P(id | both sides) * P(word | id), the second factor from the corpus counts: those of the most frequent words, as many
as the vocabulary bounds, are broadcast, the others are joined and never gathered.
Of a tail id with N words of T kinds, S of them seen once, a word seen n times has n / (N + S + 1), and the rest of the
mass goes to T + 1 words never seen. Every task trains a copy of the network on every
position of all its documents, and the copies are averaged by the number of positions they saw: piece by piece of the
network, so that no task holds more than one piece of one copy, and the driver receives one network. Which documents
train a copy together depends on how the table is split, and so do the last digits of the scores.

Results for unusual input: null and empty texts have no words and a score of 0 (mean null); texts are scored whole;
repeated rows are scored alike; an empty table gives an empty table; a null doc_id is kept; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.shingles import chunks, word_hashes

#: Least buckets of the table from hashes to ids, least classes of words (as many words in each), and tail ids.
BUCKETS, SIDE, TAIL = 1 << 18, 32, 64
VOCABULARY = SIDE * SIDE
#: Words of a corpus for which SIDE classes do; the vocabulary grows with the cube root of their number.
SIDE_WORDS = 1 << 20
#: Words a task holds before it counts them.
HELD = 1 << 22
WIDTH, WINDOW = 24, (-2, -1, 1, 2)
#: Positions of a step of training.
BATCH, RATE = 8192, 0.6
#: Positions scored at once; arrays of so many stay in a core's cache.
SCORED = 8192
#: Words with a broadcast count, for each id; parameters of a network averaged together.
KNOWN, PIECE = 16, 1024


class Network:
    """Parameters: embeddings (offset, word, width), classes (width + bias, class), words (class, width + bias, word)."""

    def __init__(self, embeddings: np.ndarray, classes: np.ndarray, words: np.ndarray):
        self.embeddings, self.classes, self.words = embeddings, classes, words

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Network:
        """Small random embeddings, and output biases that give the corpus frequencies."""
        rng = np.random.default_rng(seed)
        share = (counts + 1.0) / (counts.sum() + len(counts))
        side = round(len(counts) ** 0.5)
        by_class = share.reshape(side, side)
        classes, words = np.zeros((WIDTH + 1, side), np.float32), np.zeros((side, WIDTH + 1, side), np.float32)
        classes[:WIDTH] = rng.normal(0, 0.05, (WIDTH, side))
        words[:, :WIDTH] = rng.normal(0, 0.05, (side, WIDTH, side))
        classes[WIDTH] = np.log(by_class.sum(1))
        words[:, WIDTH] = np.log(by_class / by_class.sum(1, keepdims=True))
        embeddings = rng.normal(0, 0.3, (len(WINDOW), len(counts) + 1, WIDTH)).astype(np.float32)
        return cls(embeddings, classes, words)

    def pack(self) -> bytes:
        return b"".join(x.astype(np.float32).tobytes() for x in (self.embeddings, self.classes, self.words))

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        flat = np.frombuffer(data, np.float32)
        side = next(k for k in range(1, len(flat)) if len(WINDOW) * (k * k + 1) * WIDTH + (WIDTH + 1) * (k + k * k) >= len(flat))
        shapes = ((len(WINDOW), side * side + 1, WIDTH), (WIDTH + 1, side), (side, WIDTH + 1, side))
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*(x.reshape(s).copy() for x, s in zip(np.split(flat, cuts), shapes, strict=True)))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """The layer that sees the words around each position, with a column of ones for the biases."""
        out = np.ones((len(context), WIDTH + 1), np.float32)
        total = self.embeddings[0].take(context[:, 0], 0)
        for k in range(1, len(WINDOW)):
            total += self.embeddings[k].take(context[:, k], 0)
        np.tanh(total, out=out[:, :WIDTH])
        return out

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(word | both sides) of each position."""
        side = self.classes.shape[1]
        order, cuts = _by_value(target // side, side)
        h, group, inner = self.hidden(context[order]), target[order] // side, target[order] % side
        sorted_out = _log_softmax_at(self.classes.T @ h.T, group)
        for g in np.flatnonzero(np.diff(cuts)).tolist():  # the positions of a class lie together
            own = slice(cuts[g], cuts[g + 1])
            sorted_out[own] += _log_softmax_at(self.words[g].T @ h[own].T, inner[own])
        out = np.empty_like(sorted_out)
        out[order] = sorted_out
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability of a batch, in the order of classes."""
        side = self.classes.shape[1]
        rate /= len(target)
        order, cuts = _by_value(target // side, side)
        context, target = context[order], target[order]
        h, group, inner = self.hidden(context), target // side, target % side
        miss = _miss(self.classes.T @ h.T, group)
        back = miss.T @ self.classes.T
        self.classes += rate * (h.T @ miss.T)
        for g in np.flatnonzero(np.diff(cuts)).tolist():  # the positions of a class lie together
            own = slice(cuts[g], cuts[g + 1])
            miss = _miss(self.words[g].T @ h[own].T, inner[own])
            back[own] += miss.T @ self.words[g].T
            self.words[g] += rate * side * (h[own].T @ miss.T)
        slope = back[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
        for k in range(len(WINDOW)):
            order, cuts = _by_value(context[:, k], self.embeddings.shape[1])
            ids = np.flatnonzero(cuts[1:] > cuts[:-1])
            self.embeddings[k][ids] += rate * side * np.add.reduceat(slope.take(order, 0), cuts[ids], axis=0)


def _by_value(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each of n ids in turn, and where those of each id start; few ids are sorted by their digits."""
    order = np.argsort(ids.astype(np.uint16) if n <= 1 << 16 else ids, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))])


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one choice in each column; ``z`` is used up. Choices are rows, so that sums run over whole rows."""
    z -= z.max(0)
    own = z[at, np.arange(len(at))]
    return own - np.log(np.exp(z, out=z).sum(0))


def _miss(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In each column, 1 at the choice that was made less each choice's probability; ``z`` is used up."""
    z -= z.max(0)
    np.exp(z, out=z)
    z *= -1 / z.sum(0)
    z[at, np.arange(len(at))] += 1
    return z


def _bucket(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (buckets - 1)


@dataclass(frozen=True)
class Vocabulary:
    """The id of each bucket, the hash of each id's word (0 for tail ids), each tail id's frequency, kinds and words seen
    once; tail words with broadcast counts, by hash; and all words (word, n)."""

    ids: np.ndarray
    own: np.ndarray
    tail: np.ndarray
    sums: np.ndarray
    known: tuple[np.ndarray, np.ndarray]
    words: DataFrame


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, as its hash, occurs in all documents."""

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pd.DataFrame({"word": found.view(np.int64), "n": n})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for batch in batches:
            for chunk in chunks(batch["text"]):
                held.append(word_hashes(chunk)[0])
                if sum(len(h) for h in held) >= HELD:
                    yield counted(held)
                    held = []
        yield counted(held)

    return docs.select("text").mapInPandas(rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of all words (word, n), and the frequency of each id; the most frequent words spread over the classes."""
    by_tail = words.groupBy(F.expr(f"pmod(word, {TAIL})").cast("int").alias("t")).agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")))
    sums = np.zeros((TAIL, 3), np.int64)
    for t, *values in by_tail.collect():  # TAIL rows at most
        sums[t] = values
    side = max(SIDE, int(np.ceil(SIDE * (sums[:, 0].sum() / SIDE_WORDS) ** (1 / 6))))
    size = side * side
    top = words.orderBy(F.desc("n"), "word").limit(KNOWN * size).toPandas()  # KNOWN rows an id
    by_hash = np.argsort(top["word"].to_numpy(np.int64))
    known = top["word"].to_numpy(np.int64)[by_hash], top["n"].to_numpy(np.int64)[by_hash]
    top = top.head(size - TAIL)
    hashes, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    buckets = max(BUCKETS, 1 << (64 * size - 1).bit_length())
    _, first = np.unique(_bucket(hashes, buckets), return_index=True)
    first.sort()  # of words that meet in a bucket the most frequent has the id, the others are tail words
    hashes, n = hashes[first], n[first]
    t = hashes.view(np.int64) % TAIL
    for k, of in enumerate((n, np.ones(len(n)), n == 1)):
        sums[:, k] -= np.bincount(t, of, TAIL).astype(np.int64)
    spread = np.arange(size).reshape(side, side).T.ravel()
    ids, own, counts = np.full(buckets, spread[-1], np.int32), np.zeros(size, np.uint64), np.zeros(size, np.int64)
    at, tail = spread[: len(hashes)], spread[size - TAIL :]
    ids[_bucket(hashes, buckets)], own[at], counts[at], counts[tail] = at, hashes, n, sums[:, 0]
    return Vocabulary(ids, own, tail, sums, known, words), counts


def windows(chunk: list[bytes], ids: np.ndarray, own: np.ndarray | None = None, tail: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of every word of the texts: its id, the ids around it (the number of ids beyond the edge of the text), its text.

    With ``own`` and ``tail``, a word that isn't its id's own word has a tail id; a fourth array has the word where
    that is so, and 0 elsewhere."""
    hashes, owner = word_hashes(chunk)
    target = ids[_bucket(hashes, len(ids))].astype(np.int64)
    edge, rest = VOCABULARY, ()
    if own is not None:
        other, edge = own[target] != hashes, len(own)
        target = np.where(other, tail[hashes.view(np.int64) % TAIL], target)
        rest = (np.where(other, hashes, np.uint64(0)).view(np.int64),)
    context = np.full((len(target), len(WINDOW)), edge, np.int64)
    for k, d in enumerate(WINDOW):
        here, there = (slice(None, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(None, d))
        same = owner[here] == owner[there]
        context[here, k] = np.where(same, target[there], edge)
    return target, context, owner, *rest


def train(docs: DataFrame) -> tuple[Vocabulary, Network]:
    """The vocabulary, and the network, trained on all documents."""
    spark = docs.sparkSession
    vocab, counts = vocabulary(materialise(count_words(docs), "words"))
    first = Network.start(counts)
    shared = spark.sparkContext.broadcast((vocab.ids, vocab.own, vocab.tail, first.pack()))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *lookup, data = shared.value
        network, seen = Network.unpack(data), 0
        for batch in batches:
            for chunk in chunks(batch["text"]):
                target, context, *_ = windows(chunk, *lookup)
                for k in range(0, len(target), BATCH):
                    network.step(context[k : k + BATCH], target[k : k + BATCH], RATE)
                seen += len(target)
        if seen:
            data, width = network.pack(), 4 * PIECE
            yield pd.DataFrame([(k // width, seen, data[k : k + width]) for k in range(0, len(data), width)], columns=["piece", "seen", "network"])

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, all_seen, piece = 0.0, 0, None
        for batch in batches:
            for piece, seen, data in batch.itertuples(index=False):
                total, all_seen = total + seen * np.frombuffer(data, np.float32).astype(float), all_seen + seen
        yield pd.DataFrame([(piece, all_seen, (total / all_seen).astype(np.float32).tobytes())], columns=["piece", "seen", "network"])

    schema = "piece long, seen long, network binary"
    averages = docs.select("text").mapInPandas(rows, schema).groupBy("piece").applyInPandas(average, schema).toPandas()  # one network
    return (vocab, Network.unpack(b"".join(averages.sort_values("piece")["network"]))) if len(averages) else (vocab, first)


def score(docs: DataFrame, vocab: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum over all words) and mean_log_likelihood of each document."""
    sums = vocab.sums + (0, 1, 1)
    of_tail = -np.log(sums[:, 0] + sums[:, 2])
    shared = docs.sparkSession.sparkContext.broadcast((vocab.ids, vocab.own, vocab.tail, *vocab.known, network.pack()))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *lookup, known, known_n, data = shared.value
        model = Network.unpack(data)
        for batch in batches:
            n, total, tails = [], [], []
            for chunk in chunks(batch["text"]):
                target, context, owner, word = windows(chunk, *lookup)
                p = np.concatenate([np.zeros(0, np.float32), *(model.log_probabilities(context[k : k + SCORED], target[k : k + SCORED]) for k in range(0, len(target), SCORED))])
                n.append(np.bincount(owner, minlength=len(chunk)))
                at = np.flatnonzero(word)
                p = p.astype(float)
                p[at] += of_tail[word[at] % TAIL]
                if len(known):
                    place = np.minimum(np.searchsorted(known, word[at]), len(known) - 1)
                    found = known[place] == word[at]
                    p[at[found]] += np.log(known_n[place[found]])
                    at = at[~found]
                total.append(np.bincount(owner, p, len(chunk)))
                tails += np.split(word[at], np.searchsorted(owner[at], np.arange(1, len(chunk))))
            n, total = np.concatenate([np.zeros(0, np.int64), *n]), np.concatenate([np.zeros(0), *total])
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "n_words": n, "total": total, "tail": tails})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = materialise(numbered.mapInPandas(rows, "row long, doc_id long, n_words long, total double, tail array<long>"), "scored")
    unseen = F.array(*(F.lit(float(x)) for x in np.log(sums[:, 2] / sums[:, 1])))
    each = scored.select("row", F.explode("tail").alias("word")).join(vocab.words, "word", "left")
    within = each.groupBy("row").agg(F.sum(F.coalesce(F.log("n"), F.get(unseen, F.expr(f"pmod(word, {TAIL})").cast("int")))).alias("within"))
    total = F.col("total") + F.coalesce("within", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return scored.drop("tail").join(within, "row", "left").select("doc_id", "n_words", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def score_by_own_model(docs: DataFrame) -> DataFrame:
    """Train on the documents, then score each of them."""
    return score(docs, *train(docs))
