import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import packing

SCHEMA = "doc_id long, text string"


def check(rows, pieces, ids_of, capacity):
    """Every document comes back whole, and every sequence is gapless."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text in rows:
        ids, at = np.array([*ids_of(text or ""), 2], "<u4"), 0
        for k, p in enumerate(sorted(by_doc[doc_id], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == capacity) and 0 < p["length"] <= capacity
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[doc_id]) == 1)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_sequence)


def test_round_trip(spark, tokenizer_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["über", "word", "été", "the", "x" * 9, "\n", "12,5", "<|endoftext|>", "日本"]) for _ in range(rng.choice((0, 1, 20, 100)))) for _ in range(150)]
    rows = list(enumerate([*texts, None, "", " ".join("long" for _ in range(5000))]))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", length int, row int")
    got = packing.pack(df, tokenizer_path, capacity=128).collect()
    n = check(rows, got, lambda t: own.encode(t, add_special_tokens=False).ids, 128)
    assert n <= 1.1 * sum(p["length"] for p in got) / 128 + 1


def test_ids_equal_the_tokenizer_files(tokenizer_path, data_dir):
    import duckdb
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(tokenizer_path), packing.encoder(tokenizer_path)
    assert fast.fast is not None
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data_dir}/documents.parquet'").fetchall()]
    for text in [*texts, "a<|endoftext|>b", " \n\n  x", "I'll we've", "\u3000\x85é", "🙂🙂 ok", "x" * 3000]:
        assert fast.encode(text) == own.encode(text, add_special_tokens=False).ids


def test_empty_table_and_repeated_rows(spark, tokenizer_path):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "same")] * 5 + [(None, "x")], SCHEMA), tokenizer_path).collect()
    assert len(got) == 6 and len({(p["sequence_id"], p["offset"]) for p in got}) == 6


@pytest.mark.parametrize("seed", range(8))
def test_search_keeps_all_lengths_and_never_adds_bins(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.choice((rng.randint(1, 100), rng.randint(30, 60), 34)) for _ in range(rng.choice((3, 40, 700))))
    first = packing.best_fit(lengths, 100)
    before, squares = sum(n for _, n in first.patterns()), sum(n * sum(p) ** 2 for p, n in first.patterns())
    after = packing.local_search(first)
    held = Counter()
    for pattern, n in after.patterns():
        assert sum(pattern) <= 100
        for length in pattern:
            held[length] += n
    assert held == lengths
    assert sum(n for _, n in after.patterns()) <= before and sum(n * sum(p) ** 2 for p, n in after.patterns()) >= squares


def test_search_empties_a_bin():
    bins = packing.Bins(10)
    for pattern in ((6,), (5, 1), (4, 4)):  # two for one: 4 and 4 of the last fit beside 6 and instead of 1
        bins.add(pattern, 1)
    assert sum(n for _, n in packing.local_search(bins).patterns()) == 2
