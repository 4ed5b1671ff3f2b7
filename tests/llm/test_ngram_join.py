import re

import numpy as np
import pytest

from tidemark.llm import ngram_join
from tidemark.llm.graph import connected_components
from tidemark.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string"


def sets_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, frozenset(sets_of(t))) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            overlap = len(x & y)
            if x and y and 100 * overlap >= 75 * (len(x) + len(y) - overlap):
                links.add(frozenset((x, y)))
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}, {x for x in links if len(x) == 2}


def test_classes_match_brute_force(spark, near_copies):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in near_copies], SCHEMA + ", n_shingles string, k long")
    got = ngram_join.near_duplicate_classes(docs).collect()
    want, _ = brute(near_copies)
    assert len(got) == len(near_copies)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_all_links_match_brute_force(spark, near_copies):
    links, members = ngram_join.jaccard_links(spark.createDataFrame(near_copies, SCHEMA))
    texts = dict(near_copies)
    got = [(r["src"], r["dst"], r["overlap"]) for r in links.collect()]
    _, want = brute(near_copies)
    assert {frozenset((frozenset(sets_of(texts[a])), frozenset(sets_of(texts[b])))) for a, b, _ in got} == want and len(got) == len(want)
    assert all(len(sets_of(texts[a]) & sets_of(texts[b])) == n for a, b, n in got)
    assert {r["doc_id"] for r in members.collect()} == set(texts)


@pytest.mark.parametrize(("name", "value"), [("PART", 3), ("FREQUENT", 4), ("ROWS", 50), ("TOGETHER", 64), ("HUBS", ((5,),)), ("BLOCK", 50)])
def test_sizes_do_not_change_the_result(spark, near_copies, monkeypatch, name, value):
    monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.near_duplicate_classes(spark.createDataFrame(near_copies, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(near_copies)[0]


def test_empty_and_null(spark):
    assert ngram_join.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ngram_join.near_duplicate_classes(spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, "a b c d e f")], SCHEMA)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == [(1, 0, 1), (2, 2, 2), (None, 2, None)]


def test_shingle_sets():
    texts = ["a b c d e f", "A b\tc d\x0be f", "a b c d e", "a b", "", " \n", "a b c d e a b c d e"]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(sets_of(t)) for t in texts]
    assert np.array_equal(sets[0], sets[1]) and sets[2][0] in sets[0]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_pairs_are_not_kept_until_their_task_ends(spark):
    sets = spark.createDataFrame([(k, 100, k, b"\x00" * 63 + bytes([k])) for k in (1, 2, 3)], "k long, n long, rep long, bitmap binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "ka long, kb long")
    possible = ngram_join._possible(pairs, sets, 98)
    assert sorted(tuple(r) for r in possible.collect()) == [(1, 2, 100, 100, 1, 2), (1, 3, 100, 100, 1, 3)]
    assert ngram_join._possible(pairs.limit(0), sets, 98).isEmpty()
    assert "ArrowEvalPython" not in possible._jdf.queryExecution().toString()
