import math
import time

import numpy as np
import pytest

from tidemark.llm import cover_tree

SCHEMA = "vec_id long, label int, embedding array<float>"


def vectors(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.02, 0.1, 0.4]), size=dim)
        rows.append((i, int(rng.integers(3)) if i % 17 else None, [float(x) for x in np.float32(v * rng.choice([1, 5]))]))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(20)]  # copies
    return rows + [(900, 1, None), (901, 1, [0.0] * dim), (902, 1, [math.nan] * dim), (903, 1, [math.inf] + [0.0] * (dim - 1)), (904, 1, [1.0, None]), (905, 1, [1.0]), (906, 1, [2.0]), (907, 1, [])]


def brute(rows, threshold):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, label, v) in enumerate(rows):
        for j, other, w in rows[:a]:
            if label is not None and label == other and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize(("threshold", "block"), [(0.98, 2000), (0.98, 15), (0.9, 7)])
def test_matches_brute_force(spark, threshold, block):
    rows = vectors()
    got = cover_tree.near_vectors(spark.createDataFrame(rows, SCHEMA), threshold, block).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute(rows, threshold)


def test_empty(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_covers_and_halves():
    points = np.random.default_rng(0).normal(size=(500, 6))
    tree = cover_tree.CoverTree(points)
    for node, members in enumerate(tree.members):
        away = np.sqrt(((points[members] - points[tree.centre[node]]) ** 2).sum(1))
        assert away.max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            assert sorted(np.concatenate([tree.members[c] for c in tree.children[node]])) == sorted(members)
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in tree.children[node])


def pairs_of(x, y, threshold, same):
    return sorted((int(min(a, b)), int(max(a, b))) if same else (int(a), int(b)) for i, j in cover_tree._links(x, y, threshold, same) for a, b in zip(i, j, strict=True))


def brute_pairs(x, y, threshold, same):
    u, v = (m.astype(float) / np.abs(m.astype(float)).max(1)[:, None] for m in (x, y))
    close = (u @ v.T) / np.sqrt((u * u).sum(1))[:, None] / np.sqrt((v * v).sum(1)) >= threshold
    return [(int(a), int(b)) for a, b in np.argwhere(close) if not same or a < b]


def shape(name, n, seed=3):
    rng = np.random.default_rng(seed)
    if name == "structureless":
        x = rng.normal(size=(n, 64))
        x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.1, size=(n - n // 2, 64))
    elif name == "dense":
        x = np.ones((n, 20)) + rng.normal(scale=rng.choice([1e-7, 0.05, 0.15, 0.5], (n, 1)), size=(n, 20))
    elif name == "flat":
        x = rng.normal(size=(n, 3))
    elif name == "line":
        x = rng.choice([-3.0, 0.5], (n, 1))
    else:
        return rng.normal(size=(n, 5)) * 10.0 ** rng.integers(-200, 200, (n, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize("chunk", [2000, 60])
@pytest.mark.parametrize("threshold", [0.98, 0.5])
@pytest.mark.parametrize("name", ["structureless", "dense", "flat", "line", "far apart sizes"])
def test_links_of_blocks_match_brute_force(monkeypatch, name, threshold, chunk):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    monkeypatch.setattr(cover_tree, "TOGETHER", 500)
    x, y = shape(name, 400), shape(name, 300, seed=4)
    y[:50] = x[:50]
    assert pairs_of(x, x, threshold, True) == brute_pairs(x, x, threshold, True)
    assert pairs_of(x, y, threshold, False) == brute_pairs(x, y, threshold, False)


def test_structureless_vectors_cost_no_more_than_all_products():
    """Vectors without structure leave most pairs of nodes to the root's children: these must not be met one by one."""
    x = shape("structureless", 8000)
    start = time.process_time()
    want = brute_pairs(x, x, 0.98, True)
    plain, start = time.process_time() - start, time.process_time()
    assert pairs_of(x, x, 0.98, True) == want
    assert time.process_time() - start < plain + 2


def test_vectors_of_a_label_enter_few_tasks(spark):
    """A label is dealt to few blocks, so that a vector is sent to few tasks: to one where the label is a single block."""
    rng = np.random.default_rng(5)
    vectors = [(i, i % 2, 1, rng.normal(size=8).astype(np.float32).tobytes()) for i in range(6000)]
    classes = spark.createDataFrame([(label, 8, rep, copies, bytearray(v)) for rep, label, copies, v in vectors], "label int, dim int, rep long, copies long, vector binary")
    assert cover_tree._sides(classes, cover_tree.BLOCK, "<f4", 0.2).count() == 6000
    sides = cover_tree._sides(classes, 500, "<f4", 0.2).groupBy("label", "pair", "side").count().collect()
    assert 6000 < sum(r["count"] for r in sides) <= 6000 * 8 and max(r["count"] for r in sides) <= 3 * 1000


def test_double_precision_and_several_blocks(spark):
    x = np.concatenate([shape("far apart sizes", 150), shape("far apart sizes", 50) * 2])
    rows = [(i, i % 2, [float(v) for v in own]) for i, own in enumerate(x)]
    for block in (2000, 20):
        got = cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), 0.98, block).collect()
        want = {i: 0 for i in range(len(x))}
        for label in (0, 1):
            for a, b in brute_pairs(x[label::2], x[label::2], 0.98, True):
                want[2 * a + label] += 1
                want[2 * b + label] += 1
        assert {r["vec_id"]: r["n_links"] for r in got} == want
