"""Embedding near-duplicates: dual traversal of cover trees, giving the exact pairs above a cosine threshold.

Unit vectors with cosine at least t are at most ``sqrt(2 - 2 t)`` apart. The vectors of a label are dealt to the
nearest of a bounded number of pivots, which are the top level of the tree; a label of up to ``BLOCK`` vectors is one
block. Pairs of blocks survive if their pivots are no further apart than their covering radii and that distance allow.
Each surviving pair is one task: either block is dealt on to nearest pivots, level by level, until chunks hold at most
``CHUNK`` points; a cover tree with halving radii grows over each chunk, once a task; and pairs of trees are traversed
that the same bound does not drop. The children of two roots, which are most nodes of vectors without structure, meet
as one matrix product of sketches (a few rotated coordinates and what is left of the length: the product is never less
than the cosine); deeper nodes meet in vectorised steps. What is left is compared by cosine in double precision.

Copies (equal vectors of a label) are one point with a weight, and tasks return counts and a spanning forest of
links, so a dense group costs rows in proportion to its size. Vectors travel as bytes; copies are known again by the
SHA-256 of theirs.

Results for unusual input: a null label, and a vector that is null, zero, or holds null or non-finite
components, links with nothing; vectors of unequal lengths never link; repeated rows are copies; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import materialise
from tidemark.llm.graph import connected_components

THRESHOLD = 0.98
#: Points of a label's block, pivots of a label or a level, points of a chunk and of a leaf, and pairs looked at together.
BLOCK, PIVOTS, CHUNK, LEAF, TOGETHER = 50_000, 64, 2000, 24, 50_000
#: Rotated coordinates of a sketch.
SKETCH = 16


def _slack(dim: int) -> float:
    """What single precision may add to or take from a distance or a product of unit vectors."""
    return 1e-5 + 2e-7 * dim


@functools.lru_cache(maxsize=16)
def _axes(dim: int) -> np.ndarray:
    """A few orthonormal directions, the same in every task."""
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(SKETCH, dim))))[0].astype(np.float32)


def _within(points: np.ndarray, reach: float) -> np.ndarray:
    """Which points are within reach of which, as a matrix."""
    square, near = (points * points).sum(1), np.empty((len(points), len(points)), bool)
    for k in range(0, len(points), 256):
        near[k : k + 256] = square[k : k + 256, None] + square - 2 * (points[k : k + 256] @ points.T) <= reach * reach
    np.fill_diagonal(near, True)
    return near


class CoverTree:
    """Nodes with a centre point and a covering radius; children have at most half their parent's radius. Nodes of a
    radius up to ``stop`` are not split."""

    def __init__(self, points: np.ndarray, stop: float = 0.0):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            noise = 16 * np.sqrt(np.finfo(points.dtype).eps) * np.sqrt((points * points).sum(1).max())
            self._grow(np.arange(len(points)), max(stop, float(noise)))
        self.centre, self.radius = np.array(self.centre, int), np.array(self.radius)
        self.n_children = np.array([len(c) for c in self.children], int)
        self.first_child = np.concatenate([[0], np.cumsum(self.n_children)])
        self.all_children = np.array([c for own in self.children for c in own], int)
        self.n_members = np.array([len(m) for m in self.members], int)
        self.first_member = np.concatenate([[0], np.cumsum(self.n_members)])
        self.all_members = np.concatenate([np.zeros(0, int), *self.members])

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of all the nodes, and for each the place of its parent among the nodes."""
        counts = self.n_children[nodes]
        parent = np.repeat(np.arange(len(nodes)), counts)
        place = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.all_children[self.first_child[nodes[parent]] + place], parent

    @functools.cached_property
    def tops(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
        """The root's children (or a root without any), first those of one place; how many of these; radii, points and sketches."""
        nodes = self.all_children[: self.n_children[0]] if self.n_children[0] else np.zeros(1, int)
        nodes = nodes[np.argsort(self.radius[nodes] > 0, kind="stable")]
        points, radius = self.points[self.centre[nodes]].astype(np.float32), self.radius[nodes].astype(np.float32)
        turned = points @ _axes(points.shape[1])
        rest = np.sqrt(np.maximum(0, 1 - (turned * turned).sum(1)) + 1e-6)
        return nodes, int((radius == 0).sum()), radius, points, np.column_stack([turned, rest])

    def _add(self, own: np.ndarray, radius: float, parent: int | None) -> int:
        self.centre.append(int(own[0]))
        self.radius.append(radius)
        self.children.append([])
        self.members.append(own)
        if parent is not None:
            self.children[parent].append(len(self.centre) - 1)
        return len(self.centre) - 1

    def _grow(self, first: np.ndarray, stop: float) -> None:
        waiting = [(first, None)]
        while waiting:
            own, parent = waiting.pop()
            away = np.sqrt(np.maximum(0, ((self.points[own] - self.points[own[0]]) ** 2).sum(1)))
            radius = float(away.max())
            node = self._add(own, radius, parent)
            if len(own) <= LEAF or radius <= stop:
                continue
            near = _within(self.points[own], radius / 2)
            alone = near.sum(1) == 1
            for k in np.flatnonzero(alone):
                self._add(own[k : k + 1], 0.0, node)
            rest = np.flatnonzero(~alone)
            while len(rest):  # a net of the next level: each centre takes all that is left within half the radius
                taken = near[rest[0], rest]
                waiting.append((own[rest[taken]], node))
                rest = rest[~taken]


def _near_tops(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of two roots that the bound leaves, for trees of unit vectors."""
    (nodes_a, thin_a, radius_a, points_a, sketch_a), (nodes_b, thin_b, radius_b, points_b, sketch_b) = a.tops, b.tops
    slack = _slack(points_a.shape[1])
    least = np.float32(1 - (reach + slack) ** 2 / 2 - slack)
    found = np.flatnonzero(sketch_a[:thin_a] @ sketch_b[:thin_b].T >= least)
    if 16 * len(found) > thin_a * thin_b:
        found = np.flatnonzero(points_a[:thin_a] @ points_b[:thin_b].T >= least)
    i, j = [found // max(1, thin_b)], [found % max(1, thin_b)]
    for rows, columns in ((slice(thin_a, None), slice(0, None)), (slice(0, thin_a), slice(thin_b, None))):
        wide = radius_a[rows, None] + radius_b[columns] + np.float32(reach + slack)
        p, q = np.nonzero(points_a[rows] @ points_b[columns].T >= 1 - wide * wide / 2 - np.float32(slack))
        i.append(p + rows.start)
        j.append(q + columns.start)
    return nodes_a[np.concatenate(i)], nodes_b[np.concatenate(j)]


def _products(a: CoverTree, x: np.ndarray, b: CoverTree, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of points of node pairs, a bounded number at a time."""
    many = a.n_members[x] * b.n_members[y]
    for k in np.flatnonzero(many > TOGETHER):
        own, other = a.members[x[k]], b.members[y[k]]
        step = max(1, TOGETHER // len(other))
        for part in (own[s : s + step] for s in range(0, len(own), step)):
            yield np.repeat(part, len(other)), np.tile(other, len(part))
    x, y, many = (v[many <= TOGETHER] for v in (x, y, many))
    if not len(x):
        return
    for own in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(many) // TOGETHER)) + 1):
        pair = np.repeat(own, many[own])
        place = np.arange(len(pair)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        width = b.n_members[y[pair]]
        yield a.all_members[a.first_member[x[pair]] + place // width], b.all_members[b.first_member[y[pair]] + place % width]


def dual_pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of a's points, of b's points), as two arrays of one length, that hold every pair within ``reach``; for
    trees of unit vectors."""
    waiting = [_near_tops(a, b, reach)] if len(a.points) and len(b.points) else []
    while waiting:
        i, j = waiting.pop()
        if len(i) > TOGETHER:
            waiting += [(i[k : k + TOGETHER], j[k : k + TOGETHER]) for k in range(0, len(i), TOGETHER)]
            continue
        apart = np.sqrt(np.maximum(0, ((a.points[a.centre[i]] - b.points[b.centre[j]]) ** 2).sum(1)))
        near = apart <= a.radius[i] + b.radius[j] + reach + _slack(a.points.shape[1])
        i, j = i[near], j[near]
        open_a, open_b = a.n_children[i] > 0, b.n_children[j] > 0
        split_a = open_a & ((a.radius[i] >= b.radius[j]) | ~open_b)
        split_b = open_b & ~split_a
        yield from _products(a, i[~split_a & ~split_b], b, j[~split_a & ~split_b])
        if split_a.any():
            child, parent = a.below(i[split_a])
            waiting.append((child, j[split_a][parent]))
        if split_b.any():
            child, parent = b.below(j[split_b])
            waiting.append((i[split_b][parent], child))


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision and scaled by powers of two, which changes no cosine, so that no square over- or underflows."""
    x = x.astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _chunks(unit: np.ndarray) -> list[np.ndarray]:
    """The points dealt to nearest pivots, level by level, until no part holds more than ``CHUNK``."""
    waiting, out = [np.arange(len(unit))], []
    while waiting:
        own = waiting.pop()
        if len(own) <= CHUNK:
            out.append(own)
            continue
        pivots = unit[own[np.linspace(0, len(own) - 1, min(PIVOTS, 1 + 3 * len(own) // (2 * CHUNK))).astype(int)]]
        nearest = np.argmax(unit[own] @ pivots.T, axis=1)
        parts = [own[nearest == p] for p in np.unique(nearest)]
        waiting += parts if len(parts) > 1 else np.array_split(own, 2)
    return out


def _links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs of two blocks; within one block each pair comes once."""
    reach = math.sqrt(max(0, 2 - 2 * threshold))

    def trees(rows):
        unit, norm = np.empty(rows.shape, np.float32), np.empty(len(rows))
        for k in range(0, len(rows), CHUNK):
            part = _scaled(rows[k : k + CHUNK])
            norm[k : k + CHUNK] = np.sqrt((part * part).sum(1))
            unit[k : k + CHUNK] = part / norm[k : k + CHUNK, None]
        return [(own, CoverTree(unit[own], reach / 2)) for own in _chunks(unit)], norm

    trees_x, norm_x = trees(x)
    trees_y, norm_y = (trees_x, norm_x) if same else trees(y)
    centre_y, radius_y = np.stack([t.points[0] for _, t in trees_y]), np.array([t.radius[0] for _, t in trees_y])
    for p, (own, tree) in enumerate(trees_x):
        apart = np.sqrt(((centre_y - tree.points[0]) ** 2).sum(1))
        near = np.flatnonzero(apart <= tree.radius[0] + radius_y + reach + _slack(x.shape[1]))
        for q in near[near >= p] if same else near:
            for i, j in dual_pairs(tree, trees_y[q][1], reach):
                i, j = own[i], trees_y[q][0][j]
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                close = np.einsum("ij,ij->i", _scaled(x[i]), _scaled(y[j])) / (norm_x[i] * norm_y[j]) >= threshold if len(i) else np.zeros(0, bool)
                if close.any():
                    yield i[close], j[close]


class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _task(pair: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """For the two sides of a block pair: links found of each point (weighted), and links that span the groups."""
    side = [pair[pair["side"] == s] for s in (0, 1)]
    same = not len(side[1])
    x, y = side[0], side[0] if same else side[1]
    points = [np.frombuffer(b"".join(p["vector"]), kind).reshape(len(p), -1) for p in ((x,) if same else (x, y))]
    rep, weight = [p["rep"].to_numpy() for p in (x, y)], [p["copies"].to_numpy() for p in (x, y)]
    count = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)]
    forest, tree = _Forest(len(x) + (0 if same else len(y))), []
    for i, j in _links(points[0], points[-1], threshold, same):
        np.add.at(count[0], i, weight[1][j])
        np.add.at(count[0 if same else 1], j, weight[0][i])
        tree += [(int(rep[0][a]), int(rep[1][b]), 0) for a, b in zip(i.tolist(), j.tolist(), strict=True) if forest.join(a, b if same else b + len(x))]
    found = [(int(r), None, int(n)) for p in range(1 if same else 2) for r, n in zip(rep[p], count[p], strict=True) if n]
    return pd.DataFrame(found + tree, columns=["src", "dst", "n"]).astype({"src": "Int64", "dst": "Int64", "n": "Int64"})


def _packed(kind: str, vectors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (vec_id, label, embedding) with their number of components and the digest of their bytes; and these bytes.
    Rows that link with nothing have no bytes, and as a digest something shorter that none equals."""

    def run(batches):
        for batch in batches:
            vec_id, label, embedding = (batch.column(c) for c in ("vec_id", "label", "embedding"))
            values = embedding.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # nulls as NaN, -0.0 as 0.0
            sizes = embedding.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            before = lambda flag: np.concatenate([[0], np.cumsum(flag)])
            bad, full = before(~np.isfinite(values)), before(values != 0)
            usable = (bad[ends] == bad[ends - sizes]) & (full[ends] > full[ends - sizes])
            usable &= vec_id.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
            raw, width = memoryview(values.tobytes()), values.itemsize
            data = [bytes(raw[s * width : e * width]) if ok else None for s, e, ok in zip((ends - sizes).tolist(), ends.tolist(), usable.tolist(), strict=True)]
            digest = [hashlib.sha256(v).digest() if v is not None else str(i).encode() for v, i in zip(data, vec_id.to_pylist(), strict=True)]
            columns = [vec_id, label, pa.array(sizes, pa.int32()), pa.array(digest, pa.binary())] + ([pa.array(data, pa.binary())] if vectors else [])
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "digest"] + (["vector"] if vectors else []))

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept (its own component)."""
    single = embeddings.schema["embedding"].dataType == ArrayType(FloatType(), embeddings.schema["embedding"].dataType.containsNull)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    keyed = StructType([StructField("vec_id", LongType()), StructField("label", rows.schema["label"].dataType), StructField("dim", IntegerType()), StructField("digest", BinaryType())])
    packed = rows.mapInArrow(_packed(kind, True), StructType([*keyed, StructField("vector", BinaryType())]))
    same = packed.where("vector IS NOT NULL").groupBy("label", "dim", "digest", "vector")
    classes = materialise(same.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "points")
    found = _sides(classes, block, kind, math.sqrt(max(0, 2 - 2 * threshold))).groupBy("label", "dim", "pair")
    found = materialise(found.applyInPandas(lambda pair: _task(pair, threshold, kind), "src long, dst long, n long"), "found")
    counts = found.where("dst IS NULL").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("dst IS NOT NULL").select("src", "dst")).select(F.col("node").alias("rep"), "component")
    judged = classes.select("label", "digest", "rep", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    judged = judged.select("label", "digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.mapInArrow(_packed(kind, False), keyed).join(judged, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _sides(classes: DataFrame, block: int, kind: str, reach: float) -> DataFrame:
    """The points of each pair of blocks, by side; one block with itself has side 0 alone.

    Only labels of more than ``block`` points have several blocks. Of these labels, at most one for so many points, the
    driver gets the pivots, and how many points each pivot got and how far away."""
    spark, point = classes.sparkSession, ["rep", "copies", "vector"]
    each = F.greatest(F.lit(block), F.least(F.lit(2 * block), F.ceil(F.col("n") / 6)))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("each", each.cast("long"))
    sizes = sizes.withColumn("wanted", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / F.col("each")))).withColumn("kind", F.monotonically_increasing_id())
    large = materialise(sizes, "labels", small=True)
    kinds = {r["kind"]: r for r in large.select("kind", "each", "wanted").collect()}
    if not kinds:
        return classes.select("label", "dim", F.lit(0).alias("pair"), F.lit(0).alias("side"), *point)
    placed = classes.join(F.broadcast(large), ["label", "dim"], "left")  # at most a row for `block` points
    small = placed.where("kind IS NULL").select("label", "dim", F.lit(0).alias("pair"), F.lit(0).alias("side"), *point)
    placed = placed.where("kind IS NOT NULL").select("label", "dim", "kind", *point)
    # about four times as many as wanted are drawn by hash, so that there are enough
    chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.col("wanted") * 4 / F.col("n") * (1 << 30)
    drawn: dict[int, list] = {k: [] for k in kinds}
    for r in placed.join(F.broadcast(large.select("kind", "n", "wanted")), "kind").where(chance).select("kind", F.xxhash64("rep").alias("at"), "vector").collect():
        drawn[r["kind"]].append((r["at"], bytes(r["vector"])))
    pivots = {k: _unit([v for _, v in sorted(own)[: kinds[k]["wanted"]]], kind) for k, own in drawn.items() if own}
    width = StructType([*placed.schema, StructField("block", IntegerType()), StructField("away", DoubleType())])
    cells = placed.mapInArrow(_dealt(pivots, {}, kind), width).groupBy("kind", "block").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()
    own: dict[int, list] = {k: [] for k in kinds}
    for r in sorted(cells, key=lambda r: (r["kind"], r["block"])):
        own[r["kind"]].append((r["block"], max(1, math.ceil(r["n"] / (1.5 * kinds[r["kind"]]["each"]))), r["away"]))
    pairs, n_pairs = [], 0
    for k, found in own.items():
        parts = [(cell + PIVOTS * part, cell, away) for cell, splits, away in found for part in range(splits)]
        for a, (one, cell, away) in enumerate(parts):
            for other, cell_, away_ in parts[a:]:
                if k in pivots and np.sqrt(((pivots[k][cell] - pivots[k][cell_]) ** 2).sum()) > away + away_ + reach + _slack(pivots[k].shape[1]):
                    continue
                n_pairs += 1
                pairs += [(k, one, n_pairs, 0)] + ([(k, other, n_pairs, 1)] if other != one else [])
    splits = {(k, cell): n for k, found in own.items() for cell, n, _ in found}
    dealt = placed.mapInArrow(_dealt(pivots, splits, kind), width)
    meet = spark.createDataFrame(pairs, "kind long, block int, pair int, side int")
    sides = dealt.join(F.broadcast(meet), ["kind", "block"]).select("label", "dim", "pair", "side", *point)  # blocks of labels that have several
    tasks = max(4 * spark.sparkContext.defaultParallelism, min(2000, 4 * n_pairs))
    return sides.unionByName(small).repartition(tasks, "label", "dim", "pair")


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = _scaled(np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1))
    return x / np.sqrt((x * x).sum(1))[:, None]


def _dealt(pivots: dict[int, np.ndarray], splits: dict[tuple[int, int], int], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the nearest pivot of their label and its distance; the points of a pivot that has too many are split
    by their ids. Every distance is summed alone, so it does not depend on the rows beside it."""

    def run(batches):
        for batch in batches:
            label, rep, vector = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "rep", "vector"))
            block, far = np.zeros(len(label), np.int64), np.zeros(len(label))
            for k in np.unique(label):
                own = np.flatnonzero(label == k)
                if k in pivots:
                    unit = _unit(list(vector[own]), kind)
                    away = np.stack([np.sqrt(((unit - p) ** 2).sum(1)) for p in pivots[k]])
                    block[own], far[own] = away.argmin(0), away.min(0)
                for cell in np.unique(block[own]) if splits else ():
                    inside = own[block[own] == cell]
                    mixed = (rep[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                    block[inside] += PIVOTS * (mixed % np.uint64(splits[int(k), int(cell)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(far)], names=[*batch.schema.names, "block", "away"])

    return run
