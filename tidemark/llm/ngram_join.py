"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are distinct shingle sets (copies are one row), columns are shingles. The product is taken in two steps, and a
pair of rows lives on only while the largest overlap it can still reach is at least the smallest that two sets of its
sizes need:

* over blocks of columns, of the rows' rarest ``n - ceil(t n) + 1`` shingles each (any order is exact; rare first makes
  the columns short, and which shingles are frequent is counted over all documents). A pair needs a shared column at
  positions i and j that leaves an overlap of ``min(n1 - i, n2 - j)``, and parity bitmaps that differ in few enough bits:
  two sets differ in at least as many shingles. In a block each row has a sketch, its bitmap folded to a fixed size;
  pairs of all blocks together are held against whole bitmaps, which have about as many bits as their sets shingles;
* over blocks of rows: overlap counts of a row with those it is paired with are accumulated over all columns.

Links are found in rounds: first each row of a column with its neighbour by size and with two hubs of the column, then,
where they are not connected yet, with further hubs, at last every pair whose ends are not connected. So a group of near copies costs links in proportion to its size, yet
no connection is missed. ``links=True`` skips that saving and returns every link between different sets.

Columns with more than ``PART`` rows that are known to be frequent are dealt to several tasks: rounds with hubs link
the hubs of the parts with one of them, the last lays tiles over the rows outside the column's largest group.

Results for unusual input: null and blank texts have an empty set and link with nothing; equal rows link
with each other; rows with one doc_id and different texts are different documents; a text of any length is one row; an
empty table gives an empty table; columns besides doc_id and text are not read; rows without a doc_id are kept, and
link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, give_back, materialise
from tidemark.llm.graph import connected_components
from tidemark.llm.shingles import N_WORDS, all_shingle_sets, mix

#: Similarity as a fraction of integers: 100 * intersection >= 75 * union.
PERCENT = 75
#: Bits of a parity bitmap, at least.
LEAST_BITS = 512
_SKETCH = LEAST_BITS // 64
#: At most so many of the most frequent shingles go last in the order; 12 bytes each are broadcast.
FREQUENT = 1 << 17
#: Shingles that a task counts together; those seen fewer than SEEN times in a full count are dropped from it, so a
#: count is too low by at most SEEN - 1 a task and CHUNK shingles. That costs order and balance, never a link.
CHUNK, SEEN = 1 << 20, 4
#: Matrix entries in a block of columns, and rows in one part of a frequent column.
BLOCK, PART = 60_000, 1_000
#: Hubs of the first and the second round, as seeds of the order that they come first in.
HUBS = ((0, 1), (2, 3, 4))
#: Pairs looked at together in a task.
TOGETHER = 1 << 16
#: Bits of the filter that spares the shuffle of texts in no pair; its size is fixed.
FILTER_BITS = 1 << 23
#: Shingles in a block of rows (a single row may have more).
ROWS = 1 << 20

_U = np.uint64
_ROW = "kind int, doc_id long, t long, n long, k1 long, k2 long, bitmap binary, sketch binary"


def _need(total, percent: int):
    """The overlap that sets with so many shingles in total need: ceil(t / (1 + t) * total)."""
    return -(-percent * total // (100 + percent))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _keys(own: np.ndarray) -> tuple[int, int]:
    """Two order-free hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        sums = np.array([np.sum(mix(own ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U), np.sum(mix(own + _U(0x1234567)), dtype=_U)])
        return tuple(mix(sums + _U(len(own))).view(np.int64).tolist())


def _row_key(k1: int, k2: int, turn: int) -> int:
    """The number of a row: its first key, or mixed with the second turned by some bits where first keys meet."""
    if not turn:
        return k1
    k2 &= (1 << 64) - 1
    turned = (k2 << turn | k2 >> (64 - turn)) & ((1 << 64) - 1)
    return k1 ^ (turned - (turned >> 63 << 64))


def _row_key_column(turn: int) -> Column:
    if not turn:
        return F.col("k1")
    return F.col("k1").bitwiseXOR(F.shiftleft("k2", turn).bitwiseOR(F.shiftrightunsigned("k2", 64 - turn)))


def _bitmap(own: np.ndarray) -> bytes:
    bits = max(LEAST_BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketch(bitmap: bytes) -> bytes | None:
    """A bitmap folded to the least size; None if it has that size."""
    if len(bitmap) * 8 == LEAST_BITS:
        return None
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, _U).reshape(-1, _SKETCH), axis=0).tobytes()


class _Bitmaps:
    """Parity bitmaps of several sizes, kept in one matrix for each size."""

    def __init__(self, column: pd.Series):
        data = column.tolist()
        size = np.array([len(b) // 8 for b in data], np.int64)
        self.size, self.place, self.rows = size, np.zeros(len(data), np.int64), {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            self.place[own] = np.arange(len(own))
            self.rows[n] = np.frombuffer(b"".join(data[i] for i in own), _U).reshape(-1, n)

    def apart(self, i: np.ndarray, other: _Bitmaps, j: np.ndarray) -> np.ndarray:
        """In how many bits pairs differ, the larger bitmap folded to the size of the smaller."""
        out = np.zeros(len(i), np.int64)
        a, b = self.size[i], other.size[j]
        for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
            own, least = np.flatnonzero((a == x) & (b == y)), min(x, y)
            for k in range(0, len(own), 10_000):
                at = own[k : k + 10_000]
                sides = (m.rows[w][m.place[p[at]]].reshape(len(at), -1, least) for m, w, p in ((self, x, i), (other, y, j)))
                left, right = (np.bitwise_xor.reduce(side, axis=1) for side in sides)
                out[at] = np.bitwise_count(left ^ right).sum(1)
        return out


def _near(apart: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose bitmaps are so far apart, with so many shingles in total, can be similar enough."""
    return apart <= total - 2 * _need(total, percent)


def describe(docs: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """Kind 0: each document's text hash, set size, keys and bitmap. Kind 1: a task's frequent shingles (k1) with counts (n)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, common = [], 0, []

        def frequent() -> None:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            common.append(pd.DataFrame({"k1": hashes.view(np.int64), "n": counts})[counts >= (SEEN if size > CHUNK // 8 else 2)])

        for batch in batches:
            out = []
            for doc_id, t, own in zip(batch["doc_id"], batch["t"], all_shingle_sets(batch["text"], n_words), strict=True):
                bitmap = _bitmap(own) if len(own) else None
                out.append((0, doc_id, t, len(own), *(_keys(own) if len(own) else (0, 0)), bitmap, _sketch(bitmap) if bitmap else None))
                held.append(own)
                size += len(own)
                if size > CHUNK:
                    frequent()
                    held, size = [], 0
            yield _frame(out)
        if held:
            frequent()
        if common:
            found = pd.concat(common).groupby("k1", as_index=False)["n"].sum()
            yield _frame([(1, None, 0, n, h, 0, None, None) for h, n in zip(found["k1"], found["n"], strict=True)])
        held, common = [], []
        give_back()

    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["kind", "doc_id", "t", "n", "k1", "k2", "bitmap", "sketch"])
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInPandas(rows, _ROW)


#: An entry: column (its upper 48 bits), row, size of the row, position in it, and parts of the column.
_ENTRY = np.dtype([("h", "u8"), ("k", "i8"), ("n", "u4"), ("at", "u4"), ("s", "u2")])


def _pack(e: np.ndarray) -> bytes:
    """Entries as planes of bytes, so that the many upper bytes that are alike compress to little."""
    return b"".join(np.ascontiguousarray(e[name]).view(np.uint8).reshape(len(e), _ENTRY[name].itemsize).T.tobytes() for name in _ENTRY.names)


def _unpack(data: bytes) -> np.ndarray:
    count, start = len(data) // _ENTRY.itemsize, 0
    out = np.empty(count, _ENTRY)
    for name in _ENTRY.names:
        width = _ENTRY[name].itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, width * count, start).reshape(width, count).T).view(_ENTRY[name]).ravel()
        start += width * count
    return out


def _cell(h: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The column, or the row's part of a column with several parts."""
    part = mix(np.ascontiguousarray(k).view(_U)) % s.astype(_U)
    return np.where(s > 1, mix(h + part + _U(1)), h)


def _incidence(docs: DataFrame, ranks, n_blocks: int, percent: int, n_words: int, turn: int) -> DataFrame:
    """(block, payload): the matrix entries of a block of columns, packed by task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = ranks.value
        parts = np.minimum(np.maximum(1, -(-counts // PART)), 65535)
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            e = np.empty(size, _ENTRY)
            for name, column in zip(_ENTRY.names, zip(*held, strict=True), strict=True):
                e[name] = np.concatenate(column)
            block = ((_cell(e["h"], e["k"], e["s"]) >> _U(32)) * _U(n_blocks) >> _U(32)).astype(np.int64)
            e["h"] >>= _U(16)
            order = np.argsort(block, kind="stable")
            e, block = e[order], block[order]
            cut = np.flatnonzero(np.diff(block)) + 1
            return pd.DataFrame([(int(block[a]), _pack(e[a:b])) for a, b in zip([0, *cut], [*cut, len(e)], strict=True)], columns=["block", "payload"])

        for batch in batches:
            for own in all_shingle_sets(batch["text"], n_words):
                if not len(own):
                    continue
                key = _row_key(*_keys(own), turn)
                if key in seen:
                    continue
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen.add(key)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    known = hashes[place] == own
                    rank, split = np.where(known, counts[place], 0), np.where(known, parts[place], 1)
                else:
                    rank, split = np.zeros(len(own), np.int64), np.ones(len(own), np.int64)
                order = np.argsort(rank, kind="stable")[: _prefix(len(own), percent)]
                m = len(order)
                held.append((own[order], np.full(m, key), np.full(m, len(own)), np.arange(m), split[order]))
                size += m
                if size > 400_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        held = []
        give_back()

    return docs.select("text").mapInPandas(rows, "block int, payload binary")


def _shared(block: pd.DataFrame) -> pd.DataFrame:
    """The columns of a block that more than one row has, and parts of columns, in the order of column, size and row."""
    e = np.concatenate([_unpack(x) for x in block["payload"]])
    cell = _cell(e["h"], e["k"], e["s"])
    order = np.lexsort((e["k"], e["n"], cell))
    e, cell = e[order], cell[order]
    first = np.concatenate([[True], (cell[1:] != cell[:-1]) | (e["k"][1:] != e["k"][:-1])])
    e, cell = e[first], cell[first]
    same = cell[1:] == cell[:-1]
    e = e[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (e["s"] > 1)]
    return pd.DataFrame({"block": [int(block["block"].iloc[0])], "payload": [_pack(e)]})


_PAIR = "ka long, kb long"


class _Found:
    """Gathers the pairs of a task, each once as far as bounded memory allows."""

    def __init__(self, percent: int):
        self.percent, self.held, self.size = percent, [], 0

    def add(self, e: np.ndarray, i: np.ndarray, j: np.ndarray, sketch: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """Keep the pairs of entries that can be similar enough; now and then yields what there is."""
        for at in range(0, len(i), TOGETHER):
            a, b = i[at : at + TOGETHER], j[at : at + TOGETHER]
            n, m = e["n"][a].astype(np.int64), e["n"][b].astype(np.int64)
            need = _need(n + m, self.percent)
            ok = np.flatnonzero((np.minimum(n - e["at"][a], m - e["at"][b]) >= need) & (e["k"][a] != e["k"][b]))
            a, b, least = a[ok], b[ok], (n + m - 2 * need)[ok]
            if sketch is not None:
                near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= least
                a, b = a[near], b[near]
            self.held.append((np.minimum(e["k"][a], e["k"][b]), np.maximum(e["k"][a], e["k"][b])))
            self.size += len(a)
            if self.size >= TOGETHER:
                frame = self.frame()
                if len(frame) > TOGETHER // 2:
                    yield frame
                    self.held, self.size = [], 0
                else:
                    self.held, self.size = [(frame["ka"].to_numpy(), frame["kb"].to_numpy())], len(frame)

    def frame(self) -> pd.DataFrame:
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[side] for x in self.held)]) for side in (0, 1))
        return pd.DataFrame({"ka": a, "kb": b}).drop_duplicates()


def _hubs(e: np.ndarray, cell: np.ndarray, seed: int) -> np.ndarray:
    """For each entry, sorted by column, the place of its column's hub: the row that comes first in an order by hash."""
    with np.errstate(over="ignore"):
        order = np.lexsort((mix(np.ascontiguousarray(e["k"]).view(_U) + _U(seed) * _U(0x9E3779B97F4A7C15)), cell))
    sorted_cell = cell[order]
    first = np.concatenate([[True], sorted_cell[1:] != sorted_cell[:-1]])
    hub = order[np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))]
    out = np.empty(len(e), np.int64)
    out[order] = hub
    return out


def _with_hubs(e: np.ndarray, g: np.ndarray | None, seeds: tuple[int, ...], found: _Found) -> Iterator[pd.DataFrame]:
    """Pair each row of a column with its neighbour by size and with the column's hubs, if their groups differ."""
    if not len(e):
        return
    cell, every = _cell(e["h"], e["k"], e["s"]), np.arange(len(e))
    beside = np.flatnonzero(cell[:-1] == cell[1:])
    for i, j in [(beside, beside + 1), *((every, _hubs(e, cell, seed)) for seed in seeds)]:
        if g is not None:
            apart = g[i] != g[j]
            i, j = i[apart], j[apart]
        yield from found.add(e, i, j)


def _first_pairs(columns: DataFrame, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """Pairs of the first round."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                found = _Found(percent)
                yield from _with_hubs(_unpack(payload), None, seeds, found)
                yield found.frame()
        give_back()

    return columns.mapInPandas(rows, _PAIR).union(_hubs_of_parts(columns, seeds, percent))


def _hubs_of_parts(columns: DataFrame, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """Pairs of the hubs of a column's parts with one of them."""

    def hubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                e = _unpack(payload)
                e = e[e["s"] > 1]
                if len(e):
                    cell = _cell(e["h"], e["k"], e["s"])
                    yield _flat(e[np.unique(np.concatenate([_hubs(e, cell, seed) for seed in seeds]))])

    def join_parts(column: pd.DataFrame) -> pd.DataFrame:
        e, found = _entries(column), _Found(percent)
        done = [x for seed in seeds for x in found.add(e, np.arange(len(e)), _hubs(e, e["h"], seed))]  # a row for each part and seed
        return pd.concat([*done, found.frame()])

    return columns.mapInPandas(hubs, _FLAT).groupBy("h").applyInPandas(join_parts, _PAIR)


_FLAT = "h long, k long, n long, at long, s int"


def _flat(e: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({name: np.ascontiguousarray(e[name]).astype(np.int64) for name in _ENTRY.names}).astype({"s": "int32"})


def _entries(flat: pd.DataFrame) -> np.ndarray:
    e = np.empty(len(flat), _ENTRY)
    for name in _ENTRY.names:
        e[name] = flat[name].to_numpy()
    return e


def _members(columns: DataFrame, of_all: bool) -> DataFrame:
    """(block, k): the rows of each block; those of columns with several parts only if ``of_all``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, payload in zip(batch["block"], batch["payload"], strict=True):
                e = _unpack(payload)
                yield pd.DataFrame({"block": block, "k": np.unique(e["k"] if of_all else e["k"][e["s"] == 1])})

    return columns.mapInPandas(rows, "block int, k long")


def _in_blocks(columns: DataFrame, own: DataFrame, rows, schema: str) -> DataFrame:
    """Apply ``rows`` to the entries of each block with what is known of its rows (k, g, sketch)."""
    blocks = columns.select("block", "payload", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("g"), F.lit(None).cast("binary").alias("sketch"))

    def gathered(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, known = [], []
        for batch in batches:
            is_data = batch["payload"].notna()
            data += batch["payload"][is_data].tolist()
            known.append(batch.loc[~is_data, ["k", "g", "sketch"]])
        yield from rows(key[0], np.concatenate([_unpack(x) for x in data]), pd.concat(known))
        give_back()

    return blocks.unionByName(own.withColumn("payload", F.lit(None).cast("binary"))).groupBy("block").applyInPandas(gathered, schema)


def _runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by column: where columns start, their lengths, and whether their rows are of several groups."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(h)]])), np.minimum.reduceat(g, starts) < np.maximum.reduceat(g, starts)


def _further_pairs(columns: DataFrame, groups: DataFrame, percent: int, seeds: tuple[int, ...]) -> DataFrame:
    """Pairs (ka, kb) of rows with neighbours and hubs in other groups; and, with a payload, what is left of each block
    when columns whose rows are all in one group are gone."""

    def rows(block: int, e: np.ndarray, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, found = _group_of(e["k"], known["k"].to_numpy(), known["g"].to_numpy()), _Found(percent)
        for frame in (*_with_hubs(e, g, seeds, found), found.frame()):
            yield frame.assign(block=block, payload=None)
        if len(e):
            _, sizes, mixed = _runs(e["h"], g)
            yield pd.DataFrame({"ka": [0], "kb": [0], "block": [block], "payload": [_pack(e[np.repeat(mixed, sizes) | (e["s"] > 1)])]})

    own = _members(columns, True).join(groups, "k").withColumn("sketch", F.lit(None).cast("binary"))
    pairs = _in_blocks(columns, own, rows, f"{_PAIR}, block int, payload binary")
    return pairs.union(_hubs_of_parts(columns, seeds, percent).selectExpr("ka", "kb", "-1", "CAST(NULL AS binary)"))


def _between_groups(columns: DataFrame, groups: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of rows of a column that are in different groups (k, g); without groups, all pairs of rows."""

    def rows(block: int, e: np.ndarray, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        e, found = e[e["s"] == 1], _Found(percent)
        if not len(e):
            return
        known = known.sort_values("k")
        place = np.searchsorted(known["k"].to_numpy(), e["k"])
        g, sketch = known["g"].to_numpy()[place], _sketches(known["sketch"])[place]
        starts, sizes, mixed = _runs(e["h"], g)
        for m in np.unique(sizes[mixed]).tolist():  # all columns of one length together
            first = starts[mixed & (sizes == m)]
            for i, j in _pairs_within(m):
                step = max(1, TOGETHER // max(1, len(i)))
                for at in range(0, len(first), step):
                    a, b = (np.add.outer(first[at : at + step], x).ravel() for x in (i, j))
                    apart = g[a] != g[b]
                    yield from found.add(e, a[apart], b[apart], sketch)
        yield found.frame()

    own = _grouped(_members(columns, False), groups).join(sets.select("k", "sketch"), "k")
    return _in_blocks(columns, own, rows, _PAIR).union(_tiles(columns, groups, sets, percent))


def _grouped(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows (k, ...) with their group g; a row in none is its own."""
    if groups is None:
        return rows.withColumn("g", F.col("k"))
    return rows.join(groups, "k", "left").withColumn("g", F.coalesce("g", "k"))


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), _U).reshape(-1, _SKETCH)


def _group_of(k: np.ndarray, known: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The group of each row; a row in none is its own."""
    if not len(known):
        return k.copy()
    order = np.argsort(known)
    known, group = known[order], group[order]
    place = np.minimum(np.searchsorted(known, k), len(known) - 1)
    return np.where(known[place] == k, group[place], k)


def _pairs_within(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m places, in bounded pieces."""
    step = max(1, TOGETHER // (2 * m))
    for start in range(0, m - 1, step):
        own = np.arange(start, min(start + step, m - 1))
        counts = m - 1 - own
        i = np.repeat(own, counts)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1


def _tiles(columns: DataFrame, groups: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between groups of columns with several parts. The rows of the column's largest group meet the others in
    tiles of bounded size, and so do the others among themselves; a column of one group has no tile."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                e = _unpack(payload)
                yield _flat(e[e["s"] > 1])

    flat = _grouped(columns.mapInPandas(entries, _FLAT), groups)
    most = flat.groupBy("h", "g").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("g", F.struct("m", "g")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("total")).where("total > m")
    parts = lambda n: F.expr(f"cast(({n} + {PART - 1}) div {PART} AS int)")
    dealt = flat.join(most.select("h", "main", parts("m").alias("s_main"), parts("total - m").alias("s_rest")), "h").join(sets.select("k", "sketch"), "k")
    of = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    is_main, each = F.col("g") == F.col("main"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_rest = F.transform(each("s_rest"), lambda j: tile(0, of("s_main"), j))
    with_main = F.transform(each("s_main"), lambda i: tile(0, i, of("s_rest")))
    among_rest = F.transform(each("s_rest"), lambda j: tile(1, F.least(j, of("s_rest")), F.greatest(j, of("s_rest"))))
    laid = dealt.withColumn("in_main", is_main).withColumn("part", of("s_rest")).withColumn("tile", F.explode(F.when(is_main, with_rest).otherwise(F.concat(with_main, among_rest))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches))  # PART rows of either kind, about
        e, g, part, main, sketch = _entries(own), own["g"].to_numpy(), own["part"].to_numpy(), own["in_main"].to_numpy(), _sketches(own["sketch"])
        found = _Found(percent)
        if own["kind"].iloc[0] == 0:
            rest = np.flatnonzero(~main)
            for a in np.flatnonzero(main):
                yield from found.add(e, np.full(len(rest), a), rest, sketch)
        else:
            across = own["i"].iloc[0] != own["j"].iloc[0]
            for i, j in _pairs_within(len(e)):
                apart = (g[i] != g[j]) & ((part[i] != part[j]) if across else True)
                yield from found.add(e, i[apart], j[apart], sketch)
        yield found.frame()

    return laid.select("h", "k", "n", "at", "s", "g", "in_main", "part", "sketch", "tile.*").groupBy("h", "kind", "i", "j").applyInPandas(rows, _PAIR)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, each once, whose whole bitmaps differ in few enough bits, with sizes and documents."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = np.arange(len(batch))
            apart = _Bitmaps(batch["bitmap_a"]).apart(each, _Bitmaps(batch["bitmap_b"]), each)
            yield batch.loc[_near(apart, (batch["na"] + batch["nb"]).to_numpy(), percent), columns]
        give_back()

    # not a filter by a UDF: that keeps each partition's rows in a memory page until the task ends, and a task makes many partitions
    columns = ["ka", "kb", "na", "nb", "rep_a", "rep_b"]
    side = lambda x: sets.select(F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "bitmap")))
    return pairs.distinct().join(side("a"), "ka").join(side("b"), "kb").select(*columns, "bitmap_a", "bitmap_b").mapInPandas(near, ", ".join(f"{c} long" for c in columns))


def _overlaps(docs: DataFrame, pairs: DataFrame, percent: int, n_words: int, turn: int) -> DataFrame:
    """Links (src, dst, overlap, n_src, n_dst, src_doc, dst_doc): a block has a row and rows it is paired with, whose
    overlaps with it are accumulated over all columns."""
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    ends = pairs.select(F.col("rep_a").alias("doc")).union(pairs.select("rep_b"))
    bits = ends.withColumn("at", slot).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for word, value in bits:
        words[word] = value
    wanted = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may_be_wanted(at: pd.Series) -> pd.Series:
        i = at.to_numpy()
        return pd.Series((wanted.value[i >> 6] >> (i & 63)) & 1 == 1)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null").withColumn("at", slot).where(may_be_wanted("at")).drop("at")
    hubs = pairs.groupBy(F.col("ka").alias("hub")).agg(F.any_value("rep_a").alias("doc"), F.expr(f"cast(1 + sum(nb) div {ROWS} AS int)").alias("parts"))
    members = pairs.select(F.col("ka").alias("hub"), F.col("kb").alias("k"), F.col("rep_b").alias("doc")).join(hubs.drop("doc"), "hub")
    members = members.select("hub", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), "k", "doc")
    members = members.union(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "hub", "doc"))

    def accumulate(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        hub, found, done = None, [], set()
        for k, doc, own in zip(block["k"], block["doc"], all_shingle_sets(block["text"], n_words), strict=True):
            if not len(own) or k in done or _row_key(*_keys(own), turn) != k:  # another text of the same id, or a repeated row
                continue
            done.add(k)
            if k == key[0]:
                hub = doc, own
            else:
                found.append((k, doc, own))
        if not hub or not found:
            return pd.DataFrame([], columns=list(_LINK_COLUMNS), dtype="int64")
        sizes = np.array([len(own) for _, _, own in found])
        column = np.concatenate([own for _, _, own in found])
        hit = hub[1][np.minimum(np.searchsorted(hub[1], column), len(hub[1]) - 1)] == column
        overlap = np.bincount(np.repeat(np.arange(len(found)), sizes)[hit], minlength=len(found))
        ok = np.flatnonzero(100 * overlap >= percent * (sizes + len(hub[1]) - overlap))
        out = [(key[0], found[i][0], overlap[i], len(hub[1]), sizes[i], hub[0], found[i][1]) for i in ok]
        return pd.DataFrame(out, columns=list(_LINK_COLUMNS), dtype="int64")

    return members.join(texts, "doc").groupBy("hub", "part").applyInPandas(accumulate, ", ".join(f"{c} long" for c in _LINK_COLUMNS))


_LINK_COLUMNS = ("src", "dst", "overlap", "n_src", "n_dst", "src_doc", "dst_doc")


class Join:
    """The join of a table with itself: ``documents``, and either all ``links`` between different sets or ``components``."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, n_words: int = N_WORDS, links: bool = False):
        spark = docs.sparkSession
        self.links = self.groups = None
        described = materialise(describe(docs, n_words), "sets")
        self.rows = described.where("kind = 0").drop("kind", "bitmap", "sketch")
        kinds = described.where("kind = 0 and n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("bitmap").alias("bitmap"), F.any_value("sketch").alias("sketch"))
        self.sets = materialise(kinds, "classes", small=True)
        turn = next(t for t in range(64) if self.sets.groupBy(_row_key_column(t)).count().where("count > 1").isEmpty())
        self.sets = self.sets.withColumns({"k": _row_key_column(turn), "sketch": F.coalesce("sketch", "bitmap")})
        top = described.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "k1").limit(FREQUENT).toPandas()  # FREQUENT rows at most
        order = np.argsort(top["k1"].to_numpy().view(_U))
        ranks = spark.sparkContext.broadcast((top["k1"].to_numpy().view(_U)[order], top["n"].to_numpy(np.int64)[order]))
        entries = self.sets.agg(F.sum("n")).first()[0] or 0
        n_blocks = max(8, -(-entries * (100 - percent) // 100 // BLOCK))
        columns = materialise(_incidence(docs, ranks, n_blocks, percent, n_words, turn).groupBy("block").applyInPandas(_shared, "block int, payload binary"), "columns")

        def verified(pairs: DataFrame) -> DataFrame:
            possible = materialise(_possible(pairs, self.sets, percent), "pairs", small=True)
            found = materialise(_overlaps(docs, possible, percent, n_words, turn), "links", small=True)
            forget(possible)
            return found

        if links:
            self.links = verified(_between_groups(columns, None, self.sets, percent))
        else:
            self._join_groups(verified(_first_pairs(columns, HUBS[0], percent)))
            for seeds in HUBS[1:]:
                further, before = materialise(_further_pairs(columns, self.groups, percent, seeds), "columns"), columns
                self._join_groups(verified(further.where("payload IS NULL").select("ka", "kb")))
                columns = further.where("payload IS NOT NULL").select("block", "payload")
                forget(before)
            self._join_groups(verified(_between_groups(columns, self.groups, self.sets, percent)))
        forget(columns)

    def _join_groups(self, found: DataFrame) -> None:
        """Join the groups (k, g: the smallest row of the group) that links were found between."""
        links, before = found.select("src", "dst"), self.groups
        if before is not None:
            links = links.union(before.where("k != g").select("k", "g"))
        self.groups = connected_components(links).select(F.col("node").alias("k"), F.col("component").alias("g"))
        forget(found)
        if before is not None:
            forget(before)

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, t, stays) for every row: t is the hash of its text; stays, whether this is
        the document with the component's smallest id (of rows that repeat one, each has stays; of different texts with
        that id in one component, one has)."""
        linked = self.sets.drop("bitmap", "sketch").join(self.groups, "k", "left").withColumn("component", F.coalesce("g", "k"))
        least = linked.groupBy("component").agg(F.min(F.struct("rep", "k")).alias("least"))
        sets = linked.join(least, "component").select("n", "k1", "k2", F.col("least.rep").alias("component_id"), (F.col("least.k") == F.col("k")).alias("chosen"))
        own = self.rows.where("n > 0 and doc_id is not null").join(sets, ["n", "k1", "k2"])
        alone = self.rows.where("n = 0 or doc_id is null").withColumns({"component_id": F.col("doc_id"), "chosen": F.lit(True)})
        stays = (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
        pick = lambda df: df.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "t", stays)
        return pick(own).union(pick(alone))

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, rep) for every row; rep, the smallest doc_id with an equal set, is null for an empty set."""
        return self.rows.join(self.sets.drop("bitmap", "sketch"), ["n", "k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "rep")

    def forget(self) -> None:
        """Delete the join's tables, once its results have been written elsewhere."""
        for table in (self.rows, self.sets, self.links, self.groups):
            if table is not None:
                forget(table)


def near_duplicate_classes(docs: DataFrame, percent: int = PERCENT, n_words: int = N_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    return Join(docs, percent, n_words).components().drop("t", "stays")


def jaccard_links(docs: DataFrame, percent: int = PERCENT, n_words: int = N_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets (src, dst, overlap, n_src, n_dst; ends are the sets' smallest doc_ids), and the
    membership of documents in sets."""
    joined = Join(docs, percent, n_words, links=True)
    return joined.links.select(F.col("src_doc").alias("src"), F.col("dst_doc").alias("dst"), "overlap", "n_src", "n_dst"), joined.documents()
