"""Best-fit packing with swap-based local search.

Documents are tokenised, cut into pieces of at most ``capacity`` tokens, and packed by the histogram of piece
lengths: bins that hold the same lengths are one pattern with a multiplicity, so both best fit (decreasing) and
the local search work on at most a few thousand patterns, whatever the number of documents. The search exchanges
one for one or two for one length between underfull bins, or moves one, where that raises the sum of squared
fills, until bins empty. Pieces then take the slots of their length in turn.

Results for unusual input: a null or empty text is the end token alone; repeated rows are packed each; a null
doc_id is kept; a text of any length is cut, never shortened; an empty table gives an empty table; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

CAPACITY, END_ID = 1024, 2
#: How a byte-level tokenizer of this kind splits a text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length ranked together.
BLOCK = 50_000


class Encoder:
    """Token ids as the tokenizer file gives them. A plain byte-level BPE file is run by a faster library whose
    merges are ranked by the same ids; any other file, and texts that hold a special token, by the file's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        made = [vocab.get("".join(m)) for m in merges]
        if not plain or None in made or made != sorted(made):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; only the first of several is shorter than the rest."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins as patterns: sorted tuples of lengths with the number of bins that hold them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def room(self, pattern: tuple[int, ...]) -> int:
        return self.capacity - sum(pattern)

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        """``count`` may be negative, to take bins away; a pattern without lengths is no bin."""
        if pattern:
            pattern = tuple(sorted(pattern, reverse=True))
            have = self.by_room[self.room(pattern)]
            have[pattern] = have.get(pattern, 0) + count
            if not have[pattern]:
                del have[pattern]

    def patterns(self) -> list[tuple[tuple[int, ...], int]]:
        return [(p, n) for room in sorted(self.by_room) for p, n in sorted(self.by_room[room].items())]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Best fit decreasing: each length goes where it leaves the least room, into many like bins at once."""
    bins = Bins(capacity)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity) if bins.by_room.get(r)), None)
            pattern, have = next(iter(bins.by_room[room].items())) if room else ((), left)
            each = (room or capacity) // length  # the same bin stays the best until it can take no more
            if left < each:
                each = left
            count = min(have, left // each)
            if pattern:
                bins.add(pattern, -count)
            bins.add(pattern + (length,) * each, count)
            left -= count * each
    return bins


def _takes(lengths: tuple[int, ...], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """What a bin can give: one of its lengths, or (``most`` 2) two of them, by size. Lengths that are alike count once,
    so there are few, however many pieces a bin has."""
    kinds = Counter(lengths)
    out = [(x, (x,)) for x in kinds]
    if most == 2:
        out += [(x + y, (x, y)) for x, y in combinations(sorted(kinds), 2)] + [(2 * x, (x, x)) for x, n in kinds.items() if n > 1]
    return sorted(dict(out).items())


def _exchange(a: tuple[int, ...], b: tuple[int, ...], capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange between two bins that raises the sum of their squared fills most, or None: the fuller bin takes one
    or two lengths for none or one of its own, or one for two."""
    if sum(a) < sum(b):
        a, b = b, a
    room, best, chosen = capacity - sum(a), 0, None
    one, two = _takes(b, 1), _takes(b, 2)
    for gives, takes in (([(0, ())], one), (_takes(a, 1), two), (_takes(a, 2), one)):
        sizes = [size for size, _ in takes]
        for give, own in gives:
            at = bisect_right(sizes, give + room) - 1  # the largest that fits
            if at >= 0 and sizes[at] - give > best:
                best, chosen = sizes[at] - give, (own, takes[at][1])
    if chosen is None:
        return None
    left_a, left_b = list(a), list(b)
    for x in chosen[0]:
        left_a.remove(x)
    for y in chosen[1]:
        left_b.remove(y)
    return tuple(left_a) + chosen[1], tuple(left_b) + chosen[0]


def local_search(bins: Bins) -> Bins:
    """Exchange lengths between underfull bins while that raises the sum of squared fills, and until there are as few
    bins as the sum of all lengths needs. Each step works on all bins of two patterns at once."""
    least = -(-sum(sum(p) * n for p, n in bins.patterns()) // bins.capacity)
    tried: set[tuple] = set()
    while sum(n for _, n in bins.patterns()) > least:
        underfull = [(p, n) for p, n in reversed(bins.patterns()) if bins.room(p)]  # the emptiest first
        step = None
        for i, (b, n_b) in enumerate(underfull):
            for a, n_a in reversed(underfull[i:]):
                if (a, b) in tried or (a == b and n_a < 2):
                    continue
                if found := _exchange(a, b, bins.capacity):
                    step = a, b, min(n_a, n_b) if a != b else n_a // 2, found
                    break
                tried.add((a, b))
            if step:
                break
        if step is None:
            break
        a, b, count, (new_a, new_b) = step
        for pattern, change in ((a, -count), (b, -count), (new_a, count), (new_b, count)):
            bins.add(pattern, change)
    return bins


def slots(bins: Bins) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): pieces ranked lo to hi among their length go to consecutive sequences."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, count in bins.patterns():
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    bins = local_search(best_fit(histogram, capacity))
    # at most as many rows as the patterns have lengths, and those depend on the capacity alone
    table = spark.createDataFrame(slots(bins), "length long, lo long, hi long, first long, offset long")
    n_blocks = max(1, sum(histogram.values()) // BLOCK)
    own = Window.partitionBy("length", "block").orderBy("row")
    ranked = cut.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).withColumn("at", F.row_number().over(own) - 1)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block")).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.col("before") + F.col("at")
    placed = ranked.join(starts, ["length", "block"]).withColumn("rank", rank).join(F.broadcast(table), "length").where("rank >= lo AND rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
