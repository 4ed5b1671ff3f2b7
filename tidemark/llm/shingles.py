"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once on their bytes.

A word is a maximal run of bytes outside 20 and 09-0D hex, with A-Z lower-cased. A text with fewer words
than a shingle has its whole word sequence as its only shingle; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

N_WORDS = 5
#: Bytes of text hashed at once for words, and for shingles (longer texts go alone); a worker needs about 40 times this.
CHUNK, SHINGLE_CHUNK = 1 << 20, 1 << 18

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15 | 1), _U(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base modulo 2^64, and of its inverse, as far as they were asked for."""

    up = down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            cls.up = np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n, _BASE))])
            cls.down = np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n, inverse))])
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of the texts in order: hash, and the position of its text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _STEP)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.searchsorted(firsts, starts, "right") - 1


def shingle_sets(texts: list[bytes], n: int = N_WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    size = max(0, len(hashes) - n + 1)
    grams = np.zeros(size, _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams = grams * _STEP + hashes[k : k + size]
    grams = mix(grams)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            own = np.sort(grams[at : at + count - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            whole = _U(count)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count]:
                    whole = whole * _STEP + h
                out.append(mix(np.array([whole + _U(n)])))
        else:
            out.append(np.zeros(0, _U))
        at += count
    return out


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in lists of about ``most`` bytes; null counts as empty."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > most:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def all_shingle_sets(texts: Iterable[str | None], n: int = N_WORDS) -> Iterator[np.ndarray]:
    for chunk in chunks(texts, SHINGLE_CHUNK):
        yield from shingle_sets(chunk, n)
