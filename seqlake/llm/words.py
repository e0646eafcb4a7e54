"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
#: Bytes that are hashed at a time.
BLOCK = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Whatever is not the space or one of \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which for millions of whole numbers is faster than numpy's hash table."""
    x = np.sort(x, axis=None)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_B, _B_INVERSE)]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """start, end: places in data; doc: the text's number; first[i]: number of the first word of text i (first[-1]: all words)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased."""
        return hashed(self.data, self.start, self.end, _LOWER)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end, in order and without overlap; letters: what bytes count as."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(out):  # some bytes at a time: the arrays below are eight times as large
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
            low, high = starts[a], ends[b - 1]
            start, end = starts[a:b] - low, ends[a:b] - low
            up, down = _powers(int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            part = data[low:high] if letters is None else letters[data[low:high]]
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            out[a:b] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
            a = b
    return out


def joined(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the run of hashes from each start to its end; runs may be empty."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def words(texts: list[str], inside: np.ndarray = ALNUM) -> Words:
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    begins = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in coded], out=begins[1:])
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    edges = np.diff(mask)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(start, begins)
    doc = np.repeat(np.arange(len(coded)), np.diff(first))
    return Words(data, start, end, doc, first)


def chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
