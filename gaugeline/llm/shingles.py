"""Sets of distinct five-word shingles as sorted 64-bit hashes, computed for blocks of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 500_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _STEP[0]
    h = (h ^ (h >> np.uint64(27))) * _STEP[1]
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest block so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B_INVERSE)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words in a lower-cased byte array; a word's hash is a polynomial of its bytes, mixed."""
    solid = ~_SPACE[line]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.upto(len(line) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[: len(line)], dtype=np.uint64)])
    return start, mixed((total[end] - total[start]) * down[start])


def _block(texts: list[bytes]) -> Iterator[np.ndarray]:
    line = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    start, h = word_hashes(line)
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    place = np.searchsorted(start, cuts)
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        whole = np.zeros(n, dtype=np.uint64)
        for k in range(WORDS):
            whole += h[k: k + n] * _STEP[k]
        whole = mixed(whole).view(np.int64)
    for a, b in zip(place[:-1], place[1:]):
        if b - a >= WORDS:
            s = np.sort(whole[a: b - WORDS + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            # a short sequence is one shingle; its length takes part, so it never equals a five-word one by place
            few = np.array([np.sum(h[a:b] * np.array(_STEP[: b - a]), dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64)
            yield mixed(mixed(few)).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; none for a text that is null or without words."""
    block, size = [], 0
    for t in texts:
        t = (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(t) > BLOCK:
            yield from _block(block)
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield from _block(block)


def signature(s: np.ndarray) -> int:
    """A 64-bit hash of a set; together with the set's size it stands for the set."""
    return int(np.sum(mixed(s.view(np.uint64) + np.uint64(len(s))), dtype=np.uint64).view(np.int64)) if len(s) else 0


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashed set, twice as many as it has members (a power of two, 64 at least)."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(width, dtype=np.uint8)
    bits[mixed(s.view(np.uint64)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()
