"""Sets of five-word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of texts that are hashed at a time: arrays for so many stay in a processor's cache.
AT_ONCE = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _PLACES = _random(256, 11), _random(WORDS, 13)
#: A-Z count as a-z; space, tab and the line ends to carriage return part words.
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as they have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_MULTIPLIER, -1, 2**64)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_MULTIPLIER, inverse))
        return self.up, self.down


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and where each text's words end."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _powers.upto(len(raw) + 1)
    gap = _GAP[raw]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    edge = np.flatnonzero(np.diff(np.r_[True, gap]))
    starts, ends = edge[::2], edge[1::2]
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, borders)


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in runs of about ``AT_ONCE`` bytes."""
    start, size = 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= AT_ONCE or end == len(texts):
            yield texts[start:end]
            start, size = end, 0


def sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as the only one."""
    for part in chunks([t.encode("utf-8", "surrogatepass") for t in texts]):
        yield from _sets(part)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    hashes, ends = word_hashes(texts)
    count = max(0, len(hashes) - WORDS + 1)
    every = np.zeros(count, np.uint64)
    for k in range(WORDS):
        every += hashes[k : k + count] * _PLACES[k]
    every = mix(every)
    start = 0
    for end in ends.tolist():
        if end - start >= WORDS:
            found = np.sort(every[start : end - WORDS + 1])
            yield found[np.r_[True, found[1:] != found[:-1]]]
        elif end > start:
            part = (hashes[start:end] * _PLACES[: end - start]).sum(dtype=np.uint64)
            yield mix(np.array([part + np.uint64(end - start)], np.uint64))
        else:
            yield hashes[:0]
        start = end


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    two = (mix(found + _PLACES[k]).sum(dtype=np.uint64) + np.uint64(len(found)) for k in range(2))
    return tuple(int(x.view(np.int64)) for x in two)


def bitmap(found: np.ndarray, room: int = 1) -> bytes:
    """Hashed bitmap with a power of two of bits, at least ``room`` for each element and 64 in all."""
    size = 64
    while size < room * len(found):
        size *= 2
    bits = np.zeros(size, bool)
    bits[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()
