"""Word shingles of texts as sorted arrays of distinct 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
_CHUNK = 2_000_000
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _RANDOM.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SHORT = _RANDOM.integers(0, 2**64, WIDTH, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, _BASE)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _POWERS.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    word = np.zeros(len(data) + 1, np.int8)
    word[1:] = ~_BLANK[data]
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def _sets(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    wide = np.zeros(len(words), np.uint64)
    for k in range(WIDTH):
        wide += padded[k : k + len(words)] * _PLACE[k]
    wide = mixed(wide)
    at = 0
    for n in counts.tolist():
        if n >= WIDTH:
            found = np.sort(wide[at : at + n - WIDTH + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif n:
            yield mixed((words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n])
        else:
            yield np.zeros(0, np.uint64)
        at += n


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs of anything but ASCII white space, A-Z in lower case.  A text of
    fewer than five words has its whole sequence as one shingle; a null, empty or
    blank one has none.
    """
    chunk, size = [], 0
    for text in texts:
        chunk.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(chunk[-1])
        if size >= _CHUNK:
            yield from _sets(chunk)
            chunk, size = [], 0
    if chunk:
        yield from _sets(chunk)
