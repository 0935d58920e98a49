"""Hashed byte n-grams of many texts at a time, and per-text averages of what a table holds for them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_CHUNK = 1_000_000
_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of some texts, each behind a line feed, and where each text begins."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= _CHUNK:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(t) + 1 for t in held)])[:-1]
    return np.frombuffer(b"\n" + b"\n".join(held) + b"\n" * 8, np.uint8), starts


def buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the ``n`` bytes from each position."""
    h = np.full(len(data) - n + 1, n, np.uint32)
    for k in range(n):
        h += data[k : len(data) - n + 1 + k].astype(np.uint32) * _STEP[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def inside_words(data: np.ndarray, n: int) -> np.ndarray:
    """Positions whose ``n`` bytes have white space at their ends at most."""
    blank = _BLANK[data].astype(np.int8)
    inner = np.zeros(len(data) - n + 1, np.int8)
    for k in range(1, n - 1):
        inner |= blank[k : len(data) - n + 1 + k]
    return inner == 0


def averages(texts: Sequence[str | None], table: np.ndarray, grams: Sequence[int], bits: int) -> np.ndarray:
    """For each text the mean of ``table``'s rows over its n-grams (zero where it has none)."""
    out = []
    for data, starts in chunks(texts):
        sums, counts = np.zeros((len(starts), table.shape[1])), np.zeros(len(starts))
        for n in grams:
            good = inside_words(data, n)
            rows = table[buckets(data, n, bits)]
            rows[~good] = 0
            ends = np.minimum(np.append(starts[1:], len(data) - 8), len(good))
            sums += np.add.reduceat(rows, np.minimum(starts, len(good) - 1), axis=0, dtype=np.float64) - _tail(rows, ends[-1], len(starts))
            whole = np.concatenate([[0], np.cumsum(good)])
            counts += whole[ends] - whole[np.minimum(starts, len(good))]
        out.append(sums / np.maximum(counts, 1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, table.shape[1]))


def _tail(rows: np.ndarray, end: int, n: int) -> np.ndarray:
    """What reduceat adds to the last text from behind its end."""
    tail = np.zeros((n, rows.shape[1]))
    tail[-1] = rows[end:].sum(axis=0, dtype=np.float64)
    return tail


def counted(texts: Sequence[str | None], grams: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of all its n-grams."""
    for data, starts in chunks(texts):
        parts = []
        for n in grams:
            good = inside_words(data, n)
            parts.append((buckets(data, n, bits), good))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(data) - 8).tolist(), strict=True):
            found = np.concatenate([h[a : min(b, len(h))][g[a : min(b, len(h))]] for h, g in parts])
            index, count = np.unique(found, return_counts=True)
            yield index, (count / max(1, count.sum())).astype(np.float32)
