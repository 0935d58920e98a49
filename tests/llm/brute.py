"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_components(docs: list[tuple[int, str | None]], percent: int = 75) -> list[tuple[int, int, int]]:
    """(doc_id, number of shingles, smallest linked id) for each document."""
    sets = {doc: shingles(text) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((doc, len(sets[doc]), root(doc)) for doc in sets)


def repeated_bytes(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> (bytes, removed, spans, kept): bytes under a string that also starts in a smaller document go."""
    first: dict[bytes, int] = {}
    raw = {doc: (text or "").encode() for doc, text in docs}
    for doc in sorted(raw, reverse=True):
        for i in range(len(raw[doc]) - length + 1):
            first[raw[doc][i : i + length]] = doc
    out = {}
    for doc, data in raw.items():
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def fingerprint(text: str | None) -> int:
    """A bit is set if more than half of the hashes of all 3-word shingles have it."""
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def fingerprint_components(docs: list[tuple[int, int]], differing: int = 2) -> list[tuple[int, str, int]]:
    """(doc_id, fingerprint, smallest linked id) for each (doc_id, fingerprint), by all pairs."""
    component = {doc: doc for doc, _ in docs}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for (a, x), (b, y) in combinations(docs, 2):
        if (x ^ y).bit_count() <= differing:
            low, high = sorted((root(a), root(b)))
            component[high] = low
    return sorted((doc, f"{bits:016x}", root(doc)) for doc, bits in docs)


def quantised(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict[int, tuple[str, int]], str]:
    """vec_id -> (code, error), and the codebooks' digest, of (vec_id, vector) rows whose vectors all count."""
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in sorted(rows)}
    width = len(next(iter(whole.values()))) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in list(whole.values())[:entries]] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for v in whole.values():
                held.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for k, own in held.items():
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for i, v in whole.items():
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found))
    return out, hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def rearranged(doc_id: int | None, text: str | None, percent: int = 100, spm: int = 50) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
