"""Hashes of words and shingles of many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes with A-Z lower-cased, none of them 0.
_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def odd(n: int, seed: int) -> np.ndarray:
    """n odd multipliers, each fixed by its place."""
    return mixed(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased: hash, text, begin and end (bytes of ``raw``)."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = raw = np.frombuffer(b"\n".join(coded), np.uint8)
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[1], white.view(np.int8), [1]])))
        self.begin, self.end = edge[::2], edge[1::2]
        sizes = np.array([len(c) for c in coded], np.int64)
        self.base = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.searchsorted(self.base, self.begin, "right") - 1
        self.ascii = int(sizes.sum()) == sum(map(len, texts))
        if not len(self.begin):
            self.hash = np.empty(0, np.uint64)
            return
        # The sum of a word's bytes, each multiplied by an odd number of its place, in wrapping arithmetic.
        length = self.end - self.begin
        inner = np.flatnonzero(~white)
        at = np.cumsum(length) - length
        place = np.arange(len(inner)) - np.repeat(at, length)
        weight = odd(int(length.max()), 0x5851F42D4C957F2D)
        self.hash = mixed(np.add.reduceat(_LOWER[raw[inner]] * weight[place], at) + length.astype(np.uint64), 1)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, as sorted 64-bit hashes; fewer words are one shingle, none give none."""
    w = Words(texts)
    counts = np.bincount(w.text, minlength=len(texts)) if len(w.text) else np.zeros(len(texts), np.int64)
    n = len(w.hash)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        total[: n - j] += mixed(w.hash[j:] ^ np.uint64(0x1234567 * (j + 1)), 100 + j)
    shingle = mixed(total, k)
    out, at = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(shingle[at : at + c - k + 1]))
        elif c:
            own = w.hash[at : at + c] * odd(int(c), 31)
            out.append(mixed(np.array([own.sum(dtype=np.uint64)]), 1000 + int(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out
