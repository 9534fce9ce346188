"""Hashes of word shingles of many texts at once, and their minhash signatures."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are hashed together; a longer text goes alone.
PART = 500_000
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (BASE, back))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowest(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of the texts, one text after another (repeats kept), and where each text's begin.

    Words are runs without white space. A text of fewer words has one shingle, all of them; one of no words has none.
    Texts are taken a few at a time, so that besides the hashes only these are in memory.
    """
    encoded = [t.encode() for t in texts]
    cuts, size = [0], 0
    for i, e in enumerate(encoded):
        size += len(e) + 1
        if size >= PART:
            cuts.append(i + 1)
            size = 0
    parts = [_shingles(encoded[a:b], k) for a, b in zip(cuts, [*cuts[1:], len(encoded)]) if b > a]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(starts) for _, starts in parts]))))


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, one text after another, and how many each text has."""
    buf = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    ends_of = np.cumsum([len(e) + 1 for e in encoded])
    up, down = _powers(max(1 << 20, 1 << (len(buf) + 1).bit_length()))
    blank = _blank[buf]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])))
    words = mixed((total[ends] - total[starts]) * down[starts])
    return words, np.diff(np.searchsorted(starts, ends_of), prepend=0)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k neighbouring words, given by their hashes."""
    up, down = _powers(max(1 << 20, 1 << (len(words) + 1).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    return mixed((total[k:] - total[:-k]) * down[: len(total) - k])


def _shingles(encoded: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = word_hashes(encoded)
    upto = np.cumsum(counts)
    owner = np.repeat(np.arange(len(encoded)), counts)
    n = len(words)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    owners = np.concatenate((owner, np.full(k, -1)))
    found = np.zeros(n, np.uint64)
    for j in range(k):
        found = found * np.uint64(0xD6E8FEB86659FD93) + np.where(owners[j : n + j] == owner, padded[j : n + j], np.uint64(0))
    place = np.arange(n) - np.repeat(upto - counts, counts)
    kept = (place + k <= np.repeat(counts, counts)) | ((place == 0) & (np.repeat(counts, counts) < k))
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mixed(found[kept]), np.concatenate(([0], np.cumsum(sizes)))


@functools.lru_cache(maxsize=4)
def _multipliers(width: int) -> np.ndarray:
    seeds = np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(BASE)
    return (mixed(seeds) | np.uint64(1)).reshape(2, width)


def signatures(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """[text, width] minhashes, 32 bits each; all ones for a text without shingles."""
    out = np.full((len(starts) - 1, width), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        for j, (a, b) in enumerate(_multipliers(width).T):
            out[full, j] = np.minimum.reduceat((hashes * a + b) >> np.uint64(32), starts[full])
    return out
