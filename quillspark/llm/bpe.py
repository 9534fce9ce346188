"""Byte-level BPE shared by the token operators: byte alphabet, vocabulary files, merging."""

from __future__ import annotations

import heapq
import json


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the rest take the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: For str.translate, after decoding bytes as Latin-1.
TO_ALPHABET = byte_alphabet()


def in_alphabet(text: str) -> str:
    return text.encode().decode("latin-1").translate(TO_ALPHABET)


def load(path: str) -> tuple[dict[str, int], dict[tuple[str, str], int], dict[str, int]]:
    """Vocabulary, rank of each merge, and added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], {p: i for i, p in reversed(list(enumerate(pairs)))}, {t["content"]: t["id"] for t in spec["added_tokens"]}


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges to a word's first symbols, lowest rank first and leftmost first among equals.

    A heap over a linked list: a word of n symbols takes n log n steps, so very long words are no trouble.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    if n == 2:
        return [symbols[0] + symbols[1]] if (symbols[0], symbols[1]) in ranks else symbols
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((a + b, parts[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, parts[k]))
        if (h := before[i]) >= 0 and (r := get((parts[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, parts[h], a + b))
    return [p for p in parts if p is not None]
