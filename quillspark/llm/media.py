"""Media columns: payloads stored as lossless WebP images of 8-bit samples, many images coded at once."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm import webp
from quillspark.llm.common import text_columns

UNIT = 576
#: Widths of images, the least that is enough: the format allows 16,384 rows. With the last one, rows are filled up.
WIDTHS, MOST_ROWS = (24, UNIT, 28 * UNIT), 16_384
#: Bits of the longest code of images of up to SHORT samples, and of others; of the blocks of a predictor.
SHORT, BITS, BLOCK_BITS = 8 * UNIT, (10, 12), 9
#: Samples that a reference copies: at least, at most.
LEAST, MOST = 10, 4096
#: Samples that a reference reaches back: the format's codes end at 2**20.
FARTHEST = (1 << 20) - len(webp.NEAR)
#: Distance code of each near place, for the first of WIDTHS.
NEAR = {webp.distance_of(c, WIDTHS[0]): c for c in range(len(webp.NEAR), 0, -1)}


def payload_of(raw: bytes) -> bytes:
    """raw with bytes of 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def width_of(size: int) -> int:
    return next(w for w in WIDTHS if size <= w * MOST_ROWS)


def repeats(joined: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and earlier places of the same image that begin with the same eight samples, in order of the first.

    One place in eight is looked at, chosen by its samples, and each place where a run of equal samples begins.
    """
    n = len(joined) - 7
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = np.empty(n, np.uint64)
    for k in range(8):
        eight[k::8] = np.frombuffer(joined[k : k + (n - k + 7) // 8 * 8].tobytes(), np.uint64)
    at = np.flatnonzero((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == 0)
    key = eight[at] ^ (owner[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    run = np.flatnonzero((eight[1:] == eight[:-1]) & np.concatenate(([True], eight[1:-1] != eight[:-2]))) + 1
    here, there = np.concatenate((at[order[again + 1]], run)), np.concatenate((at[order[again]], run - 1))
    same = (owner[here] == owner[there]) & (here - there <= FARTHEST)
    here, there = here[same], there[same]
    order = np.argsort(here, kind="stable")
    return here[order], there[order]


def alike(s: bytes, i: int, j: int, step: int = 32) -> int:
    """How many samples from i on equal those from j on; j < i."""
    n = 0
    while i + n < len(s):
        a = s[i + n : i + n + step]
        b = s[j + n : j + n + len(a)]
        if a != b:
            x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
            return n + ((x & -x).bit_length() - 1 >> 3)
        n += len(a)
        step = min(2 * step, 4096)
    return n


def references(s: bytes, here: list[int], there: list[int]) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the stretches that are copied, from left to right; the earliest is taken first."""
    found, upto = [], 0
    for i, j in zip(here, there):
        if i < upto:
            if i + 8 <= upto:
                continue
            i, j = upto, j + upto - i
        while i > upto and j > 0 and s[i - 1] == s[j - 1]:
            i, j = i - 1, j - 1
        n = alike(s, i, j)
        if n >= LEAST:
            for a in range(i, i + n, MOST):
                if i + n - a >= 2:
                    found.append((a, min(MOST, i + n - a), i - j))
            upto = found[-1][0] + found[-1][1]
    return found


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Bits that an ideal code takes for symbols of these counts, row by row."""
    total = counts.sum(axis=1, keepdims=True)
    return -(counts * np.log2(np.maximum(counts, 1) / np.maximum(total, 1))).sum(axis=1)


def transformed(samples: bytes, width: int, kind: str) -> tuple[webp.BitWriter, np.ndarray, int, int]:
    """Header of the transforms, samples to code, their width, and alpha: plain, palette, left or top."""
    out, a = webp.BitWriter(), np.frombuffer(samples, np.uint8)
    if kind == "palette":
        table, index = np.unique(a, return_inverse=True)
        size, rows = webp.packed_bits(len(table)), index.reshape(-1, width)
        wide = webp.below(width, size)
        packed = np.zeros((len(rows), wide), np.uint8)
        for x in range(width):
            packed[:, x >> size] |= (rows[:, x] << ((x & (1 << size) - 1) * (8 >> size))).astype(np.uint8)
        out.write(1 | webp.PALETTE << 1, 3)
        out.write(len(table) - 1, 8)
        colours = (np.uint32(webp.OPAQUE) | table.astype(np.uint32) << 8).tolist()
        webp.encode_pixels(out, colours[:1] + [(y - x & 0xFF00) for x, y in zip(colours, colours[1:])], len(colours), False)
        return out, packed.reshape(-1), wide, 255
    if kind == "plain":
        return out, a, width, 255
    grid = a.reshape(-1, width)
    left, top = np.diff(grid, axis=1, prepend=np.uint8(0)), np.diff(grid, axis=0, prepend=np.uint8(0))
    guess = left if kind == "left" else top
    guess[0], guess[1:, 0] = left[0], top[1:, 0]
    out.write(1 | webp.PREDICTOR << 1, 3)
    out.write(BLOCK_BITS - 2, 3)
    across, down = webp.below(width, BLOCK_BITS), webp.below(len(grid), BLOCK_BITS)
    webp.encode_pixels(out, [webp.OPAQUE | (1 if kind == "left" else 2) << 8] * (across * down), across, False)
    return out, guess.reshape(-1), width, 0


def kinds(parts: list[bytes]) -> list[str]:
    """For each run of samples the transform after which an ideal code takes the fewest bits: a palette of up to 16 colours
    (two samples or more in one), the difference to the sample on the left or above, or none."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    base = np.repeat(np.arange(len(parts)) * 256, sizes)
    width = np.repeat([width_of(n) for n in sizes], sizes)
    at = np.arange(len(joined))

    def bits(x: np.ndarray) -> np.ndarray:
        return bits_of(np.bincount(base + x, minlength=256 * len(parts)).reshape(-1, 256))

    plain = bits(joined)
    step = [bits(joined - joined[np.maximum(at - back, 0)]) for back in (1, width)]
    distinct = (np.bincount(base + joined, minlength=256 * len(parts)).reshape(-1, 256) > 0).sum(axis=1)
    out = []
    for i, part in enumerate(parts):
        found = {"plain": plain[i], "left": step[0][i] + 400, "top": step[1][i] + 400}  # what their headers take, at least
        if distinct[i] <= 16 and plain[i]:
            packed = transformed(part, width_of(len(part)), "palette")[1]
            found["palette"] = bits_of(np.bincount(packed, minlength=256)[None, :])[0] + 600
        out.append(min(found, key=found.__getitem__))
    return out


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload (a positive multiple of UNIT samples): the samples are the green channel, the others are
    constant. Transforms are chosen by kinds(), stretches that occurred before are copied, the rest is prefix-coded."""
    widths = [width_of(len(p)) for p in payloads]
    parts = [p + b"\xff" * (-len(p) % w) for p, w in zip(payloads, widths)]
    chosen = kinds(parts)
    told = [transformed(p, w, kind) for p, w, kind in zip(parts, widths, chosen)]
    sizes = np.array([len(t[1]) for t in told])
    first = np.cumsum(sizes) - sizes
    joined, owner = np.concatenate([t[1] for t in told]), np.repeat(np.arange(len(told)), sizes)
    here, there = repeats(joined, owner)
    cuts = np.searchsorted(here, np.append(first, len(joined)))
    kept, copies = np.ones(len(joined), bool), []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        found = references(joined[first[i] : first[i] + sizes[i]].tobytes(), (here[a:b] - first[i]).tolist(), (there[a:b] - first[i]).tolist()) if b > a else []
        for at, n, _ in found:
            kept[first[i] + at : first[i] + at + n] = False
        copies.append(found)
    symbols, owners = joined[kept].astype(np.int64), owner[kept]
    counts = np.bincount(owners * 256 + symbols, minlength=256 * len(told)).reshape(-1, 256)
    code, length = np.zeros((len(told), 256), np.int64), np.zeros((len(told), 256), np.int64)
    heads, extra = [], []  # extra: place, code, bits of what references take
    for i, (header, _, wide, alpha) in enumerate(told):
        used = np.flatnonzero(counts[i]).tolist()
        green, distances, steps = dict(zip(used, counts[i][used].tolist())), {}, []
        for at, n, back in copies[i]:
            size, away = webp.prefix_of(n), webp.prefix_of((NEAR.get(back) if wide == WIDTHS[0] else None) or back + len(webp.NEAR))
            green[256 + size[0]] = green.get(256 + size[0], 0) + 1
            distances[away[0]] = distances.get(away[0], 0) + 1
            steps.append((at, size, away))
        most = BITS[int(sizes[i] > SHORT)]
        lengths, reach = webp.code_lengths(green, most), webp.code_lengths(distances or {0: 1}, most)
        table, reach_table = webp.codes(lengths), webp.codes(reach)
        if used:
            code[i, used], length[i, used] = zip(*(table[s] for s in used))
        out = webp.BitWriter()
        for value, n in ((webp.SIGNATURE, 8), (widths[i] - 1, 14), (len(parts[i]) // widths[i] - 1, 14), (0, 1), (0, 3), (header.value, header.size), (0, 1), (0, 1), (0, 1)):
            out.write(value, n)
        webp.write_code(out, lengths, 280)
        for s in (0, 0, alpha):  # red, blue, alpha
            webp.write_code(out, {s: 0}, 256)
        webp.write_code(out, reach, 40)
        heads.append(out)
        for at, size, away in steps:
            for c, n in (table[256 + size[0]], size[1:], reach_table[away[0]], away[1:]):
                extra.append((first[i] + at, c, n))
    bits, values, owners_ = length[owners, symbols], code[owners, symbols], owners
    if extra:
        places, more, wide_ = np.array(extra, np.int64).T
        put = np.searchsorted(np.flatnonzero(kept), places)
        bits, values, owners_ = np.insert(bits, put, wide_), np.insert(values, put, more), np.insert(owners, put, owner[places])
    body = np.bincount(owners_, weights=bits, minlength=len(told)).astype(np.int64)
    head = np.array([h.size for h in heads])
    whole = (head + body + 7) // 8
    start = np.cumsum(whole) - whole
    upto = np.cumsum(bits) - bits
    at = upto - np.repeat(np.cumsum(body) - body, np.bincount(owners_, minlength=len(told))) + (8 * start + head)[owners_]
    words = np.bincount(at >> 5, weights=(values << (at & 31)).astype(np.float64), minlength=int(whole.sum()) // 4 + 3).astype(np.uint64)
    low, high = (words & np.uint64(0xFFFFFFFF)), (words >> np.uint64(32))
    low[1:] += high[:-1]  # codes of a word don't overlap, so sums are unions
    stream = bytearray(low.astype(np.uint32).tobytes())
    for i, h in enumerate(heads):
        a, n = int(start[i]), (h.size + 7) // 8
        stream[a : a + n] = (int.from_bytes(stream[a : a + n], "little") | h.value).to_bytes(n, "little")
    return [webp.container(bytes(stream[s : s + n])) for s, n in zip(start.tolist(), whole.tolist())]


def decode_image(data: bytes) -> bytes:
    """The payload of a file: its green samples, without what filled up rows of the widest images."""
    image = webp.decode(data)
    samples = image[:, :, 1].tobytes()
    return payload_of(samples.rstrip(b"\xff")) if image.shape[1] == WIDTHS[-1] else samples


def feature(payload: bytes) -> str:
    """Number of samples, their mean and deviation, entropy in bits, and the share of blanks, from the pixels read back."""
    by = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = by / max(1, by.sum())
    levels = np.arange(256)
    mean = float((p * levels).sum())
    spread = float(np.sqrt((p * (levels - mean) ** 2).sum()))
    some = p[p > 0]
    return f"{len(payload)};{mean:.4f};{spread:.4f};{float(-(some * np.log2(some)).sum()):.4f};{p[32]:.4f}"


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every whole text as WebP and read it back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and, with keep_media, media (the file).

    The payload is the text's UTF-8 with bytes of 255 up to a multiple of 576, 576 at least; it is one image, 24 samples wide,
    or wider where that takes more than 16,384 rows (texts beyond 260 MB raise an error: no image has room for them). Hashes and features of the
    payload come from what was read back. A null text counts as empty; equal texts have equal values; rows stay as they
    are, repeated or not; extra columns are ignored.
    """

    def stored(texts: list[str]) -> dict[str, list]:
        raw = [t.encode() for t in texts]
        place = {b: i for i, b in enumerate(dict.fromkeys(raw))}  # equal texts are coded once
        files = encode_images([payload_of(b) for b in place])
        back = [decode_image(f) for f in files]
        media, read = [files[place[b]] for b in raw], [back[place[b]] for b in raw]
        return {
            "n_bytes": [len(b) for b in raw], "payload_bytes": [len(r) for r in read],
            "payload_sha256": [hashlib.sha256(r).hexdigest() for r in read], "tail_crc32": [zlib.crc32(r[-32:]) for r in read],
            "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [feature(r) for r in read], "media": media,
        }

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return text_columns(docs, lambda: stored, schema + ", media binary" * keep_media)
