"""Lossless WebP: bits, prefix codes, the general decoder with all transforms, and an encoder for each of its features.

Pixels are 32-bit integers, alpha in the highest byte, then red, green, blue. The encoder here works pixel by pixel and can
use any feature; media.py has one for samples, which codes many images at once and chooses by size.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Callable, Iterable

import numpy as np

#: Fixed values of the format: the order of code length codes, the multiplier of the colour cache, the signature byte.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER, SIGNATURE = 0x1E35A7BD, 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
#: Near places, nearest first, that short distance codes stand for: (columns to the left, rows up).
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.at, self.size = 0, 8 * len(data)
        self.data = data + bytes(8)

    def read(self, n: int) -> int:
        i = self.at >> 3
        found = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends too early")
        return found & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.value = self.size = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def container(stream: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def content(data: bytes) -> bytes:
    """The lossless stream of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    return data[20 : 20 + struct.unpack("<I", data[16:20])[0]]


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths, of `most` bits at most, of a complete prefix code for symbols with these counts; 0 for a lone symbol."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 0)
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            n, i, a = heapq.heappop(heap)
            m, _, b = heap[0]
            for s in a + b:
                lengths[s] += 1
            heapq.heapreplace(heap, (n + m, i, a + b))
        if max(lengths.values()) <= most:
            return lengths
        counts = {s: n // 2 + 1 for s, n in counts.items()}


#: Numbers of 16 bits, read backwards.
BACKWARDS = [int(f"{n:016b}"[::-1], 2) for n in range(1 << 16)]


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits in stream order, length) of each symbol of the canonical code."""
    found, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        found[s] = (BACKWARDS[code] >> 16 - n, n)
        code, last = code + 1, n
    return found


def run_lengths(lengths: list[int]) -> Iterable[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) that spell code lengths, runs of zeros shortened."""
    i, n = 0, len(lengths)
    while i < n:
        j = i
        while j < n and lengths[j] == lengths[i]:
            j += 1
        run = j - i
        if lengths[i]:
            yield from [(lengths[i], 0, 0)] * run
        while not lengths[i] and run:
            if run >= 11:
                part = min(run, 138)
                yield 18, part - 11, 7
            elif run >= 3:
                part = min(run, 10)
                yield 17, part - 3, 3
            else:
                part = 1
                yield 0, 0, 0
            run -= part
        i = j


#: The code that spells code lengths here: 13 of its 19 symbols have four bits, the others five.
SPELLING_LENGTHS = {s: 4 if s < 13 else 5 for s in range(19)}
SPELLING = codes(SPELLING_LENGTHS)
#: What tells that code: no short form, its lengths, and that all symbols follow.
SPELLED = BitWriter()
for _value, _n in ((0, 1), (len(LENGTH_ORDER) - 4, 4), *((SPELLING_LENGTHS[s], 3) for s in LENGTH_ORDER), (0, 1)):
    SPELLED.write(_value, _n)


def write_code(out: BitWriter, lengths: dict[int, int], size: int) -> None:
    """A code for symbols below size."""
    if len(lengths) <= 1 and (s := next(iter(lengths), 0)) < 256:
        out.write(1, 1)
        out.write(0, 1)
        out.write(s > 1, 1)
        out.write(s, 8 if s > 1 else 1)
        return
    if len(lengths) == 1:  # a lone symbol that the short form can't name gets a partner
        lengths = {next(iter(lengths)): 1, 0: 1}
    value, n = SPELLED.value, SPELLED.size
    for s, extra, bits in run_lengths([lengths.get(s, 0) for s in range(size)]):
        code, own = SPELLING[s]
        value |= (code | extra << own) << n
        n += own + bits
    out.write(value, n)


def read_lengths(bits: BitReader, size: int) -> dict[int, int]:
    """Code lengths of the symbols in use; a lone symbol has length 0."""
    read = bits.read
    if read(1):
        two, wide = read(1), read(1)
        first = read(8 if wide else 1)
        return {first: 1, read(8): 1} if two else {first: 0}
    spelled = [0] * 19
    for s in LENGTH_ORDER[: 4 + read(4)]:
        spelled[s] = read(3)
    step = reader({s: n for s, n in enumerate(spelled) if n})
    left = 2 + read(2 + 2 * read(3)) if read(1) else size
    found: dict[int, int] = {}
    s, last = 0, 8
    while s < size and left:
        left -= 1
        c = step(bits)
        if c < 16:
            if c:
                found[s] = last = c
            s += 1
        elif c == 16:
            for _ in range(3 + read(2)):
                found[s] = last
                s += 1
        else:
            s += 3 + read(3) if c == 17 else 11 + read(7)
    return {next(iter(found)): 0} if len(found) == 1 else found


def reader(lengths: dict[int, int]) -> Callable[[BitReader], int]:
    """A function that reads a symbol."""
    if len(lengths) <= 1:
        only = next(iter(lengths), 0)
        return lambda bits: only
    if (most := max(lengths.values())) <= 7:
        table: list[tuple[int, int] | None] = [None] * (1 << most)
        for s, (c, n) in codes(lengths).items():
            table[c :: 1 << n] = [(s, n)] * (1 << most - n)

        def look_up(bits: BitReader) -> int:
            at = bits.at
            if (told := table[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 2], "little") >> (at & 7)) & (1 << most) - 1]) is None:
                raise ValueError("no such code")
            bits.at = at + told[1]
            if bits.at > bits.size:
                raise ValueError("the stream ends too early")
            return told[0]

        return look_up
    known = {(n, c): s for s, (c, n) in codes(lengths).items()}
    shortest = min(lengths.values())

    def read(bits: BitReader) -> int:
        code, n = bits.read(shortest), shortest
        while (s := known.get((n, code))) is None:
            code |= bits.read(1) << n
            n += 1
            if n > 15:
                raise ValueError("no such code")
        return s

    return read


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance from 1 on."""
    n = value - 1
    if n < 4:
        return n, 0, 0
    high = n.bit_length() - 1
    return 2 * high + (n >> (high - 1) & 1), n & ((1 << (high - 1)) - 1), high - 1


def read_value(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def below(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def literal_table(lengths: dict[int, int]) -> tuple[int, list[bytes], list[int], list[int]]:
    """Bits of the longest code and, by the next so many bits: the up to three literals that they spell (none where a
    reference comes first), the bits these take, and the first symbol."""
    size = max(lengths.values())
    symbol, step = np.zeros(1 << size, np.int64), np.zeros(1 << size, np.int64)
    for s, (code, n) in codes(lengths).items():
        symbol[code :: 1 << n], step[code :: 1 << n] = s, n
    if not step.all():
        raise ValueError("incomplete prefix code")
    rest, used, literal = np.arange(1 << size), step.copy(), symbol < 256
    spelled, count = [symbol], literal.astype(np.int64)
    for _ in range(2):
        rest = rest >> step[rest]
        more = step[rest]
        literal = literal & (symbol[rest] < 256) & (used + more <= size)
        used = np.where(literal, used + more, used)
        spelled.append(symbol[rest])
        count += literal
    joined = np.stack(spelled, axis=1).astype(np.uint8).tobytes()
    return size, [joined[a : a + n] for a, n in zip(range(0, len(joined), 3), count.tolist())], used.tolist(), symbol.tolist()


def decode_green(bits: BitReader, lengths: dict[int, int], distance: Callable[[BitReader], int], width: int, total: int) -> bytes:
    """The green samples of an image whose other channels don't vary, several symbols at a step. It is the stream's last:
    the reader is left somewhere near its end."""
    size, literals, used, symbol = literal_table(lengths)
    raw = np.frombuffer(bits.data, np.uint8).astype(np.uint32)
    window = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24).tolist()
    out, at, mask = bytearray(), bits.at, (1 << size) - 1
    try:
        while (left := total - len(out)) > 0:
            for _ in itertools.repeat(None, left // 3 or 1):  # steps of three literals at most
                e = window[at >> 3] >> (at & 7) & mask
                at += used[e]
                if found := literals[e]:
                    out += found
                else:
                    bits.at = at
                    n = read_value(bits, symbol[e] - 256)
                    back = distance_of(read_value(bits, distance(bits)), width)
                    at = bits.at
                    if back > len(out):
                        raise ValueError("a reference from before the image")
                    out += (out[-back:] * (n // back + 1))[:n] if n > back else out[len(out) - back : len(out) - back + n]
                    break
    except IndexError:
        raise ValueError("the stream ends too early") from None
    return bytes(out[:total])


def decode_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; the main one, the last of its stream, may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, split, group_of = 1, 0, [0]
    if main and bits.read(1):
        split = bits.read(3) + 2
        group_of = (decode_pixels(bits, below(width, split), below(height, split), False) >> 8 & 0xFFFF).tolist()
        groups = max(group_of) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    lengths = [[read_lengths(bits, n) for n in sizes] for _ in range(groups)]
    across, total = below(width, split), width * height
    if groups == 1 and not cache_bits and all(len(x) == 1 for x in lengths[0][1:4]):
        rest = sum(next(iter(x)) << shift for x, shift in zip(lengths[0][1:4], (16, 0, 24)))
        if len(lengths[0][0]) == 1 and (s := next(iter(lengths[0][0]))) < 256:
            return np.full(total, rest | s << 8, np.uint32)
        if main and len(lengths[0][0]) > 1:
            green = decode_green(bits, lengths[0][0], reader(lengths[0][4]), width, total)
            return np.frombuffer(green, np.uint8).astype(np.uint32) << 8 | np.uint32(rest)
    readers = [[reader(x) for x in own] for own in lengths]
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    while len(out) < total:
        at = len(out)
        group = readers[group_of[(at // width >> split) * across + (at % width >> split)] if groups > 1 else 0]
        s = group[0](bits)
        if s < 256:
            red, blue, alpha = group[1](bits), group[2](bits), group[3](bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = read_value(bits, s - 256)
            back = distance_of(read_value(bits, group[4](bits)), width)
            if back > at:
                raise ValueError("a reference from before the image")
            new = (out[at - back :] * (n // back + 1))[:n]
        else:
            new = [cache[s - 280]]
        if cache_bits:
            for p in new:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        out += new
    return np.array(out[:total], np.uint32)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _pixel(c: Iterable[int]) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _mean(p: int, q: int) -> int:
    return _pixel((x + y) // 2 for x, y in zip(_channels(p), _channels(q)))


def _nearer(left: int, top: int, corner: int) -> int:
    """Of left and top the one nearer to left + top - corner; top among equals."""
    by_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner)))
    by_top = sum(abs(x - c) for x, c in zip(_channels(left), _channels(corner)))
    return left if by_left < by_top else top


def _clamped(values: Iterable[int]) -> int:
    return _pixel(min(255, max(0, v)) for v in values)


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of one of the 14 modes; right: the pixel above and to the right."""
    match mode:
        case 1: return left
        case 2: return top
        case 3: return right
        case 4: return corner
        case 5: return _mean(_mean(left, right), top)
        case 6: return _mean(left, corner)
        case 7: return _mean(left, top)
        case 8: return _mean(corner, top)
        case 9: return _mean(top, right)
        case 10: return _mean(_mean(left, corner), _mean(top, right))
        case 11: return _nearer(left, top, corner)
        case 12: return _clamped(x + t - c for x, t, c in zip(_channels(left), _channels(top), _channels(corner)))
        case 13: return _clamped(m + int((m - c) / 2) for m, c in zip(_channels(_mean(left, top)), _channels(corner)))
    return OPAQUE


def _walk(pixels: list[int], width: int, modes: list[int], bits: int, known: list[int], change: Callable[[int, int], int]) -> list[int]:
    """Apply change(value, prediction) pixel by pixel; predictions look at `known`, which may be what is being made."""
    out: list[int] = known
    made: list[int] = []
    across = below(width, bits)
    for i, p in enumerate(pixels):
        x, y = i % width, i // width
        if not i:
            guess = OPAQUE
        elif not y:
            guess = out[i - 1]
        elif not x:
            guess = out[i - width]
        else:
            mode = modes[(y >> bits) * across + (x >> bits)] >> 8 & 15
            guess = predicted(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        v = _pixel(change(a, b) & 255 for a, b in zip(_channels(p), _channels(guess)))
        made.append(v)
        if out is not pixels:
            out.append(v)
    return made


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def summed(pixels: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Invert the predictor where all blocks have mode 1 (left) or 2 (top): sums along a row or a column. The first row
    goes by its left, the first column by its top whatever the mode."""
    c = pixels.view(np.uint8).reshape(-1, width, 4).copy()
    c[0, 0, 3] += np.uint8(255)
    if mode == 1:
        c[:, 0] = np.cumsum(c[:, 0], axis=0, dtype=np.uint8)
        return np.cumsum(c, axis=1, dtype=np.uint8).reshape(-1).view(np.uint32)
    c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
    return np.cumsum(c, axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)


def cross_colour(pixels: np.ndarray, width: int, elements: list[int], bits: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what green tells of red, and green and red of blue."""
    i = np.arange(len(pixels))
    e = np.array(elements, np.uint32)[(i // width >> bits) * below(width, bits) + (i % width >> bits)]
    red, green, blue = (pixels >> s & 255 for s in (16, 8, 0))
    g, new_red = _signed(green), red + sign * ((_signed(e & 255) * _signed(green)) >> 5)
    true_red = _signed((new_red if sign > 0 else red) & 255)
    new_blue = blue + sign * (((_signed(e >> 8 & 255) * g) >> 5) + ((_signed(e >> 16 & 255) * true_red) >> 5))
    return (pixels & np.uint32(0xFF00FF00)) | ((new_red & 255).astype(np.uint32) << 16) | (new_blue & 255).astype(np.uint32)


def shifted_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    red, blue = ((pixels >> s & 255).astype(np.int64) + sign * green & 255 for s in (16, 0))
    return (pixels & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << 16) | blue.astype(np.uint32)


def packed_bits(colours: int) -> int:
    """Logarithm of the number of palette indices in one pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: [height, width, 4], 8 bits each, red, green, blue, alpha."""
    bits = BitReader(content(data))
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, columns = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, columns, size, decode_pixels(bits, below(columns, size), below(height, size), False).tolist()))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, columns, 0, []))
        else:
            table = decode_pixels(bits, n := bits.read(8) + 1, 1, False).tolist()
            for i in range(1, n):
                table[i] = _pixel(a + b & 255 for a, b in zip(_channels(table[i]), _channels(table[i - 1])))
            transforms.append((kind, columns, packed_bits(n), table))
            columns = below(columns, packed_bits(n))
    pixels = decode_pixels(bits, columns, height, True)
    for kind, wide, size, about in reversed(transforms):
        if kind == PREDICTOR:
            modes = {p >> 8 & 15 for p in about}
            if modes in ({1}, {2}):
                pixels = summed(pixels, wide, modes.pop())
            else:
                pixels = np.array(_walk(pixels.tolist(), wide, about, size, [], lambda a, b: a + b), np.uint32)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, wide, about, size, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = shifted_green(pixels, 1)
        else:
            x, each = np.arange(wide), 8 >> size
            index = pixels.reshape(height, -1)[:, x >> size] >> 8 >> ((x & (1 << size) - 1) * each)[None, :] & (1 << each) - 1
            table = np.zeros(256, np.uint32)
            table[: len(about)] = about
            pixels = table[index].ravel()
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(height, width, 4)[:, :, (2, 1, 0, 3)]


def encode_pixels(out: BitWriter, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, groups: tuple[int, list[int]] | None = None) -> None:
    """An entropy-coded image. groups: (block bits, group of each block). references: runs and repeats are copied."""
    out.write(cache_bits > 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    split, group_of = groups or (0, [0])
    if main:
        out.write(groups is not None, 1)
        if groups:
            out.write(split - 2, 3)
            encode_pixels(out, [OPAQUE | g << 8 for g in group_of], below(width, split), False)
    cache: dict[int, int] = {}
    steps: list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]] = []
    seen: dict[tuple[int, ...], int] = {}
    i, across = 0, below(width, split)
    while i < len(pixels):
        group = group_of[(i // width >> split) * across + (i % width >> split)] if groups else 0
        n, key = 0, tuple(pixels[i : i + 4])
        if references and key in seen and len(key) == 4:
            j = seen[key]
            while i + n < len(pixels) and n < 4096 and pixels[j + n] == pixels[i + n]:
                n += 1
        slot = (CACHE_MULTIPLIER * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 4:
            near = {distance_of(c, width): c for c in range(len(NEAR), 0, -1)}
            length, distance = prefix_of(n), prefix_of(near.get(i - j, i - j + len(NEAR)))
            steps.append((group, [(0, 256 + length[0]), (4, distance[0])], [length[1:], distance[1:]]))
        elif cache_bits and cache.get(slot) == pixels[i]:
            steps.append((group, [(0, 280 + slot)], [(0, 0)]))
            n = 1
        else:
            a, r, g, b = _channels(pixels[i])
            steps.append((group, [(0, g), (1, r), (2, b), (3, a)], [(0, 0)] * 4))
            n = 1
        for k in range(i, i + n):
            seen[tuple(pixels[k : k + 4])] = k
            if cache_bits:
                cache[(CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        i += n
    tables = []
    for group in range(max(group_of) + 1):
        counts: list[dict[int, int]] = [{} for _ in range(5)]
        for g, symbols, _ in steps:
            for k, s in symbols if g == group else ():
                counts[k][s] = counts[k].get(s, 0) + 1
        own = [code_lengths(c or {0: 1}, 15) for c in counts]
        if len(own[0]) == 1 and next(iter(own[0])) > 255:
            own[0] = {next(iter(own[0])): 1, 0: 1}
        for lengths, size in zip(own, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
            write_code(out, lengths, size)
        tables.append([codes(x) for x in own])
    for group, symbols, extras in steps:
        for (k, s), extra in zip(symbols, extras):
            out.write(*tables[group][k][s])
            out.write(*extra)


def encode(image: np.ndarray, steps: Iterable[tuple] = (), cache_bits: int = 0, references: bool = False, groups: tuple[int, list[int]] | None = None) -> bytes:
    """A lossless WebP file of [height, width, 4] samples.

    steps: transforms in order, each (PREDICTOR, block bits, modes), (CROSS_COLOUR, block bits, elements),
    (SUBTRACT_GREEN,) or (PALETTE,); modes and elements: one pixel value for each block.
    """
    height, width, _ = image.shape
    p = image.reshape(-1, 4).astype(np.uint32)
    pixels = p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
    out, columns = BitWriter(), width
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    for step in steps:
        out.write(1, 1)
        out.write(step[0], 2)
        if step[0] in (PREDICTOR, CROSS_COLOUR):
            _, size, about = step
            out.write(size - 2, 3)
            encode_pixels(out, list(about), below(columns, size), False)
            if step[0] == PREDICTOR:
                values = pixels.tolist()
                pixels = np.array(_walk(values, columns, list(about), size, values, lambda a, b: a - b), np.uint32)
            else:
                pixels = cross_colour(pixels, columns, list(about), size, -1)
        elif step[0] == SUBTRACT_GREEN:
            pixels = shifted_green(pixels, -1)
        else:
            table, index = np.unique(pixels, return_inverse=True)
            size = packed_bits(len(table))
            flat = table.tolist()
            out.write(len(flat) - 1, 8)
            deltas = [flat[0], *(_pixel(a - b & 255 for a, b in zip(_channels(y), _channels(x))) for x, y in zip(flat, flat[1:]))]
            encode_pixels(out, deltas, len(flat), False)
            packed = np.zeros((height, below(columns, size)), np.uint32)
            for x in range(columns):
                packed[:, x >> size] |= index.reshape(height, columns)[:, x].astype(np.uint32) << np.uint32((x & (1 << size) - 1) * (8 >> size))
            pixels, columns = (packed << np.uint32(8) | np.uint32(OPAQUE)).ravel(), packed.shape[1]
    out.write(0, 1)
    encode_pixels(out, pixels.tolist(), columns, True, cache_bits, references, groups)
    return container(out.bytes())
