import numpy as np
import pytest

from quillspark.llm import webp


def image(seed, height=13, width=17, colours=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    if colours:
        a = rng.integers(0, 256, (colours, 4)).astype(np.uint8)[rng.integers(0, colours, (height, width))]
    a[4:8] = a[4]
    return a


def blocks(bits, height, width, values):
    n = webp.below(height, bits) * webp.below(width, bits)
    return [values[i % len(values)] for i in range(n)]


@pytest.mark.parametrize("steps", [
    [],
    [(webp.SUBTRACT_GREEN,)],
    [(webp.PREDICTOR, 2, blocks(2, 13, 17, [webp.OPAQUE | m << 8 for m in range(14)]))],
    [(webp.PREDICTOR, 3, blocks(3, 13, 17, [webp.OPAQUE | 1 << 8]))],
    [(webp.PREDICTOR, 2, blocks(2, 13, 17, [webp.OPAQUE | 2 << 8]))],
    [(webp.CROSS_COLOUR, 3, blocks(3, 13, 17, [webp.OPAQUE | 0x7F80F1, webp.OPAQUE | 0x0203FE]))],
    [(webp.PREDICTOR, 3, blocks(3, 13, 17, [webp.OPAQUE | 11 << 8, webp.OPAQUE | 13 << 8])), (webp.SUBTRACT_GREEN,), (webp.CROSS_COLOUR, 2, blocks(2, 13, 17, [webp.OPAQUE | 0x112233]))],
])
@pytest.mark.parametrize("cache_bits,references", [(0, False), (4, True), (11, False), (0, True)])
def test_round_trip(steps, cache_bits, references):
    a = image(1)
    assert (webp.decode(webp.encode(a, steps, cache_bits, references)) == a).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    a = image(colours, colours=colours)
    assert (webp.decode(webp.encode(a, [(webp.PALETTE,)], 3, True)) == a).all()


def test_groups_of_codes():
    a = image(5)
    groups = (2, blocks(2, 13, 17, [0, 1, 2]))
    assert (webp.decode(webp.encode(a, cache_bits=2, references=True, groups=groups)) == a).all()


def test_known_bytes():
    """A 1 x 1 image, written out by hand: all five codes have a lone symbol, the pixel takes no bits."""
    bits = webp.BitWriter()
    for v, n in [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]:
        bits.write(v, n)
    for s in (10, 20, 30, 255, 0):
        for v, n in [(1, 1), (0, 1), (s > 1, 1), (s, 8 if s > 1 else 1)]:
            bits.write(v, n)
    assert webp.decode(webp.container(bits.bytes())).tolist() == [[[20, 10, 30, 255]]]


def test_near_places():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_broken():
    data = webp.encode(image(2))
    with pytest.raises(ValueError):
        webp.decode(data[:60])
    with pytest.raises(ValueError):
        webp.decode(b"GIF89a" + bytes(30))


def test_codes_are_looked_up_or_walked():
    """A table for short codes, a walk for long ones: both read what codes() spells, and refuse what it doesn't."""
    for lengths in ({s: 4 if s < 13 else 5 for s in range(19)}, {s: min(s + 1, 9) for s in range(10)}, {7: 1, 300: 1}):
        out = webp.BitWriter()
        for s in [*lengths, *reversed(lengths)]:
            out.write(*webp.codes(lengths)[s])
        bits, read = webp.BitReader(out.bytes()), webp.reader(lengths)
        assert [read(bits) for _ in range(2 * len(lengths))] == [*lengths, *reversed(lengths)]
        with pytest.raises(ValueError):
            for _ in range(20):
                read(bits)
    with pytest.raises(ValueError):
        webp.reader({1: 2, 2: 2})(webp.BitReader(b"\xff"))
