"""Baseline JPEG bytes of lines of pixels, by the public specification: 4:4:4, with a restart marker after every 8 lines.

What lies between two markers refers to nothing before it, so that strips of whole groups of 8 lines can be encoded anywhere.
Blocks, coefficients and codes are arrays; there is no loop over pixels or symbols.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

# Steps of quantisation at quality 50, by line, of brightness and of colour.
BRIGHTNESS_STEPS = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
COLOUR_STEPS = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99))  # the rest is 99
# How many codes have 1, 2, ... 16 bits, and their symbols in that order. Symbols that aren't listed follow by value.
DC_COUNTS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_COUNTS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_SYMBOLS = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)

#: Places of a block by rising frequency, along its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: The cosine transform of eight values.
COSINES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(8) + 1) / 16)
#: From red, green and blue to brightness and two differences of colour.
FROM_RGB = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Sides are written in 16 bits.
LARGEST = 65535
RUN_OF_16, END = 0xF0, 0x00
#: Pixels that are worked on together.
PIECE = 1 << 16


@cache
def steps(quality: int) -> np.ndarray:
    """Steps of both kinds in zigzag order; quality is 1 (coarsest) to 100 (every step is 1)."""
    if not 1 <= quality <= 100:
        raise ValueError("quality is 1 to 100")
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    colour = np.full((8, 8), 99)
    colour[:4, :4] = COLOUR_STEPS
    both = np.stack([np.array(BRIGHTNESS_STEPS), colour]).reshape(2, 64)[:, ZIGZAG]
    return np.clip((both * percent + 50) // 100, 1, 255)


@cache
def symbols(kind: int, of: int) -> tuple[int, ...]:
    """Symbols by length of code: of the first value of a block (kind 0) or of the others (1), of brightness (of 0) or colour (1)."""
    if kind == 0:
        return tuple(range(12))
    listed = [int(s, 16) for s in AC_SYMBOLS[of].split()]
    every = [END, RUN_OF_16, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return (*listed, *sorted(set(every) - set(listed)))


@cache
def codes(kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and its number of bits by (of, symbol): codes of a length count up, and a longer length goes on from there."""
    code, bits = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
    for of in (0, 1):
        following, left = 0, iter(symbols(kind, of))
        for length, n in enumerate((AC_COUNTS if kind else DC_COUNTS)[of], 1):
            for _ in range(n):
                symbol = next(left)
                code[of, symbol], bits[of, symbol] = following, length
                following += 1
            following <<= 1
    return code, bits


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of a value without its sign."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _coefficients(lines: np.ndarray, quality: int) -> np.ndarray:
    """(block, component, place) of lines of red, green and blue, 8 lines after 8; the last line and column fill blocks that are part empty."""
    height, width = lines.shape[:2]
    lines = np.pad(lines, ((0, -height % 8), (0, -width % 8), (0, 0)), "edge").astype(np.float64)
    parts = lines @ FROM_RGB.T - (128, 0, 0)
    blocks = parts.reshape(-(-height // 8), 8, -1, 8, 3).transpose(0, 2, 4, 1, 3)
    values = (COSINES @ blocks @ COSINES.T).reshape(-1, 3, 64)[:, :, ZIGZAG]
    whole = np.rint(values / steps(quality)[[0, 1, 1]]).astype(np.int64)
    whole[:, :, 1:] = np.clip(whole[:, :, 1:], -1023, 1023)
    return whole


def _bits(whole: np.ndarray, many: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of lines of blocks, ``many`` blocks each; a line refers to nothing before it."""
    begin = np.cumsum(many) - many
    first = np.diff(whole[:, :, 0], axis=0, prepend=0)
    first[begin] = whole[begin, :, 0]
    first = first.reshape(-1)
    rest = whole.reshape(-1, 64)[:, 1:]
    n = len(rest)
    block, place = np.nonzero(rest)
    value = rest[block, place]
    before = np.where(np.diff(block, prepend=-1) != 0, -1, np.roll(place, 1))
    run = place - before - 1
    last = np.full(n, -1)
    last[block] = place  # the last one of a block stays
    short = np.flatnonzero(last < 62)

    # an entry for each block's first value, each other value that isn't zero, and each end of a block
    of = np.minimum(np.arange(n) % 3, 1)
    dc_code, dc_bits = codes(0)
    ac_code, ac_bits = codes(1)
    size = _sizes(first)
    ac_size = _sizes(value)
    symbol = (run % 16) << 4 | ac_size
    where = np.concatenate([np.arange(n) * 65, block * 65 + 1 + place, short * 65 + 64])
    code = np.concatenate([dc_code[of, size], ac_code[of[block], symbol], ac_code[of[short], END]])
    length = np.concatenate([dc_bits[of, size], ac_bits[of[block], symbol], ac_bits[of[short], END]])
    extra = np.concatenate([size, ac_size, np.zeros_like(short)])
    numbers = np.concatenate([first, value, np.zeros_like(short)])
    zeros = np.concatenate([np.zeros_like(first), run // 16, np.zeros_like(short)])
    numbers = np.where(numbers < 0, numbers + (1 << extra) - 1, numbers)

    order = np.argsort(where, kind="stable")
    code, length, zeros = ((code << extra) | numbers)[order], (length + extra)[order], zeros[order]
    owner = of[where[order] // 65]
    # sixteen zeros in a row are codes of their own, before the value's
    own = np.repeat(np.arange(len(code)), zeros + 1)
    is_value = np.zeros(len(own), bool)
    is_value[np.cumsum(zeros + 1) - 1] = True
    code = np.where(is_value, code[own], ac_code[owner[own], RUN_OF_16])
    length = np.where(is_value, length[own], ac_bits[owner[own], RUN_OF_16])

    # ones fill a line's last byte
    after = np.searchsorted(where[order][own] // 195, begin + many)
    total = np.diff(np.cumsum(length)[after - 1], prepend=0)
    fill = -total % 8
    code, length = np.insert(code, after, (1 << fill) - 1), np.insert(length, after, fill)

    ends = np.cumsum(length)
    down = np.repeat(ends, length) - np.arange(ends[-1]) - 1
    bits = (np.repeat(code, length) >> down & 1).astype(np.uint8)
    packed = np.packbits(bits).tobytes()
    to = np.cumsum(total + fill) // 8
    return [packed[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


def strips(every: list[np.ndarray], quality: int) -> list[bytes]:
    """Strips of lines of red, green and blue, worked on in pieces of about PIECE pixels, which are parts of a strip or many strips.

    Each 8 lines are followed by a restart marker, and a strip begins with marker 0.
    """
    coded: list[bytes] = []
    held, many, pixels = [], [], 0
    for own in every:
        width = own.shape[1]
        step = 8 * max(1, PIECE // (8 * width))
        for i in range(0, len(own), step):
            piece = own[i : i + step]
            held.append(_coefficients(piece, quality))
            many += [-(-width // 8)] * -(-len(piece) // 8)
            pixels += piece.shape[0] * width
            if pixels >= PIECE:
                coded += _bits(np.concatenate(held), np.array(many))
                held, many, pixels = [], [], 0
    if held:
        coded += _bits(np.concatenate(held), np.array(many))
    lines = iter(coded)
    return [b"".join(next(lines) + bytes([0xFF, 0xD0 + i % 8]) for i in range(-(-len(own) // 8))) for own in every]


def strip(lines: np.ndarray, quality: int) -> bytes:
    return strips([lines], quality)[0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def file(width: int, height: int, strips: list[bytes], quality: int) -> bytes:
    """Strips in their order, each but the last one of a multiple of 64 lines, as a file."""
    if max(width, height) > LARGEST:
        raise ValueError(f"a JPEG file has at most {LARGEST} lines and columns, not {width} x {height}")
    tables = b"".join(bytes([i, *own]) for i, own in enumerate(steps(quality).tolist()))
    huffman = b"".join(bytes([kind << 4 | of, *(AC_COUNTS if kind else DC_COUNTS)[of], *symbols(kind, of)]) for of in (0, 1) for kind in (0, 1))
    out = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, tables),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])),
        _segment(0xC4, huffman),
        _segment(0xDD, struct.pack(">H", -(-width // 8))),
        _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])),
    ]
    return b"".join([*out, *strips])[:-2] + b"\xff\xd9"  # the last marker is the end's
