"""Image bytes from rasters of packed colours: PNG (with alpha), BMP and animated GIF, by their public specifications."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def rgba(raster: np.ndarray) -> np.ndarray:
    """A height by width raster of packed colours as bytes r, g, b, a."""
    return np.ascontiguousarray(raster.astype(">u4")).view(np.uint8).reshape(*raster.shape, 4)


#: Lines of a PNG strip.
STRIP = 64
ADLER = 65521


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_strip(raster: np.ndarray, level: int = 6) -> tuple[bytes, int]:
    """Some lines of an 8-bit RGBA file as deflate blocks that stand for themselves, and the checksum of what they hold.

    Every line has filter 0. The blocks end at a byte and refer to nothing before them, so that strips can be compressed anywhere.
    """
    h, w = raster.shape
    lines = np.zeros((h, 1 + 4 * w), np.uint8)
    lines[:, 1:] = rgba(raster).reshape(h, 4 * w)
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    return deflate.compress(lines.tobytes()) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(lines.tobytes())


def joined_checksum(first: int, second: int, size: int) -> int:
    """The checksum of two pieces of data, the second ``size`` bytes long, from those of each."""
    a, b = first & 65535, first >> 16
    c, d = second & 65535, second >> 16
    return ((b + d + size * (a - 1)) % ADLER) << 16 | (a + c - 1) % ADLER


def png_file(width: int, height: int, strips: list[tuple[bytes, int]]) -> bytes:
    """A file without interlacing of strips of STRIP lines, the last one of what is left; each is a chunk of its own."""
    check, body = 1, []
    for i, (data, own) in enumerate(strips):
        check = joined_checksum(check, own, min(STRIP, height - i * STRIP) * (1 + 4 * width))
        body.append(_chunk(b"IDAT", (b"\x78\x9c" if i == 0 else b"") + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    end = _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", check))  # an empty last block
    return b"".join([b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", head), *body, end, _chunk(b"IEND", b"")])


def strip_raster(data: bytes, width: int, to_width: int, to_height: int) -> np.ndarray:
    """The pixels of a strip, with transparent ones on the right and below; of nothing, if there is no data."""
    lines = np.frombuffer(zlib.decompressobj(-15).decompress(data), np.uint8).reshape(-1, 1 + 4 * width)[:, 1:] if data else np.zeros((0, 0), np.uint8)
    raster = np.zeros((to_height, to_width), np.int64)
    raster[: len(lines), :width] = lines.reshape(-1).view(">u4").astype(np.int64).reshape(-1, width) if len(lines) else 0
    return raster


def png(raster: np.ndarray) -> bytes:
    return png_file(raster.shape[1], raster.shape[0], [png_strip(raster[i : i + STRIP]) for i in range(0, len(raster), STRIP)])


def bmp(raster: np.ndarray) -> bytes:
    """A 24-bit file, which has no alpha."""
    h, w = raster.shape
    lines = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    lines[:, : 3 * w] = rgba(raster)[::-1, :, 2::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def colour_table(frames: list[np.ndarray]) -> np.ndarray:
    """At most 255 opaque colours: those that occur, or, where there are more, the means of a median cut."""
    opaque = np.concatenate([f[(f & 255) >= 128] for f in frames])
    colours, counts = np.unique(opaque >> 8, return_counts=True)
    boxes = [np.arange(len(colours))] if len(colours) else []
    parts = np.stack([colours >> 16, colours >> 8 & 255, colours & 255], 1) if len(colours) else np.zeros((0, 3), np.int64)
    if len(colours) <= 255:
        return parts
    while len(boxes) < 255:
        spread = [np.ptp(parts[b], axis=0).max() if len(b) > 1 else -1 for b in boxes]
        box = boxes.pop(int(np.argmax(spread)))
        box = box[np.argsort(parts[box][:, np.ptp(parts[box], axis=0).argmax()], kind="stable")]
        middle = int(np.clip(np.searchsorted(np.cumsum(counts[box]), counts[box].sum() / 2), 1, len(box) - 1))
        boxes += [box[:middle], box[middle:]]
    return np.stack([np.rint(np.average(parts[b], axis=0, weights=counts[b])).astype(np.int64) for b in boxes])


def _codes(indices: bytes, bits: int) -> bytes:
    """Variable-length LZW codes, low bits first, in blocks of at most 255 bytes."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, width, held, n, out = {}, bits + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    following, prefix = end + 1, None
    for i in indices:
        if prefix is None:
            prefix = i
        elif (longer := table.get((prefix, i))) is not None:
            prefix = longer
        else:
            put(prefix)
            if following < 4096:
                table[prefix, i] = following
                width = max(width, following.bit_length())
                following += 1
            else:
                put(clear)
                table, following, width = {}, end + 1, bits + 1
            prefix = i
    if prefix is not None:
        put(prefix)
        # the reader adds one more entry on this code, which can widen the next one
        width = max(width, min(following, 4095).bit_length())
    put(end)
    if n:
        out.append(held & 255)
    return b"".join(bytes([len(out[k : k + 255])]) + bytes(out[k : k + 255]) for k in range(0, len(out), 255)) + b"\0"


def gif(frames: list[np.ndarray], delay_ms: int) -> bytes:
    """An animation without end; index 0 is transparent (alpha below 128), each frame replaces the one before."""
    h, w = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    table = colour_table(frames)
    bits = max(2, int(len(table)).bit_length())
    colours = np.zeros((1 << bits, 3), np.uint8)
    colours[1 : len(table) + 1] = table
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF0 | (bits - 1), 0, 0), colours.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for frame in frames:
        seen, place = np.unique(frame, return_inverse=True)
        parts = np.stack([seen >> 24 & 255, seen >> 16 & 255, seen >> 8 & 255], 1)
        nearest = ((parts[:, None] - table[None]) ** 2).sum(2).argmin(1) + 1 if len(table) else np.zeros(len(seen), np.int64)
        index = np.where((seen & 255) < 128, 0, nearest)[place].astype(np.uint8)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0x09, delay_ms // 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, frame.shape[1], frame.shape[0], 0), bytes([bits]), _codes(index.tobytes(), bits)]
    return b"".join(out) + b"\x3b"
