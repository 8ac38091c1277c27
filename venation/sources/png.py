"""PNG files: written as 8-bit grey, colour, and colour with alpha; read in every kind but interlaced ones."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
KINDS = {1: 0, 2: 4, 3: 2, 4: 6}  # channels -> colour type of the format


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    rows = np.zeros((h, 1 + w * c), np.uint8)  # a filter byte of 0 before each row
    rows[:, 1:] = image.reshape(h, -1)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, KINDS[c], 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(mode: int, line: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    """One row's bytes, c of them a pixel, from what its filter left."""
    if mode == 0:
        return line
    if mode == 2:
        return line + above
    if mode == 1:  # each byte adds to the pixel before: sums modulo 256
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
    # the other two need each pixel before the next
    rest, up = line.reshape(-1, c).astype(int).tolist(), above.reshape(-1, c).astype(int).tolist()
    a, d, out = [0] * c, [0] * c, bytearray()
    for x, b in zip(rest, up):
        if mode == 3:
            a = [(v + (p + q) // 2) & 255 for v, p, q in zip(x, a, b)]
        else:
            a = [(v + _nearest_of(p, q, r)) & 255 for v, p, q, r in zip(x, a, b, d)]
            d = b
        out += bytes(a)
    return np.frombuffer(bytes(out), np.uint8)


def _nearest_of(a: int, b: int, c: int) -> int:
    """Which of left, above and above left is nearest to left + above - above left; in that order if equally near."""
    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if p <= q and p <= r else b if q <= r else c


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels of 8 bits. Palettes become colours, depths of 1, 2 and 4 grey levels of 8 bits, and 16 bits their upper 8. Interlaced files are refused."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, packed, palette, clear, head = 8, b"", None, None, None
    while at + 8 <= len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, depth, kind, _, _, interlace = head
    if interlace or kind not in (3, *KINDS.values()):
        raise ValueError("only pictures without interlacing")
    c = 1 if kind == 3 else {v: k for k, v in KINDS.items()}[kind]
    width, step = -(-w * c * depth // 8), max(1, c * depth // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    if len(raw) != h * (1 + width):
        raise ValueError("a PNG of the wrong length")
    raw = raw.reshape(h, 1 + width)
    out = np.zeros((h, width), np.uint8)
    for y in range(h):
        out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], out[y - 1] if y else np.zeros(width, np.uint8), step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        out = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)
        if kind == 0:
            out = out * np.uint8(255 // (2**depth - 1))
    out = out.reshape(h, w, c)
    if kind == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a PNG with too small a palette")
        colours = palette[out[..., 0]]
        if clear is None:
            return colours
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = clear
        return np.dstack([colours, alpha[out[..., 0]]])
    return out


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the weights of colours in brightness, to the nearest."""
    if image.shape[2] == 1:
        return image
    # Shares of red, green and blue.
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)[..., None]
