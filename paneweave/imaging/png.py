"""PNG bytes to arrays and back, with zlib only; encoding makes 8 bits without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGN = b"\x89PNG\r\n\x1a\n"
#: x, y and steps of the passes of interlaced images
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def encode(image: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array of bytes."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + image[0].size if height else 1), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return _SIGN + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Colour (h, w, 3) array of bytes; alpha is left out, samples of 16 bits are rounded."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG image")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] not in (1, 2, 4, 8, 16) or head[6] > 1:
        raise ValueError("no PNG header that is known")
    width, height, depth, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    if head[6]:
        image, at = np.zeros((height, width, channels), np.uint16), 0
        for x, y, dx, dy in _PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                size = h * (1 + -(-w * channels * depth // 8))
                image[y::dy, x::dx] = _samples(raw[at : at + size], w, h, channels, depth)
                at += size
    else:
        image = _samples(raw, width, height, channels, depth)
    if color == 3:
        return palette[image[:, :, 0]]
    if depth == 16:
        image = (image.astype(np.uint32) + 128) // 257
    elif depth < 8:
        image = image * (255 // ((1 << depth) - 1))
    image = image.astype(np.uint8)
    return np.repeat(image[:, :, :1], 3, 2) if channels < 3 else image[:, :, :3]


def _samples(data: np.ndarray, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """The samples (h, w, channels) of filtered rows."""
    wide, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    raw = data.reshape(height, 1 + wide)
    out = _unfiltered(raw[:, 0], raw[:, 1:], step)
    if depth == 16:
        out = out.view(">u2").astype(np.uint16)
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        out = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : width * channels]
    return out.reshape(height, width, channels)


#: Rows that are unfiltered together.
_BAND = 1024


def _unfiltered(how: np.ndarray, data: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``step`` is the distance of a byte's left neighbour.

    A byte depends on its neighbours to the left and above, so all bytes of a diagonal are made at once.
    Rows that depend on one side only are sums along it.
    """
    height, wide = data.shape
    if how.max(initial=0) > 4:
        raise ValueError("no PNG filter that is known")
    out = np.zeros((height, wide), np.uint8)
    if not (how > 2).any():
        above = np.zeros(wide, np.uint8)
        for y in range(height):
            line = data[y]
            out[y] = above = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel() if how[y] == 1 else line + above if how[y] == 2 else line
        return out
    pixels = wide // step
    for top in range(0, height, _BAND):
        rows = min(_BAND, height - top)
        kind = how[top : top + rows, None]
        left_only, above_only, mean, near = (kind == k for k in range(1, 5))
        band = data[top : top + rows].reshape(rows, pixels, step)
        # made[d + 2, y + 1] is the byte at (y, d - y); a row of zeros or the band's upper neighbour stands above
        made = np.zeros((pixels + rows + 1, rows + 1, step), np.int16)
        if top:
            made[1 : pixels + 1, 0] = out[top - 1].reshape(pixels, step)
        for d in range(pixels + rows - 1):
            ys = slice(max(0, d - pixels + 1), min(rows, d + 1))
            y = np.arange(ys.start, ys.stop)
            left = made[d + 1, ys.start + 1 : ys.stop + 1]
            above, corner = made[d + 1, ys], made[d, ys]
            to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
            guess = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
            guess = left_only[ys] * left + above_only[ys] * above + mean[ys] * ((left + above) >> 1) + near[ys] * guess
            made[d + 2, ys.start + 1 : ys.stop + 1] = (band[y, d - y] + guess) & 255
        y = np.arange(rows)[:, None]
        out[top : top + rows] = made[y + np.arange(pixels) + 2, y + 1].reshape(rows, wide)
    return out


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Luma with integer weights of ITU-R BT.709."""
    r, g, b = (rgb[:, :, i].astype(np.uint32) for i in range(3))
    return ((2126 * r + 7152 * g + 722 * b) // 10000).astype(np.uint8)
