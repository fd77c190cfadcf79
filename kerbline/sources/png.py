"""PNG images as arrays of bytes: every colour kind, depth and filter, interlaced or not; and plain writing.

A filtered pixel needs the ones to its left, above and in the corner between, so all pixels of one anti-diagonal can be
restored at once, whatever filters their rows have: an image takes width + height steps of array work.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row and the steps of the seven passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows that each begin with their filter's number; step: bytes from a pixel to the next."""
    kinds, raw = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("no such PNG filter")
    height, width = raw.shape[0], raw.shape[1] // step
    if not kinds.any():
        return raw
    if kinds.max() <= 2:  # nothing from the corner: whole rows at once
        out = raw.copy()
        for y, kind in enumerate(kinds):
            if kind == 1:
                out[y] = np.cumsum(raw[y].reshape(width, step), axis=0, dtype=np.uint8).ravel()
            elif kind == 2 and y:
                out[y] += out[y - 1]
        return out
    raw = raw.reshape(height, width, step)
    # skew[s + 2, y + 1] is pixel (x = s - y, y); everything outside the image stays 0
    skew = np.zeros((width + height + 1, height + 1, step), np.int16)
    kind = kinds[:, None]
    for s in range(width + height - 1):
        lo, hi = max(0, s - width + 1), min(height, s + 1)
        y = np.arange(lo, hi)
        left, up, corner, k = skew[s + 1, lo + 1 : hi + 1], skew[s + 1, lo:hi], skew[s, lo:hi], kind[lo:hi]
        guess = np.where(k == 1, left, 0)
        guess = np.where(k == 2, up, guess)
        guess = np.where(k == 3, (left + up) >> 1, guess)
        if (k == 4).any():
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where(k == 4, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)), guess)
        skew[s + 2, lo + 1 : hi + 1] = (raw[y, s - y] + guess) & 255
    y, x = np.mgrid[:height, :width]
    return skew[x + y + 2, y + 1].astype(np.uint8).reshape(height, width * step)


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """height x width x channels of whole rows of bytes; of 16-bit samples the high byte."""
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels; grey of few bits is spread over 0 to 255, palettes give their colours. ValueError if it is no PNG."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None or not body or head[3] not in CHANNELS:
        raise ValueError("not a whole PNG")
    width, height, depth, colour, _, _, interlaced = head
    channels = CHANNELS[colour]
    flat = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    out = np.zeros((height, width, channels), np.uint8)
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = max(0, -(-(width - x0) // dx)), max(0, -(-(height - y0) // dy))
        if not w or not h:
            continue
        line = (w * channels * depth + 7) // 8
        rows, flat = flat[: h * (line + 1)].reshape(h, line + 1), flat[h * (line + 1) :]
        out[y0::dy, x0::dx] = _samples(_unfiltered(rows, max(1, channels * depth // 8)), w, channels, depth)
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[out[..., 0]]
    return out * (255 // ((1 << depth) - 1)) if depth < 8 else out


def rgb(data: bytes) -> np.ndarray:
    """Height x width x 3, without transparency."""
    image = decode(data)
    return image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, axis=2)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray) -> bytes:
    """A PNG of a height x width x 3 array of bytes; rows are written as differences from the row above."""
    height, width = image.shape[:2]
    flat = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(flat, axis=0, prepend=np.zeros((1, flat.shape[1]), np.uint8))], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")
