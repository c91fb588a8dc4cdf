"""PNG images in numpy: every chunk is checked, the lines' filters are undone, and what is cut or broken is an error.

Eight bits a channel, without interlacing: gray, colour, palette, each with or without opacity.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class BrokenImage(ValueError):
    pass


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise BrokenImage("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise BrokenImage("cut before the last chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BrokenImage(f"chunk {kind!r} is cut or does not fit its sum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _paeth(left: int, above: int, corner: int) -> int:
    p = left + above - corner
    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
    return left if a <= b and a <= c else above if b <= c else corner


def _undone(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """The line's bytes (uint8) before its filter; ``step`` bytes a pixel."""
    if kind == 0:
        return line
    if kind == 1:  # differences to the pixel before: running sums by channel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise BrokenImage(f"no filter {kind}")
    out, raw, up = bytearray(len(line)), line.tolist(), above.tolist()
    for i, v in enumerate(raw):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        out[i] = (v + ((left + up[i]) >> 1 if kind == 3 else _paeth(left, up[i], corner))) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The image as [height, width, channels] of uint8; palettes are looked up."""
    head, packed, palette = None, [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise BrokenImage("no header or no pixels")
    width, height, bits, colour, _, _, laced = head
    if bits != 8 or laced or colour not in CHANNELS or not width or not height:
        raise BrokenImage("only eight bits a channel without interlacing are read")
    step = CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise BrokenImage(str(e)) from None
    if len(raw) != height * (1 + width * step):
        raise BrokenImage("pixels are missing")
    lines = raw.reshape(height, 1 + width * step)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _undone(int(lines[y, 0]), lines[y, 1:], above, step)
    found = out.reshape(height, width, step)
    if colour == 3:
        if palette is None or found.max() >= len(palette):
            raise BrokenImage("a colour is not in the palette")
        found = palette[found[..., 0]]
    return found


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance in whole levels: of three channels or more by 0.299, 0.587 and 0.114, else the first."""
    if image.shape[2] < 3:
        return image[..., 0].astype(np.int64)
    r, g, b = (image[..., k].astype(np.int64) for k in range(3))
    return (299 * r + 587 * g + 114 * b + 500) // 1000


def encode(image: np.ndarray, filters: list[int]) -> bytes:
    """A PNG of [height, width, 1, 2, 3 or 4 channels]; line y has filter filters[y % len(filters)]."""
    height, width, step = image.shape
    lines, above = [], np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = filters[y % len(filters)], image[y].ravel().astype(np.int64)
        left = np.append(np.zeros(step, np.int64), line[:-step])
        corner = np.append(np.zeros(step, np.int64), above[:-step])
        guess = {0: 0 * line, 1: left, 2: above, 3: (left + above) >> 1}.get(kind)
        if guess is None:
            guess = np.array([_paeth(*t) for t in zip(left.tolist(), above.tolist(), corner.tolist(), strict=True)])
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[step]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
