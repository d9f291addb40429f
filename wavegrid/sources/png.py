"""PNG pictures as bytes, written and read with zlib only: 8-bit grey or RGB, all filters, text chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(picture: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    """PNG of a (rows, cols) or (rows, cols, 3) uint8 array with text chunks."""
    p = np.ascontiguousarray(picture, np.uint8)
    rows, cols = p.shape[:2]
    lines = np.concatenate((np.zeros((rows, 1), np.uint8), p.reshape(rows, -1)), axis=1)
    head = struct.pack(">IIBBBBB", cols, rows, 8, 2 if p.ndim == 3 else 0, 0, 0, 0)
    notes = b"".join(_chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (text or {}).items())
    return _MAGIC + _chunk(b"IHDR", head) + notes + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(content: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(picture, text chunks) of an 8-bit PNG without interlace; alpha is dropped, palettes are looked up."""
    if content[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, data, text, palette, head = 8, b"", {}, None, None
    while at < len(content):
        size, name = struct.unpack(">I", content[at : at + 4])[0], content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data += body
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tEXt":
            key, _, value = body.partition(b"\0")
            text[key.decode("latin-1")] = value.decode("latin-1")
    cols, rows, depth, kind, _, _, interlace = head
    width = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlace")
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, cols * width + 1)
    out = np.zeros((rows, cols * width), np.uint8)
    above = np.zeros(cols * width, np.int64)
    for y in range(rows):
        way, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if way == 2:
            line = line + above
        elif way in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - width] if x >= width else 0
                b, c = above[x], above[x - width] if x >= width else 0
                if way == 1:
                    guess = a
                elif way == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    picture = out.reshape(rows, cols, width)
    if kind == 3:
        picture = palette[picture[..., 0]]
    elif kind in (4, 6):
        picture = picture[..., :-1]
    return (picture[..., 0] if picture.shape[-1] == 1 else picture), text
