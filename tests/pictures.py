"""Small encoded pictures for the tests."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """PNG of ``(height, width)`` grey, ``(height, width, 3)`` colour or ``(…, 4)`` colour with alpha."""
    kind = {2: 0, 3: 2, 4: 6}[pixels.ndim if pixels.ndim == 2 else pixels.shape[2]]
    height, width = pixels.shape[:2]
    raw = b"".join(b"\0" + np.ascontiguousarray(row, dtype=np.uint8).tobytes() for row in pixels)

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def gif(width: int, height: int) -> bytes:
    return b"GIF89a" + struct.pack("<HH", width, height) + b"\0" * 120


def jpeg(width: int, height: int, marker: int = 0xC0) -> bytes:
    app = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9
    frame = bytes([0xFF, marker]) + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 8
    return b"\xff\xd8" + app + b"\xff\xff\xdb" + struct.pack(">H", 67) + b"\0" * 65 + frame + b"\0" * 100


def webp(kind: bytes, width: int, height: int) -> bytes:
    if kind == b"VP8 ":
        body = b"\0" * 10 + struct.pack("<HH", width, height | 0x4000)
    elif kind == b"VP8L":
        body = b"\0\0\0\0\x2f" + struct.pack("<I", (width - 1) | ((height - 1) << 14))
    else:
        body = b"\0" * 8 + struct.pack("<I", width - 1)[:3] + struct.pack("<I", height - 1)[:3]
    return b"RIFF\0\0\0\0WEBP" + kind + body + b"\0" * 100
