"""A minimal PNG writer: RGB bytes, one filterless zlib stream."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode(image: np.ndarray) -> bytes:
    """image: rows x cols x 3 bytes."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows, cols, _ = image.shape
    lines = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(image))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
