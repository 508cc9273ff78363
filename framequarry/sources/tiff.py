"""Uncompressed grey TIFF files of 8 or 16 bits, read and written bit by bit (Spark's image reader cuts to 8 bits)."""

from __future__ import annotations

import struct

import numpy as np

_SIZES = {1: "B", 3: "H", 4: "I"}


def decode(raw: bytes) -> np.ndarray:
    """Height x width, uint8 or uint16. Compressed, coloured or tiled files are refused."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _SIZES:
            continue
        code = f"{order}{n}{_SIZES[kind]}"
        size = struct.calcsize(code)
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[tag] = struct.unpack(code, raw[place : place + size])
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (1,))
    if tags.get(259, (1,))[0] != 1 or len(bits) != 1 or bits[0] not in (8, 16) or 273 not in tags:
        raise ValueError("only uncompressed grey strips of 8 or 16 bits are read")
    need = width * height * bits[0] // 8
    counts = tags.get(279, (need,))
    data = b"".join(raw[o : o + c] for o, c in zip(tags[273], counts, strict=True))
    if len(data) < need:
        raise ValueError("the file is cut short")
    a = np.frombuffer(data[:need], np.uint8 if bits[0] == 8 else order + "u2").reshape(height, width)
    return a.astype(a.dtype.newbyteorder("="))


def encode(image: np.ndarray) -> bytes:
    """One strip, little-endian."""
    if image.ndim != 2 or image.dtype not in (np.uint8, np.uint16):
        raise ValueError("a grey image of uint8 or uint16 is needed")
    data = image.astype("<u2" if image.dtype == np.uint16 else np.uint8).tobytes()
    height, width = image.shape
    tags = [(256, 4, width), (257, 4, height), (258, 3, image.dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data))]
    pad = b"\0" * (len(data) % 2)
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(data) + len(pad)) + data + pad + table
